"""The attention model of ``lm`` as ONNX graphs for onnxruntime, whose exponentials and products of few columns are faster than numpy's.

They compute what ``lm.gradients`` and ``lm.log_probabilities`` do, for values whose exponentials stay in the range of floats; for others
the callers keep to numpy. Models are protocol buffers, written here by the public field numbers of the format.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np

FLOAT, INT64 = 1, 7


def _number(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _int(field: int, n: int) -> bytes:
    return _number(field << 3) + _number(n)


def _part(field: int, body: bytes | str) -> bytes:
    body = body.encode() if isinstance(body, str) else body
    return _number(field << 3 | 2) + _number(len(body)) + body


def _attribute(name: str, value) -> bytes:
    if isinstance(value, int):
        kind = _int(3, value) + _int(20, 2)
    elif isinstance(value, str):
        kind = _part(4, value) + _int(20, 3)
    else:
        kind = b"".join(_int(8, x) for x in value) + _int(20, 7)
    return _part(5, _part(1, name) + kind)


class Graph:
    """Nodes in order; ``bytes`` of the model file."""

    def __init__(self, name: str, inputs: dict[str, int], outputs: Sequence[str]):
        self.made, self.nodes, self.constants = 0, [], []
        ends = [_part(11, _part(1, n) + _part(2, _part(1, _int(1, kind)))) for n, kind in inputs.items()]
        self.ends = [_part(2, name), *ends, *(_part(12, _part(1, n) + _part(2, _part(1, _int(1, FLOAT)))) for n in outputs)]

    def __call__(self, op: str, *inputs: str, to: str | None = None, many: int = 1, domain: str = "", **attributes):
        self.made += 1
        names = [to or f"{op}{self.made}.{i}" for i in range(many)]
        self.nodes.append(_part(1, b"".join(_part(1, n) for n in inputs) + b"".join(_part(2, n) for n in names) + _part(4, op)
                                + b"".join(_attribute(k, v) for k, v in attributes.items()) + _part(7, domain)))
        return names if many > 1 else names[0]

    def product(self, x: str, y: str, to: str | None = None, left: int = 0, right: int = 0) -> str:
        """A product of matrices, transposed first where ``left`` or ``right`` is set."""
        if not left and not right:
            return self("MatMul", x, y, to=to)
        return self("FusedMatMul", x, y, to=to, domain="com.microsoft", transA=left, transB=right)

    def constant(self, value: np.ndarray) -> str:
        name = f"constant{len(self.constants)}"
        kind = {"f": FLOAT, "i": INT64}[value.dtype.kind]
        self.constants.append(_part(5, b"".join(_int(1, n) for n in value.shape) + _int(2, kind) + _part(8, name) + _part(9, value.tobytes())))
        return name

    def file(self) -> bytes:
        return (_int(1, 8) + _part(8, _part(1, "") + _int(2, 17)) + _part(8, _part(1, "com.microsoft") + _int(2, 1))
                + _part(7, b"".join(self.nodes + self.constants + self.ends)))

    def session(self):
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        options.log_severity_level = 3
        return onnxruntime.InferenceSession(self.file(), options, providers=["CPUExecutionProvider"])


def _axis(g: Graph, n: int) -> str:
    return g.constant(np.array([n], np.int64))


def _attended(g: Graph, width: int) -> tuple[str, ...]:
    """Queries, keys, values, weights, their sums, the values' mean, and what goes outward, of windows.

    Behind the values stands a one, so that the product with them sums the weights too; both are zero where nothing stands.
    """
    q, k = g("Gather", "queries", "near"), g("Gather", "keys", "rows")
    v, e = g("Gather", "values", "rows"), g("Gather", "e", "near")
    s = g("Exp", g("Add", g.product(q, k, right=1), "bias"))
    out, total = g("Split", g.product(s, v), g.constant(np.array([width, 1], np.int64)), many=2, axis=-1)
    seen = g("Div", out, total)
    return q, k, v, s, total, seen, g("Concat", g("Add", seen, e), "ones", axis=-1)


def scores_graph(width: int) -> Graph:
    """``each``: log probability of each id's class, of windows [window, 2 * half] whose second half is ``near``."""
    g = Graph("scores", {n: FLOAT for n in ("keys", "queries", "values", "e", "bias", "outward", "ones")}
              | {n: INT64 for n in ("rows", "near", "classes")}, ["each"])
    logits = g.product(_attended(g, width)[-1], "outward")
    picked = g("GatherElements", logits, "classes", axis=2)
    g("Sub", picked, g("Log", g("ReduceSum", g("Exp", logits), _axis(g, -1))), to="each")
    return g


RANGES = ("least_total", "most_total", "least_sum", "most_sum")
GRADIENTS = ("d_e", "d_q", "d_k", "d_v", "d_bias", "d_outward", *RANGES)


def gradients_graph(width: int, classes: int) -> Graph:
    """Gradients of the mean cross entropy, and the least and greatest sums of exponentials.

    ``e`` has the rows that are read, as ``zeros`` and ``there``: zero for the one that stands for nothing, which is zero in ``e`` too.
    """
    g = Graph("gradients", {n: FLOAT for n in ("e", "there", "zeros", "q", "k", "v", "bias", "outward", "o", "weight", "ones")}
              | {n: INT64 for n in ("rows", "near", "classes")}, GRADIENTS)
    last = _axis(g, -1)
    flat = lambda x, n: g("Reshape", x, g.constant(np.array([-1, n], np.int64)))
    g.product("e", "q", to="queries")
    g.product("e", "k", to="keys")
    g("Concat", g.product("e", "v"), "there", to="values", axis=-1)
    q, k, v, s, total, seen, h = _attended(g, width)
    x = g("Exp", g.product(h, "outward"))
    sums = g("ReduceSum", x, last)
    x = g("ScatterElements", g("Mul", x, g("Div", "weight", sums)), "classes", g("Neg", "weight"), axis=2, reduction="add")
    g.product(flat(h, width + 1), flat(x, classes), to="d_outward", left=1)
    d_h = g.product(x, "o", right=1)
    back = g("Div", d_h, total)
    ends = g("Neg", g("ReduceSum", g("Mul", back, seen), last))
    d_s = g("Mul", g.product(g("Concat", back, ends, axis=-1), v, right=1), s)
    g("ReduceSum", d_s, _axis(g, 0), to="d_bias", keepdims=0)
    at_rows, at_near = g("Unsqueeze", "rows", last), g("Unsqueeze", "near", last)
    met = lambda at, x: g("ScatterND", "zeros", at, x, reduction="add")
    found = {"q": met(at_near, g.product(d_s, k)), "k": met(at_rows, g.product(d_s, q, left=1)), "v": met(at_rows, g.product(s, back, left=1))}
    d_e = met(at_near, d_h)
    for n, x in found.items():
        g.product("e", x, to="d_" + n, left=1)
        d_e = g("Add", d_e, g.product(x, n, right=1), to="d_e" if n == "v" else None)
    for name, x in zip(RANGES, (total, total, sums, sums)):
        g("ReduceMin" if name.startswith("least") else "ReduceMax", x, to=name, keepdims=0)
    return g


@functools.cache
def scores(width: int):
    """A session a process, as ``gradients``."""
    return scores_graph(width).session()


@functools.cache
def gradients(width: int, classes: int):
    return gradients_graph(width, classes).session()
