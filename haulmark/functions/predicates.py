"""Boolean expression trees.

A tree is a boolean, a text (a yes/no word or a Spark SQL expression), a list (all must hold) or a
mapping with ``or`` / ``and`` lists, whose keys must all hold.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F

from .literals import FALSE_WORDS, TRUE_WORDS


def _word(text: str) -> bool | None:
    word = text.strip().lower()
    return True if word in TRUE_WORDS else False if word in FALSE_WORDS else None


def _entries(tree: dict[str, Any]):
    for key, value in tree.items():
        if key not in ("or", "and"):
            raise ValueError(f"unknown key {key!r} in a boolean tree; use 'or' and 'and'")
        yield key, list(value) if isinstance(value, (list, tuple)) else [value]


def predicate_tree(tree: Any) -> Column:
    """The tree as one boolean column."""
    if isinstance(tree, Column):
        return tree
    if isinstance(tree, bool):
        return F.lit(tree)
    if isinstance(tree, str):
        word = _word(tree)
        return F.expr(tree) if word is None else F.lit(word)
    if isinstance(tree, (list, tuple)):
        return reduce(lambda a, b: a & b, map(predicate_tree, tree), F.lit(True))
    if isinstance(tree, dict):
        parts = [reduce((lambda a, b: a | b) if key == "or" else (lambda a, b: a & b),
                        map(predicate_tree, items), F.lit(key == "and")) for key, items in _entries(tree)]
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    raise ValueError(f"not a boolean tree: {tree!r}")


def predicate_text(tree: Any) -> str:
    """The tree as text: ``(a) and (b)``."""
    if isinstance(tree, bool):
        return str(tree).lower()
    if isinstance(tree, str):
        word = _word(tree)
        return tree if word is None else str(word).lower()
    if isinstance(tree, (list, tuple)):
        return " and ".join(f"({predicate_text(x)})" for x in tree)
    if isinstance(tree, dict):
        parts = [f" {key} ".join(f"({predicate_text(x)})" for x in items) for key, items in _entries(tree)]
        return " and ".join(f"({p})" for p in parts)
    raise ValueError(f"not a boolean tree: {tree!r}")
