"""Encoding with a public byte-level BPE file through the tokenizers library.

The library's pre-tokenizer starts a new piece at every single space that stands between two characters that are not
white space, whatever surrounds them: no alternative of its pattern crosses such a space, and one of ` ?\\p{L}+`,
` ?\\p{N}+`, ` ?[^\\s\\p{L}\\p{N}]+` begins there. BPE never merges across pieces. So a text may be cut at these
spaces, and each cut ("unit") be encoded once and remembered, without changing any id. Special strings are matched by the
library before all this, so texts are first cut at them. A text, or a new unit, of plain Latin letters, digits, marks, spaces
and line ends is cut into the pre-tokenizer's pieces here, and a new piece goes to the library's model; any other unit goes whole. Files with another pre-tokenizer, a normaliser, or special
tokens that swallow white space are encoded whole, always.
"""

from __future__ import annotations

import json
import os
import re

from tokenizers import Tokenizer

_STABLE = re.compile(r"(?<=\S) (?=\S)")
# The pre-tokenizer's pattern over units of these characters, whose classes no Unicode version changes.
_SIMPLE = re.compile(r"[\n!-~À-ÖØ-öø-ſ]+")
_PLAIN = re.compile(r"[\n -~À-ÖØ-öø-ſ]+")
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ſ0-9]+|\s+(?!\S)|\s+")
# The model reads bytes as printable characters: those that are printable as themselves, the others from 256 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
BLANK, _LINE = chr(_BYTES[32]), chr(_BYTES[10])
UNITS = 1_000_000
LONG_UNIT = 64


def stable_at(text: str, at: int) -> bool:
    """Whether a piece starts at ``at`` whatever else the text holds."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if os.sep in name else public_tokenizers.path(name)


class Remembered(dict):
    """Key -> value, at most ``limit`` of them. When half as many are new, those not asked for since the half before go."""

    def __init__(self, limit: int):
        super().__init__()
        self.half, self.older = max(1, limit // 2), {}

    def remember(self, key, value) -> None:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value


class Units(Remembered):
    """Unit -> ``value`` of its ids behind a lead, found at first sight; remembers up to ``UNITS`` units that are not long."""

    def __init__(self, encoder: "Encoder", lead: str):
        super().__init__(UNITS)
        self.encoder, self.lead = encoder, lead

    def __missing__(self, unit: str):
        value = self.older.get(unit)
        if value is None:
            value = self.encoder.unit_value(self.lead, unit)
        if len(unit) <= LONG_UNIT:
            self.remember(unit, value)
        return value


class Pieces(Remembered):
    """Piece of the pre-tokenizer -> ``value`` of its ids by the model alone; remembered as units are."""

    def __init__(self, encoder: "Encoder"):
        super().__init__(UNITS)
        self.encoder = encoder

    def __missing__(self, piece: str):
        value = self.older.get(piece)
        if value is None:
            value = self.encoder._model_value(piece)
        if len(piece) <= LONG_UNIT:
            self.remember(piece, value)
        return value


class Encoder:
    """``value`` of the ids of texts: their number, or packed bytes."""

    _made: dict[tuple, "Encoder"] = {}

    def __init__(self, path: str, value=len):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added)
        post = spec.get("post_processor") or {"type": "ByteLevel"}
        self.by_unit = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                        and not spec.get("normalizer") and post.get("type") == "ByteLevel" and plain
                        and spec.get("model", {}).get("type") == "BPE")
        self.special = {a["content"]: a["id"] for a in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.value, self.spaced, self.bare, self.pieces = value, Units(self, " "), Units(self, ""), Pieces(self)
        self.joined = sum if value is len else b"".join

    @classmethod
    def of(cls, path: str, value=len) -> "Encoder":
        """One encoder per worker process, kept across its tasks."""
        key = (path, value.__name__)
        if key not in cls._made:
            cls._made[key] = cls(path, value)
        return cls._made[key]

    def encode(self, texts: list[str]):
        return self.lib.encode_batch(texts, add_special_tokens=False)

    def _model_value(self, piece: str):
        """``value`` of one piece of the pre-tokenizer made of ``_SIMPLE`` characters, by the model alone."""
        if piece.isascii():  # below 128 only these two do not stand for themselves
            shown = piece.replace(" ", BLANK).replace("\n", _LINE)
        else:
            shown = piece.encode().decode("latin-1").translate(_BYTES)
        return self.value([t.id for t in self.lib.model.tokenize(shown)])

    def bytes_value(self, raw: bytes):
        """``value`` of bytes that are no text, by the model alone."""
        return self.value([t.id for t in self.lib.model.tokenize(raw.decode("latin-1").translate(_BYTES))])

    def unit_value(self, lead: str, unit: str):
        """``value`` of the ids of a unit behind its lead, from its pieces where they are known to be those of the library."""
        if unit.isalpha() and (unit.isascii() or _SIMPLE.fullmatch(unit)):
            return self._model_value(lead + unit)
        if not _SIMPLE.fullmatch(unit) or "\n\n" in unit:
            return self.value(self.lib.encode(lead + unit, add_special_tokens=False).ids)
        found = _PIECE.findall(lead + unit)
        if len(found) == 1:
            return self._model_value(found[0])
        return self.joined(list(map(self.pieces.__getitem__, found)))

    def plain_values(self, text: str) -> list | None:
        """``value`` of the ids of each piece of a text of ``_PLAIN`` characters, whose special strings are not told apart; of other texts None."""
        return list(map(self.pieces.__getitem__, _PIECE.findall(text))) if _PLAIN.fullmatch(text) else None

    def _segment(self, text: str) -> list:
        if (found := self.plain_values(text)) is not None:
            return found
        flat = text.replace("\n", " ")
        # All white space but the space is unprintable, so here it is single spaces and line ends.
        single = "  " not in flat and flat[0] != " " and flat[-1] != " " and flat.isprintable()
        units = text.split(" ") if single else _STABLE.split(text)
        return [*map(self.bare.__getitem__, units[:1]), *map(self.spaced.__getitem__, units[1:])]

    def word_values(self, words: list[str]) -> list:
        """``value`` of the ids of each word behind a space, whatever the words hold."""
        return list(map(self.spaced.__getitem__, words))

    def values(self, text: str) -> list:
        """``value`` of the ids of consecutive stretches of the text."""
        if not text:
            return []
        if not self.by_unit:
            return [self.value(self.encode([text])[0].ids)]
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(self.value([self.special[part]]))
            elif part:
                out.extend(self._segment(part))
        return out
