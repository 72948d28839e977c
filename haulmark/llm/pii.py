"""Personal data by offset-preserving deobfuscation.

A chain of small transducers rewrites a text and remembers for every stretch where it came from:

1. characters: homoglyphs and compatibility forms (fullwidth, mathematical letters and digits) become ASCII, invisible
   characters go;
2. spelled digits ("five five two", also German, French and Spanish; "plus" before them) become digits;
3. disguises of ``@`` and ``.`` ("name [at] host (dot) org", "name at host dot org") become the characters.

The detectors run on the source text (the base spans) and on the rewritten one. A span found there is mapped back to
source characters; it is added if something inside it was rewritten and it overlaps no base span. Offsets are code
points, ends exclusive.

A null text counts as empty and has no spans. Each row is searched alone, whole; the time is in proportion to the
text's length, also for very long words or runs of digits. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, raw_text
from .registry import query, table

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}")  # only from the start of a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]


def _emails(text: str):
    """Leftmost matches of the address pattern, found from each ``@`` so that long words cost no more than once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def find_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    out = [(s, e, 0) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


# Letters of other scripts (Cyrillic, Greek, Latin without ASCII form) that look like an ASCII letter.
_LOOKS = {
    "a": "аɑα", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "јϳ", "k": "кκ", "l": "ӏ",
    "m": "м", "n": "п", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "ѵν", "w": "ԝѡ",
    "x": "хχ", "y": "уγ", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ",
    "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
_LOOKALIKE = {ord(c): plain for plain, others in _LOOKS.items() for c in others}
# Characters without width, which break up words unseen.
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Spelled digits 0 to 9 in English, German, French and Spanish.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_ODD = re.compile(f"[{_INVISIBLE}{''.join(map(chr, _LOOKALIKE))}①-⒛⁰-ₜ！-～\U0001d400-\U0001d7ff]+")
_WORDS = "|".join(sorted(_SPELLED, key=len, reverse=True))
_FIRST = "".join(sorted({w[0] for w in _SPELLED}))
# Two spelled digits in a row, or one beside a digit, so that single number words of prose stay.
# Whatever matches begins with a number word as a whole, which the first look ahead finds at less cost.
_SPOKEN = re.compile(rf"(?<!\w)(?=[{_FIRST}]\w{{1,6}}(?!\w))(?=(?:{_WORDS})(?!\w))(?:(?:{_WORDS})(?:[ ,-]{{1,2}}(?:{_WORDS}))+|(?<=[0-9][ .-])(?:{_WORDS})|(?:{_WORDS})(?=[ .-][0-9])"
                     rf"|(?<=dot )(?:{_WORDS})|(?:{_WORDS})(?= dot ))(?!\w)", re.I)
_SPOKEN_WORD = re.compile(rf"{_WORDS}", re.I)
_CASELESS = {0x130: "i", 0x131: "i", 0x17F: "s"}  # letters that patterns without case take for these
_PLUS = re.compile(r"(?<!\w)(?:plus|más) (?=[0-9(])", re.I)
_NAME = r"[A-Za-z0-9._%+-]{1,64}"
_LABEL = r"[A-Za-z0-9-]{1,63}"
_DOT_WORD = r"(?:dot|punkt|point|punto)"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
# Between brackets, or set off by marks, the words stand for the characters anywhere.
_AT_MARKED = re.compile(rf" ?(?:{_OPEN} ?(?:at|@|arroba) ?{_CLOSE}|(?<=[ A-Za-z0-9])[_*~|] ?(?:at|@) ?[_*~|]) ?", re.I)
_DOT_MARKED = re.compile(rf" ?(?:{_OPEN} ?(?:{_DOT_WORD}|\.) ?{_CLOSE}|(?<=[ A-Za-z0-9])[_*~|] ?(?:dot|\.) ?[_*~|]) ?", re.I)
# Bare words do only as a whole address or number: name at label dot label, or four numbers with dots.
_BARE = re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<name>{_NAME}(?: {_DOT_WORD} {_NAME}){{0,4}})(?P<at> at | arroba | ?@ ?)"
                   rf"(?P<host>{_LABEL}(?:(?: {_DOT_WORD} | \. |\.){_LABEL}){{1,6}})(?![A-Za-z0-9-])", re.I)
# Final labels that make "name at host.label" an address although its dots are plain.
_FINAL = re.compile(r"\.(?:com|org|net|edu|gov|mil|info|biz|io|dev|app|me|co|uk|de|fr|es|eu|us|example|test)$", re.I)
_NUMBERS = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?: {_DOT_WORD} | ?\. ?)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_DOT_BARE = re.compile(rf" (?:{_DOT_WORD}|\.) ", re.I)
# What every match of a pattern holds, so a text without it is left as it is; each begins with a rare character.
_MAY_BE_ODD = re.compile(r"[^\x00-\x7f]")
_MAY_BE_AT = re.compile(r"[\[({<_*~|] ?(?:at|@|arroba)", re.I)
_MAY_BE_DOT = re.compile(rf"[\[({{<_*~|] ?(?:{_DOT_WORD}|\.)", re.I)
_MAY_BE_BARE = re.compile(rf"[ @](?:(?<= )(?:at|arroba) |(?<=@) ?){_LABEL}(?: {_DOT_WORD} | \. |\.)[a-z0-9-]", re.I)


class Mapped:
    """A rewritten text whose every position knows its place in the source.

    The text is a row of stretches; ``new`` holds where each starts here, ``old`` its source range, ``same`` whether it
    was copied.
    """

    def __init__(self, text: str):
        self.text, self.new, self.old, self.same = text, [0], [(0, len(text))], [True]

    def rewrite(self, pattern: re.Pattern, put) -> "Mapped":
        """Replace each match by ``put(match)``; None leaves it."""
        out, parts, at, done, size = Mapped(""), [], 0, 0, 0
        out.new, out.old, out.same = [], [], []

        def copy(start: int, end: int) -> None:
            nonlocal size
            while start < end:
                k = bisect_right(self.new, start) - 1
                stop = min(end, self.new[k + 1] if k + 1 < len(self.new) else len(self.text))
                if self.same[k]:
                    o = self.old[k][0] + start - self.new[k]
                    add(stop - start, (o, o + stop - start), True)
                else:
                    add(stop - start, self.old[k], False)
                start = stop

        def add(length: int, source: tuple[int, int], same: bool) -> None:
            nonlocal size
            out.new.append(size)
            out.old.append(source)
            out.same.append(same)
            size += length

        for m in pattern.finditer(self.text):
            text = put(m)
            if text is None or text == m[0]:
                continue
            copy(done, m.start())
            parts += [self.text[done:m.start()], text]
            if text:
                add(len(text), self.source(m.start(), m.end())[:2], False)
            done = m.end()
        if not done:
            return self
        copy(done, len(self.text))
        out.text = "".join([*parts, self.text[done:]])
        return out

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source range of [start, end), and whether anything in it was rewritten or left out."""
        i, j = bisect_right(self.new, start) - 1, bisect_right(self.new, end - 1) - 1
        a = self.old[i][0] + (start - self.new[i] if self.same[i] else 0)
        b = self.old[j][0] + end - self.new[j] if self.same[j] else self.old[j][1]
        return a, b, not all(self.same[i:j + 1]) or b - a != end - start


def _plain(m: re.Match) -> str:
    text = unicodedata.normalize("NFKC", m[0].translate(dict.fromkeys(map(ord, _INVISIBLE)))).translate(_LOOKALIKE)
    return text if text.isascii() else m[0]


def _digits(m: re.Match) -> str:
    return "".join(_SPELLED[w.translate(_CASELESS).lower()] for w in _SPOKEN_WORD.findall(m[0]))


def _address(m: re.Match) -> str | None:
    host = _DOT_BARE.sub(".", m["host"])
    spoken = host != m["host"] or _DOT_BARE.search(m["name"])
    if not spoken and not _FINAL.search(host):
        return None
    return f"{_DOT_BARE.sub('.', m['name'])}@{host}"


_STEPS = ((_MAY_BE_ODD, _ODD, _plain), (None, _SPOKEN, _digits), (None, _PLUS, lambda m: "+"),
          (_MAY_BE_AT, _AT_MARKED, lambda m: "@"), (_MAY_BE_DOT, _DOT_MARKED, lambda m: "."),
          (None, _NUMBERS, lambda m: re.sub(rf" {_DOT_WORD} | ?\. ?", ".", m[0], flags=re.I)), (_MAY_BE_BARE, _BARE, _address))


def deobfuscate(text: str, gated: bool = True) -> Mapped:
    """``gated`` saves time and changes nothing."""
    out = Mapped(text)
    for may, pattern, put in _STEPS:
        if not gated or may is None or may.search(out.text):
            out = out.rewrite(pattern, put)
    return out


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that show only after deobfuscation, in source offsets."""
    mapped = deobfuscate(text)
    if mapped.text == text:
        return []
    taken = sorted((s, e) for s, e, _ in base)
    starts = [s for s, _ in taken]
    reach, most = [], 0
    for _, e in taken:
        reach.append(most := max(most, e))
    out = []
    for s, e, kind in find_spans(mapped.text):
        a, b, changed = mapped.source(s, e)
        k = bisect_right(starts, b - 1) - 1
        if changed and (k < 0 or reach[k] <= a):
            out.append((a, b, kind))
    return out


def listing(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def personal_data(docs: DataFrame, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` (of type long), counts and digest of the base spans, all spans, and how many the method added."""
    def setup():
        def row(*cells):
            body = (cells[-1] or b"").decode("utf-8", "replace")
            base = find_spans(body)
            more = hidden_spans(body, base)
            counts = [sum(k == kind for _, _, k in base) for kind in range(len(KINDS))]
            yield (*cells[:-1], *counts, hashlib.sha256(listing(base).encode()).hexdigest(), listing(base + more), len(more))

        return row

    schema = [*((k, "long") for k in keep), *((f"n_{k}", "long") for k in KINDS), ("base_sha256", "string"),
              ("spans", "string"), ("n_added", "long")]
    return map_rows(docs.select(*keep, raw_text(text)), setup, schema)


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data(table(spark, sf, "documents"))
