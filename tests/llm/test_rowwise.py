"""Quality bands, token counts and personal data against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
import zstandard
from hypothesis import given, settings, strategies as st

from haulmark.llm import pii, quality, token_counts
from haulmark.llm.bpe import Encoder, tokenizer_path
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = "byte_bpe_50k.json"


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_quality_base_and_verdict(docs, doc_rows, no_docs):
    got = by_id(quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                             "base_failed"))
    assert got == sorted(((r[0], *plain_quality(r[1])) for r in doc_rows), key=repr)
    assert quality.quality(no_docs).count() == 0
    for r in quality.quality(docs).collect():
        assert not (r.kept and r.base_failed)


def test_quality_bands_reject_noise_and_filler(spark):
    rnd = random.Random(1)
    noise = " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=12)) for _ in range(700))
    noisy = " ".join("".join(chr(rnd.randrange(0x4e00, 0x9fff)) for _ in range(8)) for _ in range(500))
    filler = " ".join(f"{'abcdefgh'[i // 128 % 8]}{'xy'[i % 2]}" for i in range(3000))
    good = "\n".join(f"The {a} of line {i} was {b} and then {a[::-1]} ran" for i, (a, b) in
                     enumerate(("".join(rnd.choices("aeioustrnl", k=6)), "".join(rnd.choices("aeioustrnl", k=5))) for _ in range(200)))
    rows = {r.doc_id: r for r in quality.quality(spark.createDataFrame(
        [(1, noise), (2, noisy), (3, filler), (4, good)], "doc_id long, text string")).collect()}
    assert [rows[i].kept for i in (1, 2, 3, 4)] == [False, False, False, True]
    assert rows[1].ratio == len(zstandard.ZstdCompressor(level=3).compress(noise.encode())) / len(noise)


def plain_kept(text):
    """The verdict from the limits, by its definition."""
    body = (text or "").encode()
    size = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b)) / len(b)

    def fits(b):
        for top, low, high in quality.BANDS:
            if top is None or len(b) <= top:
                return low <= size(b) <= high

    chunks = [body[i:i + 4096] for i in range(0, len(body), 4096)] if len(body) > 4096 else []
    return not plain_quality(text)[-1] and bool(body) and fits(body) and sum(not fits(c) for c in chunks) <= len(chunks) / 4


def test_kept_by_its_definition(spark, docs, doc_rows):
    assert by_id(quality.quality(docs).select("doc_id", "kept")) == sorted(((r[0], plain_kept(r[1])) for r in doc_rows), key=repr)


def test_noise_of_every_length_and_mixed_documents(spark):
    rnd = random.Random(2)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    noise = lambda n: " ".join("".join(rnd.choices(alphabet, k=rnd.randint(4, 9))) for _ in range(n // 4))[:n]
    prose = lambda n: " ".join("".join(rnd.choices(["the", "an", "ver", "ka", "ti", "on", "sol"], k=rnd.randint(1, 3))) for _ in range(n // 3))[:n]
    rows = [(n, noise(n)) for n in (150, 200, 250, 300, 400, 500, 700, 900, 1500, 5000)]
    rows += [(100_000 + n, prose(n)) for n in (150, 200, 250, 300, 400, 500, 700, 900, 1500, 5000)]
    rows.append((7, prose(22_000) + " " + noise(18_000)))  # 45% noise
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {n for n, kept in got.items() if kept} == {n for n, _ in rows if n > 100_000}


def test_token_counts_equal_the_library(docs, doc_rows, no_docs):
    lib = Tokenizer.from_file(tokenizer_path(BPE))
    want = []
    for r in doc_rows:
        n = len(lib.encode(r[1] or "", add_special_tokens=False).ids)
        want.append((r[0], len((r[1] or "").encode()), n, n > 512))
    assert by_id(token_counts.token_counts(docs, BPE)) == sorted(want, key=repr)
    assert token_counts.token_counts(no_docs, BPE).count() == 0
    piece = token_counts.token_counts(docs, "piece_bpe_32k.model").where("doc_id = 30").first().n_tokens
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert piece == len(model.encode(doc_rows[30][1]))


odd_text = st.text(st.sampled_from(list("ab  \n\t'sré漢😀1,. \x85\x1c !<|>")), max_size=120)


@settings(max_examples=300, deadline=None)
@given(odd_text, st.integers(3, 20), st.integers(1, 6))
def test_splicing_and_units_change_no_count(text, chunk, overlap):
    encoder = Encoder.of(tokenizer_path(BPE), len)
    want = len(encoder.lib.encode(text, add_special_tokens=False).ids)
    assert token_counts.count_tokens(encoder, text, chunk, overlap, huge=0) == want
    assert sum(encoder.values(text)) == want


def plain_spans(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 12 <= len(d) <= 19 and odd % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from(list("ab@@..12309+-() é")), max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.find_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text, kind, span", [
    ("mail ann.42 at host8 dot example dot com now", "email", "ann.42 at host8 dot example dot com"),
    ("ann [at] host [dot] org", "email", "ann [at] host [dot] org"),
    ("write ann(at)host.org!", "email", "ann(at)host.org"),
    ("write аnn@hоst.org!", "email", "аnn@hоst.org"),
    ("a​nn@ho​st.org", "email", "a​nn@ho​st.org"),
    ("call plus one nine eight eight five five five two four eight five.", "phone",
     "plus one nine eight eight five five five two four eight five"),
    ("at one nine two dot one six eight dot one dot five", "ip", "one nine two dot one six eight dot one dot five"),
    ("see ４５３２ 0151 1283 0366", "card", "４５３２ 0151 1283 0366"),
    ("server 10 . 0 . 0 . 1 is up", "ip", "10 . 0 . 0 . 1"),
    ("server 10. 0. 0. 1 is up", "ip", "10. 0. 0. 1"),
    ("joe@host . com wrote", "email", "joe@host . com"),
    ("ﬁx 漢 call +1 (nine eight eight) 555-2485", "phone", "+1 (nine eight eight) 555-2485"),
])
def test_disguises_map_back_to_the_source(text, kind, span):
    found = pii.hidden_spans(text, pii.find_spans(text))
    assert [(text[s:e], pii.KINDS[k]) for s, e, k in found] == [(span, kind)]


PIECES = ["ann", "host", "com", "c0m", "аnn", "at", "At", "arroba", "@", "dot", "DOT", "punkt", ".", "[", "(", "<", "]", ")", ">", "_", "*", "|", "one",
          "Un", "uno", "ſeven", "Fİve", "fünf", "ZÉRO", "plus", "más", "+", "10", "7", "255", ",", "-", " ", " ", " ", "  ", "\n", "４", "é", "_a"]


def all_of(mapped):
    return mapped.text, mapped.new, mapped.old, mapped.same


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_gates_and_first_looks_change_nothing(text):
    assert all_of(pii.deobfuscate(text)) == all_of(pii.deobfuscate(text, gated=False))
    plain = re.compile(re.sub(r"\(\?=\[.*?\(\?!\\w\)\)\(\?=.*?\(\?!\\w\)\)", "", pii._SPOKEN.pattern, count=1), re.I)
    assert plain.pattern.startswith(r"(?<!\w)(?:(?:") and "(?=[" not in plain.pattern[:40]
    assert [m.span() for m in pii._SPOKEN.finditer(text)] == [m.span() for m in plain.finditer(text)]


@pytest.mark.parametrize("text", ["look at the house. Dot by dot it grew", "one two three four", "x at y", "Un deux trois at home.",
                                  "plus one", "b@c.de and b@c.de", "at 3.14 dot"])
def test_plain_prose_gains_nothing(text):
    assert pii.hidden_spans(text, pii.find_spans(text)) == []


def test_personal_data_rows(spark, docs, doc_rows, no_docs):
    rows = [(1, "a@b.cd 10.0.0.1 and ann [at] host [dot] org"), (2, None), (3, ""), (3, ""), (None, "é +1 (988) 555-2485"),
            (4, "1" * 50_000 + "x" * 50_000 + "@")]
    got = {(r.doc_id, r.spans): r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = got[(1, "email:0:6,ip:7:15,email:20:43")]
    assert (first.n_email, first.n_ip, first.n_card, first.n_phone, first.n_added) == (1, 1, 0, 0, 1)
    assert first.base_sha256 == hashlib.sha256(b"email:0:6,ip:7:15").hexdigest()
    assert (None, "phone:2:19") in got and (2, "") in got and (4, "") in got
    assert pii.personal_data(no_docs).count() == 0
    assert pii.personal_data(docs).count() == len(doc_rows)
