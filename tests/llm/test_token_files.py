"""Round trips through the files, and the perfect hash."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from haulmark.llm import bpe, token_files as tf
from haulmark.llm.bpe import tokenizer_path
from tokenizers import Tokenizer

LIB = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("n", [1, 2, 5, 64, 3000])
def test_perfect_hash_has_a_place_for_each_key(n):
    keys = [None, *range(-5, n - 6)][:n]
    columns = {c: np.arange(n) * (i + 1) for i, c in enumerate(("copies", "n", "shard", "at", "start"))}
    pilots, slots = tf._build(keys, columns)
    assert len(slots) == n * tf.SLOT.itemsize
    assert tf.lookup(keys, pilots, slots) == [(2 * i, 3 * i, 4 * i, 5 * i, i) for i in range(n)]
    assert not any(tf.lookup(list(range(10**6, 10**6 + 200)), pilots, slots))


def test_files_hold_what_the_library_gives(spark, docs, doc_rows, no_docs, tmp_path):
    folder = str(tmp_path / "files")
    tf.write_token_files(docs, folder, shard_ids=3000, partition_keys=20)
    ids = [[*LIB.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in doc_rows]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    order = sorted(range(len(doc_rows)), key=lambda i: (doc_rows[i][0] is None, doc_rows[i][0] or 0))
    start, want = 0, []
    for i in order:
        want.append((doc_rows[i][0], start, len(ids[i]), crc(ids[i])))
        start += len(ids[i])
    got = sorted((tuple(r) for r in tf.stored_documents(docs, folder).collect()), key=lambda r: r[1])
    assert got == want
    meta = spark.read.parquet(f"{folder}/meta").first()
    assert (meta.keys, meta.ids, meta.width) == (len({r[0] for r in doc_rows}), start, 2)
    asked = spark.createDataFrame([(30,), (13,), (30,), (10**7,), (None,)], "doc_id long")
    stored = {r.key: r.ids for r in tf.stored_ids(asked, folder).collect()}
    assert stored == {30: ids[30], 13: ids[13], None: ids[-1]} and len(stored) == 3
    empty = str(tmp_path / "empty")
    tf.write_token_files(no_docs, empty)
    assert tf.stored_documents(no_docs, empty).count() == 0 and tf.stored_ids(asked, empty).count() == 0


def test_larger_vocabularies_take_four_bytes():
    assert np.frombuffer(tf.packed32([70_000, 0]), "<u4").tolist() == [70_000, 0]
    assert np.frombuffer(tf.packed16([50_000, 0]), "<u2").tolist() == [50_000, 0]


def test_common_pieces_stay_remembered(monkeypatch):
    """Rare words pass through the bounded memory; words that every text holds go to the model once."""
    monkeypatch.setattr(bpe, "UNITS", 100)
    encoder, asked = bpe.Encoder(tokenizer_path("byte_bpe_50k.json"), tf.packed16), Counter()
    model_value = encoder._model_value
    monkeypatch.setattr(encoder, "_model_value", lambda piece: asked.update([piece]) or model_value(piece))
    for i in range(60):
        text = "it is the end of the " + " ".join(f"{chr(97 + i % 26)}{chr(97 + j)}{'xyz'[i // 26]}q" for j in range(26)) + " and the rest."
        assert b"".join(encoder.values(text)) == tf.packed16(LIB.encode(text, add_special_tokens=False).ids)
        assert len(encoder.pieces) + len(encoder.pieces.older) <= 100
    assert {asked[w] for w in ("it", " is", " the", " end", " of", " and", " rest", ".")} == {1}


def test_plain_texts_are_cut_as_the_library_does():
    rnd = random.Random(4)
    encoder = bpe.Encoder(tokenizer_path("byte_bpe_50k.json"), tf.packed16)
    for _ in range(3000):
        text = "".join(rnd.choices(["a", "the", "B", " ", " ", "  ", "\n", "'s", "'", "ll", "re", "7", "42", ".", ",", "-", "é", "ÿ", "ſ", "×", "<|"], k=rnd.randint(1, 25)))
        assert b"".join(encoder.values(text)) == tf.packed16(LIB.encode(text, add_special_tokens=False).ids), text
