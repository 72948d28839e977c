"""The pipeline against plain versions of its stages, chained."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from haulmark.llm import decontaminate, language, simhash, token_files
from haulmark.llm.bpe import tokenizer_path

from test_mixing import rounds
from test_simhash import plain_components, plain_print


def plain_language(model, text):
    """Score by a forward loop of its own over each word."""
    runs = language.letter_runs(text or "")
    if not runs:
        return False
    pieces, total = language.Pieces.of(model.vocabulary), np.zeros(len(model.languages))
    for word in runs:
        word = language.MARK + word
        sums = [np.zeros(len(model.languages))]  # logs, as long words leave the range of floats
        for end in range(1, len(word) + 1):
            here = np.full(len(model.languages), -np.inf)
            for start in range(max(0, end - pieces.longest), end):
                piece = pieces.ids.get(word[start:end], pieces.unk if end - start == 1 else None)
                if piece is not None:
                    here = np.logaddexp(here, sums[start] + model.logs[piece])
            sums.append(here)
        total += sums[-1]
    x = total * min(1.0, 40 / sum(map(len, runs)))
    p = np.exp(x - x.max())
    return (p / p.sum()).max() >= 0.5


def plain_contaminated(text, items):
    words = decontaminate.normal_words((text or "").encode())
    for item in items:
        w = decontaminate.normal_words((item or "").encode())
        if w and len(words) < 4000:
            score = decontaminate.align(w, words)[0]
            shared = {tuple(w[i:i + 4]) for i in range(len(w) - 3)} & {tuple(words[i:i + 4]) for i in range(len(words) - 3)}
            if shared and score >= 0.4 * 2 * len(w):
                return True
    return False


def test_run_equals_plain_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(1000, None, None, None, 0), (1001, "", "en", "s", 0), (1002, "12 34", "en", "s", 5), (1003, "x" * 3000, None, None, 3000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.where("doc_id in (3, 4)")).withColumn("size", F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))

    rows = [r.asDict() for r in docs.collect()]
    model = language.train(spark.read.parquet(str(tmp_path / "documents.parquet")))
    rows = [r for r in rows if plain_language(model, r["text"])]
    prints = [plain_print(r["text"]) for r in rows]
    rows = list({c: r for r, c in reversed(list(zip(rows, plain_components([r["doc_id"] for r in rows], prints)))) if r["doc_id"] == c}.values())
    items = [r.text for r in spark.read.parquet(str(tmp_path / "benchmark.parquet")).collect()]
    rows = [r for r in rows if not plain_contaminated(r["text"], items)]
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in rows}
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources]
    mixed = []
    for s, total, target in zip(sources, sizes, rounds(sizes, [i % 3 + 1 for i in range(len(sources))])):
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: hashlib.md5(f"17:{r['doc_id']}:{r['text']}".encode()).hexdigest())
        whole = int(target // total)
        upto, rest = 0, target - whole * total
        for r in mine:
            upto += size[r["doc_id"]]
            mixed += [r] * (whole + (rest > 0 and upto - size[r["doc_id"]] / 2 <= rest))
    lib, start, want = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), 0, []
    for r in sorted(mixed, key=lambda r: r["doc_id"]):
        ids = [*lib.encode(r["text"], add_special_tokens=False).ids, 0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]) == want
    assert 50 < len(want)


def test_stages_keep_columns_and_take_empty_tables(spark, docs, no_docs, tmp_path):
    spark.createDataFrame([(1, "some words of an item to find")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, no_docs, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, str(tmp_path)).count() == 0
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_hand_over_texts_in_batches_of_bounded_bytes(spark, tmp_path):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "rows"])

    docs = spark.range(1_500, numPartitions=1).selectExpr("id as doc_id", "repeat('a b c d e ', 1000) as text")
    kept, name = spark.conf.get(corpus_pipeline.BATCH_BYTES, None), corpus_pipeline.BATCH_BYTES
    try:
        spark.conf.unset(name)
        corpus_pipeline.bounded(lambda spark, docs, sf_dir: docs)(spark, docs, "")
        assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
        found = docs.mapInArrow(sizes, "size long, rows long").toPandas()
        assert found["rows"].sum() == 1_500 and found["size"].max() < 4 << 20
        spark.conf.set(name, "5m")
        corpus_pipeline.bounded(lambda spark, docs, sf_dir: docs)(spark, docs, "")
        assert spark.conf.get(name).startswith("5")
        spark.conf.unset(name)
        folder = str(tmp_path / "files")
        corpus_pipeline.bounded(lambda spark, docs, sf_dir: token_files.write_token_files(docs, folder))(spark, docs, "")
        back = token_files.stored_documents(docs, folder)
        assert back.count() == 1_500 and back.select("n_tokens", "ids_crc32").distinct().count() == 1
    finally:
        spark.conf.unset(name) if kept is None else spark.conf.set(name, kept)


def test_near_duplicates_broadcast_no_listed_fingerprints(spark, docs, monkeypatch):
    seen, real = [], simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    assert corpus_pipeline.near_duplicate_stage(spark, docs, "").count()
    seen[0].collect()
    meets = [x for x in seen[0]._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "bit_count" in x]
    assert meets and all("SortMergeJoin" in x for x in meets), meets
