"""Quoted files with line breaks in fields, cut by many tasks, against one reader of the whole text."""

from __future__ import annotations

import csv
import io
import random

import pytest
from hypothesis import given, settings, strategies as st

from haulmark.settings import LoadSetting
from haulmark.sources.delimited import scan_delimited
from haulmark.sources.quoted import quote_scanner, quoted_records

QUOTED = LoadSetting(quoting=True, multi_line=True)


def plain_records(text, delimiter=",", quote='"', escape="\\"):
    """One character at a time."""
    out, now, state, i = [], "", "start", 0
    while i < len(text):
        c = text[i]
        if state == "in":
            if c == escape and escape != quote and i + 1 < len(text):
                now += c
                i += 1
                c = text[i]
            elif c == quote:
                if escape == quote and text[i + 1:i + 2] == quote:
                    now += c
                    i += 1
                else:
                    state = "field"
        elif c == "\n":
            out.append(now)
            now, state, i = "", "start", i + 1
            continue
        elif c == delimiter:
            state = "start"
        elif state == "start" and c == quote:
            state = "in"
        else:
            state = "field"
        now += c
        i += 1
    return out + [now] if now or state != "start" else out


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from('ab,"\\\n'), max_size=40), st.sampled_from(['"', "\\"]))
def test_lines_scanned_one_by_one_give_the_records(text, escape):
    scan = quote_scanner(",", '"', escape)
    out, inside = [], False
    lines = text.split("\n")
    for line in lines[:-1] if lines[-1] == "" else lines:
        if inside:
            out[-1] += "\n" + line
        else:
            out.append(line)
        inside = scan(line, inside)
    want = plain_records(text, escape=escape)
    assert out == [w.removesuffix("\n") if i == len(want) - 1 else w for i, w in enumerate(want)]


@pytest.mark.parametrize("size, broadcast", [("64b", True), ("64b", False), ("1000b", True), ("64m", True)])
def test_records_of_any_splits(spark, tmp_path, size, broadcast, monkeypatch):
    from haulmark.sources import quoted

    if not broadcast:
        monkeypatch.setattr(quoted, "BROADCAST_SPLITS", -1)
    rnd = random.Random(size)
    texts = []
    for k in range(3):
        rows = []
        for i in range(60):
            field = rnd.choice(["plain", "", "two\nlines", 'a "quoted" word', "with, comma\n\n\nand more\n", "x" * 150 + "\n" + "y" * 200, "\\ back"])
            rows.append([f"{k}-{i}", field, str(rnd.random())])
        body = io.StringIO()
        csv.writer(body, quoting=csv.QUOTE_ALL, lineterminator="\n", doublequote=False, escapechar="\\").writerows(rows)
        texts.append(body.getvalue())
        (tmp_path / f"f{k}.csv").write_text(texts[-1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = quoted_records(spark, str(tmp_path), QUOTED)
        assert size != "64b" or got.select("source", "block").distinct().count() > 8
        assert sorted(r.value for r in got.collect()) == sorted(x for t in texts for x in plain_records(t))
        if size == "1000b":
            dropped = quoted_records(spark, str(tmp_path), LoadSetting(quoting=True, multi_line=True, header=True))
            assert sorted(r.value for r in dropped.collect()) == sorted(x for t in texts for x in plain_records(t)[1:])
        cells = scan_delimited(spark, str(tmp_path), ["a", "b", "c"], QUOTED).collect()
        want = [r for t in texts for r in csv.reader(io.StringIO(t), doublequote=False, escapechar="\\")]
        assert all(r._arity_ok for r in cells) and sorted([r.a, r.b or "", r.c] for r in cells) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_files_and_unclosed_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text('1,"open\nto the\nend')
    (tmp_path / "c.csv").write_text('2,x\r\n"3\r\n4",y\r\n')
    assert sorted(r.value for r in quoted_records(spark, str(tmp_path), QUOTED).collect()) == ['"3\n4",y', '1,"open\nto the\nend', "2,x"]
