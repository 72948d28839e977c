"""Literals, templates, predicates, expectations and reconciliation."""

from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from haulmark.functions import literals as FL, predicates as P, text as FT
from haulmark.operators import checks as C


EURO = "\N{EURO SIGN}"
EURO_ESCAPE = "\\u" + "20ac"


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i")


def apply(spark, fn, values, kind="string"):
    return [r.y for r in column(spark, values, kind).select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_memory(spark):
    assert apply(spark, FL.memory_to_bytes, ["10KiB", "10 kilobyte", "10k", "10MB", "10B", "9 gigabyte", "9TiB", "10XB", "KB", "1.5MB", "10KB", None]) == [
        10240, 10240, 10240, 10485760, 10, 9663676416, 9895604649984, None, None, None, None, None]
    with pytest.raises(Exception, match="not a memory size: 10XB"):
        apply(spark, lambda c: FL.memory_to_bytes(c, strict=True), ["10XB"])


def test_duration(spark):
    assert apply(spark, FL.duration_to_nanos, ["10 nanosecond", "10 micro", "10ms", "9s", "10m", "100 hours", "98d", "5 weeks", "10S"]) == [
        10, 10_000, 10_000_000, 9 * 10**9, 600 * 10**9, 360_000 * 10**9, 98 * 86400 * 10**9, None, None]


def test_dedent(spark):
    body = "\n          test1\n\n            test2\n   \n"
    assert apply(spark, FT.dedent, [body, "a\nb", "\n \n"]) == ["test1\n  test2", "a\nb", ""]


def test_characters(spark):
    assert apply(spark, FL.unescape_char, ["a", r"\t", r"\u0009", EURO_ESCAPE, r"\101", r"\\", r"\"", "ab", ""]) == [
        "a", "\t", "\t", EURO, "A", "\\", '"', None, None]
    assert apply(spark, FL.unicode_code, ["\t", "a", EURO]) == [r"\u0009", "\\u" + "0061", EURO_ESCAPE]
    assert apply(spark, FL.char_hex, ["\u0001", ",", EURO]) == [r"'\0x001'", r"'\0x02c'", r"'\0x20ac'"]
    assert apply(spark, lambda c: FL.char_hex(c, "bare"), ["\u0001", ","]) == ["01", "2c"]


def test_bool_words(spark):
    assert apply(spark, FL.parse_bool_literal, ["yes", "No", "TRUE", "off", "1", None]) == [True, False, True, False, None, None]


def test_paths(spark):
    assert apply(spark, lambda c: FT.normalize_uri(c, "/base"), ["hdfs://n/x", "/a//b/", "rel", "s3a:x", "/a b?c#d%", "/"]) == [
        "hdfs://n/x", "file:/a/b", "file:/base/rel", "s3a:x", "file:/a%20b%3Fc%23d%25", "file:/"]
    assert apply(spark, lambda c: FT.join_path(c, F.lit("x/"), F.lit("/y")), ["a", "/a//", ""]) == ["/a/x/y", "/a/x/y", "/x/y"]


def test_json_or_text(spark):
    assert apply(spark, lambda c: FT.json_or_text(c).cast("string"), ['{"a":1}', "not json", "[1,2]"]) == ['{"a":1}', "not json", "[1,2]"]


def test_mask(spark):
    assert apply(spark, lambda c: FT.mask_tokens(c, [2, 9]), [["a", "b", "c"], ["a"], []], "array<string>") == ["a ***** c", "a", ""]


def test_row_to_map(spark):
    row = spark.sql("select 'quinn' as harley, 'joker' as `boy.friend`, 28 as age").select(
        FT.row_to_map(["harley", "boy.friend", "age"]).alias("m")).first()
    assert row.m == {"harley": "quinn", "boy.friend": "joker", "age": "28"}


def test_templates_inline(spark):
    fill = lambda c: FT.render_with(c, {"foo.bar": "baz", "foo2": "${foo1}", "foo1": "bar2", "cash": "a$1\\2"})
    assert apply(spark, fill, ["${foo2}", "x ${foo.bar} y ${?nope}z", "${", "${}", "$5 ${cash}", None]) == [
        "bar2", "x baz y z", "${", "${}", "$5 a$1\\2", None]
    with pytest.raises(Exception, match="unable to resolve variable nope"):
        apply(spark, fill, ["${nope}"])


def test_variables_that_refer_to_each_other():
    with pytest.raises(ValueError, match="a -> b -> a"):
        FT.resolve_variables({"a": "${b}", "b": "${a}"})


@pytest.mark.parametrize("others", [0, 300])
def test_template_table_equals_inline(spark, others):
    """The same rules with few variables and with many."""
    variables = {"a": "1", "b": "<${a}>", "c": "${b}${?zz}${a}"}
    more = [(f"v{i}", f"${{v{i - 1}}}" if i % 3 else "x") for i in range(others)]
    table = spark.createDataFrame([*variables.items(), ("a", "1"), ("unused", None), ("c", None), *more], "name string, value string")
    texts = ["${c} and ${c} and ${a}", "none", "${?zz}", "${?unused}", None]
    want = apply(spark, lambda c: FT.render_with(c, variables), texts)
    out = FT.render_template(column(spark, texts), ["i"], "x", table)
    assert [r.x for r in out.orderBy("i").collect()] == want
    for missing in ("nope", "unused"):
        with pytest.raises(Exception, match=f"unable to resolve variable {missing}"):
            FT.render_template(column(spark, [f"${{{missing}}}"]), ["i"], "x", table).collect()
    with pytest.raises(Exception, match="different values: a"):
        FT.render_template(column(spark, ["x"]), ["i"], "x", table.unionByName(table.limit(1).selectExpr("'a' as name", "'2' as value")))
    loop = spark.createDataFrame([("k", "${l}${l}"), ("l", "${k}${k}")], "name string, value string")
    with pytest.raises(ValueError, match="refer to each other: k, l"):
        FT.render_template(column(spark, ["${a}"]), ["i"], "x", table.unionByName(loop))


def check(spark, tree):
    return spark.range(1).select(P.predicate_tree(tree)).first()[0]


def test_trees(spark):
    assert check(spark, ["1==1", "2==2", "3==2"]) is False
    assert check(spark, {"or": ["1==0", "1==1"], "and": ["1==1", "2==2"]}) is True
    assert check(spark, {"or": ["1==0", "1==1"], "and": ["1==1", "2==1"]}) is False
    assert check(spark, {"or": [{"and": ["1==1", "2==2"]}, "no"]}) is True
    assert (check(spark, True), check(spark, "yes"), check(spark, [])) == (True, True, True)
    with pytest.raises(ValueError):
        P.predicate_tree({"xor": []})


def test_tree_text():
    assert P.predicate_text(["a", "b"]) == "(a) and (b)"
    assert P.predicate_text({"or": ["a", "yes"]}) == "((a) or (true))"


TREES = st.recursive(st.booleans(), lambda x: st.lists(x, min_size=1, max_size=3) | st.dictionaries(
    st.sampled_from(["or", "and"]), st.lists(x, min_size=1, max_size=3), min_size=1), max_leaves=8)


def truth(tree):
    if isinstance(tree, bool):
        return tree
    if isinstance(tree, list):
        return all(map(truth, tree))
    return all((any if k == "or" else all)(map(truth, v)) for k, v in tree.items())


@settings(max_examples=25, deadline=None)
@given(TREES)
def test_any_tree(spark, tree):
    assert check(spark, tree) is truth(tree)


def test_when(spark):
    state = spark.sql("select 5 as loaded")
    assert C.when(spark.range(3), state, "loaded > 4").count() == 3
    assert C.when(spark.range(3), state, {"or": ["loaded > 5", "no"]}).count() == 0


def test_expectations(spark):
    out = C.expectations(spark.range(10), [("id >= 0", "positive"), ("id < 9", "small"), ("nullif(id, 3) >= 0", "no nulls")]).collect()
    assert [(r.check_no, r.failed_rows, r.passed) for r in out] == [(1, 0, True), (2, 1, False), (3, 1, False)]
    with pytest.raises(C.ExpectationFailed, match="small"):
        C.expect(spark.range(10), [("id < 9", "small")])
    C.expect(spark.range(10), [("id < 10", "small")])


def test_reconcile(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(1,), (2,), (4,)], "k int")
    assert C.reconcile(a, b, ["k"]).first()[:] == (4, 3, 1, 1, 1, False)
    assert C.reconcile(a, a, ["k"]).first().matched
    assert C.reconcile(a.where("k > 9"), a.where("k > 9"), ["k"]).first()[:] == (0, 0, 0, 0, 0, True)
