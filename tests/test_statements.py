"""DELETE, UPDATE and MERGE statements: where they are cut, and the rows they leave against DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from haulmark.operators.merge import MergeConflict, merge_into
from haulmark.plans import sqlapi as Q
from haulmark.statements import Clause, Create, Delete, Insert, Merge, StatementError, Target, Update, cut

CONDITIONS = [
    "x IN (7, 8)", "x NOT IN (7, 8)", "x IN (5, 5)", "x NOT IN (7, NULL)", "x BETWEEN 2 AND 4", "x NOT BETWEEN 2 AND 4 OR y IS NULL",
    "y LIKE 'a%'", "y NOT LIKE '%where%'", "y IS NULL", "y IS NOT NULL", "x IS DISTINCT FROM 3", "NOT x = 3", "NOT (x IN (1, 2) OR y = 'a set b')",
    "CASE WHEN x > 5 THEN y = 'a where' WHEN x IS NULL THEN true ELSE x = 1 END", "((x)) > (1 + (2))", "x IN (SELECT k FROM other WHERE k > 2)",
    "x NOT IN (SELECT k FROM other WHERE k IS NOT NULL AND k < 4)", "EXISTS (SELECT 1 FROM other AS o WHERE o.k = x)",
    "x > (SELECT avg(k) FROM other) /* where x = 1 /* nested */ */", "y = 'it''s; -- where'", "x = 1 -- or where true\n OR x = 2", "true", "x > 100",
]
ROWS = [(1, "a where"), (2, "a set b"), (3, None), (4, "it's; -- where"), (5, "b"), (7, "abc"), (8, "b"), (9, "when"), (None, "a"), (None, None), (3, "when")]
OTHER = [(2,), (3,), (3,), (8,), (None,)]


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    out.execute("create table other (k int)")
    out.executemany("insert into other values (?)", OTHER)
    return out


@pytest.fixture(scope="module")
def other(spark):
    spark.createDataFrame(OTHER, "k int").createOrReplaceTempView("other")


def filled(spark, name, rows, ddl="x int, y string", rest=""):
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet {rest}")
    spark.createDataFrame(rows, ddl).coalesce(2).write.insertInto(name)
    return name


def left(df):
    return sorted(map(tuple, df.collect()), key=repr)


def in_duckdb(con, rows, ddl, *statements):
    con.execute("drop table if exists t")
    con.execute(f"create table t ({ddl.replace('string', 'varchar')})")
    con.executemany(f"insert into t values ({', '.join('?' * len(rows[0]))})", rows)
    counts = [con.execute(s).fetchone()[0] for s in statements]
    return counts, sorted(con.execute("select * from t").fetchall(), key=repr)


@pytest.mark.parametrize("condition", CONDITIONS)
def test_delete_and_update_rows(spark, con, other, condition):
    name = filled(spark, "cut_me", ROWS)
    plain = condition.replace("/* where x = 1 /* nested */ */", "").replace("it''s", "it''s")
    ours = condition.replace("'it''s", "'it\\'s")
    (changed, gone), want = in_duckdb(con, ROWS, "x int, y string", f"UPDATE t SET x = x + 10, y = y || ' where' WHERE {plain}", f"DELETE FROM t WHERE {plain}")
    assert Q.sql_execute(spark, f"UPDATE {name} SET x = x + 10, y = y || ' where' WHERE {ours};") == changed
    assert Q.sql_execute(spark, f"DELETE FROM {name}\nwhere {ours}") == gone
    assert left(spark.table(name)) == want


def test_regular_expressions_and_booleans_as_values(spark):
    name = filled(spark, "cut_values", [(7, "a1"), (8, "b"), (None, None)], "x int, y string")
    assert Q.sql_execute(spark, f"UPDATE {name} AS u SET y = CAST(u.x IN (7, 9) AS string)") == 3
    assert left(spark.table(name)) == [(7, "true"), (8, "false"), (None, None)]
    assert Q.sql_execute(spark, f"DELETE FROM {name} `when` WHERE `when`.y RLIKE '^tr'") == 1
    assert Q.sql_execute(spark, f"DELETE FROM {name}") == 2


def test_conditions_on_partitioned_tables_name_the_table(spark, other):
    name = filled(spark, "cut_parts", [(1, "a", 1), (2, "b", 1), (3, "c", 2)], "x int, y string, p int", "PARTITIONED BY (p)")
    assert Q.sql_execute(spark, f"DELETE FROM {name} WHERE EXISTS (SELECT 1 FROM other o WHERE o.k = {name}.x)") == 2
    assert left(spark.table(name)) == [(1, "a", 1)]


pieces = st.sampled_from(["x", "= 1", "IN (SELECT a FROM b WHERE c SET d)", "'where set'", '"when \\" then"', "`where`", "t.set", "/* where ' */", "-- set where '\n",
                          "CASE WHEN a THEN b ELSE (CASE WHEN where_ THEN 1 END) END", "((", "))", "[1, 2]", "BETWEEN 1 AND 2", "r'\\'", "AND", "NOT", "1.5"])


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=8), st.lists(pieces, min_size=1, max_size=4))
def test_cuts_fall_between_the_parts(condition, value):
    if condition.count("((") != condition.count("))") or value.count("((") != value.count("))"):
        return
    seen = ["".join(x) for x in ("".join(p[0] for p in ps if p in ("((", "))")) for ps in (condition, value))]
    if any(s[:k].count(")") > s[:k].count("(") for s in seen for k in range(len(s) + 1)):
        return
    words = lambda ps: [p for p in ps if not p.startswith(("/*", "--"))]
    if not words(condition) or not words(value):
        return
    core = lambda ps: " ".join(ps)[" ".join(ps).index(words(ps)[0]):]
    got = cut(f"update a.b as t set t.c = {' '.join(value)} , d=2 Where {' '.join(condition)}")
    assert got.target == Target("a.b", "t") and list(got.values) == ["c", "d"] and got.values["d"] == "2"
    strip = lambda text: " ".join(text.split())
    assert strip(core(condition)).startswith(strip(got.condition)) and strip(got.condition).endswith(strip(words(condition)[-1]))
    assert strip(core(value)).startswith(strip(got.values["c"])) and strip(got.values["c"]).endswith(strip(words(value)[-1]))


@pytest.mark.parametrize("sql", ["DELETE FROM t WHERE a = 1 WHERE b = 2", "DELETE FROM t WHERE (a = 1", "DELETE FROM t WHERE", "DELETE FROM t WHERE a = 'x",
                                 "UPDATE t SET a 1", "UPDATE t SET a = 1, a = 2", "UPDATE t SET a = , b = 1", "DELETE FROM t WHERE a)", "DELETE FROM t USING u WHERE a",
                                 "WITH x AS (SELECT 1) DELETE FROM t WHERE a IN (SELECT * FROM x)", "MERGE INTO t USING s ON a = b", "/* DELETE FROM t"])
def test_what_cannot_be_cut_is_refused(sql):
    with pytest.raises(StatementError):
        cut(sql)


def test_shapes_of_statements():
    assert cut("SELECT 1") is None and cut("CREATE VIEW v AS SELECT 1") is None and cut("") is None and cut("CREATE TABLE t (a int) USING parquet") is None
    assert cut("delete from `a b`.t") == Delete(Target("`a b`.t"), "true")
    assert cut("UPDATE t u SET u.a = (SELECT max(x) FROM s WHERE y = 1), b = DEFAULT") == Update(
        Target("t", "u"), {"a": "(SELECT max(x) FROM s WHERE y = 1)", "b": "DEFAULT"}, "true")
    assert cut("CREATE TABLE IF NOT EXISTS a.t USING orc AS WITH q AS (SELECT 1 AS x) SELECT x AS y FROM q") == Create(
        "a.t", "CREATE TABLE IF NOT EXISTS a.t USING orc AS", "WITH q AS (SELECT 1 AS x) SELECT x AS y FROM q", True)
    assert cut("WITH q AS (SELECT 1) INSERT INTO TABLE t PARTITION (p = 'x') (a) SELECT insert('abc', 1, 1, 'x') FROM q") == [Insert(
        "t", "INSERT INTO TABLE t PARTITION (p = 'x') (a)", "WITH q AS (SELECT 1) SELECT insert('abc', 1, 1, 'x') FROM q")]
    assert [(x.target, x.query) for x in cut("FROM s INSERT INTO a SELECT x WHERE x > 1 INSERT OVERWRITE b SELECT y")] == [
        ("a", "FROM s SELECT x WHERE x > 1"), ("b", "FROM s SELECT y")]
    got = cut("INSERT OVERWRITE t PARTITION (p = 1) IF NOT EXISTS (SELECT 1)")
    assert (got[0].guard, got[0].query) == ("PARTITION (p = 1)", "(SELECT 1)")
    assert cut("""MERGE INTO t AS a USING (SELECT * FROM s WHERE x > 1) b ON a.k = b.k AND (CASE WHEN b.x THEN 1 END) = 1
        WHEN MATCHED AND CASE WHEN b.d THEN true END THEN DELETE WHEN MATCHED THEN UPDATE SET a.v = CASE WHEN b.v > 0 THEN b.v END, w = 2
        WHEN NOT MATCHED BY TARGET THEN INSERT (k, v) VALUES (b.k, coalesce(b.v, 0)) WHEN NOT MATCHED BY SOURCE AND a.k < 0 THEN UPDATE SET v = 1""") == Merge(
        Target("t", "a"), "(SELECT * FROM s WHERE x > 1)", "b", "a.k = b.k AND (CASE WHEN b.x THEN 1 END) = 1", (
            Clause("matched", "delete", None, "CASE WHEN b.d THEN true END"),
            Clause("matched", "update", {"v": "CASE WHEN b.v > 0 THEN b.v END", "w": "2"}),
            Clause("unmatched", "insert", {"k": "b.k", "v": "coalesce(b.v, 0)"}),
            Clause("missing", "update", {"v": "1"}, "a.k < 0")))


def test_rows_of_other_writes(spark, tmp_path, other):
    for name in ("made", "made_too"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows = Q.sql_script(spark, """CREATE TABLE made USING parquet AS SELECT k, k AS l FROM other WHERE k IS NOT NULL;
        CREATE TABLE IF NOT EXISTS made USING parquet AS SELECT k FROM other;
        FROM other INSERT INTO made SELECT k, 1 WHERE k = 3 INSERT INTO made SELECT k, 2;
        """)
    assert rows == {"made": 4 + 2 + 5} and spark.table("made").count() == 11
    folder = str(tmp_path / "out")  # a row of one NULL is an empty line, which no reader gives back
    assert Q.sql_execute(spark, f"INSERT OVERWRITE DIRECTORY '{folder}' USING csv SELECT k FROM other WHERE k IS NULL OR k = 2") == 2
    parts = filled(spark, "made_parts", [(1, 1)], "a int, p int", "PARTITIONED BY (p)")
    text = f"INSERT OVERWRITE {parts} PARTITION (p = {{}}) IF NOT EXISTS SELECT k FROM other"
    assert [Q.sql_execute(spark, text.format(p)) for p in (1, 2)] == [0, 5]
    assert spark.table(parts).count() == 6


T, S = [(1, "a", 10), (2, "b", 20), (3, "c", 30), (None, "n", 0), (5, "e", 50)], [(2, "B", 1), (3, "C", -1), (8, "H", 8), (9, None, -9), (None, "N", 4)]
MERGE = """MERGE INTO {} AS t USING src s ON t.k = s.k
  WHEN MATCHED AND s.n < 0 THEN DELETE WHEN MATCHED THEN UPDATE SET v = s.v || t.v, n = t.n + s.n
  WHEN NOT MATCHED AND s.n > 0 THEN INSERT (k, n) VALUES (s.k, s.n * 2) WHEN NOT MATCHED AND s.v IS NULL THEN INSERT *
  WHEN NOT MATCHED BY SOURCE AND t.k > 4 THEN UPDATE SET v = 'gone' WHEN NOT MATCHED BY SOURCE AND t.k IS NULL THEN DELETE"""
MERGED = [(1, "a", 10), (2, "Bb", 21), (5, "gone", 50), (8, None, 16), (9, None, -9), (None, None, 8)]


@pytest.mark.parametrize("ddl, rest", [("k int, v string, n int", ""), ("k int, v string, n int, p int", "PARTITIONED BY (p)")])
def test_merge(spark, ddl, rest, tmp_path):
    extra = (lambda r: (*r, 0 if r[0] is None else r[0] % 3)) if rest else (lambda r: r)
    spark.createDataFrame([extra(r) for r in S], ddl).createOrReplaceTempView("src")
    name = filled(spark, "merge_me", [extra(r) for r in T], ddl, f"{rest} LOCATION '{tmp_path / 'there'}'")
    sql = MERGE.replace("(k, n) VALUES (s.k, s.n * 2)", "(k, n, p) VALUES (s.k, s.n * 2, s.p)") if rest else MERGE
    untouched = {r.f for r in spark.sql(f"SELECT _metadata.file_path AS f FROM {name} WHERE k = 1").collect()}
    assert Q.sql_execute(spark, sql.format(name)) == 2 + 2 + 3
    assert left(spark.table(name)) == sorted(map(extra, MERGED), key=repr)
    if rest:  # 1 and the inserted 8, 9 and null lie in partitions 1, 2, 0 and 0; only 2 and 0 hold rows that change
        assert untouched <= {r.f for r in spark.sql(f"SELECT _metadata.file_path AS f FROM {name}").collect()}
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    assert described["Type"] == "EXTERNAL" and described["Location"].endswith("/there")


def test_merge_refuses_two_source_rows_and_changes_nothing(spark):
    name = filled(spark, "merge_twice", T, "k int, v string, n int")
    spark.createDataFrame([(2, "x", 1), (2, "y", 2), (7, "z", 3), (7, "z", 3)], "k int, v string, n int").createOrReplaceTempView("src")
    with pytest.raises(MergeConflict):
        Q.sql_execute(spark, f"MERGE INTO {name} USING src ON {name}.k = src.k WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *")
    assert left(spark.table(name)) == sorted(T, key=repr)
    assert Q.sql_execute(spark, f"MERGE INTO {name} USING src ON {name}.k = src.k WHEN MATCHED THEN DELETE WHEN NOT MATCHED THEN INSERT *") == 3
    assert left(spark.table(name)) == sorted([*(r for r in T if r[0] != 2), (7, "z", 3), (7, "z", 3)], key=repr)
    assert Q.sql_execute(spark, f"MERGE INTO {name} USING src ON {name}.k = src.k WHEN NOT MATCHED BY SOURCE AND k = 1 THEN DELETE") == 1
    assert spark.table(name).where("k = 7").count() == 2
    for bad in ("UPDATE SET nope = 1", "UPDATE SET k = 1, K = 2"):
        with pytest.raises(ValueError):
            Q.sql_execute(spark, f"MERGE INTO {name} USING src ON {name}.k = src.k WHEN MATCHED THEN {bad}")


def test_merge_with_a_hot_key(spark):
    rows = [(0 if i % 3 else i, "v", i) for i in range(30_000)]
    name = filled(spark, "merge_hot", rows, "k int, v string, n int")
    source = spark.createDataFrame([(0, "zero", 0), (3, "three", 0), (-1, "new", 0)], "k int, v string, n int")
    clauses = [Clause("matched", "update", {"v": "source.v"}), Clause("unmatched", "insert")]
    hot = sum(r[0] in (0, 3) for r in rows)
    assert merge_into(spark, name, source, "merge_hot.k = source.k", clauses) == hot + 1
    assert spark.table(name).where("v = 'zero'").count() == hot - 1 and spark.table(name).count() == 30_001
