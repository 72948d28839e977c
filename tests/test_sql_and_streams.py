"""SQL entry points, streams and scripts."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from haulmark.plans import sqlapi as Q
from haulmark.plans.catalog import QUERIES, SQL
from haulmark.operators.export import export_delimited
from haulmark.schema import target
from haulmark.settings import ExportSetting, LoadSetting
from haulmark.streaming import script_transform, stream_load


def fresh(spark, name, ddl, rest=""):
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet {rest}")
    return name


def test_read_first_row(spark):
    assert Q.sql_read(spark, "select 1 as a, 'x' as b, true as c, date'2024-01-02' as d, null as e") == {
        "a": 1, "b": "x", "c": "yes", "d": "2024-01-02", "e": None}
    assert Q.sql_read(spark, "select 1 as a where false") == {}
    with pytest.raises(TypeError):
        Q.sql_read(spark, "select array(1) as a")
    assert Q.first_row(spark.createDataFrame([(datetime.datetime(2024, 1, 2),)], "t timestamp_ntz")) == {"t": "2024-01-02 00:00:00"}


def test_execute_counts_inserted_rows(spark):
    name = fresh(spark, "exec_me", "a bigint, b bigint")
    assert Q.sql_execute(spark, f"INSERT INTO {name} SELECT id, id FROM range(7)") == 7
    assert Q.sql_execute(spark, f"insert into table {name} (b, a) with r as (select 1 as x) select x, 2 from r") == 1
    assert Q.sql_execute(spark, f"INSERT INTO {name} VALUES (1, 1), (2, 2)") == 2
    assert spark.table(name).where("a = 2 and b = 1").count() == 1
    assert Q.sql_execute(spark, f"INSERT OVERWRITE {name} SELECT id, id FROM range(3)") == 3
    assert spark.table(name).count() == 3
    assert Q.sql_execute(spark, f"TRUNCATE TABLE {name}") == 0


def test_script(spark):
    one, two = fresh(spark, "script_a", "a bigint"), fresh(spark, "script_b", "a bigint, p string", "PARTITIONED BY (p)")
    text = f"""INSERT INTO {one} SELECT id FROM range(3);
        INSERT INTO {two} PARTITION (p = 'x') SELECT id FROM range(4);

        SELECT 'a;b';
        INSERT INTO {one} SELECT id FROM range(5);
    """
    assert Q.sql_script(spark, text) == {one: 8, two: 4}
    assert spark.table(two).where("p = 'x'").count() == 4
    assert Q.sql_script(spark, [f"INSERT INTO {one} SELECT 1L"]) == {one: 1}


def test_sql_file(spark, files):
    base = files(**{"q.sql": "select '${who}' as w,\n id from range(${n}) where id > :low"})
    out = Q.sql_from_file(spark, path=f"{base}/q.sql", variables={"who": "me ${n}", "n": "5"}, args={"low": 2})
    assert sorted(map(tuple, out.collect())) == [("me 5", 3), ("me 5", 4)]
    with pytest.raises(ValueError):
        Q.sql_from_file(spark)
    with pytest.raises(ValueError, match="unable to resolve"):
        Q.sql_from_file(spark, sql="select ${nope}")


def test_sql_export(spark, tmp_path):
    assert Q.sql_export(spark, "select id, null as n from range(3)", str(tmp_path / "o")) == 3
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o")).collect()) == ["0,", "1,", "2,"]


def test_stream_load_in_two_runs(spark, tmp_path):
    cols = target(("a", "int"), ("b", "string"))
    name = fresh(spark, "streamed_in", "a int, b string, batch bigint", "PARTITIONED BY (batch)")
    source, state, bad = (str(tmp_path / x) for x in ("in", "state", "bad"))
    for run in range(2):
        export_delimited(spark.sql(f"select concat(cast(id as string), case when id = 3 then 'x' else '' end) as a, 'r{run}' as b from range(5)"),
                         f"{source}/run{run}", ExportSetting(header=True))
        stream_load(spark, f"{source}/*", name, state, LoadSetting(header=True), cols, reject_path=bad, batch_column="batch").awaitTermination()
        assert spark.table(name).count() == 4 * (run + 1)
    assert sorted(r.value for r in spark.read.text(f"{bad}/*").collect()) == ["3x\u0001r0", "3x\u0001r1"]


def test_stream_settings_are_honoured_or_refused(spark, tmp_path):
    name = fresh(spark, "streamed_set", "a int, b string, batch bigint", "PARTITIONED BY (batch)")
    spark.sql("select 'x,NA' as value union all select '1,NA' union all select '2,ok'").coalesce(1).write.text(str(tmp_path / "in"))
    bad, states = str(tmp_path / "bad"), [str(tmp_path / f"state{i}") for i in range(2)]
    for state in states:  # a new checkpoint gives the same batch id again, as a replay does
        stream_load(spark, str(tmp_path / "in"), name, state, LoadSetting(null_string="NA", reject_path=bad)).awaitTermination()
        spark.catalog.refreshTable(name)  # the stream has a session of its own
        assert sorted(map(tuple, spark.table(name).select("a", "b").collect()), key=repr) == [(1, None), (2, "ok")]
        assert [r.value for r in spark.read.text(f"{bad}/*").collect()] == ["x\u0001NA"]
    plain = fresh(spark, "streamed_plain", "a int")
    for wrong in (LoadSetting(truncate=True), LoadSetting(codec="gzip")):
        with pytest.raises(ValueError):
            stream_load(spark, str(tmp_path / "in"), name, states[0], wrong)
    with pytest.raises(ValueError, match="no column 'batch'"):
        stream_load(spark, str(tmp_path / "in"), plain, states[0])


def test_statements_of_every_form(spark, tmp_path):
    name = fresh(spark, "dml_forms", "a bigint, b bigint")
    assert Q.sql_execute(spark, f"-- note; more\n/* x */ INSERT INTO {name} SELECT id, id FROM range(5)") == 5
    assert Q.sql_execute(spark, f"WITH r AS (SELECT 7L AS x) INSERT INTO {name} SELECT x, max(x) FROM r GROUP BY x") == 1
    assert Q.sql_execute(spark, f"INSERT INTO {name} BY NAME SELECT 1L AS b, 9L AS a") == 1
    assert Q.sql_execute(spark, f"INSERT OVERWRITE DIRECTORY '{tmp_path}/d' USING parquet SELECT * FROM {name}") == 7
    assert Q.sql_execute(spark, f"UPDATE {name} AS t SET a = t.a + 100, b = 0 WHERE t.a = 9 OR t.b IN (7)") == 2
    assert Q.sql_execute(spark, f"delete from {name} where a < 2") == 2
    assert sorted(map(tuple, spark.table(name).collect())) == [(2, 2), (3, 3), (4, 4), (107, 0), (109, 0)]
    assert Q.sql_execute(spark, f"DELETE FROM {name}") == 5 and spark.table(name).count() == 0
    assert Q.sql_script(spark, f"INSERT INTO {name} VALUES (1, 1), (2, 2);\nDELETE FROM {name} WHERE a = 1;\n") == {name: 2}
    assert spark.table(name).count() == 1


def test_stream_over_its_limit_fails(spark, tmp_path):
    name = fresh(spark, "streamed_bad", "a int")
    spark.range(4).selectExpr("'x' as value").write.text(str(tmp_path / "in"))
    query = stream_load(spark, str(tmp_path / "in"), name, str(tmp_path / "state"), LoadSetting(error_tolerance=0.5), batch_column=None)
    with pytest.raises(Exception, match="rows rejected"):
        query.awaitTermination()
    assert spark.table(name).count() == 0


def test_script_transform(spark):
    out = script_transform(spark.range(5), "sed s/^/n/", "x string")
    assert sorted(r.x for r in out.collect()) == [f"n{i}" for i in range(5)]


def test_execute_query_counts_every_segment(spark, tmp_path):
    data = [(i, segment, float(i % 9 * 100 - 150)) for i in (*range(1, 400), 7, 7) for segment in ("BUILDING", "FURNITURE", None)]
    data += [(None, "FURNITURE", 500.0), (None, "MACHINERY", 500.0), (35, "HOUSEHOLD", 500.0)]
    spark.createDataFrame(data, "c_custkey bigint, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    rich = [(k, s) for k, s, balance in data if balance > 100]
    kept = [s for k, s in rich if s == "FURNITURE" and (k is None or k % 5 and not 20 <= k <= 40 and k % 7 not in (2, 3) and k % 11 != 4)]
    every = [s for _, s in rich]
    want = {(s, every.count(s), kept.count(s)) for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", None)}
    got = QUERIES["sql_execute"](spark, str(tmp_path)).select("c_mktsegment", "n", "kept")
    assert set(map(tuple, got.collect())) == want and got.count() == 5
    sql = SQL["sql_execute"].replace("from customer", f"from read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    assert set(duckdb.connect().execute(f"select c_mktsegment, n, kept from ({sql})").fetchall()) == want
