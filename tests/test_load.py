"""The nine-column load target: rejects, blanks, widths, tolerance, globs and the composed load."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from haulmark.operators import load as L, stats as S, tables as T, validate as V
from haulmark.operators.stats import LoadRejected
from haulmark.schema import names, target
from haulmark.settings import LoadSetting
from haulmark.sources import delimited as D

TAIL = "TRUE,-7,640000123456,215.5,06:05:04,2003-02-28,2003-02-28 23:59:01"
NINE = target(("col1", "int"), ("col2", "varchar(10)"), ("col3", "boolean"), ("col4", "tinyint"), ("col5", "bigint"),
              ("col6", "decimal(6,2)"), ("col7", "time"), ("col8", "date"), ("col9", "timestamp_ntz"))
BAD_INT = [f"7,anvil,{TAIL}", f"19,bellows,{TAIL}", f"23,crowbar,{TAIL}", f"3O,drill,{TAIL}", f"41,easel,{TAIL}"]


@pytest.fixture
def nine(spark, request):
    name = "t_" + request.node.name.split("[")[0].replace("test_", "")[:40]
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} (" + ", ".join(f"{c.name} {c.storage_type if c.type == 'time' else c.type}" for c in NINE)
              + ") USING parquet")
    return name


def classify(spark, lines, columns=NINE, setting=LoadSetting()):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return V.check_rows(D.split_lines(df, names(columns), setting), columns)


def test_bad_int_is_rejected_and_counted(spark, nine, tmp_path):
    (tmp_path / "in.csv").write_text("\n".join(BAD_INT) + "\n")
    out = L.load(spark, str(tmp_path / "in.csv"), nine, LoadSetting(reject_path=str(tmp_path / "rejects")), NINE)
    assert (out.total, out.loaded, out.rejected) == (5, 4, 1)
    assert spark.table(nine).count() == 4
    rejects = [r.value for r in spark.read.text(str(tmp_path / "rejects")).collect()]
    assert rejects == ["3O\u0001drill\u0001" + TAIL.replace(",", "\u0001")]


def test_tolerance(spark, nine, tmp_path):
    lines = BAD_INT[:2] + [BAD_INT[3], "1,a,true,1,1,1.0,06:05:00", "1,a"]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    with pytest.raises(LoadRejected, match="60.00%"):
        L.load(spark, str(tmp_path / "in.csv"), nine, LoadSetting(error_tolerance=0.5, check_first=True), NINE)
    assert spark.table(nine).count() == 0
    assert L.load(spark, str(tmp_path / "in.csv"), nine, LoadSetting(error_tolerance=0.7), NINE).loaded == 2


def test_blanks_are_null(spark):
    out = classify(spark, [BAD_INT[0], f"23,,{TAIL}", f",easel,{TAIL}"])
    assert out.where("_reason is not null").count() == 0
    assert out.where("col1 = 23").first().col2 is None
    assert out.where("col2 = 'easel'").first().col1 is None


def test_width_reject(spark):
    lines = [x.replace(",", "\u0001") for x in BAD_INT[:3] + [f"30,screwdrivers,{TAIL}", BAD_INT[4]]]
    out = classify(spark, lines, setting=LoadSetting(delimiter="\u0001"))
    assert [r._reason for r in out.where("_reason is not null").collect()] == ["width:col2"]
    assert S.load_stats(out).first().loaded == 4


def test_arity_and_blank_lines(spark):
    out = classify(spark, ["1,2", "", BAD_INT[0] + ",extra", BAD_INT[0]])
    assert sorted(str(r._reason) for r in out.collect()) == ["None", "arity", "arity", "arity"]


@pytest.mark.parametrize("kind,good,bad", [
    ("int", ["12", "+12", "-2147483648", "007"], [" 12", "12 ", "1.0", "2147483648", "1e3", "0x1", "\t1", "1\u0001", "--1", "+", "1,2", "/1"]),
    ("tinyint", ["127", "-128"], ["128", "a"]),
    ("smallint", ["32767"], ["32768"]),
    ("bigint", ["9223372036854775807"], ["9223372036854775808"]),
    ("decimal(6,2)", ["4410.06", "1e2", ".5", "5.", "1.005"], ["12345.6", " 1", "1 ", "1,5", "NaN", ".", "1e", "--1", "1/2", "/"]),
    ("double", ["1.0d", " 1.5 ", "NaN", "-Infinity", "1e400", ".5f", "0x1p3"], ["inf", "nan", "1,5", "abc", "1.0x", "Infinity1", "-inf", "1 2"]),
    ("float", ["1.5f", "3"], ["x"]),
    ("date", ["2003-02-28", "2003-2-8"], ["2003/02/28", "03-02-28", "2003-13-01", "2003-02-28 00:00:00", "2003-2-8 1", "2003-02- 8", "2003-02-8 ", "2003-02", "2003", "2003-02-T1", "+903-02-28", "20030-02-8", "2003-2-8T1"]),
    ("time", ["06:05:00", "1:2:3"], ["24:00:00", "12:60:00", "06:05"]),
    ("timestamp_ntz", ["2003-02-28 06:05:00", "2003-02-28 06:05:00.123456", "2003-2-8 1:2:3"], ["2003-02-28", "2003-02-28T06:05:00", "x", "2003-02-28 06:05", "2003-02-28 06:05:0Z", "2003-02-28 12:61:00", "2003-02-28 06:05:00Z", "2003-02-28 06:05:00+01"]),
    ("boolean", ["true", "TRUE", "yes", "anything"], []),
    ("varchar(3)", ["abc"], ["abcd"]),
    ("string", ["anything at all"], []),
])
def test_typed_cells(spark, kind, good, bad):
    cols = target(("a", kind), ("b", "string"))
    df = spark.createDataFrame([(x, "good") for x in good] + [(x, "bad") for x in bad], "a string, b string")
    out = V.check_rows(df, cols)
    assert {r.b for r in out.where("_reason is null").select("b").collect()} == {"good"}
    assert out.where("_reason is not null").count() == len(bad)
    assert out.where("_reason is not null and b = 'good'").count() == 0
    assert dict(out.dtypes)["a"] == cols[0].storage_type


def test_boolean_is_never_rejected(spark):
    df = spark.createDataFrame([("true",), ("TRUE",), ("yes",), ("1",), ("",)], "a string")
    assert [r.a for r in V.check_rows(df, target(("a", "boolean"))).collect()] == [True, True, False, False, None]


def test_time_is_normalised(spark):
    df = spark.createDataFrame([("1:2:3",), ("23:59:59",)], "a string")
    assert [r.a for r in V.check_rows(df, target(("a", "time"))).collect()] == ["01:02:03", "23:59:59"]


def test_not_null_column(spark):
    df = spark.createDataFrame([("", "x"), ("1", "y")], "a string, b string")
    out = V.check_rows(df, target(("a", "int", False), ("b", "string")))
    assert [(r.b, r._reason) for r in out.collect()] == [("x", "null:a"), ("y", None)]


def test_null_marker_only_in_nullable_columns(spark):
    df = spark.createDataFrame([("NA", "NA")], "a string, b string")
    row = V.check_rows(df, target(("a", "string"), ("b", "string", False)), "NA").first()
    assert (row.a, row.b, row._reason) == (None, "NA", None)


def test_quoted_fields(spark):
    setting = LoadSetting(quoting=True)
    df = spark.createDataFrame([('1,"a,b"',), ('2,"x\\"y"',), ("3",), ("4,a,b",), ("",), ('5,""',)], "value string")
    cols = target(("a", "int"), ("b", "string"))
    out = V.check_rows(D.split_lines(df, ["a", "b"], setting), cols)
    assert [(r.a, r.b, r._reason) for r in out.where("_reason is null").orderBy("a").collect()] == [
        (1, "a,b", None), (2, 'x"y', None), (5, None, None)]
    assert sorted(r._reject for r in out.where("_reason = 'arity'").collect()) == ["", "3", "4,a,b"]


def test_unquoted_reader_keeps_quotes(spark):
    df = spark.createDataFrame([('"a",b',)], "value string")
    assert D.split_lines(df, ["x", "y"]).first()["x"] == '"a"'


def test_strict_load_fails_on_the_first_bad_row(spark, nine):
    df = spark.createDataFrame([(x,) for x in BAD_INT], "value string")
    fields = D.split_lines(df, names(NINE))
    with pytest.raises(Exception, match="rejected row"):
        T.load_strict(fields, nine, NINE)
    assert spark.table(nine).count() == 0
    assert T.load_strict(fields.where("col1 <> '3O'"), nine, NINE) == 4


def test_rebuild_drops_side_tables_and_reloads(spark, nine):
    spark.sql(f"CREATE TABLE {nine}_et (x int) USING parquet")
    fields = D.split_lines(spark.createDataFrame([(x,) for x in BAD_INT], "value string"), names(NINE))
    for _ in range(2):
        loaded, rejects = T.load_rebuild(fields, nine, NINE)
        assert (loaded, rejects.count(), spark.table(nine).count()) == (4, 1, 4)
    assert not spark.catalog.tableExists(f"{nine}_et")


def test_truncate_first(spark, nine, tmp_path):
    (tmp_path / "in.csv").write_text("\n".join(BAD_INT) + "\n")
    for _ in range(2):
        L.load(spark, str(tmp_path / "in.csv"), nine, LoadSetting(truncate=True), NINE)
    assert spark.table(nine).count() == 4


def test_empty_source_is_skipped(spark, nine, tmp_path):
    (tmp_path / "in.csv").write_text("")
    assert L.skip_if_empty(spark, str(tmp_path / "in.csv"))
    out = L.load(spark, str(tmp_path / "in.csv"), nine, LoadSetting(mode="auto", error_tolerance=0.1), NINE)
    assert (out.total, out.rejected, out.mode) == (0, 0, "default")


def test_rejects_of_an_earlier_run_are_cleared(spark, nine, tmp_path):
    setting = LoadSetting(reject_path=str(tmp_path / "rejects"), mode="auto", truncate=True)
    for text, loaded, rejected in (("\n".join(BAD_INT), 4, 1), (BAD_INT[0], 1, 0), ("\n".join(BAD_INT), 4, 1), ("", 0, 0)):
        (tmp_path / "in.csv").write_text(text)
        out = L.load(spark, str(tmp_path / "in.csv"), nine, setting, NINE)
        assert (out.loaded, out.rejected, spark.table(nine).count()) == (loaded, rejected, loaded)
        assert spark.read.text(str(tmp_path / "rejects")).count() == rejected


def test_glob_load(spark, nine, tmp_path):
    ids = iter([100, 101, 102, 103, 104, 105, 106, 106])
    for d in ("dir1", "dir2"):
        (tmp_path / d).mkdir()
        for f in ("file1.txt", "file2.txt"):
            (tmp_path / d / f).write_text("".join(f"{next(ids)},x,{TAIL}\n" for _ in range(2)))
    out = L.load(spark, f"{tmp_path}/dir*/*.txt", nine, LoadSetting(), NINE)
    assert out.loaded == 8
    assert spark.table(nine).where("col1 = 106").count() == 2


def test_error_limit(spark):
    rejects = spark.range(50)
    assert S.error_limit(rejects, 49).first()[0] and not S.error_limit(rejects, 50).first()[0]
    with pytest.raises(LoadRejected):
        S.check_error_limit(51, 50)


def test_tolerance_of_nothing_read(spark):
    stats = spark.sql("select 0L as total, 0L as loaded, 0L as rejected")
    assert S.error_tolerance(stats, 0.0).first().passed
    S.check_tolerance(0, 0, 0.0)


def test_fatal_codes(spark):
    S.check_fatal(spark.createDataFrame([(1145,), (1159,)], "code int"))
    with pytest.raises(LoadRejected, match="7"):
        S.check_fatal(spark.createDataFrame([(1145,), (7,)], "code int"))


def test_auto_mode():
    assert S.auto_mode(104857601) == ("bulk", 80000)
    assert S.auto_mode(104857600) == ("default", 4000)
    assert S.auto_mode(10 ** 12, "default", 100) == ("default", 100)


def test_hot_key_and_hot_copies(spark):
    """A key and a row that hold a third of the table each: nothing is lost, one row per key is kept."""
    hot = spark.range(3000).selectExpr("1L as k", "id % 1500 as v", "'a' as s")
    copies = spark.range(3000).selectExpr("2L as k", "7L as v", "'b' as s")
    rest = spark.range(3000).selectExpr("id + 10 as k", "id as v", "'c' as s")
    kept, uv = V.unique_violations(hot.union(copies).union(rest), ["k"], ["v"])
    assert kept.count() == 3002
    assert [tuple(r) for r in kept.where("k < 3").orderBy("k").collect()] == [(1, 0, "a"), (2, 7, "b")]
    assert uv.agg(F.sum("copies")).first()[0] == 2999 + 2999
    one, dropped = V.drop_duplicate_rows(hot.union(copies).union(rest))
    assert one.count() == 1500 + 1 + 3000 and dropped.first()[0] == 1500 + 2999


def test_repair_utf8(spark):
    df = spark.sql("select cast(x'61ff62' as string) as a, 'ok \N{REPLACEMENT CHARACTER}' as b")
    row = df.select(V.repair_utf8("a").alias("a"), V.repair_utf8("b").alias("b")).first()
    assert (row.a, row.b) == ("a b", "ok \N{REPLACEMENT CHARACTER}")


def test_error_sample_in_source_order(spark, tmp_path):
    (tmp_path / "in.txt").write_text("".join(f"{i},x\n" for i in range(100)))
    lines = D.scan_lines(spark, str(tmp_path / "in.txt"), LoadSetting(skip_lines=3), positions=True)
    first = S.error_sample(lines, [D.SOURCE, D.BLOCK, D.SEQ], 3)
    assert [r.value for r in first.collect()] == ["3,x", "4,x", "5,x"]


def test_settings_are_checked():
    for wrong in ({"delimiter": "ab"}, {"mode": "fast"}, {"error_tolerance": 60}, {"multi_line": True}):
        with pytest.raises(ValueError):
            LoadSetting(**wrong)
    assert LoadSetting(header=True, skip_lines=0).skip_rows == 0


def test_rejects_are_the_rows_as_read(spark, tmp_path):
    """The null marker does not show in the reject file."""
    name = "t_verbatim"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} (a int, b string) USING parquet")
    (tmp_path / "in.csv").write_text("x,NA\n1,NA\n2,ok\n")
    setting = LoadSetting(null_string="NA", repair_utf8=True, reject_path=str(tmp_path / "bad"))
    out = L.load(spark, str(tmp_path / "in.csv"), name, setting, target(("a", "int"), ("b", "string")))
    assert (out.loaded, out.rejected) == (2, 1)
    assert sorted(map(tuple, spark.table(name).collect())) == [(1, None), (2, "ok")]
    assert [r.value for r in spark.read.text(str(tmp_path / "bad")).collect()] == ["x\u0001NA"]
    fields = spark.createDataFrame([("x", bytearray(b"q\xffz"))], "a string, b binary").selectExpr("a", "cast(b as string) as b")
    row = V.check_rows(fields, target(("a", "int"), ("b", "string")), repair=True).selectExpr("b", "hex(_reject) as read").first()
    assert (row.b, row.read) == ("q z", "78" + "01" + "71FF7A")


@pytest.mark.parametrize("mode", ["default", "bulk", "auto"])
def test_an_empty_file_is_loaded_alike_in_all_modes(spark, tmp_path, mode):
    name = f"t_empty_{mode}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} (a int) USING parquet")
    spark.sql(f"INSERT INTO {name} VALUES (1)")
    (tmp_path / "in.csv").write_text("")
    out = L.load(spark, str(tmp_path / "in.csv"), name, LoadSetting(truncate=True, mode=mode), target(("a", "int"),))
    assert (out.total, spark.table(name).count()) == (0, 0)


def test_a_load_reads_its_source_once_and_a_refused_one_changes_nothing(spark, tmp_path, monkeypatch):
    """The source is gone before anything is inserted or any reject written, whatever the number of rejects."""
    source, bad = tmp_path / "in.csv", str(tmp_path / "bad")
    name = "load_once"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} (a int, b string) USING parquet")
    written = L.pinned

    def then_gone(*args, **kwargs):
        out = written(*args, **kwargs)
        source.unlink()
        return out

    monkeypatch.setattr(L, "pinned", then_gone)
    for rejects, limit, ok in ((0, 0, True), (3, 3, True), (4, 3, False), (90, None, True)):
        source.write_text("".join(f"{'x' if i < rejects else ''}{i},v\n" for i in range(100)))
        before = spark.table(name).count()
        setting = LoadSetting(reject_path=bad, error_limit=limit)
        if ok:
            out = L.load(spark, str(source), name, setting)
            assert (out.total, out.loaded, out.rejected) == (100, 100 - rejects, rejects)
        else:
            with pytest.raises(LoadRejected, match=f"{rejects} rows"):
                L.load(spark, str(source), name, setting)
        assert spark.table(name).count() == before + (100 - rejects if ok else 0)
        assert sorted(r.value for r in spark.read.text(bad).collect()) == sorted(f"x{i}\u0001v" for i in range(rejects))
