"""Job-log lines with known counters. All names and numbers are made up here; only the line shapes are given."""

from __future__ import annotations

from haulmark.operators import joblogs as G


def log(spark, *lines, job="j"):
    return spark.createDataFrame([(job, i, x) for i, x in enumerate(lines)], "job_id string, line_no long, line string")


def test_rows_by_table(spark):
    out = G.hive_rows_by_table(log(
        spark, "31 Rows loaded to parcels", "6 Rows loaded to parcels", "x 9 Rows loaded to parcels",
        "Table depot.parcels stats: [numFiles=2, numRows=418, totalSize=907, rawDataSize=3300]"))
    assert {r.table_name: r.rows for r in out.collect()} == {"parcels": 37, "depot.parcels": 418}


def test_partition_rows(spark):
    line = "INFO  : Partition depot.trips {leg=%d, port=oslo} stats: [numFiles=3, numRows=%d, totalSize=11, rawDataSize=13]"
    out = G.hive_partition_rows(log(spark, *[line % (i, 600 + 10 * i) for i in range(4)],
                                    "Table depot.crew stats: [numFiles=1, numRows=23, x]", "none"))
    assert {r.table_name: r.rows for r in out.collect()} == {"depot.trips": 2460, "depot.crew": 23}


def test_map_counters(spark):
    at = "21/09/14 INFO mapred.JobClient:     "
    out = G.mr_counters(log(spark, at + "Map input records=41", at + "Map input records=57", at + "Map output records=66"))
    assert out.first()[:] == ("j", 57, 66)
    assert G.map_output_rows(log(spark, "  Map output records=66", "x Map output records=67")).first()[:] == ("j", 66)


def test_bulk_counters(spark):
    r = G.bulk_load_counters(log(
        spark, "Teradata Parallel Transporter Version: Job id is freight-7,running on quay", "Job log: /var/spool/freight-7.out",
        "tpt_writer: Total Rows Sent To RDBMS:      82013", "tpt_writer: Total Rows Applied:             81990",
        "tpt_writer: Total Rows in Error Table 1:   14", "tpt_writer: Total Rows in Error Table 2:   5",
        "tpt_writer: Total Duplicate Rows:          4")).first()
    assert (r.sent, r.loaded, r.err_table1, r.err_table2, r.duplicate, r.err_file) == (82013, 81990, 14, 5, 4, 0)
    assert (r.source, r.rejected, r.job_name, r.log_file) == (82013, 23, "freight-7", "/var/spool/freight-7.out")


def test_bulk_error_file_rows(spark):
    r = G.bulk_load_counters(log(spark, "tpt_writer: Total Rows Sent To RDBMS:  7200",
                                 "tpt_reader: TPT19229 1387 error rows sent to error file /srv/bad")).first()
    assert (r.err_file, r.source, r.rejected) == (1387, 8587, 1387)


def test_stream_counters(spark):
    lines = log(spark, "tpt_writer: Rows Inserted: 2750", "tpt_reader: TPT19229 38 error rows sent to error file /srv/bad")
    r = G.stream_load_counters(lines).first()
    assert (r.loaded, r.error_file, r.error_table, r.rejected, r.source) == (2750, 38, 0, 38, 2788)
    counted = spark.createDataFrame([("j", 12)], "job_id string, error_table long")
    assert G.stream_load_counters(lines, counted).first().source == 2800


def test_error_records(spark):
    parcel = bytes([2, 0, 65, 66, 67, 10, 200, 31, 33, 126])
    dump = " ".join(f"{b:02x}" for b in parcel) + "   |" + "".join(chr(b) if 32 <= b < 127 else "." for b in parcel) + "|"
    et = "\n".join(['[Error 1160] table "depot.crates_ERR_1" contains rows', "ErrorCode=2679", "ErrorFieldName=weight",
                    f"ActualDataParcelLength={len(parcel)}",
                    f"DataParcel: byte array length {len(parcel)} (0x{len(parcel):x}), offset 0 (0x0), dump length {len(parcel)} (0x{len(parcel):x})",
                    "00000    " + dump])
    uv = 'table "depot.crates_ERR_2" contains rows\r\ncrate=91\r\nport=riga\r\nseen=2020-02-29'
    df = spark.createDataFrame([(1, et), (2, uv), (3, "other"), (4, '"crates_ERR_1"\nbroken')], "id int, message string")
    out = {r.id: r for r in G.fastload_error_records(df, "crates").collect()}
    assert (out[1].kind, out[1].field, out[1].code) == ("ET", "weight", 2679)
    assert out[1].record == parcel.decode("latin-1")
    assert (out[2].kind, out[2].record) == ("UV", "crate=91,port=riga,seen=2020-02-29")
    assert (out[4].field, out[4].code, out[4].record) == ("", -1, "") and 3 not in out


def test_first_rows(spark):
    assert G.tsv_first_row(log(spark, "crate\tport", "55\tturku", "56\tgdynia")).first()["values"] == {"crate": "55", "port": "turku"}
    rule = "+----------+--+"
    box = log(spark, "", rule, "|  crates  |", rule, "| 7712     |", rule)
    assert G.boxed_table_first_row(box).first()["values"] == {"crates": "7712"}


def test_running_jobs(spark):
    out = G.running_jobs(log(spark, "  load-12 RUNNING ", "load-x", "reload-3", "other"), "load")
    assert sorted(r.line for r in out.collect()) == ["load-12 RUNNING", "reload-3"]
