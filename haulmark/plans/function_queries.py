"""Column functions, predicates and job-log analytics over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import literals as FL, text as FT
from ..operators import checks as C, joblogs as G
from .inputs import log_lines
from .registry import query, table

# --- scalar functions ------------------------------------------------------------------------------


@query("memory_to_bytes", """
  select l_orderkey, l_linenumber, l_partkey, case l_linenumber when 1 then l_partkey when 2 then l_partkey * 1024 when 3 then l_partkey * 1048576
    when 4 then l_partkey * 1073741824 when 5 then l_partkey * 1099511627776 end as bytes from lineitem""")
def memory_to_bytes(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "concat(cast(l_partkey as string), case l_linenumber when 1 then 'B' when 2 then 'KiB' "
        "when 3 then ' megabytes' when 4 then ' g' when 5 then 'TB' else 'XB' end) as size")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", FL.memory_to_bytes("size").alias("bytes"))


@query("duration_to_nanos", """
  select l_orderkey, l_linenumber, l_partkey, l_partkey * case l_linenumber when 1 then 1 when 2 then 1000 when 3 then 1000000 when 4 then 1000000000
    when 5 then 60000000000 when 6 then 3600000000000 else 86400000000000 end as nanos from lineitem""")
def duration_to_nanos(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "concat(cast(l_partkey as string), case l_linenumber when 1 then ' nanosecond' when 2 then ' micro' "
        "when 3 then 'ms' when 4 then 's' when 5 then 'm' when 6 then ' hours' else 'd' end) as span")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", FL.duration_to_nanos("span").alias("nanos"))


@query("dedent", "select doc_id, concat(lang, chr(10), '  ', source, chr(10), lang) as body from documents")
def dedent(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id", "concat('\\n   \\n      ', lang, '\\n        ', source, '\\n\\t\\n      ', lang, '\\n') as body")
    return rows.select("doc_id", FT.dedent("body").alias("body"))


@query("render_template", """
  select o_orderkey, concat('order ', o_orderpriority, ' of ', n_name, ' (', r_name, ') ', '.') as body
  from orders join nation on n_nationkey = o_custkey % 25 join region on r_regionkey = n_regionkey""")
def render_template(spark, sf):
    """Nation variables refer to region variables; the table is inlined because it is small."""
    nations = table(spark, sf, "nation").selectExpr(
        "concat('nation.', cast(n_nationkey as string)) as name", "concat(n_name, ' (${region.', cast(n_regionkey as string), '})') as value")
    regions = table(spark, sf, "region").selectExpr("concat('region.', cast(r_regionkey as string)) as name", "r_name as value")
    templates = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "concat('order ', o_orderpriority, ' of ${nation.', cast(o_custkey % 25 as string), '} ${?none}.') as body")
    return FT.render_template(templates, ["o_orderkey"], "body", nations.unionByName(regions))


@query("render_template_table", """
  select o_orderkey, concat('for ', c_name, ' in ', c_mktsegment, ', again ', c_name) as body
  from orders join customer on c_custkey = o_custkey""")
def render_template_table(spark, sf):
    """A variable table that grows with the data is joined, with references between variables."""
    customers = table(spark, sf, "customer")
    names = customers.selectExpr("concat('name.', cast(c_custkey as string)) as name", "c_name as value")
    full = customers.selectExpr("concat('full.', cast(c_custkey as string)) as name",
                                "concat('${name.', cast(c_custkey as string), '} in ', c_mktsegment) as value")
    templates = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "concat('for ${full.', cast(o_custkey as string), '}, again ${?name.', cast(o_custkey as string), '}') as body")
    return FT.render_template(templates, ["o_orderkey"], "body", names.unionByName(full))


@query("normalize_uri", """
  select page_id, url as whole, concat('file:/data/', cast(page_id as varchar)) as rel, concat('file:/x/', cast(page_id as varchar)) as abs from pages""")
def normalize_uri(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("page_id", "url", "cast(page_id as string) as rel", "concat('/x/', cast(page_id as string)) as abs")
    return rows.select("page_id", FT.normalize_uri("url", "/data").alias("whole"), FT.normalize_uri("rel", "/data").alias("rel"),
                       FT.normalize_uri("abs", "/data").alias("abs"))


@query("join_path", "select doc_id, concat('/', source, '/', lang, '/', cast(doc_id as varchar)) as path from documents")
def join_path(spark, sf):
    return table(spark, sf, "documents").select("doc_id", FT.join_path(
        F.concat(F.lit("/"), "source", F.lit("/")), F.concat("lang", F.lit("//")), F.col("doc_id").cast("string")).alias("path"))


@query("unescape_char", """
  select event_id, case event_type when 'click' then 'a' when 'view' then chr(9) when 'error' then chr(1) when 'signup' then 'A' else chr(92) end as c from events""")
def unescape_char(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", r"case event_type when 'click' then 'a' when 'view' then r'\t' when 'error' then r'\u0001' when 'signup' then r'\101' else r'\\' end as c")
    return rows.select("event_id", FL.unescape_char("c").alias("c"))


@query("unicode_code", """
  select doc_id, concat(chr(92), 'u', lpad(lower(to_hex(unicode(substr(text, 1, 1)))), 4, '0')) as code from documents""")
def unicode_code(spark, sf):
    return table(spark, sf, "documents").select("doc_id", FL.unicode_code("text").alias("code"))


@query("char_hex", """
  select p_partkey, concat('''\\0x0', lower(to_hex(ascii(substr(p_name, 1, 1)))), '''') as quoted, lower(to_hex(ascii(substr(p_name, 1, 1)))) as bare from part""")
def char_hex(spark, sf):
    first = F.substring("p_name", 1, 1)
    return table(spark, sf, "part").select("p_partkey", FL.char_hex(first).alias("quoted"), FL.char_hex(first, "bare").alias("bare"))


@query("json_or_text", """
  select event_id, case when event_id % 3 = 0 then null else cast(props ->> 'k' as bigint) end as k,
    case when event_id % 3 = 0 then concat('not json ', event_type) end as words from events""")
def json_or_text(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "case when event_id % 3 = 0 then concat('not json ', event_type) else props end as body")
    doc = rows.select("event_id", FT.json_or_text("body").alias("v"))
    return doc.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"),
                      F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")).alias("words"))


@query("mask_tokens", "select o_orderkey, concat('login ***** for ', cast(o_custkey as varchar), ' *****') as shown from orders")
def mask_tokens(spark, sf):
    tokens = F.array(F.lit("login"), F.col("o_orderstatus"), F.lit("for"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", FT.mask_tokens(tokens, [2, 5]).alias("shown"))


@query("parse_bool_literal", """
  select event_id, case event_type when 'click' then true when 'view' then true when 'error' then false when 'signup' then false end as flag from events""")
def parse_bool_literal(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "case event_type when 'click' then 'Yes' when 'view' then 'true' when 'error' then 'NO' when 'signup' then ' false ' else 'maybe' end as word")
    return rows.select("event_id", FL.parse_bool_literal("word").alias("flag"))


@query("row_to_map", "select c_custkey, c_name as dotted, 2 as entries from customer")
def row_to_map(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("customer.name"), "c_nationkey")
    mapped = rows.select("c_custkey", FT.row_to_map(["customer.name", "c_nationkey"]).alias("m"))
    return mapped.select("c_custkey", F.col("m")["customer.name"].alias("dotted"), F.size("m").alias("entries"))


# --- predicates and checks -------------------------------------------------------------------------

_TREE = {"or": ["l_quantity < 5", ["l_discount > 0.05", "l_tax > 0.02"]], "and": ["l_returnflag <> 'N'", True]}


@query("predicate_tree", """
  select l_orderkey, l_linenumber, l_partkey from lineitem
  where (l_quantity < 5 or (l_discount > 0.05 and l_tax > 0.02)) and l_returnflag <> 'N'""")
def predicate_tree(spark, sf):
    return table(spark, sf, "lineitem").where(C.predicate_tree(_TREE)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("predicate_text", """
  select '((l_quantity < 5) or ((l_discount > 0.05) and (l_tax > 0.02))) and ((l_returnflag <> ''N'') and (true))' as text, count(*) as n from lineitem
  where (l_quantity < 5 or (l_discount > 0.05 and l_tax > 0.02)) and l_returnflag <> 'N'""")
def predicate_text(spark, sf):
    label = C.predicate_text(_TREE)
    return table(spark, sf, "lineitem").where(C.predicate_tree(_TREE)).agg(F.lit(label).alias("text"), F.count(F.lit(1)).alias("n"))


@query("when_condition", "select c_custkey from customer where (select count(*) from orders where o_orderstatus = 'F') > 0")
def when_condition(spark, sf):
    state = table(spark, sf, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return C.when(table(spark, sf, "customer").select("c_custkey"), state, "done > 0")


@query("expectations", """
  select 1 as check_no, 'o_totalprice > 0' as expression, 'prices are positive' as description,
    count(case when not o_totalprice > 0 then 1 end) as failed_rows, count(case when not o_totalprice > 0 then 1 end) = 0 as passed from orders
  union all select 2, '((o_orderstatus = ''F'') or (o_custkey > 10))', 'open orders have customers',
    count(case when not (o_orderstatus = 'F' or o_custkey > 10) then 1 end), count(case when not (o_orderstatus = 'F' or o_custkey > 10) then 1 end) = 0 from orders""")
def expectations(spark, sf):
    return C.expectations(table(spark, sf, "orders"), [
        ("o_totalprice > 0", "prices are positive"),
        ({"or": ["o_orderstatus = 'F'", "o_custkey > 10"]}, "open orders have customers")])


@query("reconcile", """
  with s as (select o_orderkey as k, count(*) as n from orders group by 1), t as (select l_orderkey as k, count(*) as n from lineitem group by 1)
  select cast(sum(s.n) as bigint) as source_rows, cast(sum(t.n) as bigint) as target_rows, count(case when t.n is null then 1 end) as missing_keys,
    count(case when s.n is null then 1 end) as extra_keys, count(case when s.n <> t.n then 1 end) as uneven_keys,
    count(case when t.n is null or s.n is null or s.n <> t.n then 1 end) = 0 as matched from s full join t on s.k = t.k""")
def reconcile(spark, sf):
    return C.reconcile(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")),
                       table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@query("reconcile_contents", """
  with t as (select o_orderkey, o_orderkey % 97 = 0 as gone, o_custkey % 50 = 7 as altered, o_orderkey % 101 = 0 as twice from orders)
  select o_orderkey, case when gone then 'missing' when altered then 'changed' else 'extra' end as kind,
    cast(case when gone or altered then 1 else 0 end as bigint) as source_only,
    cast(case when gone then 0 when altered then case when twice then 2 else 1 end else 1 end as bigint) as target_only
  from t where gone or altered or twice
  union all select -o_orderkey - 1, 'extra', 0, 1 from orders where o_orderkey % 89 = 0""")
def reconcile_contents(spark, sf):
    source = table(spark, sf, "orders").withColumn("note", F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")))
    kept = source.where("o_orderkey % 97 <> 0")
    altered = kept.withColumn("note", F.expr("if(o_custkey % 50 = 7, if(note is null, o_orderstatus, null), note)"))
    target = altered.unionByName(altered.where("o_orderkey % 101 = 0")).unionByName(
        source.where("o_orderkey % 89 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    return C.reconcile_contents(source, target.select(*reversed(target.columns)), ["o_orderkey"])


# --- job logs --------------------------------------------------------------------------------------

@query("hive_rows_by_table", """
  select concat(case when event_type = 'click' then '' else 'db.' end, event_type) as table_name, cast(sum(user_id + 1) as bigint) as rows
  from events where event_type in ('click', 'view') group by 1""")
def hive_rows_by_table(spark, sf):
    return G.hive_rows_by_table(log_lines(spark, sf, """case event_type
        when 'click' then concat(cast(user_id + 1 as string), ' Rows loaded to click')
        when 'view' then concat('Table db.view stats: [numFiles=1, numRows=', cast(user_id + 1 as string), ', totalSize=5120, rawDataSize=70400]')
        else concat('INFO ', cast(user_id as string), ' Rows loaded') end"""))


@query("hive_partition_rows", """
  select concat('db.', event_type) as table_name, cast(sum(user_id) as bigint) as rows from events where event_type <> 'error' group by 1""")
def hive_partition_rows(spark, sf):
    return G.hive_partition_rows(log_lines(spark, sf, """case when event_type = 'error' then 'no statistics here'
        when event_type = 'view' then concat('INFO  : Table db.view stats: [numFiles=4, numRows=', cast(user_id as string), ', totalSize=9, rawDataSize=8]')
        else concat('INFO  : Partition db.', event_type, ' {event_date=2017-12-01, country=us} stats: [numFiles=4, numRows=', cast(user_id as string), ', totalSize=9, rawDataSize=8]') end"""))


@query("mr_counters", """
  select user_id as job_id, coalesce(max_by(event_id, event_id) filter (event_type = 'click'), 0) as input_records,
    coalesce(max_by(event_id * 2, event_id) filter (event_type = 'view'), 0) as output_records from events group by 1""")
def mr_counters(spark, sf):
    return G.mr_counters(log_lines(spark, sf, """case event_type
        when 'click' then concat('17/01/01 INFO mapred.JobClient:     Map input records=', cast(event_id as string))
        when 'view' then concat('17/01/01 INFO mapred.JobClient:     MAP OUTPUT RECORDS=', cast(event_id * 2 as string), '  ')
        else concat('Map input records=', cast(event_id as string), ' or so') end"""))


@query("map_output_rows", """
  select user_id as job_id, coalesce(max_by(event_id, event_id) filter (event_type = 'click'), 0) as rows_loaded from events group by 1""")
def map_output_rows(spark, sf):
    return G.map_output_rows(log_lines(spark, sf, """case event_type when 'click' then concat('   Map output records=', cast(event_id as string))
        else concat('INFO Map output records=', cast(event_id as string)) end"""))


_BULK_SQL = """
  select user_id as job_id, coalesce(max_by(event_id * 10, event_id) filter (event_type = 'click'), 0) as sent,
    coalesce(max_by(event_id, event_id) filter (event_type = 'view'), 0) as loaded,
    coalesce(max_by(event_id, event_id) filter (event_type = 'error' and event_id % 2 = 0), 0) as err_table1,
    coalesce(max_by(event_id, event_id) filter (event_type = 'error' and event_id % 2 = 1), 0) as err_table2,
    coalesce(max_by(event_id * 7, event_id) filter (event_type = 'signup'), 0) as duplicate,
    coalesce(max_by(event_id * 3, event_id) filter (event_type = 'purchase' and event_id % 3 = 0), 0) as err_file,
    max_by(concat('job-', cast(event_id as varchar)), event_id) filter (event_type = 'purchase' and event_id % 3 = 1) as job_name,
    max_by(concat('/logs/', cast(event_id as varchar), '.out'), event_id) filter (event_type = 'purchase' and event_id % 3 = 2) as log_file
  from events group by 1"""


@query("bulk_load_counters", f"""
  select *, sent + err_file as source, err_table1 + err_table2 + duplicate + err_file as rejected from ({_BULK_SQL})""")
def bulk_load_counters(spark, sf):
    return G.bulk_load_counters(log_lines(spark, sf, """case
        when event_type = 'click' then concat('tpt_writer: Total Rows Sent To RDBMS:      ', cast(event_id * 10 as string))
        when event_type = 'view' then concat('tpt_writer: Total Rows Applied:           ', cast(event_id as string))
        when event_type = 'error' then concat('tpt_writer: Total Rows in Error Table ', cast(event_id % 2 + 1 as string), ':  ', cast(event_id as string))
        when event_type = 'signup' then concat('tpt_writer: Total Duplicate Rows:       ', cast(event_id * 7 as string))
        when event_id % 3 = 0 then concat('tpt_reader: TPT19229 ', cast(event_id * 3 as string), ' error rows sent to error file /tmp/x')
        when event_id % 3 = 1 then concat('Teradata Parallel Transporter Version: Job id is job-', cast(event_id as string), ',running on host')
        else concat('Job log: /logs/', cast(event_id as string), '.out') end"""))


@query("stream_load_counters", """
  select *, error_table + error_file as rejected, loaded + error_table + error_file as source from (
    select user_id as job_id, coalesce(max_by(event_id, event_id) filter (event_type = 'click'), 0) as loaded,
      coalesce(max_by(event_id * 3, event_id) filter (event_type = 'view'), 0) as error_file,
      max_by(concat('root-', cast(event_id as varchar)), event_id) filter (event_type = 'error') as job_name,
      max_by(concat('/var/log/', cast(event_id as varchar)), event_id) filter (event_type = 'signup') as log_file,
      count(case when event_type = 'purchase' then 1 end) as error_table from events group by 1)""")
def stream_load_counters(spark, sf):
    lines = log_lines(spark, sf, """case event_type
        when 'click' then concat('tpt_writer: Rows Inserted: ', cast(event_id as string))
        when 'view' then concat('tpt_reader: TPT19229 ', cast(event_id * 3 as string), ' error rows sent to error file /tmp/x')
        when 'error' then concat('Teradata Parallel Transporter: Job id is root-', cast(event_id as string), ', running on host')
        when 'signup' then concat('Job log: /var/log/', cast(event_id as string)) else 'other' end""")
    found = table(spark, sf, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("job_id")).agg(
        F.count(F.lit(1)).alias("error_table"))
    return G.stream_load_counters(lines, found)


@query("fastload_error_records", """
  select event_id, case when event_type = 'click' then 'ET' else 'UV' end as kind, case when event_type = 'click' then concat('F_', cast(user_id as varchar)) end as field,
    case when event_type = 'click' then cast(user_id as integer) end as code,
    case when event_type = 'click' then event_type else concat('col1=', cast(event_id as varchar), ',col2=', cast(user_id as varchar)) end as record
  from events where event_type in ('click', 'view')""")
def fastload_error_records(spark, sf):
    messages = table(spark, sf, "events").select("event_id", F.expr("""case event_type
        when 'click' then concat('table "t_ERR_1" contains an error record\\nErrorCode=', cast(user_id as string), '\\nErrorFieldName=F_', cast(user_id as string),
            '\\nActualDataParcelLength=5\\nDataParcel:\\n00000  ', regexp_replace(hex(event_type), '(..)', '$1 '))
        when 'view' then concat('table "t_ERR_2" contains a duplicate\\r\\ncol1=', cast(event_id as string), '\\r\\ncol2=', cast(user_id as string))
        else 'table "other_ERR_1"' end""").alias("message"))
    return G.fastload_error_records(messages, "t")


@query("tsv_first_row", """
  select user_id as job_id, string_agg(event_type, '=' order by event_id) as pair from (
    select *, row_number() over (partition by user_id order by event_id) as n from events) where n <= 2 group by 1""")
def tsv_first_row(spark, sf):
    lines = log_lines(spark, sf, "concat('a\\t', event_type)")
    out = G.tsv_first_row(lines)
    return out.select("job_id", F.array_join(F.concat(
        F.slice(F.map_keys("values"), 2, 1), F.slice(F.map_values("values"), 2, 1)), "=").alias("pair"))


@query("boxed_table_first_row", """
  select user_id as job_id, max(case when n = 2 then event_type end) as name, max(case when n = 4 then cast(event_id as varchar) end) as value from (
    select *, row_number() over (partition by user_id order by event_id) as n from events where event_id % 2 = 0) where n <= 4 group by 1""")
def boxed_table_first_row(spark, sf):
    lines = log_lines(spark, sf, """case when event_id % 2 = 0 then concat('|  ', event_type, '  | id |') else '' end""")
    values = log_lines(spark, sf, """case when event_id % 2 = 0 then concat('|  ', cast(event_id as string), ' | 7 |') else '' end""")
    # Header from one rendering, row from the other: the fourth non-empty line carries the id.
    names = G.boxed_table_first_row(lines).select("job_id", F.map_keys("values")[0].alias("name"))
    cells = G.boxed_table_first_row(values).select("job_id", F.map_values("values")[0].alias("value"))
    return names.join(cells, "job_id")


@query("running_jobs", """
  select user_id as job_id, event_id as line_no, concat('nightly-', cast(user_id as varchar), ' running') as line from events where event_type = 'click'""")
def running_jobs(spark, sf):
    return G.running_jobs(log_lines(spark, sf, """case event_type when 'click' then concat('  nightly-', cast(user_id as string), ' running ')
        when 'view' then 'nightly-x running' else 'hourly-3' end"""), "nightly")
