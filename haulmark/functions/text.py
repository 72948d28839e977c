"""Text, path, JSON and map helpers as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import pinned, scratch_path
from .literals import as_column

PLACEHOLDER = r"\$\{(\??)(.+?)\}"
# The mask, the percent codes (the percent sign first), and how many variables are looked up inside an expression before the
# table join takes over (the lookup is linear in the map).
MASK = "*****"
URI_CODES = {"%": "%25", " ": "%20", "?": "%3F", "#": "%23"}


def dedent(col: Column | str) -> Column:
    """Drop blank lines and strip the smallest common indent."""
    lines = F.filter(F.split(as_column(col), "\n", -1), lambda x: F.length(F.trim(_tabs(x))) > 0)
    indent = F.array_min(F.transform(lines, lambda x: F.length(F.regexp_extract(x, r"^(\s*)", 1))))
    return F.array_join(F.transform(lines, lambda x: x.substr(indent + 1, F.length(x))), "\n")


def _tabs(x: Column) -> Column:
    return F.regexp_replace(x, r"[\x00-\x20]+", "")


def normalize_uri(col: Column | str, base: str = "/") -> Column:
    """A path without a scheme becomes an absolute ``file:`` URI under ``base``.

    Characters that would end or change the path of a URI are percent-encoded.
    """
    c = as_column(col)
    root = base.rstrip("/")
    absolute = F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(root + "/"), c))
    path = F.regexp_replace(F.regexp_replace(absolute, "/+", "/"), "(.)/$", "$1")
    for char, code in URI_CODES.items():
        path = F.replace(path, F.lit(char), F.lit(code))
    return F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), c).otherwise(F.concat(F.lit("file:"), path))


def join_path(*cols: Column | str) -> Column:
    """Parts folded from the root, with doubled slashes collapsed and none left at the end."""
    joined = F.concat(F.lit("/"), F.concat_ws("/", *[as_column(c) for c in cols]))
    return F.regexp_replace(F.regexp_replace(joined, "/+", "/"), "(.)/$", "$1")


def json_or_text(col: Column | str) -> Column:
    """Valid JSON as a VARIANT document, any other text as a VARIANT string."""
    c = as_column(col)
    return F.coalesce(F.try_parse_json(c), c.cast("variant"))


def mask_tokens(col: Column | str, positions: Sequence[int]) -> Column:
    """Tokens at the given 1-based positions become ``*****``; joined by a space."""
    hidden = [p - 1 for p in positions]
    return F.array_join(
        F.transform(as_column(col), lambda x, i: F.when(i.isin(*hidden), F.lit(MASK)).otherwise(x) if hidden else x), " ")


def row_to_map(cols: Sequence[str]) -> Column:
    """Columns as a name/value map; a dot in a name stays part of the name."""
    pairs = []
    for c in cols:
        pairs += [F.lit(c), F.col(f"`{c}`").cast("string")]
    return F.create_map(*pairs)


def _substitute(text: Column, value_of) -> Column:
    """Replace every placeholder by ``value_of(name, optional)``."""
    literals = F.split(text, r"\$\{\??.+?\}", -1)
    tokens = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    whole = "^" + PLACEHOLDER + "$"
    values = F.transform(tokens, lambda t: value_of(F.regexp_extract(t, whole, 2), F.regexp_extract(t, whole, 1) == "?"))
    pieces = F.zip_with(literals, F.concat(values, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(text.contains("${"), F.array_join(pieces, "")).otherwise(text)


def render_with(col: Column | str, variables: Mapping[str, str]) -> Column:
    """Placeholders filled from variables given in the program, which are written out in the expression."""
    flat = resolve_variables(variables)
    known = F.create_map(*[F.lit(x) for pair in flat.items() for x in pair]) if flat else \
        F.create_map().cast("map<string,string>")

    def value_of(name: Column, optional: Column) -> Column:
        return F.coalesce(F.try_element_at(known, name), F.when(optional, F.lit("")),
                          F.raise_error(F.concat(F.lit("unable to resolve variable "), name)).cast("string"))

    return _substitute(as_column(col), value_of)


def resolve_variables(variables: Mapping[str, str]) -> dict[str, str]:
    """Expand variables that refer to variables; a cycle or a missing required name is an error."""
    rgx = re.compile(PLACEHOLDER)
    done: dict[str, str] = {}

    def value(name: str, trail: tuple[str, ...]) -> str:
        if name in trail:
            raise ValueError("variables refer to each other: " + " -> ".join([*trail, name]))
        if name not in done:
            def one(m: re.Match) -> str:
                if m.group(2) in variables:
                    return value(m.group(2), (*trail, name))
                if m.group(1):
                    return ""
                raise ValueError(f"unable to resolve variable {m.group(2)}")

            done[name] = rgx.sub(one, variables[name])
        return done[name]

    for name in variables:
        value(name, ())
    return done


def render_template(df: DataFrame, key: Sequence[str], col: str, variables: DataFrame) -> DataFrame:
    """Fill placeholders of ``df[col]`` from a table of ``(name, value)``; the result replaces ``col``.

    The same joins serve a table of any size; a small one is broadcast by its measured size. Rows that repeat a name with the
    same value are one variable, with different values an error. A variable whose value is NULL counts as not
    given. Variables that refer to variables are filled first, those with no open reference before those that refer to
    them; a round fills what the last one freed, so rounds are as many as the longest chain. Variables that refer to each other
    are never freed, which is an error before any text could grow. ``key`` identifies a template row.
    """
    return _fill_from_table(df, list(key), col, resolve_table(variables))


def resolve_table(variables: DataFrame) -> DataFrame:
    """``(name, value)`` with every reference to another variable filled."""
    same = F.when(F.min("value") == F.max("value"), F.min("value")).otherwise(
        F.raise_error(F.concat(F.lit("variable with different values: "), F.first("name"))).cast("string"))
    table = pinned(variables.where("name is not null and value is not null").groupBy("name").agg(same.alias("value")), "variables")
    tokens = F.regexp_extract_all(F.col("value"), F.lit(PLACEHOLDER), F.lit(2))
    named = table.where(F.col("value").contains("${")).select("name", F.explode(F.array_distinct(tokens)).alias("ref"))
    refs = pinned(named.join(table.select(F.col("name").alias("ref")), "ref", "left_semi"), "references")
    ready = table.join(refs.select("name").distinct(), "name", "left_anti")
    # Each round's variables go to a folder of their own under one path, so that all rounds are one scan.
    path, rounds = scratch_path(variables.sparkSession, "filled"), 0
    filled = table.limit(0)
    while True:
        fresh = pinned(_fill_from_table(ready, ["name"], "value", filled), "filled", f"{path}/round={rounds}")
        filled = variables.sparkSession.read.schema("name string, value string, round int").parquet(path).select("name", "value")
        if refs.isEmpty():
            return filled
        left = pinned(refs.join(fresh.select(F.col("name").alias("ref")), "ref", "left_anti"), "references")
        ready = table.join(refs.select("name").distinct().join(left.select("name").distinct(), "name", "left_anti"), "name", "left_semi")
        if ready.isEmpty():
            some = ", ".join(sorted(r["name"] for r in refs.select("name").distinct().limit(5).collect()))
            raise ValueError(f"variables refer to each other: {some}")
        refs, rounds = left, rounds + 1


def _fill_from_table(df: DataFrame, key: list[str], col: str, table: DataFrame) -> DataFrame:
    """One replacement round; only rows that hold a placeholder take part in the joins."""
    whole = "^" + PLACEHOLDER + "$"
    tokens = F.array_distinct(F.regexp_extract_all(F.col(col), F.lit(PLACEHOLDER), F.lit(0)))
    refs = df.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.explode(tokens).alias("_token")) \
        .withColumn("_ref", F.regexp_extract("_token", whole, 2))
    # One variable may be named by a large share of the templates; the references are the side that can be split.
    values = refs.join(table.select(F.col("name").alias("_ref"), F.col("value").alias("_value")), "_ref", "left")
    checked = F.coalesce(F.col("_value"), F.when(F.col("_token").startswith("${?"), F.lit("")), F.raise_error(
        F.concat(F.lit("unable to resolve variable "), F.col("_ref"))).cast("string"))
    maps = values.groupBy(*[f"_k_{k}" for k in key]).agg(
        F.map_from_entries(F.collect_list(F.struct("_token", checked))).alias("_values"))
    literals = F.split(F.col(col), r"\$\{\??.+?\}", -1)
    found = F.regexp_extract_all(F.col(col), F.lit(PLACEHOLDER), F.lit(0))
    filled = F.array_join(F.zip_with(literals, F.concat(
        F.transform(found, lambda t: F.try_element_at(F.col("_values"), t)), F.array(F.lit(""))),
        lambda a, b: F.concat(a, b)), "")
    on = [F.col(k) == F.col(f"_k_{k}") for k in key]
    out = df.join(maps, on, "left")
    return out.withColumn(col, F.when(F.col("_values").isNull(), F.col(col)).otherwise(filled)).select(*df.columns)
