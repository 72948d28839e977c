"""MERGE into a plain file table: a copy-on-write of what a keyed join finds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import pinned, scratch_path
from ..statements import Clause, name_parts
from .tables import BROADCAST_PARTITIONS, FOLDER, in_partitions, put_back, with_folder

_ROW, _SOURCE, _CLAUSE = "_target_row", "_source_row", "_merge_clause"


class MergeConflict(ValueError):
    """A target row is changed by more than one source row."""


def merge_into(spark: SparkSession, table: str, source: DataFrame, on: str, clauses: Sequence[Clause],
               alias: str | None = None, source_alias: str = "source") -> int:
    """Merge ``source`` into ``table``; returns rows updated, deleted and inserted.

    Of the clauses of a kind the first whose condition holds counts; its texts name both sides by their aliases. One left join
    on the condition finds each target row's source rows, so AQE may split hot keys, which lie on the left; it is written
    once, with what becomes of each row. From there a target row with two source rows is an error, before anything is changed
    (unless all that is done to matched rows is to delete them), and source rows that are not among the matched are inserted.
    A partitioned table rewrites only the partitions that hold a row to change; inserted rows of other partitions are appended.
    Kind, location and properties stay. A partition column cannot be assigned.
    """
    columns, types = spark.table(table).columns, dict(spark.table(table).dtypes)
    parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    changing, matching, inserting = ([c for c in clauses if c.when in kinds] for kinds in (("matched", "missing"), ("matched",), ("unmatched",)))
    _check(table, columns, parts, clauses)
    name = alias or name_parts(table)[-1]
    given = pinned(source.withColumn(_SOURCE, F.monotonically_increasing_id()), "merge-source")
    sides = _Sides(f"`{name}`", f"`{source_alias}`", columns, types)
    rows = spark.table(table)
    with_source = lambda target, how: target.alias(name).join(given.alias(source_alias), F.expr(on), how)
    changed, staged, touched = 0, None, None
    if changing:
        if parts:
            found = [with_source(with_folder(rows), "left_semi")] if matching else []
            if lone := [F.coalesce(F.expr(c.condition), F.lit(False)) for c in changing if c.when == "missing"]:
                found.append(with_source(with_folder(rows), "left_anti").where(reduce(Column.__or__, lone)))
            found = [x.select(*parts, FOLDER) for x in found]
            touched = pinned(reduce(DataFrame.unionByName, found).distinct(), "merge-touched")
            rows = in_partitions(rows, touched, parts, touched.count() <= BROADCAST_PARTITIONS)
        decided = with_source(sides.with_lone_values(rows.withColumn(_ROW, F.monotonically_increasing_id()), name, clauses), "left")
        decided = decided.withColumn(_CLAUSE, _first_that_holds(clauses, {"matched": F.col(_SOURCE).isNotNull(), "missing": F.col(_SOURCE).isNull()}))
        path = scratch_path(spark, "merge")
        staged = pinned(decided.select(*[sides.updated(c, clauses) for c in columns], _ROW, _SOURCE, _CLAUSE), "merge", path)
        only_delete = len(matching) == 1 and matching[0].action == "delete" and matching[0].condition == "true"
        if matching and not only_delete and not staged.where(f"{_SOURCE} is not null").groupBy(_ROW).count().where("count > 1").isEmpty():
            raise MergeConflict(f"rows of {table} match more than one source row")
        # A row with several source rows is here once for each; all of them fare alike.
        changed = staged.where(f"{_CLAUSE} >= 0").select(_ROW).distinct().count()
        if not matching and changed:
            path = scratch_path(spark, "merge-once")
            staged = pinned(staged.dropDuplicates([_ROW]), "merge", path)
    fresh, added = None, 0
    if inserting:
        # With a matched clause all matched rows lie in touched partitions, so the staged rows know them; else the target is asked.
        seen = staged.where(f"{_SOURCE} is not null") if matching else with_source(spark.table(table), "inner")
        rest = given.join(seen.select(_SOURCE).distinct(), _SOURCE, "left_anti").alias(source_alias).withColumn(
            _CLAUSE, _first_that_holds(clauses, {"unmatched": F.lit(True)})).where(f"{_CLAUSE} >= 0")
        fresh = pinned(rest.select(*[sides.inserted(c, clauses) for c in columns]), "merge-inserts")
        added = fresh.count()
    if changed:
        gone = ", ".join(str(i) for i, c in enumerate(clauses) if c.action == "delete") or "-2"
        put_back(spark, table, path, staged.schema, parts, touched, f"{_CLAUSE} not in ({gone})")
    if added:
        fresh.write.insertInto(table)
        spark.catalog.refreshTable(table)
    return changed + added


def _check(table: str, columns: Sequence[str], parts: Sequence[str], clauses: Sequence[Clause]) -> None:
    known, fixed = {c.lower() for c in columns}, {c.lower() for c in parts}
    for c in clauses:
        given = {k.lower() for k in (columns if c.values is None else c.values)} if c.action != "delete" else set()
        if c.when == "missing" and c.action == "update" and c.values is None:
            raise ValueError("a row without a source row has no source columns to take")
        if given - known:
            raise ValueError(f"{table} has no columns {sorted(given - known)}")
        if c.action == "update" and given & fixed:
            raise ValueError("a partition column cannot be updated")


def _first_that_holds(clauses: Sequence[Clause], found: Mapping[str, Column]) -> Column:
    """The number of the first clause of the found kinds whose condition holds, else -1."""
    out = F.lit(-1)
    for i, c in reversed(list(enumerate(clauses))):
        if c.when in found:
            holds = F.col(f"_holds_{i}") if c.when == "missing" else F.expr(c.condition)
            out = F.when(found[c.when] & F.coalesce(holds, F.lit(False)), F.lit(i)).otherwise(out)
    return out


@dataclass(frozen=True)
class _Sides:
    """What a column becomes by the clauses; target and source are quoted aliases."""
    target: str
    source: str
    columns: Sequence[str]
    types: Mapping[str, str]

    def with_lone_values(self, rows: DataFrame, name: str, clauses: Sequence[Clause]) -> DataFrame:
        """Target rows with what the clauses for rows without a source row make of them; their texts see the target only."""
        more = []
        for i, c in enumerate(clauses):
            if c.when == "missing":
                more.append(F.expr(c.condition).alias(f"_holds_{i}"))
                more += [F.expr(text).alias(f"_value_{i}_{key.lower()}") for key, text in (c.values or {}).items()]
        return rows.alias(name).select("*", *more)

    def _value(self, i: int, clause: Clause, column: str) -> Column | None:
        if clause.values is None:
            return F.expr(f"{self.source}.`{column}`")
        text = next((v for k, v in clause.values.items() if k.lower() == column.lower()), None)
        if text is None:
            return None
        return F.col(f"_value_{i}_{column.lower()}") if clause.when == "missing" else F.expr(text)

    def _by_clause(self, column: str, clauses: Sequence[Clause], action: str, rest: Column) -> Column:
        for i, c in enumerate(clauses):
            value = self._value(i, c, column) if c.action == action else None
            if value is not None:
                rest = F.when(F.col(_CLAUSE) == i, value.cast(self.types[column])).otherwise(rest)
        return rest.alias(column)

    def updated(self, column: str, clauses: Sequence[Clause]) -> Column:
        return self._by_clause(column, clauses, "update", F.expr(f"{self.target}.`{column}`"))

    def inserted(self, column: str, clauses: Sequence[Clause]) -> Column:
        return self._by_clause(column, clauses, "insert", F.lit(None).cast(self.types[column]))
