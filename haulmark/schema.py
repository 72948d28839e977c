"""Target columns: a name, a type written as Spark SQL writes it, and whether NULL is allowed.

``time`` is accepted as a type: the value is checked and kept as an ``HH:mm:ss`` string, because
this Spark has no TIME column type.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from collections.abc import Iterable

from pyspark.sql import DataFrame

_WIDTH = re.compile(r"^(?:varchar|char)\((\d+)\)$")


@dataclass(frozen=True)
class TargetColumn:
    name: str
    type: str
    nullable: bool = True

    @property
    def width(self) -> int | None:
        """Declared length of a ``varchar(n)`` or ``char(n)`` column."""
        found = _WIDTH.match(self.type)
        return int(found.group(1)) if found else None

    @property
    def storage_type(self) -> str:
        """The Spark type the checked value has."""
        return "string" if self.type == "time" or self.width else self.type


def target(*columns: tuple[str, str] | tuple[str, str, bool]) -> list[TargetColumn]:
    """``target(("id", "int"), ("name", "varchar(10)"), ("at", "time", False))``"""
    return [TargetColumn(c[0], c[1].lower().replace(" ", ""), *c[2:]) for c in columns]


def target_of(table: DataFrame) -> list[TargetColumn]:
    """Target columns of an existing table, from its schema alone (no scan)."""
    out = []
    for f in table.schema.fields:
        declared = (f.metadata or {}).get("__CHAR_VARCHAR_TYPE_STRING")
        out.append(TargetColumn(f.name, declared or f.dataType.simpleString(), f.nullable))
    return out


def names(columns: Iterable[TargetColumn]) -> list[str]:
    return [c.name for c in columns]
