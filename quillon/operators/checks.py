"""Lists of checks as expressions: each adds points and a reason when it applies."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Check(NamedTuple):
    applies: Column
    points: int
    reason: str


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))


def not_true(c: str | Column) -> Column:
    """Null counts as false."""
    return ~(F.col(c) if isinstance(c, str) else c).eqNullSafe(F.lit(True))


def blank(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c), F.lit("")) == ""


def number(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def points(checks: list[Check]) -> Column:
    total = F.lit(0.0)
    for c in checks:
        total = total + F.when(c.applies, float(c.points)).otherwise(0.0)
    return clamp(total)


def reasons(checks: list[Check]) -> Column:
    return F.array_compact(F.array(*[F.when(c.applies, F.lit(c.reason)) for c in checks]))


def triggered(checks: list[Check]) -> Column:
    """Of those that apply: struct<label, weight>, in order."""
    return F.array_compact(F.array(*[F.when(c.applies, F.struct(F.lit(c.reason).alias("label"), F.lit(c.points).alias("weight"))) for c in checks]))
