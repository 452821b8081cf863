"""Where a session's relations come from, as its settings say.

``spark.quillon.data`` is the folder of the tables, ``spark.quillon.owner`` whose rows they
are, and ``spark.quillon.examples`` a folder that is read as long as nobody is named.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from quillon.sources import tables

PREFIX = "spark.quillon."


class Source(NamedTuple):
    """A folder, and the owner whose rows are seen; without one all are."""

    folder: str
    owner: int | None

    def relation(self, spark: SparkSession, name: str) -> DataFrame:
        """A relation of the data model by its name."""
        if name not in tables.RELATIONS:
            raise ValueError(f"no relation is called {name}")
        return getattr(tables, name)(spark, self.folder, self.owner)


def source(spark: SparkSession) -> Source:
    """The source that the session's settings choose. A blank setting is none; an owner that is no number, and settings that name no folder to read, are refused."""
    given = {n: (spark.conf.get(PREFIX + n, None) or "").strip() for n in ("data", "owner", "examples")}
    if given["owner"] and not given["owner"].isdecimal():
        raise ValueError(f"{PREFIX}owner is no number: {given['owner']}")
    if given["data"] and given["owner"]:
        return Source(given["data"], int(given["owner"]))
    if not given["examples"]:
        raise ValueError(f"set {PREFIX}data and {PREFIX}owner, or {PREFIX}examples")
    return Source(given["examples"], None)
