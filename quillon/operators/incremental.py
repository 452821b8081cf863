"""The latest row of each key, kept up to date as rows come in.

The state has one row a key and lies in buckets of the key. New rows are reduced
to their own latest, dealt to the same buckets, and merged with the state bucket by
bucket: what has come before is read and written, but not shuffled or looked up
again. Versions are published through the commit log, so an increment counts once,
and a failed one is never seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import commit_log
from quillon.operators.latest import latest


@contextmanager
def _bucketed(spark: SparkSession, folder: str, schema: T.StructType, key: str, buckets: int) -> Iterator[DataFrame]:
    """Files that were written in buckets, with what Spark knows of their layout. The name is the session's own; dropping it leaves the files."""
    name = f"state_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{folder}'")
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _write(rows: DataFrame, folder: str, key: str, buckets: int) -> None:
    name = f"state_{uuid.uuid4().hex}"
    rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", folder).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")


def merged(state: DataFrame, rows: DataFrame, key: str, at: str, tie: str, buckets: int) -> DataFrame:
    """The state with the rows' own latest; of a key's two the greater by ``at`` and ``tie`` stays."""
    columns = state.columns
    new = latest(rows.select(*columns).where(F.col(key).isNotNull()), key, at, tie).repartition(buckets, key)
    was = state.select(F.col(key).alias("__key"), F.struct(*columns).alias("__was"))
    both = was.join(new.select(F.col(key).alias("__of"), F.struct(*columns).alias("__new")), F.col("__key") == F.col("__of"), "full_outer")
    order = lambda row: F.struct(F.col(f"{row}.{at}"), F.col(f"{row}.{tie}"))
    newer = F.col("__was").isNull() | (F.col("__new").isNotNull() & (order("__new") > order("__was")))
    return both.select(F.when(newer, F.col("__new")).otherwise(F.col("__was")).alias("row")).select("row.*")


def add(spark: SparkSession, path: str, job: str, rows: DataFrame, key: str, at: str, tie: str = "id", buckets: int | None = None) -> dict:
    """Take rows into the state at ``path``, once for each job. The first increment fixes columns and buckets; rows without key have no latest."""
    for _ in range(5):
        was = commit_log.snapshot(spark, path)
        if job in was.jobs:
            return was.jobs[job]
        layout = was.jobs.get("__layout") or {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "key": key, "schema": rows.schema.json()}
        schema, n = T.StructType.fromJson(json.loads(layout["schema"])), layout["buckets"]
        folder = f"{path}/state-{uuid.uuid4().hex}"
        if was.files:
            with _bucketed(spark, next(iter(was.files)), schema, key, n) as state:
                _write(merged(state, rows, key, at, tie, n), folder, key, n)
        else:
            _write(latest(rows.where(F.col(key).isNotNull()), key, at, tie).repartition(n, key), folder, key, n)
        said = {"version": was.version + 1}
        try:
            commit_log.publish(spark, path, commit_log.Snapshot(was.version + 1, 0, {folder: (0, None, None)}, was.jobs | {"__layout": layout, job: said}))
            return said
        except commit_log.ConflictError:
            continue
    raise commit_log.ConflictError(f"others publish {path} all the time")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each key so far."""
    was = commit_log.snapshot(spark, path)
    if not was.files:
        raise ValueError(f"{path} holds no state")
    return spark.read.schema(T.StructType.fromJson(json.loads(was.jobs["__layout"]["schema"]))).parquet(next(iter(was.files)))
