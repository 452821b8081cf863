"""Tables of Parquet files whose writes happen once.

A job writes its files under its own id and a new attempt, and then publishes a
manifest: a small file that lists all files of the table, the jobs done, and the
highest id given. It gets its name by one rename that fails if the name is taken, so
of two jobs that started from the same version one is refused and starts anew.
Readers take the files of the newest manifest and no others: what a failed attempt
has left is never seen, and a job whose id is listed adds nothing when it runs again.

Manifests lie in ``_log`` in the table's folder. A file is a row in them, with the
least and the greatest of the table's key; rows of documents never pass the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConflictError(RuntimeError):
    """Another job published this version first."""


class Snapshot(NamedTuple):
    """A version of a table. ``files``: by path, (rows, least key, greatest key). ``jobs``: by id, what the job reported."""

    version: int = 0
    high: int = 0
    files: dict[str, tuple[int, int, int]] = {}
    jobs: dict[str, dict] = {}


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _name(version: int) -> str:
    return f"{version:020d}.json"


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The newest version; a table without any is empty."""
    fs, log = _fs(spark, f"{path}/_log")
    if not fs.exists(log):
        return Snapshot()
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    newest = max((n for n in names if n.endswith(".json") and n[:-5].isdigit()), default=None)
    if newest is None:
        return Snapshot()
    (row,) = spark.read.text(f"{path}/_log/{newest}", wholetext=True).collect()
    own = json.loads(row[0])
    return Snapshot(own["version"], own["high"], {f: tuple(x) for f, x in own["files"].items()}, own["jobs"])


def publish(spark: SparkSession, path: str, new: Snapshot) -> None:
    """Make a version the newest, or fail if its number is taken."""
    fs, log = _fs(spark, f"{path}/_log")
    fs.mkdirs(log)
    _, draft = _fs(spark, f"{path}/_log/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(new._asdict()).encode()))
    out.close()
    _, final = _fs(spark, f"{path}/_log/{_name(new.version)}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    never_over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, final, never_over)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise ConflictError(f"version {new.version} of {path} is taken") from e
        raise


def read(spark: SparkSession, path: str, schema: T.StructType, at: Snapshot | None = None) -> DataFrame:
    """The rows of the newest version, or of the one given."""
    files = (at or snapshot(spark, path)).files
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _written(rows: DataFrame, path: str, job: str, key: str) -> dict[str, tuple[int, int, int]]:
    """Write the rows as they are partitioned; their files, with the least and greatest key."""
    folder = f"{path}/{quote(job, safe='')}/{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    back = rows.sparkSession.read.schema(rows.schema).parquet(folder).select(F.col("_metadata.file_path").alias("file"), F.col(key).alias("key"))
    found = back.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
    return {unquote(r.file): (r.n, r.low, r.high) for r in found}


def commit(spark: SparkSession, path: str, job: str, build: Callable[[Snapshot], tuple[DataFrame | None, list[str], Callable[[], dict]]], key: str = "id", attempts: int = 5) -> dict:
    """Run a job once: what it reports, or what it reported when it was done before.

    ``build`` gets the version to start from and gives the rows to add, the files
    to drop, and what to report once the rows are written. If another job publishes meanwhile it is asked again.
    """
    for attempt in range(attempts):
        was = snapshot(spark, path)
        if job in was.jobs:
            return was.jobs[job]
        rows, dropped, report = build(was)
        files = {f: x for f, x in was.files.items() if f not in set(dropped)}
        if rows is not None:
            files |= _written(rows, path, job, key)
        said = report()
        high = max([was.high, *(x[2] for x in files.values() if x[2] is not None)])
        try:
            publish(spark, path, Snapshot(was.version + 1, high, files, was.jobs | {job: said}))
            return said
        except ConflictError:
            if attempt == attempts - 1:
                raise
    raise ValueError("a job needs an attempt")


#: Files are found by blocks of so many keys.
SPAN = 1 << 20


def holding(keys: DataFrame, files: dict[str, tuple[int, int, int]], key: str) -> list[str]:
    """The files whose range of keys has one of the keys; ranges and keys meet by blocks of keys."""
    rows = [(f, low, high) for f, (_, low, high) in files.items() if low is not None]
    if not rows:
        return []
    spark = keys.sparkSession
    ranges = spark.createDataFrame(rows, "file string, low long, high long").withColumn("span", F.explode(F.sequence(F.floor(F.col("low") / SPAN), F.floor(F.col("high") / SPAN))))
    own = keys.select(F.col(key).cast("long").alias("k")).distinct().withColumn("of", F.floor(F.col("k") / SPAN))
    return [r.file for r in own.join(ranges, (F.col("of") == F.col("span")) & F.col("k").between(F.col("low"), F.col("high"))).select("file").distinct().collect()]


def update(spark: SparkSession, path: str, schema: T.StructType, job: str, patches: DataFrame, key: str = "id") -> dict:
    """Copy on write: rows whose key has a patch take its other columns; only files that may hold such keys are written anew.

    A patch of null sets null. Of several patches of a key the greatest counts; keys that no row
    has are reported. Rows that are hit are stamped where the table has ``updated_at``
    and the patch doesn't. Reports updated, missing, files_rewritten, files_kept.
    """
    columns = [c for c in patches.columns if c != key]
    one = patches.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(F.struct(*columns)).alias("__patch"))

    def build(was: Snapshot):
        hit = holding(patches, was.files, key)
        wanted = one.count()
        if not hit:
            return None, [], lambda: {"updated": 0, "missing": wanted, "files_rewritten": 0, "files_kept": len(was.files)}
        rows = spark.read.schema(schema).parquet(*hit)
        joined = rows.join(one, F.col(key) == F.col("__key"), "left")
        is_hit = F.col("__key").isNotNull()

        def value(f: T.StructField):
            if f.name in columns:
                return F.when(is_hit, F.col("__patch")[f.name]).otherwise(F.col(f.name))
            return F.when(is_hit, F.current_timestamp()).otherwise(F.col(f.name)) if f.name == "updated_at" else F.col(f.name)

        new = joined.select(*[value(f).cast(f.dataType).alias(f.name) for f in schema.fields]).repartitionByRange(len(hit), key)
        updated = rows.join(one, F.col(key) == F.col("__key"), "left_semi").count()
        found = rows.select(key).join(one, F.col(key) == F.col("__key"), "left_semi").distinct().count()
        return new, hit, lambda: {"updated": updated, "missing": wanted - found, "files_rewritten": len(hit), "files_kept": len(was.files) - len(hit)}

    return commit(spark, path, job, build, key)
