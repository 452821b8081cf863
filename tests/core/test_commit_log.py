import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.operators import commit_log as c
from quillon.operators import imports
from quillon.operators.components import components
from quillon.operators.ordered import with_rank
from quillon.schemas import BUSINESS

RECORDS = "row long, name string, address string, gbp_place_id string"


def rows_of(spark, path):
    return {r.id: (r.name, r.source_job_id) for r in c.read(spark, path, BUSINESS).collect()}


def run(spark, path, records, job):
    none = spark.createDataFrame([], RECORDS)
    return imports.import_batch(spark.createDataFrame(records, RECORDS), none, none, path, 1, job).first()


def test_imports_happen_once(spark, tmp_path, monkeypatch):
    """A retry adds nothing, two imports share no id, and what a failed attempt has written is not seen."""
    path = str(tmp_path / "table with a blank")
    first, second = [(1, "A", None, "p1"), (2, "a", None, "p2"), (4, "B", None, "p3")], [(1, "B", None, "p9"), (2, "C", "x", None), (3, "D", None, "p1"), (4, "E", None, None)]
    a = run(spark, path, first, 7)
    assert (a.inserted, a.duplicates) == (2, 1) and rows_of(spark, path) == {1: ("A", 7), 2: ("B", 7)}
    assert run(spark, path, first, 7) == a and run(spark, path, second, 7) == a and len(rows_of(spark, path)) == 2

    def fail(*_):
        raise OSError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(c, "publish", fail)
        with pytest.raises(OSError, match="lost"):
            run(spark, path, second, 8)
    assert spark.read.option("recursiveFileLookup", True).schema(BUSINESS).parquet(path).where("source_job_id = 8").count() == 2
    assert len(rows_of(spark, path)) == 2
    assert run(spark, path, second, 8).inserted == 2
    assert rows_of(spark, path) == {1: ("A", 7), 2: ("B", 7), 3: ("C", 8), 4: ("E", 8)}
    assert c.snapshot(spark, path).version == 2 and set(c.snapshot(spark, path).jobs) == {"import-7", "import-8"}


def test_of_two_jobs_at_once_one_starts_anew(spark, tmp_path, monkeypatch):
    path, publish, met = str(tmp_path / "t"), c.publish, []

    def late(*args):
        if not met:
            met.append(True)
            run(spark, path, [(1, "A", None, None), (2, "X", None, None)], 1)
        publish(*args)

    monkeypatch.setattr(c, "publish", late)
    assert run(spark, path, [(1, "A", None, None), (2, "Y", None, None)], 2).inserted == 1
    assert rows_of(spark, path) == {1: ("A", 1), 2: ("X", 1), 3: ("Y", 2)}
    with pytest.raises(c.ConflictError):
        publish(spark, path, c.Snapshot(2))


def test_one_update_of_a_hundred_files_rewrites_one(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1, 5001).select("id", F.concat(F.lit("v"), "id").alias("v"), F.lit("2001-01-01 00:00:00").cast("timestamp").alias("updated_at"))
    c.commit(spark, path, "load", lambda was: (df.repartitionByRange(100, "id"), [], lambda: {}))
    before = set(c.snapshot(spark, path).files)
    assert len(before) == 100
    patches = spark.createDataFrame([(77, "new"), (77, "mew"), (78, None), (9999, "x"), (None, "y")], "id long, v string")
    said = c.update(spark, path, df.schema, "patch", patches)
    assert said == {"updated": 2, "missing": 1, "files_rewritten": 1, "files_kept": 99} == c.update(spark, path, df.schema, "patch", patches)
    assert len(before & set(c.snapshot(spark, path).files)) == 99
    got = {r.id: (r.v, r.updated_at.year > 2001) for r in c.read(spark, path, df.schema).collect()}
    assert got == {i: (f"v{i}", False) for i in range(1, 5001)} | {77: ("new", True), 78: (None, True)}
    nobody = c.update(spark, path, df.schema, "nobody", spark.createDataFrame([(-5, "z")], "id long, v string"))
    assert nobody == {"updated": 0, "missing": 1, "files_rewritten": 0, "files_kept": 100}
    far = spark.createDataFrame([(3, "far"), (4000, "far")], "id long, v string")
    assert c.update(spark, path, df.schema, "two", far)["files_rewritten"] == 2 and c.read(spark, path, df.schema).where("v = 'far'").count() == 2


def test_update_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "id long, v string")
    assert c.update(spark, str(tmp_path / "no"), df.schema, "j", spark.createDataFrame([(1, "a")], "id long, v string"))["missing"] == 1
    assert c.read(spark, str(tmp_path / "no"), df.schema).collect() == []
    c.commit(spark, str(tmp_path / "e"), "none", lambda was: (df, [], lambda: {}))
    assert c.read(spark, str(tmp_path / "e"), df.schema).collect() == [] and c.snapshot(spark, str(tmp_path / "e")).high == 0


def test_ranks_have_no_gaps(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(100), i) for i in range(500)]
    got = with_rank(spark.createDataFrame(rows, "a long, b long").repartition(7), ["a", "b"], "n", 40).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows) and sorted(r.n for r in got) == list(range(41, 541))


def reach(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 300)], [(299, i) for i in range(299)], [(i * 7 % 301, (i + 1) * 7 % 301) for i in range(300)], [],
    [(random.Random(i).randrange(400), random.Random(-i).randrange(400)) for i in range(1, 250)],
])
def test_components(spark, edges):
    edges = [(a, b) for a, b in edges if a != b]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == reach(edges) and max(Counter(r.node for r in got).values(), default=1) == 1


def test_chains_fold_beside_each_other(spark, monkeypatch):
    """200,000 records, most of them in chains where every record depends on the one before: many tasks, and the sequential result."""
    monkeypatch.setattr(imports, "ROUNDS", 1)
    chains, length = 2000, 100
    df = spark.range(chains * length).select(
        (F.col("id") % length * chains + F.floor(F.col("id") / length)).alias("row"),
        F.concat_ws("-", F.floor(F.col("id") / length), F.floor(F.col("id") % length / 2)).alias("name"), F.lit(None).cast("string").alias("address"),
        F.concat_ws("-", F.floor(F.col("id") / length), F.floor((F.col("id") % length + 1) / 2)).alias("gbp_place_id"),
    )
    out = imports.deduplicate(df, spark.createDataFrame([], RECORDS)).withColumn("part", F.spark_partition_id())
    got = out.collect()
    # Along a chain every second record is kept.
    assert sorted(r.row for r in got) == [i * chains + k for i in range(0, length, 2) for k in range(chains)]
    sizes = Counter(r.part for r in got)
    assert len(sizes) > 3 and max(sizes.values()) < 0.6 * len(got)
