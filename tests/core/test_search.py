import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import commit_log, search


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(6)
    words = ["Café", "BAR", "casa", "100%", "under_score", "ñandú", "a", "İstanbul", "back\\slash", "ab"]
    rows = [(i, rng.choice([None, "", *(" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(20))])) for i in range(0, 60_000, 20)] + [(59_999, "The Needle")]
    df = spark.createDataFrame(rows, "id long, name string")
    path = str(tmp_path_factory.mktemp("search") / "index")
    search.build(spark, path, df, files=30)
    return path, df


TERMS = ["café", "BAR casa", "r_s", "0%", "under_score", "needle", "ab", "", "ñan", "x%y", "_af_", "c%sa", "istanbul", "zzzz", "İst", "100% c"]


@pytest.mark.parametrize("wildcards", [False, True])
def test_equal_to_a_scan(spark, index, wildcards):
    path, df = index
    for term in TERMS:
        want = df.where(F.col("name").ilike(f"%{term}%") if wildcards else F.contains(F.lower("name"), F.lower(F.lit(term))))
        got = search.search(spark, path, term, wildcards)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), term


def test_a_rare_term_reads_one_file(spark, index):
    path, _ = index
    assert len(commit_log.snapshot(spark, f"{path}/names").files) == 30
    assert len(search.search(spark, path, "needle").inputFiles()) == 1 + len([f for f in spark.read.parquet(f"{path}/lists").inputFiles()])
    ids = [r.id for r in search.candidates(spark, path, ["nee", "eed", "edl", "dle"]).collect()]
    assert ids == [59_999]
    assert spark.read.parquet(f"{path}/lists").select(F.max(F.size("ids"))).first()[0] <= search.BLOCK
