import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from quillon.llm import line_dedup as d

WHITE = "\t\n\x0b\x0c\r "


def key(line):
    return line.strip(WHITE).encode().lower().decode()


def brute(rows):
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40 and i is not None:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and i != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = ["Ü" * 40, "x" * 39, "y" * 40, "Shared LINE number " + "z" * 30, "\tshared line number " + "z" * 30 + " \r", "short", "", "\x1f" + "q" * 45, "q" * 45 + "\xa0"]
    rows = [(i, rng.choice([None, "", "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))])) for i in range(60)]
    rows += [(5, "y" * 40), (5, "y" * 40 + "\nother"), (None, "y" * 40), (99, "\n".join(["y" * 40] * 3000))]
    df = spark.createDataFrame([(*r, "m", 1, 2, 3) for r in rows], "doc_id long, text string, n_lines string, extra int, __doc int, new int")
    out = d.drop_shared_lines(df)
    assert out.columns == ["doc_id", "text", "extra", "__doc", "new", "n_lines", "n_dropped"]
    assert {(r.extra, r["__doc"], r.new) for r in out.collect()} == {(1, 2, 3)}
    got = [tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_empty(spark):
    assert d.drop_shared_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
