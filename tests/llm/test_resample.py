import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import resample as r

SCHEMA = "doc_id long, text string, n_words string, level int"


def grams(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return found, [" ".join(found[i : i + k]) for k in range(1, longest + 1) for i in range(len(found) - k + 1)]


def brute(rows, target, longest=1, buckets=10_000, percent=10, min_words=20):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in rows for g in grams(t, longest)[1])
    t = Counter(bucket(g) for x in target for g in grams(x, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, text in rows:
        words, own = grams(text, longest)
        weight = sum(gain(bucket(g)) for g in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    rank = {}
    for k, x in enumerate(able[: percent * len(able) // 100]):
        rank.setdefault(x, []).append(k + 1)
    return sorted(((*x, rank[x].pop(0) if rank.get(x) else None) for x in out), key=repr)


def texts(rng, n):
    pool = ["alpha", "Beta", "GAMMA", "Été", "été", "x1", "42", "日本", "a_b", "don't", "\x00", "z\x1fy", "İ"]
    return [rng.choice([None, "", " - ", *(" ".join(rng.choice(pool) + (str(rng.randrange(40)) if rng.random() < 0.3 else "") for _ in range(rng.choice([1, 19, 20, 21, 60]))) for _ in range(9))]) for _ in range(n)]


@pytest.mark.parametrize("longest, buckets, percent, nodes", [(1, 10_000, 10, 300_000), (3, 50, 35, 40), (2, 10_000, 100, 300_000)])
def test_against_brute_force(spark, monkeypatch, longest, buckets, percent, nodes):
    monkeypatch.setattr(r, "MOST_NODES", nodes)
    rng = random.Random(longest)
    rows = [(rng.choice([None, i, i, i, i, 3]), t) for i, t in enumerate(texts(rng, 300))]
    rows += [rows[9]] * 4
    target = texts(rng, 20)
    df = spark.createDataFrame([(*x, "m", 1) for x in rows], SCHEMA).repartition(5)
    got = r.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), longest, buckets, percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target, longest, buckets, percent)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b " * 20, None, None)], SCHEMA)
    assert r.resample(none, none).collect() == []
    assert [tuple(x)[:4] for x in r.resample(one, none, percent=100).collect()] == [(1, 40, 40, -3041)]
    assert r.resample(one, one, percent=100).collect()[0].weight == 0


def test_documents_like_the_target_are_drawn(spark):
    rng = random.Random(1)
    near, far = [f"near{i}" for i in range(50)], [f"far{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(near if i % 10 == 0 else far, k=400))) for i in range(1000)]
    target = spark.createDataFrame([(" ".join(rng.choices(near, k=2000)),)], "text string")
    drawn = r.resample(spark.createDataFrame(rows, "doc_id long, text string"), target, percent=5).where("rank is not null")
    assert drawn.count() == 50 and drawn.where(F.col("doc_id") % 10 == 0).count() >= 45


def test_very_long_text():
    trie = r.Trie(2)
    text = b"Aa bB, " * 500_000
    trie.add(text)
    own = [0] * 100
    trie.pour(own)
    assert sum(own) == 1_999_999 and trie.size == 0
    assert r.Trie(2, own).gain(text)[:2] == (1_000_000, 1_999_999)
