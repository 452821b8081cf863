import random
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import byte_words as w
from quillon.llm import filter_audit as a

WHITE = " \t\n\x0b\x0c\r"


def split(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return [x for x in text.split(" ") if x]


def fails(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, p in rows:
        t = t or ""
        own = split(t)
        yield i, p or "", {
            *"A" * (len(own) < 200), *"B" * (100 * len(set(own)) < 50 * len(own)), *"C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)),
            *"D" * any(c in "#$%&*|" for c in t), *"E" * (i is not None and i > first[t]),
        }


def brute(rows, labels):
    docs = list(fails(rows))
    removed = {}
    for p in {d[1] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[1] == p]
            gone = []
            for k, letter in enumerate(order):
                out = [d for d in left if letter in d[2]]
                seen = [d for d in gone if letter in d[2]]
                left = [d for d in left if letter not in d[2]]
                gone += out
                alone = [d for d in docs if d[1] == p and d[2] == {letter}]
                removed[p, order, k + 1] = [len(left), len(out), len(seen), len(alone), *(sum(any(x[j] == 1 for x in labels if x[0] == d[0] and d[0] is not None) for d in out) for j in (1, 2))]
    shares = Counter()
    for (p, order, k), x in removed.items():
        shares[p, order[k - 1]] += x[1]
    return {key: (*x, shares[key[0], key[1][key[2] - 1]]) for key, x in removed.items()}


def collected(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["a", "b", "Été", "X#", "|", "ab" * 9, "\U0001f600", "Q" * 7, "\xa0", "\x1c"]
    texts = [None, "", "   ", "\n", *("".join(rng.choice(pool) + rng.choice(WHITE) for _ in range(rng.choice([3, 150, 250, 600]))) for _ in range(12))]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (199, 200, 201)] + ["Wo " * 99 + " ".join(map(str, range(101))), " ".join(["x" * 3] * 400 + [str(i) for i in range(400)])]
    rows = [(rng.choice([None, i, i, i, 7]), rng.choice(texts), rng.choice([None, "", "p", "q"])) for i in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, n_words int, digest int").repartition(3)
    assert collected(a.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == brute(rows, labels)


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert a.audit(spark.createDataFrame([], "doc_id long, text string, source string"), labels).collect() == []


def test_own_filters(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, "a", "s"), (3, None, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = collected(a.audit(df, labels, {"S": lambda: F.col("n_words") < 2, "N": lambda: F.col("n_words") < 1}))
    assert got == {("s", "SN", 1): (1, 2, 0, 1, 0, 0, 3), ("s", "SN", 2): (1, 0, 1, 0, 0, 0, 1), ("s", "NS", 1): (2, 1, 0, 0, 0, 0, 1), ("s", "NS", 2): (1, 1, 1, 1, 0, 0, 3)}
    for bad in ({"AB": None}, {}, {"A": None, "B": None}):
        with pytest.raises(ValueError, match="one letter"):
            a.audit(df, labels, bad)


def test_hot_text_meets_in_few_rows(spark):
    """What comes to the task of one text's copies doesn't grow with their number."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    got = collected(a.audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got["0", "EABCD", 1][:2] == (1, 1499) and got["1", "EABCD", 1][:2] == (0, 1500)


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_words_in_blocks(monkeypatch, block):
    monkeypatch.setattr(w, "BLOCK", block)
    rng = random.Random(block)
    texts = ["", "a", " ", "x" * 300, "x" * 30 + " y", "ab", "cd ", *("".join(rng.choice(["é", "b", " ", "\n", "\x00", "\x1f"]) for _ in range(rng.randint(0, 90))) for _ in range(60)), None, "z" * 200]
    column = pa.array(["skipped", *texts]).slice(1)
    data, at = w.buffers(column)
    found = []
    for low, high in w.portions(at, 50):
        own, bounds = data[at[low] : at[high]], at[low : high + 1] - at[low]
        start, end, first, (one, two) = w.words(own, bounds, 2)
        for i in range(high - low):
            found.append([(own[s:e].tobytes().decode(), x, y) for s, e, x, y in zip(*(v[first[i] : first[i + 1]] for v in (start, end, one, two)), strict=True)])
    assert [[x[0] for x in f] for f in found] == [split(t or "") for t in texts]
    seen = {}
    for word, *h in (x for f in found for x in f):
        assert seen.setdefault(word, h) == h
    assert len({tuple(h) for h in seen.values()}) == len({h[0] for h in seen.values()}) == len(seen)


def test_equal_hashes_are_verified():
    data = np.frombuffer(b"aa bb aa cc bb aa dd", "u1")
    start, end, first, _ = w.words(data, np.array([0, 9, 20]))
    assert a.distinct_words(data, start, end, first, np.zeros(len(start), "u8")).tolist() == [2, 4]
    assert w.same_words(data, start, end, np.array([0, 0, 1]), np.array([2, 1, 4]), most=1).tolist() == [True, False, True]


def test_very_long_text():
    text = (b"word%d " * 400_000) % tuple(range(400_000))
    data = np.frombuffer(text + text, "u1")
    n, distinct, upper, symbols, points = a.measured(data, np.array([0, len(data)]))
    assert (n[0], distinct[0], upper[0], symbols[0], points[0]) == (800_000, 400_000, 0, 0, len(data))


def test_runs_of_words():
    h = w.mix(np.array([1, 2, 3, 1, 2, 3, 1, 2], "u8"))
    for n in (1, 2, 3, 5, 7, 8):
        got = w.runs(h, n)
        assert len(got) == 9 - n
        assert {i for i in range(len(got)) for j in range(i) if got[i] == got[j]} == {i for i in range(3, len(got))}
    assert len(w.runs(h, 9)) == 0 and w.runs(h, 2)[0] != w.runs(h[::-1], 2)[-1]
