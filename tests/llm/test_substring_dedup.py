import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import substring_dedup as s

SCHEMA = "doc_id long, text string, n_words string, chunk int, row int"
WHITE = " \t\n\x0b\x0c\r"


def split(text):
    for c in WHITE:
        text = (text or "").replace(c, " ")
    return [x for x in text.split(" ") if x]


def brute(rows, window):
    count = Counter(tuple(own[i : i + window]) for _, t in rows for own in [split(t)] for i in range(len(own) - window + 1))
    out = []
    for i, t in rows:
        own = split(t)
        gone = {p for k in range(len(own) - window + 1) if count[tuple(own[k : k + window])] > 1 for p in range(k, k + window)}
        spans, at = [], 0
        while at < len(own):
            if at in gone:
                begin = at
                while at in gone:
                    at += 1
                spans.append((begin, at - begin))
            at += 1
        out.append((i, None if t is None else " ".join(x for k, x in enumerate(own) if k not in gone), len(own), len(gone), spans))
    return sorted(out, key=repr)


def collected(df):
    return sorted(((r.doc_id, r.text, r.n_words, r.n_removed, [tuple(x) for x in r.repeats]) for r in df.collect()), key=repr)


def corpus(rng, window, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "É", "x" * 40, "日本"]
    passages = [rng.choices(vocabulary, k=rng.choice([window - 1, window, window + 1, 3 * window])) for _ in range(6)]
    texts = [None, "", " \n ", "a " * (2 * window), "a b " * window, "a " * window]
    for _ in range(n):
        own = rng.choices(vocabulary, k=rng.randint(0, 3 * window))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(passages)
        texts.append("".join(x + rng.choice(WHITE) for x in own))
    return [(rng.choice([None, i, i, i, 3]), t) for i, t in enumerate(texts)] + [(900, texts[8]), (901, texts[8]), (901, texts[8])]


@pytest.mark.parametrize("window, chunk, held, block", [(35, 16 << 20, 2_000_000, 1 << 20), (5, 900, 100, 64), (4, 3000, 50, 200), (2, 1 << 20, 2_000_000, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, window, chunk, held, block):
    monkeypatch.setattr(s, "CHUNK", chunk)
    monkeypatch.setattr(s, "RANGE", 2 * chunk)
    monkeypatch.setattr(s, "HELD", held)
    monkeypatch.setattr(s, "MOST_PARTITIONS", 3 if chunk == 900 else 20_000)
    monkeypatch.setattr(s.w, "BLOCK", block)
    rng = random.Random(window)
    rows = corpus(rng, window, 120)
    df = spark.createDataFrame([(*r, "m", 1, 2) for r in rows], SCHEMA).repartition(3)
    out = s.drop_repeats(df, window)
    assert out.columns == ["doc_id", "text", "chunk", "row", "n_words", "n_removed", "repeats"]
    assert {(r.chunk, r.row) for r in out.collect()} == {(1, 2)}
    assert collected(out) == brute(rows, window)


def test_copies_and_one_passage_in_many_documents(spark):
    """The lists have one entry for each hash and chunk, however many documents share a passage."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"start{i} {passage} end{i}") for i in range(800)] + [(i, "whole " + passage) for i in range(800, 1000)]
    out = s.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.text.startswith("start"), r.n_removed, len(r.repeats)) for r in out.where("doc_id < 800").collect()} == {(True, 40, 1)}
    assert {(r.text, r.n_removed) for r in out.where("doc_id >= 800").collect()} == {("", 41)}


def test_empty_and_bad_window(spark):
    assert s.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert collected(s.drop_repeats(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"))) == [(1, "", 0, 0, []), (None, None, 0, 0, [])]
    with pytest.raises(ValueError, match="two words"):
        s.drop_repeats(spark.createDataFrame([], "doc_id long, text string"), 1)


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(400_000)]
    long = " ".join(words) + " " + " ".join(words[1000:1100])
    (row,) = s.drop_repeats(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
    assert (row.n_words, row.n_removed) == (400_100, 200) and [tuple(x) for x in row.repeats] == [(1000, 100), (400_000, 100)]
    assert hashlib.sha256(row.text.encode()).digest() == hashlib.sha256(" ".join(words[:1000] + words[1100:]).encode()).digest()


def test_texts_are_shuffled_once(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.concat(F.lit("w"), i * (F.col("id") % 200)))).alias("text"))
    out = s.drop_repeats(df)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 2


def test_lists_of_hashes_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5000):
        values = np.unique(rng.integers(0, 1 << 32, n, dtype="u8").astype("u4"))
        flags = rng.integers(0, 4, len(values)).astype("u1")
        got = s._unpack(s._pack(values, flags))
        assert (got[0] == values).all() and (got[1] == flags).all()
        assert (s._unpack(s._pack(values))[0] == values).all() and s._unpack(s._pack(values))[1] is None


def test_pairs_are_told_by_both_hashes():
    of, with_ = np.array([1, 4, 4, 9], "u8"), np.array([5, 2, 3, 9], "u8")
    one, two = np.array([1, 1, 4, 4, 4, 9, 10], "u8"), np.array([5, 6, 3, 2, 1, 9, 9], "u8")
    assert s._among(one, two, of, with_).tolist() == [True, False, True, True, False, True, False]
    assert s._among(one, two, of[:0], with_[:0]).tolist() == [False] * 7
