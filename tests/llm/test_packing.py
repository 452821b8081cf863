import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm import packing as p
from quillon.llm.tokens import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def check(rows, got, length):
    lib = Tokenizer.from_file(PATH)
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            own = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(own) and (not hasattr(r, "ids") or bytes(r.ids) == own)
            at += r.length
        assert at == len(ids)
    return sum(r.length for r in got) / (len(by_seq) * length)


def test_every_id_once_and_little_padding(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "of", "zebra", "x1"]) for _ in range(rng.choice([3, 40, 90, 200, 700])))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "y " * 20_000), *((i, "same text here") for i in range(1000, 1300))]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, bin int")
    assert check(rows, p.pack(df, PATH, length=256, with_ids=True).collect(), 256) > 0.94


def test_empty_and_single(spark):
    assert p.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    check([(1, "a")], p.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PATH).collect(), 2048)


def test_repeated_rows_are_separate_documents(spark):
    got = p.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string"), PATH).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3


def test_cutting_stock_meets_its_bound():
    rng = np.random.default_rng(4)
    sizes = np.arange(1, 65)
    demand = rng.integers(0, 400, 64).astype(float)
    sizes, demand = sizes[demand > 0], demand[demand > 0]
    plan = p.cutting_patterns(sizes, demand, 64)
    assert (sum(a * t for a, t in plan) == demand).all()
    assert all((a * sizes).sum() <= 64 for a, _ in plan)
    used, least = sum(t for _, t in plan), -(-int((sizes * demand).sum()) // 64)
    assert used <= least * 1.02 + 2


def test_knapsack():
    value, taken = p.best_pattern(np.array([3, 5, 7]), np.array([0.3, 0.52, 0.71]), 10)
    assert abs(value - 1.04) < 1e-9 and taken.tolist() == [0, 2, 0]


def test_short_texts_leave_little_padding(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "of", "on"]) for _ in range(rng.randint(4, 19)))) for i in range(6000)]
    assert check(rows, p.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect(), 2048) > 0.96
    bare = [(i, rng.choice([None, ""])) for i in range(4096)]
    assert check(bare, p.pack(spark.createDataFrame(bare, "doc_id long, text string"), PATH).collect(), 2048) == 1


def test_plan_of_short_and_long_pieces():
    rng = np.random.default_rng(5)
    for scale in (10, 60, 400):
        lengths = np.minimum(rng.lognormal(np.log(scale), 1, 20_000).astype("i8") + 1, 2048)
        sizes, demand = np.unique([p.bin_of(int(x), 2048, 8) for x in lengths], return_counts=True)
        plan = p.sequence_plan(sizes, demand.astype(float), 2048, 8)
        assert (sum(a * t for a, t in plan) == demand).all() and all((a * sizes).sum() <= 2048 for a, _ in plan)
        assert lengths.sum() / 2048 / sum(t for _, t in plan) > 0.98


def test_a_program_cut_short_is_valid_and_says_so():
    rng = np.random.default_rng(5)
    sizes, demand = np.arange(30, 400, 7), rng.integers(1, 5000, 53).astype(float)
    with pytest.warns(UserWarning, match="longer than the best after 3 columns"):
        plan = p.cutting_patterns(sizes, demand, 1000, rounds=3)
    assert (sum(n * pattern for pattern, n in plan) == demand).all() and all(pattern @ sizes <= 1000 for pattern, _ in plan)
    whole = p.cutting_patterns(sizes, demand, 1000)
    assert sum(n for _, n in whole) <= sum(n for _, n in plan) and (sum(n * pattern for pattern, n in whole) == demand).all()


def test_ties_and_equal_lengths(spark):
    rows = [(i, "same words in all") for i in range(500)]
    got = p.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, length=256).collect()
    assert check(rows, got, 256) > 0.9
    assert sorted(map(tuple, got)) == sorted(map(tuple, p.pack(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3), PATH, length=256).collect()))
