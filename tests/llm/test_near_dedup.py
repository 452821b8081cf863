import os
import random
from collections import Counter

import pytest

from quillon.llm import near_dedup as n
from quillon.llm.components import components


def brute(rows, words, similarity=80):
    sets = {}
    for i, t in rows:
        w = [x for x in (t or "").encode().lower().split()]
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows, words):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, component_id string, mark int")
    got = n.groups(df, words=words).collect()
    assert len(got) == len(rows)
    want = brute(rows, words)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id
            assert r.kept == (r.doc_id == r.component_id)


def near(rng, words, share):
    return [rng.choice(VOCAB) if rng.random() < share else w for w in words]


DIR = "/root/testdata/sf0.01"
VOCAB = [f"w{i}" for i in range(3000)]


@pytest.mark.parametrize("words", [2, 5])
def test_against_brute_force(spark, words):
    rng = random.Random(words)
    rows, i = [], 0
    for group in range(40):
        base = [rng.choice(VOCAB) for _ in range(rng.choice([1, 2, 5, 30, 120, 400]))]
        for _ in range(rng.choice([1, 1, 2, 3, 30 if group < 3 else 4])):
            rows.append((i, " ".join(near(rng, base, rng.choice([0, 0.005, 0.02, 0.04])))))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "One"), (i + 4, "one "), (i + 5, "É x y z v"), (i + 6, "é x y z v"), (None, "one")]
    rng.shuffle(rows)
    check(spark, rows, words)


def test_chains_and_one_big_group(spark):
    rng = random.Random(9)
    base = [rng.choice(VOCAB) for _ in range(150)]
    rows = []
    for i in range(60):  # each differs a little from the one before, the ends a lot
        rows.append((1000 - i, " ".join(base)))
        base[(i * 7) % 150] = f"new{i}"
    hub = [rng.choice(VOCAB) for _ in range(120)]
    rows += [(2000 + i, " ".join(near(rng, hub, 0.015))) for i in range(300)]
    check(spark, rows, 2)


@pytest.mark.parametrize("parts", [4, 64, 200])
def test_any_number_of_partitions(spark, parts):
    rng = random.Random(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        base = [rng.choice(VOCAB) for _ in range(300)]
        check(spark, [(i, " ".join([*base[:150], f"own{i}", *base[150:]])) for i in (1, 2, 3)], 2)
        rows = []
        for i in range(300):
            if i % 7 == 0:
                base = [rng.choice(VOCAB) for _ in range(60)]
            rows.append((i, " ".join(near(rng, base, 0.02))))
        check(spark, rows, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranges_follow_the_rows(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(near(rng, [f"w{j}-{i // 4}" for j in range(60)], 0.05))) for i in range(40)]
    classes = spark.range(40)
    assert n.ranges(classes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(n, "RANGE_ROWS", 30)
    assert n.ranges(classes) == 40 * n.TREES // 30 == 32
    check(spark, rows, 2)


def test_regions_of_several_components(spark):
    """One large group, texts that are nearly like it, and links between some of these."""
    rng = random.Random(11)
    base = [rng.choice(VOCAB) for _ in range(120)]
    rows = [(1000 + i, " ".join(near(rng, base, 0.01))) for i in range(250)]
    for i in range(120):  # far from the group, each with a twin that is near to it alone
        far = near(rng, base, 0.16)
        rows += [(3000 - 2 * i, " ".join(far)), (3001 - 2 * i, " ".join(near(rng, far, 0.03)))]
    rng.shuffle(rows)
    check(spark, rows, 2)


def test_pages_of_one_template_meet_rarely(spark):
    """Similarity of about 0.7 everywhere, and some true pairs: what the exact join lists grows with the pages, not with their square."""
    listed = {}
    for pages in (500, 2000):
        rng = random.Random(pages)
        frame = [rng.choice(VOCAB) for _ in range(100)]
        texts = [[*frame, *(f"p{i}x{j}" for j in range(21))] for i in range(pages)]
        for i in range(0, pages, 50):  # the page before it, with few words exchanged
            texts[i + 1] = [*texts[i][:-2], "z1", "z2"]
        df = spark.createDataFrame([(i, i, True, " ".join(t)) for i, t in enumerate(texts)], "node long, label long, seeks boolean, text string")
        sets = df.select("node", "text").rdd.map(lambda r: (r.node, bytearray(n.shingles(r.text, 2).tobytes()))).toDF("node long, own binary")
        pairs = n.bounded_pairs(df.drop("text"), sets, 80)
        found = {(r.a, r.b) for r in n.confirm(pairs, sets, 80).collect()}
        assert found == {(i, i + 1) for i in range(0, pages, 50)}
        listed[pages] = pairs.count()
    assert listed[2000] <= 6 * listed[500] <= 6 * 500


@pytest.mark.parametrize("similarity", [60, 80, 93])
def test_prefixes_miss_no_link(similarity):
    """Every linked pair shares a shingle of its prefixes within a band and the bound."""
    import numpy as np

    rng = np.random.default_rng(similarity)
    for _ in range(300):
        size = int(rng.integers(1, 80))
        base = np.unique(rng.integers(0, 1 << 62, size, dtype="u8"))
        other = np.unique(np.concatenate([base[rng.random(len(base)) < rng.choice([0.8, 0.9, 1])], rng.integers(0, 1 << 62, int(rng.integers(0, 10)), dtype="u8")]))
        if not len(other):
            continue
        both = len(np.intersect1d(base, other))
        if 100 * both < similarity * (len(base) + len(other) - both):
            continue
        often = np.zeros(n.COUNTERS, "u4")
        for s in (base, other):
            np.add.at(often, n._counter(s), 1)
        often += (rng.random(n.COUNTERS) < 0.5).astype("u4") * 3 * (often > 0)
        x, y = sorted((base, other), key=len)
        left, right = n.prefix(x, often, similarity), n.prefix(y, often, similarity)
        own = {int(k): int(at) for k, at, small in zip(*left[:3]) if small}
        band = int(n.band(len(x)))
        assert any(
            int(k) in own and not small and first <= band <= last and min(len(x) - own[int(k)], len(y) - at) * (100 + similarity) >= similarity * (len(x) + len(y))
            for k, at, small, first, last in zip(*right)
        )


def test_one_id_with_several_texts_is_one_document(spark):
    rng = random.Random(2)
    a, b = ([rng.choice(VOCAB) for _ in range(100)] for _ in range(2))
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, " ".join([*a, "x"])), (9, " ".join([*b, "y"])), (10, " ".join(b)), (4, "alone it stands"), (None, " ".join(a))]
    rows += [(50, f"many texts have this id {i} {i + 1} {i + 2}") for i in range(400)] + [(2, "many texts have this id 17 18 19")]
    got = n.groups(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(7, 7), (8, 7), (9, 7), (10, 7), (4, 4), (None, None), (50, 2), (2, 2)}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("words", [2, 5])
def test_recall_of_exact_links(spark, words):
    """All links of the documents, found by their shared shingles: none may be between two components."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in n.groups(docs, words=words).collect()}
    sets = {r.doc_id: set(n.shingles(r.text, words).tolist()) for r in docs.collect()}
    holders, links = {}, 0
    for i, own in sorted(sets.items()):
        shared = Counter(x for k in own for x in holders.get(k, ()))
        for j, both in shared.items():
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                links += 1
                assert got[i] == got[j], (i, j)
        for k in own:
            holders.setdefault(k, []).append(i)
    assert links > 20
    assert sum(i != c for i, c in got.items()) <= links


def test_repeated_rows_empty_and_long(spark):
    rows = [(7, "a b c"), (7, "a b c"), (3, "A B C"), (9, "x " * 50_000 + "y")]
    got = n.groups(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (7, 3, False), (7, 3, False), (9, 9, True)]
    assert n.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 200)] + [(500, x) for x in range(501, 700)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(80)]
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_links_are_written_in_few_files(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        found = components(spark.createDataFrame([(i, i + 1) for i in range(200) if i % 10 != 9], "a long, b long"))
        assert len(found.inputFiles()) == 1
        assert {r.node: r.label for r in found.collect()} == {i: i // 10 * 10 for i in range(200)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
