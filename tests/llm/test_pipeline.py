import os
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from quillon.llm import decontaminate, shared
from tests.llm.test_lang_id import by_hand
from tests.llm.test_line_dedup import key
from tests.llm.test_near_dedup import brute

DIR = "/root/testdata/sf0.001"


def nearest(p, t):
    """Edits between p and the nearest part of t: every cell of the table, row by row."""
    row, place, codes = np.zeros(len(t) + 1, "i4"), np.arange(len(t) + 1, dtype="i4"), np.array(list(map(ord, t)))
    for i, a in enumerate(p, 1):
        new = np.append(i, np.minimum(row[:-1] + (codes != ord(a)), row[1:] + 1)).astype("i4")
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "packing"]
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), before.schema)
        assert docs.columns == before.columns
        kept[name] = (before.collect(), docs.collect())
    a, b = kept["language"]
    learned = [(r.doc_id, r.text, r.lang) for r in a if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    judged = by_hand(learned, [r.text for r in a])
    assert Counter(b) == Counter(r for r, (lang, lead) in zip(a, judged, strict=True) if lang != "und" and lead >= 0.03)
    assert len(b) >= 0.97 * len(a)
    a, b = kept["lines"]
    assert len(a) == len(b)
    lines = Counter()
    for r in b:
        lines.update({key(x) for x in (r.text or "").split("\n") if len(key(x)) >= 40})
    assert max(lines.values()) < 5
    a, b = kept["near_duplicates"]
    want = brute([(r.doc_id, r.text) for r in a], 5)
    assert {r.doc_id for r in b} == {i for i, (_, c) in want.items() if c == i}
    a, b = kept["decontamination"]
    items = [decontaminate.normal(r.text or "") for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    texts = {r.doc_id: decontaminate.normal(r.text or "") for r in a}
    assert {r.doc_id for r in b} == {i for i, t in texts.items() if not any(nearest(p, t) <= decontaminate.budget(len(p)) for p in items if p and t)}
    packed = cp.pack(spark, docs, DIR).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in b}
    whole = cp.run(spark, DIR).collect()
    assert Counter((r.doc_id, r.start, r.length) for r in whole) == Counter((r.doc_id, r.start, r.length) for r in packed)


WORDS = "the of and to in is that for it as with on be at by this was are or an from which you have not all one had but what when can said there".split()
KINDS = "doc_id long, text string, lang string, source string, n_chars long, doc long, id long, accepted string, label string, kept int, row int, gone int, new int, spread int, node int"


def table(spark, rows):
    extra = (1, 2, "a", "b", 3, 4, 5, 6, 7, 8)
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *extra) for i, t, lang in rows], KINDS)


def english(k, n=60):
    return " ".join(WORDS[(k * 7 + i * i * (k + 3)) % len(WORDS)] + ("s" if (i + k) % 5 == 0 else "") for i in range(n))


@pytest.fixture(scope="module")
def stages():
    return dict(cp.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([(1, english(77)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


SHARED = "this line of forty characters and more stands everywhere"
ODD = [(100, None, "en"), (101, "", None), (102, " \n ", "en"), (None, english(50), "en"), (None, None, None)]


def test_language_stage(spark, stages, folder):
    rows = [(i, english(i), "en") for i in range(30)] + [(40 + i, "der und das mit nicht ein auf dem wir haus von zur ist " * 5 + str(i), "de") for i in range(30)]
    rows += [(3, english(3), "en")] * 2 + [(200, english(9) * 300, None), (201, "12 34", "en"), *ODD]
    out = stages["language"](spark, table(spark, rows), folder)
    assert out.columns == table(spark, []).columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == Counter((i, t) for i, t, _ in rows if t and any(map(str.isalpha, t)))
    assert {tuple(r)[5:] for r in out.collect()} == {(1, 2, "a", "b", 3, 4, 5, 6, 7, 8)}
    with pytest.raises(ValueError, match="no document has a label"):
        stages["language"](spark, table(spark, [(1, "a text", None)]), folder)


def test_lines_stage(spark, stages, folder):
    rows = [(i, f"{english(i, 5)}\n{SHARED}", "en") for i in range(6)] + [(2, f"{english(2, 5)}\n{SHARED}", "en"), (None, SHARED, "en"), (300, "\n".join([SHARED.upper()] * 4000), None), *ODD]
    out = stages["lines"](spark, table(spark, rows), folder)
    assert out.columns == table(spark, []).columns
    want = Counter((i, english(i, 5) if i is not None and i < 6 else t) for i, t, _ in rows)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want


def test_near_duplicates_stage(spark, stages, folder):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:100], f"own{i}", *base[100:]]), "en") for i in (9, 5, 7)] + [(5, " ".join(base), "en")] * 2
    rows += [(400, english(1) * 500, "en"), (401, english(1) * 500, "en"), *ODD]
    out = stages["near_duplicates"](spark, table(spark, rows), folder)
    assert out.columns == table(spark, []).columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, t) for i, t, _ in rows if i not in (7, 9, 401))


def test_decontamination_stage(spark, stages, folder):
    rows = [(1, f"start {english(77)} end", "en"), (1, f"start {english(77)} end", "en"), (2, english(3), "en"), (3, english(5) * 400 + " " + english(77), None), *ODD]
    out = stages["decontamination"](spark, table(spark, rows), folder)
    assert out.columns == table(spark, []).columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, t) for i, t, _ in rows if i not in (1, 3))


def test_packing_stage(spark, stages, folder):
    rows = [(1, english(1), "en"), (1, english(1), "en"), (2, english(3) * 400, None), *ODD]
    got = stages["packing"](spark, table(spark, rows), folder).collect()
    assert Counter(str(r.doc_id) for r in got if r.start == 0) == Counter(str(i) for i, _, _ in rows)
    sizes = {i: {r.doc_tokens for r in got if r.doc_id == i} for i in (1, 2, 100, 101)}
    assert sizes[100] == sizes[101] == {1} and all(len(s) == 1 for s in sizes.values())
    assert sum(r.length for r in got if r.doc_id == 2) == sizes[2].pop() > 2048


def test_empty_table_in_every_stage(spark, stages, folder):
    for name, stage in stages.items():
        out = stage(spark, table(spark, []), folder)
        assert out.collect() == [] and (name == "packing" or out.columns == table(spark, []).columns)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_stages_with_python_bound_their_batches(spark):
    docs = spark.createDataFrame([(i, "some words of a short text", "en", "web") for i in range(1, 9)], "doc_id long, text string, lang string, source string")
    before = spark.conf.getAll.get(shared.BATCH_SETTING)
    try:
        for name, stage in cp.STAGES:
            spark.conf.unset(shared.BATCH_SETTING)
            stage(spark, docs, DIR)
            assert name == "lines" or spark.conf.get(shared.BATCH_SETTING) == shared.BATCH_BYTES, name
    finally:
        spark.conf.unset(shared.BATCH_SETTING) if before is None else spark.conf.set(shared.BATCH_SETTING, before)
