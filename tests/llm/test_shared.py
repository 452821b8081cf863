import os
from types import SimpleNamespace

import pyarrow as pa
import pytest

from quillon.llm import shared


def test_no_folder_is_refused():
    none = SimpleNamespace(get=lambda *_: None)
    session = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none))
    with pytest.raises(ValueError, match="names no folder"):
        shared.fresh_path(session, "x")


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with shared.scratch(spark):
        gone = shared.materialize(spark.range(3), "gone")
        with shared.scratch(spark):
            inner = shared.materialize(spark.range(4), "inner", keep=True)
        assert gone.count() == 3
    assert inner.count() == 4
    assert not any(os.path.exists(p.removeprefix("file://")) for p in gone.inputFiles())


def test_values_of_a_column():
    for n in (0, 1, 256, 700):
        own = [None if i % 5 == 3 else f"é{i}" for i in range(n)]
        assert list(shared.values(pa.array(own, pa.string()))) == own
    assert list(shared.values(pa.array(range(900), pa.int64()).slice(100, 600))) == list(range(100, 700))


def test_a_worker_keeps_what_one_kind_of_work_needs():
    from quillon.llm import decontaminate, lang_id, near_dedup, tokens

    path, texts = tokens.vocabulary("byte_bpe_50k.json"), pa.record_batch({"doc_id": [1], "text": ["one two three"]})
    made = tokens.encoder(path)
    assert tokens.encoder(path) is made
    signed = list(near_dedup._signed(2)(iter([texts])))
    assert not tokens._ENCODERS and near_dedup._WORDS
    assert list(near_dedup._signed(2)(iter([texts]))) == signed and near_dedup._WORDS
    own = lang_id.compressors({"en": b" the of and "})
    assert not near_dedup._WORDS and lang_id.compressors({"en": b" the of and "}) is own
    decontaminate.matcher("key", [(1, "a benchmark item")], 10, 8)
    assert not lang_id._CACHE and decontaminate._MATCHERS
    again = tokens.encoder(path)
    assert not decontaminate._MATCHERS and again is not made and again.ids("one two three") == made.ids("one two three")


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    def largest():
        sizes = lambda batches: (pa.record_batch({"n": [b.nbytes]}) for b in batches)
        rows = spark.range(0, 10_000, 1, 1).selectExpr("repeat('abcdefgh ', 200) AS text").mapInArrow(sizes, "n long").collect()
        return max(r.n for r in rows)

    before = spark.conf.getAll.get(shared.BATCH_SETTING)
    spark.conf.unset(shared.BATCH_SETTING)
    try:
        assert largest() > 10 << 20
        shared.small_batches(spark)
        assert largest() < 5 << 20
        spark.conf.set(shared.BATCH_SETTING, "64m")
        shared.small_batches(spark)
        assert largest() > 10 << 20
    finally:
        spark.conf.unset(shared.BATCH_SETTING) if before is None else spark.conf.set(shared.BATCH_SETTING, before)
