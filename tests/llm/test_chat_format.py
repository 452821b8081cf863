from quillon.llm import chat_format as c

U, A = "user", "assistant"


def pairs(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")


def test_prompt_and_masks(spark):
    rows = [
        (1, [(U, "hi"), (A, "good"), (U, "more"), (A, "yes")], [(U, "hi"), (A, "bad")]),
        (2, [(U, "q"), (A, "a")], [(U, "q"), (A, "a")]),
        (3, [(U, "x")], [(U, "y")]),
        (4, [(U, "x")], None),
        (5, [], []),
        (6, [(U, "a")], [(U, "a"), (A, "é\n" * 9000)]),
    ]
    got = {r.pair_id: r for r in c.format_preferences(pairs(spark, rows)).collect()}
    r = got[1]
    assert r.n_common == 1 and r.prompt == "<|user|>\nhi<|end|>\n" and r.rejected == "<|assistant|>\nbad<|end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["good", "yes"] and [r.rejected[s.start : s.end] for s in r.rejected_mask] == ["bad"]
    assert (got[2].n_common, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (2, "", "", [])
    assert got[3].n_common == 0 and got[3].prompt == "" and got[3].chosen_mask == []
    assert got[4].prompt is None and got[4].chosen is None and got[5].prompt == ""
    assert [got[6].rejected[s.start : s.end] for s in got[6].rejected_mask] == ["é\n" * 9000]


def test_pairs_from_conversations(spark):
    rows = [(0, 0, U, "q", 1), (0, 1, A, "a0", 1), (0, 2, U, "thanks", 1), (1, 1, A, "a1", 1), (1, 0, U, None, 1), (2, 0, U, "alone", 1), (4, None, A, "x", 1), (5, 0, U, "no reply", 1), (None, 0, A, "n", 1), (1, 1, A, "a1", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, last int")
    made = c.swapped_replies(df)
    got = {r.pair_id: r for r in c.format_preferences(made).collect()}
    assert set(got) == {0, 1, 2, 4, 5}
    assert got[0].prompt == "<|user|>\nq<|end|>\n" and got[0].chosen.startswith("<|assistant|>\na0") and got[0].rejected.startswith("<|assistant|>\na1") and got[0].rejected.endswith("thanks<|end|>\n")
    assert got[2].rejected is None and got[4].rejected is None and got[5].rejected is None
    assert c.format_preferences(c.swapped_replies(df.where("false"))).collect() == []
    assert "Python" not in made._jdf.queryExecution().toString()


def test_very_many_turns(spark):
    turns = [(A if i % 2 else U, "x" * (i % 7)) for i in range(20_001)]
    r = c.format_preferences(pairs(spark, [(1, turns, [(U, "other")])])).first()
    assert r.n_common == 0 and len(r.chosen_mask) == 10_000
    assert all(r.chosen[s.start : s.end] == "x" * ((2 * i + 1) % 7) and r.chosen[: s.start].endswith("<|assistant|>\n") for i, s in list(enumerate(r.chosen_mask))[::37])


def test_no_turns_and_early_divergence(spark):
    rows = [(1, [], [(A, "only")]), (2, [(U, "a"), (A, "b"), (U, "c"), (A, "d")], [(U, "a"), (A, "B"), (U, "c"), (A, "d")])]
    got = {r.pair_id: r for r in c.format_preferences(pairs(spark, rows)).collect()}
    assert (got[1].n_common, got[1].chosen, got[1].chosen_mask) == (0, "", []) and len(got[1].rejected_mask) == 1
    assert got[2].n_common == 1 and [got[2].rejected[s.start : s.end] for s in got[2].rejected_mask] == ["B", "d"]
