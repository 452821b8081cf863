from quillon.llm import line_dedup as d


def test_only_built_in_functions(spark):
    df = spark.createDataFrame([(i, "y" * 40 + "\nown") for i in range(6)], "doc_id long, text string")
    out = d.drop_shared_lines(df)
    assert not any(n in out._jdf.queryExecution().executedPlan().toString() for n in ("Python", "Pandas", "Arrow"))
    assert {(r.doc_id, r.text, r.n_dropped) for r in out.collect()} == {(i, "own", 1) for i in range(5)} | {(5, "y" * 40 + "\nown", 0)}


def test_an_id_with_several_texts(spark):
    """Positions are those of a row's own text; lines that occur twice go twice."""
    x, y = "x" * 40, "Y" * 45
    rows = [(1, f"{x}\na\n{y}"), (1, f"b\n{y}\n{x}\n{x}\n"), (1, "c"), *[(i, f"{x}\n{y}") for i in range(2, 7)]]
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in d.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "a", 3, 2), (1, "b\n", 5, 3), (1, "c", 1, 0), *((i, "", 2, 2) for i in range(2, 6)), (6, f"{x}\n{y}", 2, 0)}


def test_very_many_lines(spark):
    """Linear in the lines of a text, also where all of them go."""
    lines = [f"shared line with a number and some more words {i}" for i in range(100_000)]
    rows = [(i, "\n".join(lines)) for i in range(5)] + [(5, "\n".join(lines[::-1]))]
    got = {r.doc_id: (len(r.text), r.n_lines, r.n_dropped) for r in d.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (0, 100_000, 100_000) for i in range(5)} | {5: (sum(map(len, lines)) + 99_999, 100_000, 0)}
