import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from quillon.sources import csv_import, records


def text_of(rows, sep=",", end="\n"):
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator=end).writerows(rows)
    return out.getvalue()


def read(spark, path, **kw):
    df = csv_import.read_csv(spark, str(path), most_bytes=None, **kw)
    return df, [tuple(r)[1:-1] for r in df.orderBy(csv_import.ORDINAL).collect()]


@pytest.mark.parametrize("size", [64, 300, 1 << 27])
@pytest.mark.parametrize("sep", [",", ";"])
def test_ranges_of_a_file_agree_with_one_pass(spark, tmp_path, size, sep):
    """Line ends, quotes and separators within quotes; ranges that begin within a quoted field, or hold nothing else."""
    rng = random.Random(size)
    piece = lambda: rng.choice(["x", "a b", "\n", '"', sep, "\n\n", '""', "é", '"\n', f'{sep}"', "1"])
    rows = [["nombre", "ciudad", "tel"]] + [["".join(piece() for _ in range(rng.choice([1, 1, 2, 30]))) + "z" for _ in range(3)] for _ in range(150)]
    (tmp_path / "in.csv").write_text(text_of(rows, sep), encoding="utf-8", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        df, got = read(spark, tmp_path / "in.csv")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [tuple(r) for r in rows[1:]]
    assert [r[0] for r in df.select(csv_import.ORDINAL).orderBy(csv_import.ORDINAL).collect()] == list(range(1, 151))


def test_files_of_a_folder_are_numbered_on(spark, tmp_path):
    for i, rows in enumerate([[["name", "city"], ["a", "x\ny"]], [["name", "city"]], [["name", "city"], ["b", ""], ["c", "z"]]]):
        (tmp_path / f"{i}.csv").write_text("\n" * i + text_of(rows) + "\n  \n")
    (tmp_path / "9.csv").write_text("")
    df, got = read(spark, tmp_path)
    assert got == [("a", "x\ny"), ("b", None), ("c", "z")]
    (tmp_path / "8.csv").write_text("name,other\nq,r\n")
    with pytest.raises(ValueError, match="different headers"):
        read(spark, tmp_path)


def test_a_quote_that_is_never_closed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MOST_LINES", 50)
    (tmp_path / "in.csv").write_text("name,city\na,b\nc,\"d\n" + "e,f\n" * 100)
    with pytest.raises(records.UnclosedQuoteError, match="more than 50 lines"):
        read(spark, tmp_path / "in.csv")


def test_what_a_line_does_to_quotes(spark):
    cases = {
        "a,b": (False, True), '"a",b': (False, True), 'a,"b': (True, True), 'b",c': (False, False), '"': (True, False), 'x"y,z': (False, True), '"a""b': (True, True), "": (False, True),
        'end","again': (True, True), '""': (False, True), 'a"': (False, False),
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    outside, within = records.open_after(F.col("v"), ",")
    got = {r.v: (r.o, r.w) for r in df.select("v", outside.alias("o"), within.alias("w")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in cases.items()}
    assert {k: got[k][1] for k in cases if k != '""'} == {k: cases[k][1] for k in cases if k != '""'}
