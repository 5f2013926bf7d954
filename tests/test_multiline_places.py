"""Multi-line records without their text."""

from loglake.operators import framing


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_multiline_sorts_a_file_once(spark):
    raws = {1: ["x", "A", "b", "c", "d", "e", "A", "A", "f"], 2: ["b", "c"], 3: ["A"], 4: ["A", "b", "A", "b", "c", "d"]}
    lines = spark.createDataFrame([(f, n, r) for f, rows in raws.items() for n, r in enumerate(rows, 1)], "file long, pos long, raw string")
    whole, places = (framing.multiline(lines, "file", "pos", "^A", max_lines=3, text=text) for text in (True, False))
    rows = lambda df: sorted(tuple(r) for r in df.select("file", "pos", "lines").collect())
    assert rows(whole) == rows(places)
    assert rows(places)[:5] == [(1, 1, 1), (1, 2, 3), (1, 5, 1), (1, 6, 1), (1, 7, 1)]
    assert {(r["file"], r["pos"]): r["raw"] for r in whole.collect()}[4, 3] == "A\nb\nc"
    assert plan(places).count("Sort [") == 1 and "Aggregate" not in plan(places)
