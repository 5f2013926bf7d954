"""What columns hold is told from values that are counted once, and dear readers get only what they may read."""

import pytest
from pyspark.sql import functions as F

from loglake.operators import columns
from loglake.plans import catalog

TIMES = [
    "2024/01/02 03:04:05", "+12024/01/02 03:04:05", "2024-01-02 03:04:05", "Jan  2 03:04:05", " Jan 2 03:04:05", "ſep 2 03:04:05", "Feb 29 03:04:05", "Feb 30 03:04:05", "02/Jan/2024:03:04:05 +0530", "JAN 2 2024 03:04:05",
    "2024-01-02", "03:04:05", "10.0.0.1", "1704164645", "17041646451234", "fd00::1", "2024 Jan 2 03:04:05", "12 % of", "", None,
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def levels(spark, n=400):
    """Many values, few values and none, of two sources."""
    e = F.col("id")
    few, at = F.array(F.lit("Low"), F.lit("low"), F.lit("HIGH"), F.lit("")), F.col("id").cast("int")
    cut = lambda name, value: spark.range(n).select(F.concat(F.lit("s"), e % 2).alias("source_id"), F.lit(name).alias("field"), value.alias("value"))
    return cut("src_1", F.format_string("10.0.0.%d", e % 200)).union(cut("level_2", F.element_at(few, at % 4 + 1))).union(cut("none_3", F.lit("")))


@pytest.mark.parametrize("name", ["role_assignment", "typed_fields", "role_by_values", "column_candidates", "time_layout"])
def test_lines_are_read_once(spark, sf_dir, name):
    got = plan(catalog.QUERIES[name](spark, sf_dir))
    assert got.count("Scan parquet") == 1
    assert got.count("Expand [") == 1


def test_lists_share_the_counts(spark):
    df = columns.typed(levels(spark))
    got = {(r["source_id"], r["field"]): (r["listed"], r["least_value"]) for r in df.collect()}
    assert "ReusedExchange" in plan(df)
    assert got == {("s0", "src_1"): (None, None), ("s1", "src_1"): (None, None), ("s0", "level_2"): (["high", "low"], "HIGH"), ("s1", "level_2"): (["low"], "low"), ("s0", "none_3"): ([], None), ("s1", "none_3"): ([], None)}


def test_readers_get_only_what_they_may_read(spark):
    values = spark.createDataFrame([(t,) for t in TIMES], "value string")
    text = F.regexp_replace("value", " +", " ")
    read = {p: (F.try_to_timestamp(text, F.lit(p)) if "yyyy" in p else F.try_to_timestamp(F.concat(F.lit("2000 "), text), F.lit(f"yyyy {p}"))).isNotNull() for p in columns.LAYOUTS}
    tests = columns.layout_tests(F.col("value"))
    for p in columns.LAYOUTS:
        rows = values.select("value", read[p].alias("a"), tests[p].alias("b")).collect()
        assert [r["value"] for r in rows if r["a"]] == [r["value"] for r in rows if r["b"]] != [], p
        # the reader stands behind a test of the layout's signs
        told = tests[p]._jc.toString()
        assert "contains" in told and told.index("contains") < told.index("try_to_timestamp"), p
