"""A line is read once, whatever filters and formats follow."""

from pyspark.sql import functions as F

from loglake.operators import extract, normalize
from loglake.plans.lines import KV_SPEC, kv_lines


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_do_not_repeat_the_extraction(spark, sf_dir):
    parsed = normalize.normalize(kv_lines(spark, sf_dir), [KV_SPEC])
    every, some = plan(parsed), plan(parsed.filter("event is not null").select("record_id", F.size("event.dupes")))
    assert some.count("regexp_extract_all") == every.count("regexp_extract_all")


def test_pairs_keep_their_quotes_and_ends(spark):
    cases = {
        'a=1 b="x y" c=z': ([("a", "1"), ("b", "x y"), ("c", "z")], []),
        'a="" b="c=d e': ([("a", ""), ("b", "c=d e")], ["key_injection_suspect"]),
        'a=x"y z" b="': ([("a", 'x"y'), ('z" b', "")], ["key_injection_suspect"]),
        'a="1"b=2 a=3': ([("a", "1"), ("b", "2")], ["duplicate_key"]),
        'k =\n v=1': ([("k ", "\n"), ("v", "1")], []),
        "no pair": ([], []),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", extract.kv(F.col("raw")).alias("x")).collect()
    assert {r["raw"]: (list(r["x"]["fields"].items()), r["x"]["flags"]) for r in rows} == cases
