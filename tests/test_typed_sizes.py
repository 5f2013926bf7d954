"""What columns hold doesn't depend on how many rows there are."""

from pyspark.sql import functions as F

from loglake.operators import columns


def many(spark, n, low=20000, ports=3000):
    """A source of ``n`` lines with ``ports`` ephemeral ports."""
    return spark.range(n).select(F.lit("s").alias("source_id"), F.lit("c1_port").alias("field"), (F.col("id") % ports + low).cast("string").alias("value"))


def test_ports_of_a_large_table(spark):
    for n in (400, 60_000):
        got = {r["type"] for r in columns.candidates(many(spark, n)).collect()}
        assert got == {"port", "integer"}, n
        assert columns.typed(many(spark, n)).first()["path"] == "src_endpoint.port", n


def test_few_numbers_are_no_ports(spark):
    for n in (400, 60_000):
        assert {r["type"] for r in columns.candidates(many(spark, n, ports=30)).collect()} == {"integer"}, n


def test_proposals_of_a_large_source(spark):
    from loglake.operators import propose

    e = F.col("id")
    lines = lambda raw: spark.range(40_000).select(e.alias("record_id"), F.lit("s").alias("source_id"), raw.alias("raw"))
    kv = lines(F.format_string("src=10.0.0.%d sport=%d", e % 200, e % 3000 + 20000))
    (got,) = propose.propose_kv(kv).collect()
    assert {(m["from"], m["to"]) for m in got["map"]} >= {("src", "src_endpoint.ip"), ("sport", "src_endpoint.port")}
    known = spark.createDataFrame([("s", ["srcport"], "src_endpoint.port")], "source_id string, from array<string>, to string")
    assert ("moved", "srcport", "sport") in {tuple(r)[1:4] for r in propose.propose_kv_patch(kv, known).collect()}
    slots = propose.template_slots(lines(F.format_string("Built 10.0.0.%d/%d", e % 200, e % 3000 + 20000))).filter("kind = 'slot'").collect()
    assert {r["path"] for r in slots} == {"src_endpoint.ip", "src_endpoint.port"}
