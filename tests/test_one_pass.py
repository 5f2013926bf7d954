"""Windows that go through their rows once."""

from pyspark.sql import functions as F

from loglake.operators import identity
from loglake.plans.records import facts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_graph_makes_claims_once(spark, sf_dir):
    made = plan(identity.graph_edges(identity.claims(facts(spark, sf_dir))))
    assert made.count("FileScan") == 1 and "_who" not in made


def test_a_holder_without_a_name_renews(spark):
    rows = spark.sql("SELECT 'dhcp' AS kind, a AS action, '10.0.0.1' AS ip, u AS user, CAST(NULL AS STRING) AS host, '' AS mac, timestamp_seconds(s) AS at, r AS record_id FROM VALUES ('bind', NULL, 0, 1L), ('bind', '', 60, 2L), ('bind', 'x', 90, 3L) t(a, u, s, r)")
    found = identity.claims(rows).select("record_id", F.unix_seconds("valid_from").alias("f"), F.unix_seconds("valid_to").alias("t")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 0, 90), (3, 90, 90 + 8 * 3600)]
