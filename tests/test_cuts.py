"""Greedy cuts against a sequential loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglake.operators import cuts
from loglake.sources import exports


def sequential(sizes, most, limit, under):
    out, batch, held, count = [], 0, 0, 0
    for s in sizes:
        if under and count and (held + s > most or count == limit):
            batch, held, count = batch + 1, 0, 0
        out.append(batch)
        held, count = held + s, count + 1
        if not under and (held >= most or count == limit):
            batch, held, count = batch + 1, 0, 0
    return out


@pytest.mark.parametrize("under", [True, False])
@pytest.mark.parametrize("limit", [None, 1, 7])
def test_ranges_against_a_loop(under, limit):
    r = random.Random(9)
    for _ in range(300):
        sizes = [r.randrange(1, 12) for _ in range(r.randrange(1, 60))]
        rule, most = None, r.randrange(1, 30)
        rule = cuts.Rule(most, limit, under)
        want = sequential(sizes, most, limit, under)
        at, state = 0, (0, 0, 0)
        while at < len(sizes):
            n = r.randrange(1, 20)
            part = np.array(sizes[at : at + n])
            t = cuts.table(part, rule)
            total, base, first, begins = np.cumsum(part), -state[0], -state[1], []
            while (k := int(rule.next(total, base, first))) < len(total):
                begins.append(k)
                base, first = int(total[k - 1]) if k else 0, k
            got = state[2] + np.searchsorted(begins, np.arange(len(part)), side="right")
            assert got.tolist() == want[at : at + n], (sizes, most, at, n)
            k = cuts.first_cut(rule, t["total"], t["n"], state)
            state = (state[0] + t["bytes"], state[1] + t["n"], state[2]) if k > t["n"] else (t["open_bytes"][k], t["open_rows"][k], state[2] + t["cuts"][k])
            at += n


@pytest.mark.parametrize("under", [True, False])
def test_tables(spark, under):
    r = random.Random(2)
    rows = [(g, k, r.randrange(1, 400), "x") for g, n in (("hot", 3000), ("b", 40), (None, 5)) for k in range(n)]
    table = spark.createDataFrame(rows, "g string, k bigint, n bigint, other string").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several ranges, however little there is
    try:
        got = cuts.cut(table, "g", "k", "n", 1000, 20, under).orderBy("g", "k").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for g in ("hot", "b", None):
        mine = [x for x in got if x["g"] == g]
        assert [x["batch"] for x in mine] == sequential([x["n"] for x in mine], 1000, 20, under)
    assert cuts.cut(table.limit(0), "g", "k", "n", 10).collect() == []


def test_envelopes(spark, sf_dir):
    from loglake.plans.service import export_rows

    lines = exports.hec(export_rows(spark, sf_dir))
    sized = exports.batches(lines, "source_id", "record_id", "bytes", 20_000).groupBy("source_id", "batch").agg(F.sum("bytes").alias("b"))
    assert sized.filter("b > 20000").count() == 0
    one = lines.select(F.get_json_object("line", "$.event.ocsf.actor_user_name").alias("u"), F.get_json_object("line", "$.sourcetype").alias("t")).first()
    assert one["u"].startswith("u") and one["t"] == "loglake:event"
