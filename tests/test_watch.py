"""The drift loop as a stream against the same decisions from whole tables."""

import random

from pyspark.sql import functions as F

from loglake.operators import drift
from loglake.streaming import watch

SCHEMA = "source_id string, record_id bigint, raw string, parsed boolean, parser_id string"


def kv(n):
    return f"ts={1_700_000_000_000 + n} user=u{n % 7} action=\"view\" value={n % 50}.5"


def renamed(n):
    return f"when={1_700_000_000_000 + n} login=u{n % 7} act=view amount={n % 50} zone=z{n % 3}"


def batches():
    """Sources over four batches: calm stays healthy, moved is renamed in the second batch, few has under fifty lines, late comes with the third."""
    n, out = 0, []
    for b in range(4):
        rows = []
        for source, lines in (("calm", 80), ("moved", 80), ("few", 8), ("late", 60 if b >= 2 else 0)):
            for _ in range(lines):
                n += 1
                bad = (source == "moved" and b >= 1) or (source == "late")
                rows.append((source, n, renamed(n) if bad else kv(n), not bad, None if bad else "kv"))
        if b == 1:
            rows = [r for r in rows if r[0] != "calm"]  # nothing of calm came
        random.Random(b).shuffle(rows)
        out.append(rows)
    return out


def test_stream_over_restarts(spark, tmp_path):
    every, size = batches(), 120
    src, root, ck = tmp_path / "in", f"file://{tmp_path}/state", str(tmp_path / "ck")
    for k, rows in enumerate(every):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        loop = watch.Watch(spark, root, size)  # a new one each time: a restart
        stream = spark.readStream.schema(SCHEMA).parquet(str(src))
        q = loop.start(stream, ck)
        assert q.awaitTermination(600)
        assert loop.committed() == list(range(k + 1))
    got = {}
    for r in loop.outcomes().collect():
        got.setdefault(r["batch"], {})[r["source_id"]] = r

    # the same, of plain Python windows
    window, base, alerts = {}, {}, {}
    for k, rows in enumerate(every):
        for source in {r[0] for r in rows}:
            window[source] = sorted(window.get(source, []) + [r for r in rows if r[0] == source], key=lambda r: r[1])[-size:]
        assert got[k].keys() == {r[0] for r in rows}
        for source, r in got[k].items():
            lines = window[source]
            fine, rest = [x for x in lines if x[3]], [x for x in lines if not x[3]]
            rate = len(rest) / len(lines)
            assert (r["parsed"], r["quarantined"]) == (len(fine), len(rest))
            score = round(rate, 4)
            if source in base:
                frame = lambda x: spark.createDataFrame(x, SCHEMA)
                rates = spark.createDataFrame([(source, rate)], "source_id string, rate double")
                score = drift.compared(frame(base[source]), frame(rest if len(rest) >= 50 else lines), rates).first()["score"]
            assert r["score"] == score
            if len(lines) < 50:
                want = "needs_samples"
            elif score < 0.35 and rate <= 0.2:
                want, base[source] = "baseline", fine
                alerts.pop(source, None)
            elif len(rest) < 50 or alerts.get(source):
                want = "alert"
            else:
                want = "proposal"
            assert r["decision"] == want, (k, source)
            if want in ("alert", "proposal"):
                alerts[source] = alerts.get(source, False) or want == "proposal"
    assert [got[k]["moved"]["decision"] for k in range(4)] == ["baseline", "proposal", "alert", "alert"]
    assert len({got[k]["moved"]["alert_id"] for k in (1, 2, 3)}) == 1
    assert [got[k]["late"]["decision"] for k in (2, 3)] == ["proposal", "alert"]
    assert {got[k]["calm"]["decision"] for k in got if "calm" in got[k]} == {"baseline"}


def test_again_closed_and_empty(spark, tmp_path):
    loop = watch.Watch(spark, f"file://{tmp_path}/s", 100)
    bad = spark.createDataFrame([("a", n, renamed(n), False, None) for n in range(70)], SCHEMA)
    loop.step(bad.limit(0), 0)
    assert loop.outcomes().count() == 0
    loop.step(bad, 1)
    loop.store.drop("commits/1")  # the batch ends before its commit and is run again
    loop.step(bad, 1)
    loop.step(bad, 1)
    assert [(r["decision"], r["alert_id"]) for r in loop.outcomes().collect()] == [("proposal", "a-1")]
    loop.step(bad.withColumn("record_id", F.col("record_id") + 100), 2, spark.createDataFrame([("a-1",)], "alert_id string"))
    last = loop.outcomes().filter("batch = 2").first()
    assert (last["decision"], last["alert_id"], last["quarantined"]) == ("proposal", "a-2", 100)
