"""Following files, identities and fan-out as streams, over restarts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loglake.operators import identity
from loglake.plans.records import asked as questions
from loglake.plans.records import facts as all_facts
from loglake.sources import tail
from loglake.streaming import fanout
from loglake.streaming import identity as stream


def lines(spark, tmp_path, run):
    """What one run over the folder gives."""
    q = tail.follow(spark, str(tmp_path / "in")).select("addr", "offset", "raw", "source_id").writeStream.format("parquet").option("path", str(tmp_path / f"out{run}")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(r["raw"] for r in spark.read.parquet(str(tmp_path / "out0")).collect())


def test_appended_bytes_over_restarts_and_rotation(spark, tmp_path):
    folder = tmp_path / "in/gate"
    folder.mkdir(parents=True)
    log = folder / "a.log"
    log.write_bytes(b"one\ntwo\nhal")
    assert lines(spark, tmp_path, 0) == ["one", "two"]  # a partial line waits
    with log.open("ab") as f:
        f.write(b"f\nthree\r\n")
    assert lines(spark, tmp_path, 0) == ["half", "one", "three", "two"]
    assert lines(spark, tmp_path, 0) == ["half", "one", "three", "two"]  # nothing new
    os.rename(log, folder / "a.log.1")  # rotated: the old file goes on, the new one begins
    with (folder / "a.log.1").open("ab") as f:
        f.write(b"last of the old\n")
    log.write_bytes(b"one\nnew\n")
    (folder / "b.log").write_bytes(b"")
    want = ["half", "last of the old", "new", "one", "one", "three", "two"]
    assert lines(spark, tmp_path, 0) == want
    with (folder / "b.log").open("ab") as f:
        f.write(b"b1\n")
    inode = log.stat().st_ino
    with log.open("r+b") as f:  # cut short in place and written anew
        f.truncate(0)
        f.write(b"again\n")
    assert log.stat().st_ino == inode
    assert lines(spark, tmp_path, 0) == sorted([*want, "again", "b1"])


def test_whole_lines(tmp_path):
    p = tmp_path / "x"
    for data in (b"", b"a", b"a\n", b"a\nb", b"\n" * 5 + b"x" * 300, b"x" * 300 + b"\n" + b"y" * 300):
        p.write_bytes(data)
        assert tail.whole_lines(str(p), len(data), b"\n", step=7) == data.rfind(b"\n") + 1


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, old)


def test_identity_stream_ends_in_the_batch_result(spark, sf_dir, tmp_path, rocks):
    facts = all_facts(spark, sf_dir).select("kind", "action", "ip", "mac", "host", "user", "at", "record_id")
    ask = questions(spark, sf_dir).select("id", "ip", "at")
    denser = F.timestamp_micros((F.unix_micros("at") - 1704067200000000) % 86400000000 + 1704067200000000)  # all on one day, so that facts meet
    facts, ask = facts.withColumn("at", denser), ask.withColumn("at", denser)
    some = [r[0] for r in facts.select("ip").distinct().orderBy("ip").limit(40).collect()]
    facts, ask = facts.filter(F.col("ip").isin(some)).cache(), ask.filter(F.col("ip").isin(some)).cache()
    r = random.Random(4)
    for k, (f, a) in enumerate(zip(facts.randomSplit([1.0] * 3, 7), ask.randomSplit([1.0] * 3, 8))):
        f.withColumn("_r", F.rand(r.randrange(99))).orderBy("_r").drop("_r").coalesce(1).write.parquet(str(tmp_path / f"facts/{k}"))
        a.coalesce(1).write.parquet(str(tmp_path / f"ask/{k}"))
    read = lambda name, like: spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))
    for _ in range(2):  # a second run finds nothing new
        q = stream.identities(read("facts", facts), read("ask", ask)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    changes = spark.read.parquet(str(tmp_path / "out"))
    want = identity.claims(identity.valid_facts(facts))
    blank = lambda df: df.select("ip", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in identity.HOLDER], "valid_from", "valid_to", "closed", "record_id")
    assert sorted(map(tuple, blank(stream.claims_now(changes)).collect())) == sorted(map(tuple, blank(want).collect()))
    cols = ["id", "ip", "user", "confidence", "valid_from", "valid_to", "host", "mac"]
    got = {r["id"]: tuple(r) for r in stream.answers_now(changes).select(*cols).collect()}
    truth = {r["id"]: tuple(r) for r in identity.resolve(ask, want, "id").select(*cols).collect()}
    assert got == truth
    assert changes.filter("what = 'window'").count() > 0 and changes.filter("what = 'claim' and n = -1").count() > 0


def test_windows_of_change():
    bind = lambda at, user, record: ("radius", "bind", user, "", "", at * stream.HOUR, record)
    early, late = [bind(0, "a", 1)], [bind(0, "a", 1), bind(4, "b", 2)]
    spans = stream.windows(stream.derive(early), stream.derive(late), 9 * stream.HOUR)
    assert spans == [(4 * stream.HOUR, 9 * stream.HOUR + 1)]  # up to the last question
    assert stream.windows(stream.derive(early), stream.derive(late), 3 * stream.HOUR) == []


def test_fan_out_with_a_failing_and_a_refusing_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    down = {"now": True}

    def good(rows, number):
        rows.write.mode("overwrite").parquet(str(tmp_path / f"good/b={number}"))

    def flaky(rows, number):
        if down["now"]:
            raise ConnectionError("down")
        rows.write.mode("overwrite").parquet(str(tmp_path / f"flaky/b={number}"))

    def strict(rows, number):
        if rows.filter("value = 'bad'").count():
            raise fanout.Rejected("400: bad row")
        rows.write.mode("overwrite").parquet(str(tmp_path / f"strict/b={number}"))

    def run():
        out = fanout.Fanout(spark, {"good": good, "flaky": flaky, "strict": strict}, f"file://{tmp_path}/state")
        q = out.start(spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert q.exception() is None
        return out

    (tmp_path / "in/1.txt").write_text("a\nb\n")
    out = run()
    assert out.errors == {"flaky": "ConnectionError: down"} and out.spooled() == [0]
    (tmp_path / "in/2.txt").write_text("bad\nc\n")
    out = run()
    assert out.drain() == {"good": 0, "flaky": 2, "strict": 0}
    down["now"] = False
    (tmp_path / "in/3.txt").write_text("d\n")
    out = run()
    assert out.errors == {} and out.spooled() == []
    held = lambda name: sorted(r["value"] for r in spark.read.parquet(str(tmp_path / name)).collect())
    assert held("good") == held("flaky") == ["a", "b", "bad", "c", "d"]
    assert held("strict") == ["a", "b", "d"]
    dead = out.dead("strict").collect()
    assert sorted(r["value"] for r in dead) == ["bad", "c"] and {r["_rejected"] for r in dead} == {"400: bad row"}
    assert out.dead("good") is None
    again = fanout.Fanout(spark, {"good": good}, f"file://{tmp_path}/state")
    again.accept(spark.createDataFrame([("x",)], "value string"), 0)  # Spark runs a batch again that all have
    assert held("good") == ["a", "b", "bad", "c", "d"]
