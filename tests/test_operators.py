"""Cases that the tables do not hold."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loglake.functions import values as V
from loglake.operators import extract, framing, ledger, normalize


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [("10.0.0.1", "10.0.0.1"), ("010.0.0.1", None), ("256.1.1.1", None), ("::FFFF:1.2.3.4", "1.2.3.4"), ("FE80::1", "fe80::1"), ("", None)])
def test_ip(spark, text, want):
    assert one(spark, text, V.to_ip) == want


def test_conversions_reject(spark):
    assert one(spark, " 1", V.to_int) is None
    assert one(spark, "70000", V.to_port) is None
    assert one(spark, "yes", V.to_bool) is None
    assert one(spark, "aa-bb-cc-dd-ee-ff", V.to_mac) == "aa:bb:cc:dd:ee:ff"
    assert one(spark, "1e400x", V.to_float) is None


def test_kv_edge(spark):
    got = one(spark, 'a=1 b="x y" a=2 c="open', extract.kv)
    assert got["fields"] == {"a": "1", "b": "x y", "c": "open"}
    assert [(d["k"], d["v"]) for d in got["dupes"]] == [("a", "2")]
    assert set(got["flags"]) == {"duplicate_key", "key_injection_suspect"}
    assert one(spark, "no pairs here", extract.kv)["fields"] == {}
    assert one(spark, None, extract.kv) is None


def test_cef_escapes(spark):
    got = one(spark, r"CEF:0|V\|x|P|1|7|n|3|msg=a\=b\nc src=1.2.3.4", extract.cef)["fields"]
    assert got["cef.vendor"] == "V|x" and got["msg"] == "a=bnc" and got["src"] == "1.2.3.4"


def test_normalize_empty_and_order(spark):
    spec = lambda i, t: {"id": i, "version": "1", "extractors": [{"id": "x", "kind": "kv", "map": {"message": {"from": "m", "type": t}}}]}
    lines = spark.createDataFrame([("m=abc",), ("m=",), ("q=1",), (None,)], "raw string").withColumn("received_at", F.lit(0).cast("timestamp"))
    rows = normalize.normalize(lines, [spec("b", "string"), spec("a", "int")]).select("raw", "event.parser_id", "event.ocsf.message").collect()
    assert [(r["parser_id"], r["message"]) for r in rows] == [("b", "abc"), ("a", None), (None, None), (None, None)]


def tree(leaves):
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return hashlib.sha256(b"\x01" + tree(leaves[:k]) + tree(leaves[k:])).digest()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 100])
def test_merkle(spark, n):
    rows = spark.createDataFrame([(1, k + 1, bytearray(hashlib.sha256(b"\x00%d" % k).digest())) for k in range(n)], "segment bigint, record_id bigint, leaf binary")
    root = ledger.roots(rows).first()["root"]
    assert bytes(root) == tree([hashlib.sha256(b"\x00%d" % k).digest() for k in range(n)])
    proofs = ledger.inclusion_paths(rows).withColumn("root", F.lit(bytearray(root)))
    ok = ledger.verify_inclusion(F.col("leaf"), F.col("index"), F.col("size"), F.col("path"), F.col("root"))
    bad = ledger.verify_inclusion(F.col("leaf"), F.col("index"), F.col("size") + 1, F.concat("path", F.array("leaf")), F.col("root"))
    assert proofs.select(ok.alias("a"), bad.alias("b")).distinct().collect() == [(True, False)]


def test_multiline_cap(spark):
    lines = spark.createDataFrame([("f", k, t) for k, t in enumerate(["x", "A 1", "b", "c", "d", "A 2"])], "file string, pos bigint, raw string")
    got = framing.multiline(lines, "file", "pos", "^A ", max_lines=3).orderBy("pos").select("pos", "raw").collect()
    assert [tuple(r) for r in got] == [(0, "x"), (1, "A 1\nb\nc"), (4, "d"), (5, "A 2")]


def test_templates_of_a_tree(spark):
    from loglake.operators import drift

    rows = [("s", f"Built connection {k} for user{k} from 10.0.0.{k % 9}") for k in range(30)] + [("s", f"Built session {k} for user{k} from 10.0.0.1") for k in range(20)]
    rows += [("s", f"{w} down") for w in ("eth0", "eth1", "7x")] + [("t", "Built nothing"), ("t", ""), ("t", None), ("t", "a b c d"), ("t", "a x y z")]
    lines = spark.createDataFrame(rows, "source_id string, raw string").repartition(6)
    got = {(r["source_id"], r["template"]): r["lines"] for r in drift.templates(lines).collect()}
    assert got == {("s", "Built <*> <NUM> for <*> from <IP>"): 50, ("s", "<*> down"): 3, ("t", "Built nothing"): 1, ("t", "a b c d"): 1, ("t", "a x y z"): 1}
    assert drift.templates(spark.createDataFrame([], "source_id string, raw string")).collect() == []
