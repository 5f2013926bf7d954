"""Parsers proposed for free text: patterns that read their lines again, and the rules that tell source from destination."""

import pytest
from pyspark.sql import functions as F

from loglake.operators import normalize, texts

HEAD = "Jan %2d 2024 10:%02d:%02d fw : "
BUILT = "%%ASA-6-%d: Built inbound TCP connection %d for outside:198.51.100.%d/%d (198.51.100.%d/%d) to inside:10.1.%d.%d/443 (10.9.9.9/443)"
LEFT = "session of user%s ended"


def asa(n):
    out = []
    for k in range(n):
        head = HEAD % (k % 28 + 1, k % 60, k * 7 % 60)
        code = 302013 if k % 2 else 302015
        peer, port = k % 90 + 1, 20000 + k * 37 % 30000
        out.append(head + BUILT % (code, 5000 + k, peer, port, peer, port, k % 4, k * 3 % 250))
    return out + [HEAD % (1, 2, 3) + LEFT % k for k in range(10)]


def table(spark, raws, source="fw"):
    return spark.createDataFrame([(source, k + 1, r) for k, r in enumerate(raws)], "source_id string, record_id long, raw string").withColumn("received_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))


def proposed(spark, raws, least=20):
    return sorted(texts.propose_text(table(spark, raws), least).collect(), key=lambda r: r["extractor"])


def test_patterns_read_their_lines(spark):
    raws = asa(120)
    found = proposed(spark, raws)
    assert [r["lines"] for r in found] == [60, 60]  # a family a code; ten lines of another message are too few
    assert all(r["confirm"].startswith("inbound") for r in found)
    by_path = {x["path"]: x["name"] for x in found[0]["slots"] if x["path"]}
    assert by_path == {"time": "ts", "src_endpoint.ip": "src_ip", "src_endpoint.port": "src_port", "dst_endpoint.ip": "dst_ip"}
    assert [(e["to"], e["default"]) for e in found[0]["map"] if e["type"] == "const"] == [("dst_endpoint.port", "443"), ("connection_info.protocol_num", "6"), ("connection_info.protocol_name", "tcp"), ("action_id", "1"), ("activity_id", "6"), ("severity_id", "1")]
    out = normalize.normalize(table(spark, raws), [texts.spec(found)]).select("record_id", "event.ocsf.src_endpoint_ip", "event.ocsf.dst_endpoint_ip", "event.ocsf.src_endpoint_port", "event.ocsf.dst_endpoint_port", F.col("event").isNotNull().alias("hit")).orderBy("record_id").collect()
    assert [r["hit"] for r in out] == [True] * 120 + [False] * 10
    for k, r in enumerate(out[:120]):
        assert tuple(r)[1:5] == (f"198.51.100.{k % 90 + 1}", f"10.1.{k % 4}.{k * 3 % 250}", 20000 + k * 37 % 30000, 443)


SAYS = {
    "word": ("from %s with dst %s", (1, 0), "src dst", None), "backwards": ("dst %s by source %s", (0, 1), "dst src", None), "arrow": ("flow %s -> %s", (0, 1), "src dst", None),
    "outbound": ("outbound flow %s and %s", (0, 1), "dst src", "outbound: the first address is the foreign host"), "port": ("flow %s/53 and %s/ok", (0, 1), "src dst", "its place only"),
    "server": ("flow %s/53 and %s/40001", (0, 1), "dst src", "a well-known port"), "place": ("flow %s and %s", (0, 1), "src dst", "its place only"),
}


def test_directions(spark):
    ips = [(f"10.0.0.{k}", f"192.0.2.{k * 3 % 200}") for k in range(30)]
    rows = [(name, n * 100 + k, form % ip) for n, (name, (form, *_)) in enumerate(SAYS.items()) for k, ip in enumerate(ips)]
    lines = spark.createDataFrame(rows, "source_id string, record_id long, raw string")
    found = {r["source_id"]: r for r in texts.propose_text(lines, 20).collect()}
    assert set(found) == set(SAYS)
    for name, (_, _, order, why) in SAYS.items():
        paths = [x["path"].split("_")[0] for x in found[name]["slots"] if x["path"].endswith(".ip")]
        assert (" ".join(paths), found[name]["confirm"]) == (order, why), name
    assert found["arrow"]["render"] == "flow {src_ip} -> {dst_ip}"
    assert found["server"]["pattern"] == r"^flow (?P<dst_ip>\d{1,3}(?:\.\d{1,3}){3})/53 and (?P<src_ip>\d{1,3}(?:\.\d{1,3}){3})/40001$"
    assert {(e["to"], e["default"]) for e in found["server"]["map"] if "port" in e["to"]} == {("dst_endpoint.port", "53"), ("src_endpoint.port", "40001")}


@pytest.mark.parametrize("raws", [[], [None, "", "  "], ["same line"] * 30, ["one %d" % k for k in range(5)]])
def test_nothing_to_propose(spark, raws):
    assert proposed(spark, raws) == []


def test_blanks_that_vary(spark):
    row = proposed(spark, ["a{b} x%d%sy" % (k, " " * (k % 2 + 1)) for k in range(30)])[0]
    assert row["render"] is None and row["pattern"] == r"^a\{b\} (?P<v5>[\w.]+) +y$" and row["confirm"] is None
    assert [(e["to"], e["default"]) for e in row["map"]] == [("activity_id", "6"), ("severity_id", "1")]
