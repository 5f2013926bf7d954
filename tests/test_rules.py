"""The rules of parser documents, a case a row: extraction, mapping, times, flags, coverage, rendering, identity, checks of documents."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loglake.operators import normalize, specs

PAIRS = [{"from": "srcip", "to": "src_endpoint.ip", "type": "ip"}]
PORTS = [*PAIRS, {"from": "srcport", "to": "src_endpoint.port", "type": "port"}]
OPTIONAL = [*PAIRS, {"from": "srcport", "to": "src_endpoint.port", "type": "port", "optional": True}]
PROTO = [{"from": "proto", "to": "connection_info.protocol_num", "type": "enum", "enum": {"tcp": 6, "udp": 17}, "default": 0}]
THREE = [{"id": i, "kind": "regex", "pattern": p, "map": [{"from": g, "to": t, "type": "port"}]} for i, p, g, t in (("first", r"^A (?P<x>\d+)$", "x", "src_endpoint.port"), ("second", r"^A (?P<y>\d+)$", "y", "dst_endpoint.port"), ("third", r"^B (?P<z>\d+)$", "z", "dst_endpoint.port"))]
CELLS = {"kind": "csv", "sep": ",", "quote": '"', "min_columns": 5, "when": {"column": 1, "equals": "TRAFFIC"}, "columns": ["_", "_", "src_ip", "dst_ip", "_"], "map": [{"from": "src_ip", "to": "src_endpoint.ip", "type": "ip"}, {"from": "dst_ip", "to": "dst_endpoint.ip", "type": "ip"}]}
ALERT = {"kind": "json", "when": {"path": "event_type", "equals": "alert"}, "map": [{"from": "src_ip", "to": "src_endpoint.ip", "type": "ip"}, {"from": "alert.severity", "to": "severity_id", "type": "int"}]}
LINE = {"kind": "regex", "pattern": r"^(?P<pri><\d+>)?(?P<ts>[A-Z][a-z]{2} +\d+ [\d:]+) (?P<host>\S+) (?P<ip>[\d.]+)$", "map": [{"from": "ts", "to": "time", "type": "time", "layout": "Jan _2 15:04:05"}, {"from": "ip", "to": "src_endpoint.ip", "type": "ip"}]}
NANOS = {"kind": "kv", "map": [{"from": "t", "to": "time", "type": "time", "layout": "epoch_ns"}]}
CEF = {"kind": "cef", "map": [{"from": "cef.severity", "to": "severity_id", "type": "int"}, {"from": "src", "to": "src_endpoint.ip", "type": "ip"}, {"from": "spt", "to": "src_endpoint.port", "type": "port", "optional": True}]}
LEEF = {"kind": "leef", "map": [{"from": "leef.event_id", "to": "message", "type": "string"}, {"from": "src", "to": "src_endpoint.ip", "type": "ip"}]}
LEASE = {"kind": "dhcp", "when": {"field": "msgtype", "in": ["DHCPACK", "DHCPRELEASE"]}, "action": {"field": "msgtype", "enum": {"DHCPACK": "bind", "DHCPRELEASE": "release"}}, "ip": "ip", "mac": "mac", "host": "hostname", "at": "ts"}
TWO = lambda render: {"kind": "regex", "pattern": r"^(?P<a>\d+) (?P<b>\w+)$", "render": render, "map": [{"from": "a", "to": "src_endpoint.port", "type": "port"}]}
ACME = "CEF:0|Acme|Perimeter|1.0|100|Blocked|7|"
WHOLE = ACME + "src=10.1.4.7 spt=51544 msg=hello world dst=203.0.113.9"
kv = lambda entries: {"kind": "kv", "map": entries}
ms = lambda *t: int(dt.datetime(*t, tzinfo=dt.UTC).timestamp() * 1000)

# name: extractors, line, what holds (None: no match), received, zone, further parts of the document
CASES = {
    "kv maps some, keeps the rest": (kv(PORTS), "srcip=10.1.4.7 srcport=51544 user=alice action=allow", {"extractor": "e", "src_endpoint.ip": "10.1.4.7", "src_endpoint.port": 51544, "unmapped": {"user": "alice", "action": "allow"}}),
    "kv quoted value is not looked into": (kv(PAIRS), 'srcip=1.1.1.1 msg="hi srcip=9.9.9.9 dstip=8.8.8.8" user=bob', {"src_endpoint.ip": "1.1.1.1", "unmapped": {"msg": "hi srcip=9.9.9.9 dstip=8.8.8.8", "user": "bob"}, "flags": []}),
    "kv duplicate": (kv(PAIRS), "srcip=1.1.1.1 x=1 srcip=6.6.6.6 y=2", {"src_endpoint.ip": "1.1.1.1", "dupes": ["srcip=6.6.6.6"], "flags": ["duplicate_key"]}),
    "kv empty is absent": (kv([{"from": "user", "to": "actor.user.name"}, *PAIRS]), "srcip=1.1.1.1 user= a=1 b=2", {"src_endpoint.ip": "1.1.1.1", "actor.user.name": None, "unmapped": {"a": "1", "b": "2"}}),
    "enum": (kv(PROTO), "proto=tcp a=1 b=2 c=3", {"connection_info.protocol_num": "6"}),
    "enum is exact": (kv(PROTO), "proto=TCP a=1 b=2 c=3", {"connection_info.protocol_num": "0"}),
    "const": (kv([{"const": 6, "to": "activity_id"}]), "a=1 b=2 c=3 d=4", {"activity_id": 6, "class_uid": 4001, "category_uid": "4", "type_uid": 400106, "mapped_fields": 1}),
    "first extractor wins": (THREE, "A 80", {"extractor": "first", "src_endpoint.port": 80, "dst_endpoint.port": None}),
    "later extractor": (THREE, "B 443", {"extractor": "third", "dst_endpoint.port": 443}),
    "no extractor": (THREE, "C 1", None),
    "csv": (CELLS, ",TRAFFIC,10.0.0.1,10.0.0.2,extra,tail", {"src_endpoint.ip": "10.0.0.1", "dst_endpoint.ip": "10.0.0.2", "unmapped": {"col_1": "TRAFFIC", "col_4": "extra", "col_5": "tail"}}),
    "csv too few": (CELLS, ",TRAFFIC,10.0.0.1,10.0.0.2", None),
    "csv routed elsewhere": (CELLS, ",THREAT,10.0.0.1,10.0.0.2,x", None),
    "csv quoted separator": (CELLS, ',TRAFFIC,10.0.0.1,10.0.0.2,"a,b"', {"src_endpoint.ip": "10.0.0.1", "unmapped": {"col_1": "TRAFFIC", "col_4": "a,b"}}),
    "csv stray quote": (CELLS, ',TRAFFIC,10.0.0.1,10.0.0.2,a"b', None),
    "json": (ALERT, '{"event_type":"alert","src_ip":"10.0.0.1","alert":{"severity":2,"signature":"x"}}', {"src_endpoint.ip": "10.0.0.1", "severity_id": 2, "unmapped": {"alert.signature": "x", "event_type": "alert"}}),
    "json routed elsewhere": (ALERT, '{"event_type":"flow","src_ip":"10.0.0.1"}', None),
    "json by index": ({"kind": "json", "map": [{"from": "user.tags.0", "to": "message"}]}, '{"user":{"tags":["a","b"]},"n":null}', {"message": "a", "unmapped": {"user.tags.1": "b"}}),
    "regex group took no part": (LINE, "Sep 28 09:00:00 fw01 10.0.0.1", {"src_endpoint.ip": "10.0.0.1", "unmapped": {"host": "fw01"}}, "2026-09-28T04:00:00"),
    "regex group took part": (LINE, "<166>Sep 28 09:00:00 fw01 10.0.0.1", {"unmapped": {"pri": "<166>", "host": "fw01"}}, "2026-09-28T04:00:00"),
    "regex group of nothing": ({"kind": "regex", "pattern": r"^a=(?P<a>\d*) b=(?P<b>\d+)$", "map": [{"from": "a", "to": "message"}]}, "a= b=1", {"message": None, "unmapped": {"b": "1"}}),
    "time in the parser's zone": (LINE, "Sep 28 09:00:00 fw01 10.0.0.1", {"time": ms(2026, 9, 28, 3, 30)}, "2026-09-28T04:00:00"),
    "time in another zone": (LINE, "Sep 28 09:00:00 fw01 10.0.0.1", {"time": ms(2026, 9, 28, 9)}, "2026-09-28T04:00:00", "+00:00"),
    "time of last year": (LINE, "Dec 31 23:00:00 fw01 10.0.0.1", {"time": ms(2026, 12, 31, 23)}, "2027-01-02T00:30:00", "+00:00"),
    "time of this year": (LINE, "Dec 31 23:00:00 fw01 10.0.0.1", {"time": ms(2026, 12, 31, 23)}, "2026-12-31T23:30:00", "+00:00"),
    "time a month ahead": (LINE, "Feb 01 00:10:00 fw01 10.0.0.1", {"time": ms(2026, 2, 1, 0, 10)}, "2026-01-31T23:00:00", "+00:00"),
    "time in nanoseconds": (NANOS, "t=1790566202000000000 a=1 b=2 c=3", {"time": 1790566202000}),
    "time that can't be read": (NANOS, "t=notatime a=1 b=2 c=3", {"time": None, "flags": ["time_unparseable"], "mapped_fields": 0}),
    "coverage sums to the line": (kv([{"from": "a", "to": "x", "type": "int"}]), "a=1 b=2 c=3 d=4", {"x": "1", "sums": True, "mapped_bytes": 1, "unmapped_bytes": 3, "constant_bytes": 11, "uncovered_bytes": 0, "mapped_fields": 1, "unmapped_fields": 3}),
    "coverage beyond a pattern": ({"kind": "regex", "pattern": r"a=(?P<a>\d+)", "map": [{"from": "a", "to": "x", "type": "int"}, {"from": "a", "to": "message"}]}, "zz a=12 yy", {"mapped_bytes": 4, "uncovered_bytes": 6, "constant_bytes": 0, "mapped_fields": 2}),
    "rendering differs": (TWO("{a}  {b}"), "80 tcp", {"flags": ["render_back_mismatch"], "render_ok": False}),
    "rendering is the line": (TWO("{a} {b}"), "80 tcp", {"flags": [], "render_ok": True}),
    "value too large": (kv([{"from": "a", "to": "x", "type": "int"}]), "a=1 big=" + "x" * 70000, {"flags": ["oversize_field"]}),
    "identity": ({"kind": "regex", "pattern": r"^(?P<msgtype>DHCPACK|DHCPRELEASE) (?P<ip>[\d.]+) (?P<mac>\S+) (?P<hostname>\S+)$", "map": [{"from": "ip", "to": "src_endpoint.ip", "type": "ip"}]}, "DHCPACK 10.1.4.9 aa:bb:cc:8a:06:2d laptop-carol", {"identity": {"kind": "dhcp", "action": "bind", "ip": "10.1.4.9", "mac": "aa:bb:cc:8a:06:2d", "host": "laptop-carol", "user": ""}}, None, "+05:30", {"identity": LEASE}),
    "cef": (CEF, WHOLE, {"severity_id": 7, "src_endpoint.ip": "10.1.4.7", "src_endpoint.port": 51544, "unmapped": {"cef.vendor": "Acme", "cef.product": "Perimeter", "cef.device_version": "1.0", "cef.signature_id": "100", "cef.name": "Blocked", "cef.version": "0", "dst": "203.0.113.9", "msg": "hello world"}}),
    "cef behind a header": (CEF, "<134>Sep 28 09:00:00 fw01 " + WHOLE, {"src_endpoint.ip": "10.1.4.7", "vendor": "Acme"}),
    "cef escapes": (CEF, r"CEF:0|Acme|Perimeter|1.0|100|Blocked \| by policy|7|src=10.1.4.7 note=a\=b", {"name": "Blocked | by policy", "note": "a=b"}),
    "cef too short": (CEF, "CEF:0|Acme|Perimeter|1.0|100|Blocked", None),
    "cef duplicate": (CEF, ACME + "src=10.1.4.7 src=6.6.6.6", {"src_endpoint.ip": "10.1.4.7", "dupes": ["src=6.6.6.6"], "flags": ["duplicate_key"]}),
    "leef 1.0": (LEEF, "LEEF:1.0|Acme|Perimeter|1.0|Deny|src=10.0.0.1\tdst=8.8.8.8\tmsg=hello world", {"message": "Deny", "src_endpoint.ip": "10.0.0.1", "unmapped": {"dst": "8.8.8.8", "msg": "hello world", "leef.version": "1.0", "leef.vendor": "Acme", "leef.product": "Perimeter", "leef.product_version": "1.0"}}),
    "leef 2.0": (LEEF, "LEEF:2.0|Acme|Perimeter|1.0|Deny|^|src=10.0.0.1^dst=8.8.8.8", {"src_endpoint.ip": "10.0.0.1", "dst": "8.8.8.8"}),
    "leef 2.0 in hex": (LEEF, "LEEF:2.0|Acme|Perimeter|1.0|Deny|x09|src=10.0.0.1\tdst=8.8.8.8", {"src_endpoint.ip": "10.0.0.1", "dst": "8.8.8.8"}),
    "mapped key is absent": (kv(PORTS), "srcip=10.1.4.7 user=alice a=1 b=2", None),
    "optional key is absent": (kv(OPTIONAL), "srcip=10.1.4.7 user=alice a=1 b=2", {"src_endpoint.ip": "10.1.4.7", "src_endpoint.port": None}),
    "targets without a column": (kv([{"from": "a", "to": "device.hostname"}, {"const": 2, "to": "action_id"}, {"const": 3001, "to": "class_uid"}]), "a=gate", {"device.hostname": "gate", "action_id": "2", "class_uid": 3001}),
    "several keys": (kv([{"from": ["d", "t"], "to": "message"}]), "d=2024 t=9", {"message": "2024 9", "unmapped": {}}),
    "several keys, one absent": (kv([{"from": ["d", "t"], "to": "message", "optional": True}]), "d=2024 a=9", {"message": None, "unmapped": {"d": "2024", "a": "9"}}),
    "key with blanks": (kv([]), "hello user=x", {"unmapped": {"hello user": "x"}}),
    "empty list of values": (CELLS | {"when": {"column": 1, "in": []}}, ",ANY,10.0.0.1,10.0.0.2,x", {"src_endpoint.ip": "10.0.0.1"}),
}


def document(extractors, zone="+05:30", more=None):
    each = extractors if isinstance(extractors, list) else [{"id": "e"} | extractors]
    return {"id": "conf", "version": "1.0.0", "vendor": "test", "product": "conf", "timezone": zone, "match": {"signature": "."}, "ocsf_defaults": {"class_uid": 4001, "category_uid": 4}, "extractors": each} | (more or {})


@pytest.mark.parametrize("name", CASES)
def test_rule(spark, name):
    extractors, line, want, received, zone, more = (*CASES[name], *[None, "+05:30", None][len(CASES[name]) - 3 :])
    spec = specs.compiled(document(extractors, zone, more))
    rows = spark.createDataFrame([(line, received or "2026-01-01T00:00:00")], "raw string, r string").select("raw", F.to_timestamp("r").alias("received_at"))
    event = normalize.normalize(rows, [spec]).first()["event"]
    if want is None:
        assert event is None
        return
    event = event.asDict(True)
    cover = event["coverage"]
    for key, value in want.items():
        path = key.replace(".", "_")
        if key == "sums":
            assert sum(cover[k] for k in ("mapped_bytes", "unmapped_bytes", "constant_bytes", "uncovered_bytes")) == len(line)
        elif key == "identity":
            assert {k: event["identity"][k] for k in value} == value
        elif key in cover:
            assert cover[key] == value
        elif path in event["ocsf"]:
            assert event["ocsf"][path] == value
        elif key == "flags" or key in event and key not in ("vendor",):
            assert event[key] == value
        else:
            found = event["more"] | event["unmapped"] | {k.removeprefix("cef."): v for k, v in event["unmapped"].items()}
            assert found.get(key) == value, event


@pytest.mark.parametrize(
    ("extractors", "why"),
    [
        ([{"id": "bad", "kind": "regex", "pattern": r"^(?P<a>\d+)$", "map": [{"from": "nope", "to": "src_endpoint.port", "type": "port"}]}], 'parser "conf" extractor "bad" map[0] (from: nope)'),
        ([{"id": "bad", "kind": "regex", "pattern": r"^(?=a)(?P<a>\w+)$", "map": [{"from": "a", "to": "message"}]}], 'parser "conf" extractor "bad" pattern'),
        ([{"id": "dup", "kind": "kv", "map": []}, {"id": "dup", "kind": "kv", "map": []}], 'parser "conf" extractor "dup"'),
        ([{"id": "x", "kind": "xml"}], "unknown kind"),
    ],
)
def test_documents_that_are_refused(extractors, why):
    with pytest.raises(specs.SpecError, match="^.*" + __import__("re").escape(why)):
        specs.compiled(document(extractors))


def test_layouts():
    assert specs.layout("2006-01-02T15:04:05.000Z07:00") == "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"
    assert specs.layout("Jan _2 15:04:05") == "MMM d HH:mm:ss" and specs.layout("epoch_ms") == "epoch_ms"
