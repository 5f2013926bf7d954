"""Scans of byte ranges against a plain scan of the whole file, octet-counted frames, addresses against the standard library."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from loglake.functions import values as V
from loglake.sources import framed


def plain(data, mode, most):
    end, name, strip = framed.MODES[mode]
    at, out, cont = 0, [], 0
    while at < len(data):
        i = data.find(end, at) - at
        if 0 <= i <= most:
            raw, term = data[at : at + i], name
            if strip and raw.endswith(b"\r"):
                raw, term = raw[:-1], "crlf"
            out.append((at, term, cont, raw))
            at, cont = at + i + len(end), 0
        elif len(data) - at > most:
            out.append((at, "none", 1 | cont, data[at : at + most]))
            at, cont = at + most, 2
        else:
            out.append((at, "none", cont, data[at:]))
            break
    return out


def test_ranges_find_each_record_once(tmp_path, monkeypatch):
    monkeypatch.setattr(framed, "READ", 7)
    for seed in range(1500):
        r = random.Random(seed)
        data = bytes(r.choice(b"ab\r\n\0") if r.random() < 0.6 else r.choice(b"xyz") for _ in range(r.randrange(60)))
        mode, most, step = r.choice(list(framed.MODES)), r.choice([1, 3, 5, 100]), r.choice([1, 2, 4, 9, 1000])
        path = tmp_path / "f"
        path.write_bytes(data)
        assert [x for s in range(0, len(data), step) for x in framed.records(str(path), s, s + step, len(data), mode, most)] == plain(data, mode, most)


def test_octets():
    assert list(framed.octets(b"3 abc5 hello", 4, 100)) == [(2, 0, b"abc", None), (7, 1, b"hell", None), (11, 2, b"o", None)]
    assert list(framed.octets(b"0 x", 4, 100))[0][3] == "length is zero" and list(framed.octets(b"101 x", 4, 100))[0][3] == "length is over the cap"
    assert list(framed.octets(b"9 ab", 4, 100)) == [(2, 1, b"ab", None)] and list(framed.octets(b"9 ", 4, 100))[0][3] == "unexpected end"


def test_missing_files(spark, tmp_path):
    assert framed.scan(spark, [str(tmp_path / "none-*")]).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        framed.scan(spark, [str(tmp_path / "none")]).count()


def test_addresses(spark):
    r = random.Random(1)
    said = [str(x) for x in (ipaddress.IPv6Address(":".join(f"{r.choice([0, 0, 0, 1, 0xABC, 0x8000, 0x10, 0xFFFF]):x}" for _ in range(8))) for _ in range(150))]
    said = [*said, *(ipaddress.ip_address(x).exploded.upper() for x in said[:50]), "1.2.3.4", "::ffff:10.0.0.1", "300.1.1.1", "x", "::", "1::", "1:2", ""]
    for row in spark.createDataFrame([(x,) for x in said], "x string").select("x", V.to_ip(F.col("x")).alias("ip"), V.ip_bits(V.to_ip(F.col("x"))).alias("bits")).collect():
        try:
            a = ipaddress.ip_address(row["x"])
            a = getattr(a, "ipv4_mapped", None) or a
            want = (str(a), f"{int(a):0{a.max_prefixlen}b}")
        except ValueError:
            want = (None, None)
        assert (row["ip"], row["bits"]) == want
