"""Multi-line records with their text, ends and parts, against the reference's way through a file line by line."""

import random
import re

import pytest

from loglake.operators import framing
from loglake.operators.framing import CONT, MORE, TERMS
from loglake.plans import catalog


def by_line(lines, start, max_lines, most):
    """(first place, frag, term, raw) of (place, term, raw) lines, as ``Multiline.consume`` folds them; what it would flush beyond ``most`` bytes is cut."""
    out, held = [], None

    def flush():
        pos, raw, term, n, cont = held
        while True:
            out.append((pos, (MORE if len(raw) > most else 0) | cont, "none" if len(raw) > most else term, raw[:most]))
            if len(raw) <= most:
                return
            raw, cont = raw[most:], CONT

    for pos, term, raw in lines:
        if re.search(start, raw):
            if held:
                flush()
            held = (pos, raw, term, 1, 0)
        elif held is None:
            held = (pos, raw, term, 1, 0)
            flush()
            held = None
        else:
            first, text, before, n, cont = held
            text, n = text + TERMS.get(before, b"") + raw, n + 1
            held = (first, text, term, n, cont)
            if len(text) >= most:
                out.append((first, MORE | cont, "none", text[:most]))
                held = (first, text[most:], term, n, CONT)
            elif n >= max_lines:
                flush()
                held = None
    if held:
        flush()
    return out


@pytest.mark.parametrize(("max_lines", "most"), [(1, 1000), (2, 3), (3, 7), (3, 1), (5, 12), (500, 20), (4, 1 << 20)])
def test_records_as_folded_line_by_line(spark, max_lines, most):
    r = random.Random(max_lines * 100 + most)
    files = {}
    for f in range(100):
        lines, at = [], 0
        for _ in range(r.randrange(1, 25)):
            raw = (b"A" if r.random() < 0.25 else b"") + bytes(r.choice(b"ab\xff\xc3") for _ in range(r.choice([0, 1, 2, r.randrange(most + 1 if most < 30 else 12)])))
            term = r.choice(["lf", "lf", "crlf", "nul", "none"])
            lines.append((at, term, raw))
            at += len(raw) + len(TERMS.get(term, b"")) + 1
        files[f] = lines
    rows = [(f, pos, term, bytearray(raw)) for f, lines in files.items() for pos, term, raw in lines]
    df = spark.createDataFrame(rows, "file int, pos bigint, term string, raw binary").repartition(7, "pos")
    records = framing.multiline(df, "file", "pos", "^A", max_lines, max_bytes=most, term="term")
    got = {f: [] for f in files}
    for x in records.orderBy("file", "pos", "part").collect():
        got[x["file"]].append((x["pos"], x["frag"], x["term"], bytes(x["raw"]), x["lines"]))
    for f, lines in files.items():
        assert [x[:4] for x in got[f]] == by_line(lines, b"^A", max_lines, most), f
        assert b"".join(raw + TERMS.get(term, b"") for _, _, term, raw, _ in got[f]) == b"".join(raw + TERMS.get(term, b"") for _, term, raw in lines)
        assert sum(x[4] for x in got[f]) == len(lines)
    places = framing.multiline(df, "file", "pos", "^A", max_lines, max_bytes=most, term="term", text=False)
    assert sorted(map(tuple, places.collect())) == sorted(map(tuple, records.groupBy("file", "pos").agg({"lines": "sum"}).collect()))


def test_null_lines_and_words(spark):
    lines = spark.createDataFrame([("f", 0, None), ("f", 1, "A ü"), ("f", 2, None), ("f", 3, "ß"), ("g", 0, None)], "file string, pos bigint, raw string")
    got = framing.multiline(lines, "file", "pos", "^A ").orderBy("file", "pos").select("file", "pos", "lines", "frag", "raw").collect()
    assert [tuple(x) for x in got] == [("f", 0, 1, 0, ""), ("f", 1, 3, 0, "A ü\n\nß"), ("g", 0, 1, 0, "")]


def test_query_gathers_the_text(spark, sf_dir):
    records = catalog.QUERIES["multiline_group"](spark, sf_dir)
    assert records._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    got = records.collect()
    assert {len(x["raw"].split("\n")) == x["lines"] and all(len(line) == 6 for line in x["raw"].split("\n")) for x in got} == {True}
