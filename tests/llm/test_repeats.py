import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loglake.llm import repeats


def brute(rows, length):
    """Every passage in a dictionary."""
    least = {}
    data = [(k, (t or "").encode()) for k, t in rows]
    for k, b in data:
        for i in range(len(b) - length + 1):
            if k is not None:
                least[b[i : i + length]] = min(k, least.get(b[i : i + length], k))
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if k is not None and least[b[i : i + length]] < k:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


def invented(seed, n, alphabet="abé \n"):
    r = random.Random(seed)
    lines = ["".join(r.choices(alphabet, k=r.randrange(5, 90))) for _ in range(12)]
    rows = []
    for k in range(n):
        parts = [r.choice(lines) if r.random() < 0.5 else "".join(r.choices(alphabet, k=r.randrange(0, 80))) for _ in range(r.randrange(0, 6))]
        rows.append((k * 3 % 101, "".join(parts)))
    rows += [(7, "a" * 500), (8, "a" * 300), (9, "a" * 49), (200, rows[3][1]), (-5, rows[4][1]), (None, rows[5][1]), (None, "b" * 200), (201, None), (202, ""), (7, "a" * 500), (203, "x\0y" * 40), (204, "\0" * 90), (205, "\0" * 70)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(k, t, "c", 1, 2) for k, t in rows], "doc_id bigint, text string, chunk string, row int, ID int").repartition(5)


@pytest.mark.parametrize("hot", [4096, 3])
def test_against_every_passage(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "CHUNK", 3000)
    rows = invented(1, 90)
    got = repeats.remove_repeats(table(spark, rows))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows, 50)
    assert sum(r[2] > 0 for r in brute(rows, 50)) > 20


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, repeats.remove_repeats(docs).collect())) == brute(rows, 50)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id int, text string")).collect() == []
    assert [tuple(r)[:4] for r in repeats.remove_repeats(spark.createDataFrame([(1, None), (1, None)], "doc_id int, text string")).collect()] == [(1, 0, 0, 0)] * 2


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed):
    r = np.random.default_rng(seed)
    text = r.integers(0, [2, 3, 257, 4, 3, 30][seed], 700).astype(np.uint16)
    if seed == 4:
        text[100:300] = 2
    text[-1] = 0
    order = repeats.suffix_order(text, 50)
    assert sorted(order.tolist()) == list(range(700))

    def prefix(p):
        part = text[p : p + 50].tolist()
        return part[: part.index(0)] if 0 in part else part

    held = order.tolist()
    assert all(prefix(a) <= prefix(b) for a, b in zip(held, held[1:]))
    shared = repeats.common_prefixes(text, order, 50)
    text = np.append(text, np.zeros(60, np.uint16))
    for a, b, n in zip(held, held[1:], shared[1:].tolist()):
        if n == 50:
            assert text[a : a + 50].tolist() == text[b : b + 50].tolist()
        else:
            assert text[a : a + n].tolist() == text[b : b + n].tolist() and text[a + n] != text[b + n]


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 100)
    text = bytes(random.Random(3).choices(range(97, 100), k=1000))
    seen = set()
    for data, at, parts in repeats.steps([text, b"", text[:60]], 50):
        of, first, stop, key = repeats.runs(data, at, 50, 16)
        for d, a, b in zip(of, first, stop):
            k, offset = parts[d]
            seen |= {(k, int(offset + p - at[d])) for p in range(a, b)}
    assert seen == {(0, p) for p in range(951)} | {(2, p) for p in range(11)}
