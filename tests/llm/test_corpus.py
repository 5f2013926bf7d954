"""Sharding, decontamination, quality, near-duplicates, neighbours and the pipeline against brute force."""

import itertools
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglake.llm import ann, components, decontaminate, minhash, quality, sharding
from loglake.llm.shared import table


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})


def test_shards_match_the_mixture(spark):
    rows = [(k, f"s{min(k % 7, 3)}" if k % 50 else None, "x" * (k % 5)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumns({"shard": F.lit(0), "_h": F.lit("x")})
    got = sharding.shard_documents(df, 7, seed=3).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    for s in range(7):
        own = [r for r in got if r["shard"] == s]
        assert 3000 // 7 <= len(own) <= 3000 // 7 + 1 and sorted(r["slot"] for r in own) == list(range(len(own)))
        for source in {r[1] for r in rows}:
            share = sum(r[1] == source for r in rows) / 7
            assert abs(sum(r["source"] == source for r in own) - share) <= 2
    assert all(r["text_crc32"] == zlib.crc32(rows[r["doc_id"]][2].encode()) and r["size"] == len(rows[r["doc_id"]][2]) + 16 for r in got)


def test_shards_edges(spark):
    df = spark.createDataFrame([(1, "a", "t"), (1, "a", "t"), (None, None, None)], "doc_id bigint, source string, text string")
    got = sharding.shard_documents(df, 5).collect()
    assert len(got) == 3 and len({(r["shard"], r["slot"]) for r in got}) == 3
    assert sharding.shard_documents(df.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(df, 0)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], (last + 1 if x == y else max(row[j], row[j + 1]))
    return row[-1]


def test_lcs():
    r = random.Random(0)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        assert decontaminate.lcs(a, b) == slow_lcs(a, b) <= decontaminate.common([x + 1 for x in a], [x + 1 for x in b])


def test_leaks_and_paraphrases(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)  # several blocks
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8)))
    text = lambda n: " ".join(word() + r.choice(["", "", ",", ".\n"]) for _ in range(n))
    items = [(k, text(r.randrange(15, 61)) + ".") for k in range(20)] + [(98, None), (99, "")]
    docs, want = [], set()
    for k in range(120):
        body = text(r.randrange(0, 300))
        if k % 3 == 0:
            item = items[k % 20][1]
            if k % 2:  # every eighth word replaced, other case
                item = " ".join(word() if j % 8 == 3 else w for j, w in enumerate(item.upper().split()))
            at = r.randrange(len(body) + 1)
            body = f"{body[:at]} {item} {body[at:]}"
            want.add((k, k % 20))
        elif k % 3 == 1:
            body += " " + " ".join(items[k % 20][1].split()[:6])  # six words are no leak
        docs.append((k, body))
    df = docs_of(spark, [*docs, (200, None), (201, ""), (0, docs[0][1]), (202, "w " * 100_000 + items[5][1])]).withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("codes", F.lit(1))
    got = decontaminate.find_leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want | {(202, 5)}
    assert sum(r["doc_id"] == 0 for r in got) == 2
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    kept = {r["doc_id"] for r in decontaminate.remove_leaks(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want} | {200, 201}


def test_svd_finds_the_space(spark):
    r = np.random.default_rng(0)
    rows = [np.unique(r.integers(1, 60, 12)).astype(np.uint32) for _ in range(40)]
    idf = np.concatenate(([0.0], r.random(60) + 0.5))
    a = np.zeros((40, 61))
    for k, row in enumerate(rows):
        a[k, row] = idf[row]
    df = spark.createDataFrame([(bytearray(x.tobytes()),) for x in rows], "codes binary").repartition(3)
    _, values = decontaminate.randomised_svd(df, idf, 45, power=2)
    assert values[:40] == pytest.approx(np.linalg.svd(a)[1][:40], rel=1e-6)


def test_forward_backward():
    r = np.random.default_rng(1)
    lengths, moves = [3, 1, 4], r.normal(size=(2, 2))
    rows = quality.Sequences.of([(np.zeros((n, len(quality.FEATURES)), np.uint8), np.ones(n, np.int32)) for n in lengths])
    emission = r.normal(size=sum(lengths))
    good, pairs = quality.marginals(emission, rows.steps(), moves)
    want_pairs, at = np.zeros((2, 2)), 0
    for n in lengths:
        ways = {}
        for y in itertools.product((0, 1), repeat=n):
            ways[y] = math.exp(sum(emission[at + k] for k in range(n) if y[k]) + sum(moves[a, b] for a, b in itertools.pairwise(y)))
        z = sum(ways.values())
        for k in range(n):
            assert good[at + k] == pytest.approx(sum(w for y, w in ways.items() if y[k]) / z)
        for y, w in ways.items():
            for a, b in itertools.pairwise(y):
                want_pairs[a, b] += w / z
        at += n
    assert pairs == pytest.approx(want_pairs)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no tables")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.train(docs, labels)
    got = quality.score_documents(docs, model).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert len(bad) >= 5 and sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(g >= 0.3 for g in good) / len(good) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_quality_edges(spark):
    docs = docs_of(spark, [(k, t) for k in range(40) for t in [("Some good words, as they go here.\nAnd more." if k % 2 else "### ### $$$ | | |\n!! !! %%%")]] + [(90, None), (91, ""), (92, " \n\t"), (None, "Fine words here."), (93, "a\n" * 30_000)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, None), (None, 0)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score_documents(docs.withColumns({"score": F.lit("x"), "predicted": F.lit(7)}), model).collect()}
    assert all(got[k]["predicted"] == k % 2 for k in range(40))
    assert got[90]["score"] == got[91]["score"] == got[92]["score"] == 0.0 and got[None]["held_out"]
    assert quality.score_documents(docs.limit(0), model).count() == 0
    one_kind = quality.train(docs, labels.filter("quality = 1"))
    assert all(r["predicted"] == 1 for r in quality.score_documents(docs.filter("text like 'Some%'"), one_kind).collect())


def brute_components(rows, num=85, den=100):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").encode()
        w = w.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if shared and den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
            up[root(i)] = root(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            ids[root(i)] = min(ids.get(root(i), k), k)
    return sorted((k if k is not None else -1, len(s), c if (c := ids.get(root(i))) is not None else -1) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_rows(seed, families=12, size=9):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, k = [], 0
    for f in range(families):
        base = [word() for _ in range(r.choice([30, 80, 150]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
                copy[r.randrange(len(copy))] = word()
            if r.random() < 0.3:
                base = copy  # chains of copies
            rows.append((k, r.choice([" ", "  ", "\n"]).join(copy)))
            k += 1
    return rows


@pytest.mark.parametrize("block", [3, 1024])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_rows(block) + [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "One  TWO"), (505, "one two three"), (1, "other text with this id"), (None, "one two"), (None, "alone with no id at all"), (506, "É a"), (507, "é a")]
    df = docs_of(spark, rows).withColumns({"set_key": F.lit(1), "component": F.lit(2)}).repartition(3)
    got = minhash.near_duplicates(df).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in got) == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None and r["component_id"] is not None)


def test_near_duplicates_empty(spark):
    df = docs_of(spark, [(1, "a b c d e f")])
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(df).collect()] == [(1, 2, 1, True)]


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    for shared in (1700, 1200, 300):
        x = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
        y = np.concatenate((x[:shared], r.integers(0, 1 << 63, 2000 - shared, dtype=np.uint64)))
        same = (minhash.minima(x) == minhash.minima(y)).mean()
        assert abs(same - shared / (4000 - shared)) < 0.14


def test_components(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "u bigint, v bigint")
    up = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {x: c for x, c in up.items() if x in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert components.components(df.limit(0)).count() == 0


def brute_neighbours(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            best = {}
            for i, y in ok:
                if i != q:
                    best[i] = min(best.get(i, math.inf), float(np.sqrt(((x - y) ** 2).sum())))
            out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def test_neighbours(spark):
    r = np.random.default_rng(3)
    rows = [(k, r.normal(size=8).round(2).tolist()) for k in range(400)]
    rows += [(k, rows[20][1]) for k in range(400, 460)]  # many copies of one vector, a query's
    rows += [(600, None), (700, [0.0] * 8), (800, [float("nan")] + [1.0] * 7), (900, [None] + [1.0] * 7), (1000, [1.0, 2.0]), (None, [1.0] * 8), (rows[0][0], rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"x": F.lit(1), "node": F.lit(2)})
    got = {}
    for row in ann.nearest_neighbours(df, every=20).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    want = brute_neighbours(rows, 20, 10)
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11))
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hit / (10 * len(want)) >= 0.98
    assert [i for _, i, _ in got[20]] == list(range(400, 410))
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(x) for x in ann.nearest_neighbours(few).collect()] == [(0, 1, 1, 1.0)]
    assert ann.nearest_neighbours(few.limit(0)).count() == 0


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    steps, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        steps.append(now)
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert all(s.columns == docs.columns for s in steps[:-1])
    model = quality.train(docs, labels)
    assert ids[0] == {r["doc_id"] for r in quality.score_documents(docs, model).collect() if r["predicted"] == 1}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = [(k, texts[k]) for k in sorted(ids[0])]
    assert ids[1] == {k for k, _, c in brute_components(left, 80) if k == c}  # stages take a similarity of 0.8
    items = [decontaminate.words(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    leaked = {k for k in ids[1] for w in [decontaminate.words(texts[k])] if any(slow_lcs(w, item) == len(item) and b" ".join(item) in b" ".join(w) for item in items)}
    assert ids[1] - ids[2] == leaked
    assert ids[3] == ids[2]
