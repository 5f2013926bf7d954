"""Stages of the pipeline on rows of our own."""

import pytest

from loglake.llm import decontaminate, minhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_near_duplicate_stage(spark):
    base = [f"w{k}" for k in range(104)]  # 100 shingles
    near = [*base[:94], *(f"x{k}" for k in range(10))]  # 90 shared of 110: 0.818
    far = [*base[:92], *(f"y{k}" for k in range(12))]  # 88 shared of 112: 0.786, and of near's 110 as many
    other, third = " ".join(f"o{k}" for k in range(40)), " ".join(f"t{k}" for k in range(40))
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (2, other), (None, " ".join(base)), (None, third), (None, third.upper()), (5, "same"), (5, "same")]
    got = sorted(corpus_pipeline.near_duplicate_stage(spark, rows_of(spark, rows), "").collect(), key=str)
    assert len([r for r in got if r["text"].lower() == third]) == 1
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None) == sorted([rows[0], rows[2], rows[3], rows[7]])
    assert len(got) == 5


def test_banding_misses_less_than_one_in_a_million():
    for least in (0.5, 0.8, 0.85, 0.95):
        bands, n = minhash.banding(least)
        assert (1 - least**n) ** bands < 1e-6
    assert minhash.banding(0.85) == (32, 6)


def test_leaks_without_the_last_sentence(spark):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(30)) + f". Last{k}.") for k in range(4)]
    docs = [(k, f"some words before {items[k][1].rsplit('. ', 1)[0]} and after") for k in range(4)]
    docs += [(10 + k, items[k][1]) for k in range(4)] + [(20, "i0w1 i0w2 i0w3 Last0.")]
    bench = spark.createDataFrame([(k, t, f"Last{k}" if k < 2 else None) for k, t in items], "item_id bigint, text string, answer string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(rows_of(spark, docs), bench).collect()}
    assert got == {(k, k) for k in range(4)} | {(10 + k, k) for k in range(4)}
    # an answer of its own is asked for, where there is one
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(rows_of(spark, docs), bench, answer_col="answer").collect()}
    assert got == {(k, k) for k in (2, 3)} | {(10 + k, k) for k in range(4)}


def test_small_sources_are_interleaved(spark):
    from pyspark.sql import functions as F

    from loglake.llm import sharding

    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 10_000, "big").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("source"), F.lit("t").alias("text"))
    got = sharding.shard_documents(rows, 40).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "big").alias("big")).collect()
    assert len(got) == 40 and all(r["n"] == 500 and abs(r["big"] - 250) <= 2 for r in got)


def test_copies_of_a_row_are_dealt_out(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from loglake.llm import sharding

    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = spark.range(300).select(F.when(F.col("id") < 100, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.lit("t").alias("text"))
    got = sharding.shard_documents(rows, 8)
    assert got.count() == 300 and got.filter("doc_id = 1").count() == 100
    slots = got.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect()
    assert all(r["s"] == list(range(len(r["s"]))) and len(r["s"]) in (37, 38) for r in slots) and len(slots) == 8
    docs = rows.filter("doc_id != 1").withColumn("more", F.lit(5))
    sharding.write_shards(docs, sharding.shard_documents(docs, 3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("shard").count().filter("count between 66 and 67").count() == 3 and back.filter("more = 5").count() == 200


def test_fold_against_replay():
    import random

    from loglake.llm import chat

    for seed in range(300):
        r = random.Random(seed)
        log = [(r.choice([*chat.KINDS, "delta", "noise"]), r.choice([None, 0, 1, 2, 3, 9]), r.choice(["user", "assistant"]), r.choice("abc")) for _ in range(r.randint(0, 25))]
        fold, plain = chat.Fold(), []
        for kind, turn, role, text in log:
            fold.take(kind, turn, role, text)
            if turn is None or kind == "noise":
                continue
            own = [m for m in plain if m[0] == turn]
            if kind == "delta":
                plain = plain if own else [*plain, [turn, role, ""]]
                next(m for m in plain if m[0] == turn)[2] += text
                continue
            plain = [m for m in plain if m[0] <= turn]
            if kind == "message":
                plain = [m for m in plain if m[0] != turn] + [[turn, role, text]]
            elif own:
                own[0][2] = text if kind == "edit" else ""
        assert fold.final() == [(role, text) for _, role, text in sorted(plain, key=lambda m: m[0])]


def test_fold_is_linear():
    import time

    from loglake.llm import chat

    fold, began = chat.Fold(), time.time()
    for k in range(200_000):
        fold.take("message", k, "user", "x")
    assert len(fold.final()) == 200_000 and time.time() - began < 20


def test_log_of_a_table_takes_things_back(spark):
    from loglake.llm import chat

    rows = spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", f"{c}:{t} " + "y" * (t * 700)) for c in range(10) for t in range(8)], "conv_id bigint, turn bigint, role string, text string")
    log = chat.log_of(rows)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == set(chat.KINDS)
    got = {r["conv_id"]: r["formatted"] for r in chat.format_log(log).collect()}
    assert got == {c: chat.render([("assistant" if t % 2 else "user", f"{c}:{t} " + "y" * (t * 700)) for t in range(8)]) for c in range(10)}


def test_decontamination_stage_tells_rows_by_id_and_text(spark, tmp_path):
    item = " ".join(f"item{k}" for k in range(40))
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"before {item} after"), (1, "another text under the same id"), (None, f"{item}"), (None, None), (2, "")]
    got = corpus_pipeline.decontamination_stage(spark, rows_of(spark, rows), str(tmp_path)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [rows[1], rows[3], rows[4]]))


@pytest.mark.parametrize("name", ["quality_stage", "near_duplicate_stage", "decontamination_stage"])
def test_stages_at_the_edges(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "s", 0), (5, "", "en", "s", 0)], docs.schema))
    for rows in (docs.limit(0), odd):
        got = getattr(corpus_pipeline, name)(spark, rows, sf_dir)
        assert got.columns == docs.columns and got.count() <= rows.count()


def test_recall_of_leaks_against_all_pairs(spark):
    """Every document against every item by the longest common subsequence: paraphrases of a share of 0.6 to 0.9, items of common words among them."""
    import random

    r = random.Random(8)
    rare = [f"w{k}x" for k in range(4000)]
    often = [f"c{k}" for k in range(40)]
    said = lambda n, share: [r.choice(often) if r.random() < share else r.choice(rare) for _ in range(n)]
    items = [said(r.randrange(25, 90), 0.8 if k % 4 == 0 else 0.3) for k in range(60)]
    docs = []
    for k in range(900):
        body = said(r.randrange(0, 250), 0.5)
        if k % 3 == 0:
            item, keep = items[k % 60], r.uniform(0.62, 0.9)
            own = [w if r.random() < keep else r.choice(rare) for w in item]
            at = r.randrange(len(body) + 1)
            body = [*body[:at], *own, *body[at:]]
        docs.append(body)
    want = {(d, k) for d, body in enumerate(docs) for k, item in enumerate(items) if len(body) and decontaminate.lcs(body, item) >= 0.6 * len(item) and near(body, item)}
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(rows_of(spark, [(k, " ".join(x)) for k, x in enumerate(docs)]), bench).collect()}
    assert got <= {(d, k) for d, body in enumerate(docs) for k, item in enumerate(items) if decontaminate.lcs(body, item) >= 0.6 * len(item)}
    assert len(got & want) >= 0.95 * len(want) > 200


def near(body, item):
    """Whether some run of twice the item's length has the share, so that scattered words of a long document don't count."""
    return any(decontaminate.lcs(body[at : at + 2 * len(item)], item) >= 0.6 * len(item) for at in range(0, max(1, len(body) - len(item)), max(1, len(item) // 2)))


def test_segmentations_come_whole(spark):
    from loglake.llm import pieces

    v = pieces.Vocabulary.load()
    docs = rows_of(spark, [(1, "the quick brown foxes of the onerbleretion"), (2, ""), (3, None), (4, "a")])
    import zlib

    import numpy as np

    for row in pieces.segmentations(pieces.encode_documents(docs, v)).collect():
        assert len(row["segmentations"]) == len(row["nbest"])
        for one, whole in zip(row["nbest"], row["segmentations"], strict=True):
            assert zlib.crc32(np.array(whole, np.int32).tobytes()) == one["ids_crc32"] and len(whole) == one["n_tokens"]
            assert pieces.decode_ids(v, whole) == {1: "the quick brown foxes of the onerbleretion", 4: "a"}[row["doc_id"]]


def test_listed_rules_against_brute_force(spark):
    import random
    import re

    from loglake.llm import urlfilter

    r = random.Random(2)
    names = [f"n{k}" for k in range(300)] + ["ads", "shop", "com", "org", "img"]
    word = lambda: r.choice(names)
    lines = ["! note", "[head]", "", "a.com##div", "*"]
    for k in range(3000):
        lines.append(r.choice([f"||{word()}.{word()}^", f"||{word()}.com/{word()}/", f"/{word()}/*/{word()}.", f"{word()}-{word()}", f"|http://{word()}.org/", f"/{word()}|", f"@@||{word()}.com^", f"||{word()}.org^*{word()}$script,third-party"]))
    rules = urlfilter.read_rules(lines)
    assert 2000 < len(rules) <= 3000
    urls = [f"http://{r.choice(['', 'www.', word() + '.'])}{word()}.{r.choice(['com', 'org', word()])}/{word()}/{r.choice([word(), word().upper() + '-' + word()])}/{word()}.{word()}" for _ in range(3000)] + [None, "", "x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {x["page_id"]: (x["host"] + x["path"], x["verdict"]) for x in urlfilter.filter_urls(df, rules).collect()}
    compiled = [(re.compile(x.pattern), x.verdict) for x in rules]
    blocked = 0
    for text, verdict in got.values():
        hits = {v for p, v in compiled if p.search(text)}
        assert verdict == ("allow" if "allow" in hits or not hits else "block")
        blocked += verdict == "block"
    assert 100 < blocked < 2900
