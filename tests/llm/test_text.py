"""Segmentation, token counts, HTML text, chat and URL rules against brute force."""

import hashlib
import itertools
import random
import re
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loglake.llm import chat, htmltext, pieces, tokencount, urlfilter
from loglake.llm.shared import shared_dir, stored


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def small(words):
    ids = [f"<0x{k:02X}>" for k in range(256)]
    names = ["<unk>", *ids, *words]
    return pieces.Vocabulary(names, [0.0] * 257 + [-float(1 + (7 * k) % 5) for k in range(len(words))], [False] * 257 + [True] * len(words), list(range(1, 257)), 0)


def all_segmentations(v, text):
    """(score, lengths, ids) of every segmentation of a text with blank marks, in the operator's order."""
    out = []

    def walk(at, score, lengths, ids):
        if at == len(text):
            out.append((score, lengths, ids))
        for n in range(1, min(v.longest, len(text) - at) + 1):
            k = v.ids.get(text[at : at + n], -1)
            if k >= 0 or n == 1:
                walk(at + n, score + (float(v.scores[k]) if k >= 0 else v.unknown_score), (*lengths, n), (*ids, k))

    walk(0, 0.0, (), ())
    return sorted(out, key=lambda x: (-x[0], tuple(-n for n in reversed(x[1]))))


WORDS = [pieces.SPACE, pieces.SPACE + "a", "a", "b", "ab", "ba", "aba", "c", "bc", pieces.SPACE + "ab", ",", ".", ",,"]


@pytest.mark.parametrize("text", ["▁ab", "▁abab", "▁aababc", "▁aXb", "a", "▁", "▁bcba"])
def test_a_star_is_exact(text):
    v = small(WORDS)
    want = all_segmentations(v, text)
    got = [(s, tuple(k)) for s, k in pieces.a_star(v, text, 6)]
    assert [s for s, _ in got] == [s for s, _, _ in want[:6]] and len(set(got)) == len(got) <= len(want)
    assert set(got) <= {(s, k) for s, _, k in want} and got[0] == (want[0][0], want[0][2])


def test_long_chunks_agree_with_short(monkeypatch):
    v = small(WORDS)
    r = random.Random(2)
    texts = ["".join(r.choice("abcX,") for _ in range(r.randrange(1, 40))) for _ in range(100)]
    a = pieces.Segmenter(v, 4).texts_nbest([v.chunks(t) for t in texts])
    monkeypatch.setattr(pieces, "LONG", 3)
    b = pieces.Segmenter(v, 4).texts_nbest([v.chunks(t) for t in texts])
    assert a[0].tolist() == b[0].tolist() and a[2] == b[2]


def test_texts_against_all_segmentations():
    v = small(WORDS)
    s = pieces.Segmenter(v, 5)
    r = random.Random(1)
    for _ in range(60):
        text = "".join(r.choice("ab c,.Xb") for _ in range(r.randrange(1, 9)))
        flat, ends, found = s.texts_nbest([v.chunks(text)])
        want = all_segmentations(v, (" " + text).replace(" ", pieces.SPACE))
        assert [x for x, _ in found[0]] == pytest.approx([x for x, _, _ in want[:5]])
        assert len({b for _, b in found[0]}) == len(found[0])
        assert found[0][0][1] == flat.tobytes() and ends[-1] == len(flat)
        spelled = {np.array(v.spelled(list(k), (" " + text).replace(" ", pieces.SPACE)), np.int32).tobytes() for score, _, k in want if score >= want[min(4, len(want) - 1)][0]}
        assert {b for _, b in found[0]} <= spelled
        assert pieces.decode_ids(v, flat.tolist()) == text


def test_vocabulary_falls_into_chunks(vocabulary):
    assert not vocabulary.whole
    text = "A b,c  d\n\te²f  \n"
    assert "".join(vocabulary.chunks(text)) == " " + text


def test_encode_and_decode(spark, vocabulary):
    texts = [None, "", "hello world", "hello world", "naïve — 漢字 \U0001f600\n\n  x", "a" * 70_000, "word " * 20_000, "\t"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"ids": F.lit(1), "score": F.lit("x")})
    got = {r["doc_id"]: r for r in pieces.encode_documents(docs, vocabulary).collect()}
    assert len(got) == len(texts) and all(r["round_trip"] for r in got.values())
    assert got[0]["n_tokens"] == 0 and got[0]["score"] is None and got[1]["nbest"] == []
    assert got[2]["ids"] == got[3]["ids"] and len(got[2]["nbest"]) == 4
    assert all(a["score"] >= b["score"] for r in got.values() for a, b in itertools.pairwise(r["nbest"]))
    back = pieces.decode_documents(pieces.encode_documents(docs, vocabulary), vocabulary)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert pieces.encode_documents(docs.limit(0), vocabulary).count() == 0


def test_same_scores_as_the_library(vocabulary):
    """The library's unigram search over the same pieces and scores finds the same best scores."""
    sentencepiece = pytest.importorskip("sentencepiece")
    data = bytearray(open(pieces.MODEL, "rb").read())

    def varint(i):
        n = shift = 0
        while True:
            n |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if not data[i - 1] & 128:
                return n, i

    i = 0
    while i < len(data):  # the trainer's settings are field 2, the kind of model is its field 3
        tag, i = varint(i)
        n, i = varint(i)
        j = i if tag >> 3 == 2 else i + n
        while j < i + n:
            t, j = varint(j)
            if t & 7 == 0:
                if t >> 3 == 3:
                    data[j] = 1
                _, j = varint(j)
            elif t & 7 == 2:
                m, j = varint(j)
                j += m
            else:
                j += 4 if t & 7 == 5 else 8
        i += n
    sp = sentencepiece.SentencePieceProcessor(model_proto=bytes(data))
    s = pieces.Segmenter(vocabulary, 3)
    for text in ("the quick brown fox", "onerbleretion thonthwh", "Ciónue que", "ein verzeichnis"):
        _, _, found = s.texts_nbest([vocabulary.chunks(text)])
        want = [sum(vocabulary.scores[k] for k in ids) for ids in sp.nbest_encode_as_ids(text, 3)]
        assert [x for x, _ in found[0]] == pytest.approx(want)


def test_token_counts(spark):
    ranks = tokencount.ranks_of()
    enc = tokencount.encoding(ranks)
    texts = [None, "", "one two", "one two", "<|endoftext|> is text", "x" * 5000, "a b " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"file": F.lit(1), "n": F.lit(2)}).repartition(3)
    want = {k: len(enc.encode_ordinary(t or "")) for k, t in enumerate(texts)}
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    placed = stored(tokencount.write_tokens(docs, ranks, path), "placed")
    for block in (2, 6, 64, 1 << 20):
        got = placed.join(tokencount.scan(spark, path, block=block), ["file", "ordinal"]).collect()
        assert {r["id"]: r["n_tokens"] for r in got} == want, block
    assert {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs, ranks).collect()} == want
    assert tokencount.count_tokens(docs.limit(0), ranks).count() == 0


def test_scan_of_open_end_and_many_blocks(spark, monkeypatch):
    """Tokens after the last separator are a document; the scan's two levels agree with a plain loop."""
    monkeypatch.setattr(tokencount, "STEP", 3)
    r = np.random.default_rng(2)
    ids = r.integers(0, 20, 400).astype("<u2")
    ids[ids < 2] = tokencount.END
    store, root = tokencount.where(f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}")
    store.create_dir(root)
    with store.open_output_stream(f"{root}/a.bin") as out:
        out.write(ids.tobytes())
    want, n = [], 0
    for k in ids.tolist():
        if k == tokencount.END:
            want.append(n)
            n = 0
        else:
            n += 1
    want += [n] * (n > 0)
    for block in (2, 10, 34, 4096):
        got = tokencount.scan(spark, f"file://{root}", block=block).orderBy("ordinal").collect()
        assert [x["n_tokens"] for x in got] == want and [x["ordinal"] for x in got] == list(range(len(want)))


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu one</a></li><li>two</li></ul></nav><!-- c -->
<div class="ad">Buy it</div><article><h1>Title {n}</h1><p>First &amp; <b>bold
text</b>, more words here.<p>Second&nbsp;one &#233; 3 &lt; 4.</p></article><aside class="sidebar"><p>Side words</p></aside><footer>&copy; foot</footer></body></html>"""


def test_html_text(spark):
    pages = [(k, PAGE.format(n=k)) for k in range(60)] + [(100, None), (101, ""), (102, "plain"), (103, PAGE.format(n=3)[: PAGE.index("Second") + 3]), (104, "<article><p>" + "word " * 50_000)]
    df = spark.createDataFrame(pages, "page_id bigint, html string").withColumns({"text": F.lit("old"), "n_chars": F.lit(0)})
    model = htmltext.train(df)
    got = {r["page_id"]: r for r in htmltext.extract(df, model).collect()}
    for k in range(60):
        assert got[k]["text"] == f"Title {k}\n\nFirst & bold text, more words here.\n\nSecond one é 3 < 4."
    assert got[100]["text"] == got[101]["text"] == ""
    assert got[103]["text"].startswith("Title 3\n\nFirst")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert htmltext.extract(df.limit(0), model).count() == 0


def test_lstm_gradient():
    r = np.random.default_rng(0)
    rows = [r.random((n, htmltext.WIDTH)).astype(np.float32) for n in (3, 1, 5)]
    x, steps, spread = htmltext.layout(rows, np.array([3, 1, 5]))
    target, mask = np.zeros(len(x)), np.zeros(len(x))
    for s, rows_ in zip(spread, rows, strict=True):
        mask[s + 1 : s + 1 + len(rows_)] = 1
        target[s + 1] = 1
    p = htmltext.init(1)
    _, g = htmltext.gradient(x, steps, target, mask, p)
    for name in ("fx", "fh", "bh", "bb", "o", "ob"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        ends = []
        for step in (1e-5, -1e-5):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            ends.append(htmltext.gradient(x, steps, target, mask, q)[0])
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[name][at], rel=1e-4)


def test_block_labels_do_not_depend_on_the_batch():
    p = htmltext.init(3)
    rows = [np.random.default_rng(k).random((n, htmltext.WIDTH)) for k, n in enumerate((4, 0, 7, 1))]
    for got, one in zip(htmltext.label(rows, p), rows, strict=True):
        assert np.allclose(got, htmltext.label([one], p)[0])


TEXT = st.text(st.sampled_from("ab\\#</turn> :\né#"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(TEXT, st.just("assistant")), TEXT), max_size=5))
def test_chat_reads_back(messages):
    text = chat.render(messages)
    assert [(role, chat.unescape(text[a:b])) for role, a, b in chat.turns(text)] == messages
    assert "".join(chat.unescape(text[a:b]) for a, b in chat.loss_spans(text)) == "".join(t for r, t in messages if r == "assistant")


def test_event_sourcing(spark):
    log = [
        (1, 0, 0, "message", 0, "user", "hi"), (1, 1, 0, "message", 1, "assistant", "he"), (1, 2, 0, "delta", 1, None, "llo"), (1, 3, 0, "regenerate", 1, None, None), (1, 4, 0, "delta", 1, None, "bye"),
        (2, 0, 0, "message", 0, "user", "a"), (2, 1, 0, "message", 1, "assistant", "b"), (2, 2, 0, "edit", 0, None, "A"), (2, 3, 0, "delta", 1, "assistant", "lost start"),
        (3, 0, 0, "noise", 0, "user", "x"), (3, 1, 0, "message", None, "user", "x"), (None, 0, 0, "message", 0, None, None),
    ]
    got = {r["conv_id"]: r["formatted"] for r in chat.format_log(spark.createDataFrame(log, chat.EVENT)).collect()}
    assert got == {1: chat.render([("user", "hi"), ("assistant", "bye")]), 2: chat.render([("user", "A"), ("assistant", "lost start")]), 3: "", None: chat.render([("", "")])}
    assert chat.format_log(spark.createDataFrame([], chat.EVENT)).count() == 0


def test_chat_of_a_table(spark):
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "x" * 5000), (2, None, None, None), (None, 3, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit(9))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_log(chat.log_of(df))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 5000
    assert got[1]["turns_sha256"] == hashlib.sha256(("user\nq\n" * 2 + "assistant\n" + "x" * 5000 + "\n").encode()).hexdigest()
    assert got[2]["n_turns"] == 1 and got[None]["loss_sha256"] == hashlib.sha256(b"n").hexdigest()


def test_url_rules(spark):
    urls = [None, "", "nothing", "HTTP://WWW.Example.COM/en/7?x", "http://example.com/en/71/a", "https://a.com/en/", "http://com/en/x", "http://xcom/en/", "x://b.net/de/8#f", "x://example.net/de/8", "http://spam-farm.example.org/q", "http://q.org/es/é", "http://h.com?/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({"host": F.lit(0), "verdict": F.lit("?")})
    got = {r["page_id"]: r for r in urlfilter.filter_urls(df, urlfilter.RULES).collect()}

    def brute(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            raw = re.match(r"[^/?#]*", rest)[0]
            host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [r for r in urlfilter.RULES if re.search(r.pattern, host + path)]
        best = min(fits, key=lambda r: r.rank, default=None)
        return host, path, best and best.name, best.verdict if best else "allow"

    for k, url in enumerate(urls):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == brute(url)
    assert got[3]["rule"] == "example.com/en/7" and got[3]["verdict"] == "allow" and got[10]["verdict"] == "block" and got[7]["rule"] is None
    assert urlfilter.filter_urls(df.limit(0), urlfilter.RULES).count() == 0


def test_url_rules_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "RULES_AT_ONCE", 3)
    df = spark.createDataFrame([(0, "http://example.com/en/7"), (1, "http://b.net/de/1"), (2, "http://u.x/")], "page_id bigint, url string")
    rules = [*urlfilter.RULES, urlfilter.Rule("u.x", (), "block", "loose")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.filter_urls(df, rules).collect()}
    assert got == {0: ("example.com/en/7", "allow"), 1: ("net/de/", "block"), 2: ("loose", "block")}


def test_url_rules_of_the_contract(spark):
    """Each rule with the contract's own word, on the host, a subdomain and next to the rule that is longer."""
    want = {
        "http://com/en/": ("com/en/", "block"), "http://a.com/en/x": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"), "http://w.example.com/en/71": ("example.com/en/7", "allow"), "http://example.com/en/8": ("com/en/", "block"),
        "http://net/de/": ("net/de/", "allow"), "http://b.net/de/8": ("net/de/", "allow"), "http://spam-farm.net/de/1": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://w.example.net/de/81?q": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"),
        "http://org/es/": ("org/es/", "block"), "http://a.org/es/x": ("org/es/", "block"), "http://a.org/ES/x": (None, "allow"), "http://spam-farm.net/en/1": (None, "block"),
    }
    df = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r["url"]: (r["rule"], r["verdict"]) for r in urlfilter.filter_urls(df, urlfilter.RULES).collect()} == want
