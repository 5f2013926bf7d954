import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loglake.llm import alignment


@pytest.fixture(scope="module")
def both():
    return alignment.ByteTokens(), alignment.PieceTokens()


def brute(rows, a, b):
    """Every pair of tokens is looked at."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(alignment.BYTE_BPE)
    plain.encode_special_tokens = True
    docs, held = [], Counter()
    for key, text in rows:
        text = text or ""
        said = (" " + text).encode()
        x = plain.encode(" " + text, add_special_tokens=False).ids
        y = b.processor().encode(text)
        if not text or b"".join(a.table[k] for k in x) != said or b"".join(b.table[k] for k in y) != said:
            docs.append((key, 0, 0, 0, [], ""))
            continue
        xe, ye = list(np.cumsum([len(a.table[k]) for k in x])), list(np.cumsum([len(b.table[k]) for k in y]))
        links = [(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if max(xe[i] - len(a.table[x[i]]), ye[j] - len(b.table[y[j]])) < min(xe[i], ye[j])]
        groups, i, j = [], 0, 0
        for e in sorted(set(xe) & set(ye)):
            p, q = xe.index(e) + 1, ye.index(e) + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            i, j = p, q
        held.update(set(links))
        docs.append((key, len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    return Counter((k, n, m, g, len(ls), sum(held[z] == best[z[0]] for z in ls), sum(held[z] for z in ls), d) for k, n, m, g, ls, d in docs)


def test_alignment_against_all_pairs(spark, sf_dir, both):
    a, b = both
    random.seed(5)
    odd = [None, "", " ", "a", "▁ taken for a space", "<|endoftext|> and </s> <unk> <0x41>", "naïve 東京 \U0001f600 \x00 \r\n\t x", "a" * 3000, "same text", "same text", "  two  spaces  ", "́ mark", "é"]
    odd += ["".join(random.choice("ab é東\n\t.'sтĐ\U0001f468‍0١") for _ in range(random.randrange(1, 60))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(odd)] + [(3, "a"), (None, "no id")]
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(25).collect() if len(r.text) < 3000]
    table = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id bigint, text string, chunk string, ID int").repartition(3)
    got = alignment.align_documents(table, a, b)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows, a, b)


def test_alignment_in_small_chunks(spark, both, monkeypatch):
    """Counts are those of all documents, however these are cut into chunks."""
    a, b = both
    rows = [(k, " ".join(random.Random(k).choices(["north", "south", "Überlingen", "x9"], k=12))) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    whole = Counter(map(tuple, alignment.align_documents(table, a, b).collect()))
    assert whole == brute(rows, a, b)
    monkeypatch.setattr(alignment, "LISTED", 3)
    assert Counter(map(tuple, alignment.align_documents(table, a, b).collect())) == whole


def test_empty_table(spark, both):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id string, text string"), *both).collect() == []


def test_gallop():
    r = np.random.default_rng(3)
    shorts, longs = [], []
    for n in (1, 2, 9, 600, 3000):
        long = np.unique(r.integers(0, 20 * n, 3 * n))
        shorts.append(np.unique(np.append(r.choice(np.arange(long[-1] + 1), n), long[-1])))
        longs.append(long)
    s_at, l_at = alignment.bounds([len(x) for x in shorts]), alignment.bounds([len(x) for x in longs])
    found = alignment.gallop(np.concatenate(shorts), s_at, np.concatenate(longs), l_at)
    assert found.tolist() == np.concatenate([np.searchsorted(l, s) + p for s, l, p in zip(shorts, longs, l_at)]).tolist()
