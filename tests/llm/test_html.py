"""The block labeller on pages of several layouts with their text marked by hand, and its network against a scalar one."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loglake.llm import htmltext

SAID = [
    "The council met on Tuesday evening to discuss the new bridge, which has been planned for more than ten years and is now expected to open in spring.",
    "Engineers told the meeting that the foundations were finished ahead of time, but that the price of steel had risen by a third since the contract was signed.",
    "Several residents asked whether the old ferry would keep running. The mayor said that no decision had been taken and that a report would follow in June.",
    "A second vote is needed before work on the approach roads can begin. It is to be held next month.",
]
TITLE = "New bridge to open in spring"
LISTED = ["length of 320 metres", "two lanes for bicycles", "cost of 40 million"]


def ps(texts, tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


FOOT = "<footer>&copy; Town Paper</footer></body></html>"
#: Name -> (page, text).
LAYOUTS = {
    "named": (
        f'<html><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><article><h1>{TITLE}</h1>{ps(SAID)}</article><aside class="sidebar"><h3>Most read</h3><ul><li><a href=1>Ten walks</a></li></ul></aside>{FOOT}',
        [TITLE, *SAID],
    ),
    "neutral names": (
        f'<html><body><div class="k1"><div class="t"><a href=x>Home</a></div><div class="t"><a href=y>News</a></div><div class="t"><a href=z>Sport</a></div></div><div class="k2"><h1>{TITLE}</h1>{ps(SAID)}</div><div class="k3">Copyright Town Paper 2024. All rights reserved.</div></body></html>',
        [TITLE, *SAID],
    ),
    "comments within": (
        f'<html><body><nav><a href=x>Home</a> <a href=y>News</a></nav><article><h1>{TITLE}</h1>{ps(SAID)}<div class="thread"><h3>3 replies</h3><div><b>anna</b><p>About time, I have waited for this since I was at school.</p></div><div><b>joe77</b><p>Who pays for the steel?</p></div><div><b>Mr K</b><p>Keep the ferry, it is the best thing in this town and my children love it.</p></div></div></article>{FOOT}',
        [TITLE, *SAID],
    ),
    "hidden": (
        f'<html><body><nav><a href=x>Home</a></nav><article><h1>{TITLE}</h1>{ps(SAID[:2])}<p hidden>You should not see this paragraph, it is only for robots and counts nothing.</p><p style="color:red; display: none">Nor this one, which is as long as any other paragraph in the text and ends well.</p>{ps(SAID[2:])}</article>{FOOT}',
        [TITLE, *SAID],
    ),
    "comments after, no names": (
        f'<html><body><header><div>Town Paper</div></header><div class="xq"><h1>{TITLE}</h1>{ps(SAID)}</div><div class="zz"><div><span>anna, 3.4.2024</span><div>About time, I have waited for this since I was at school.</div><a href=r>reply</a></div><div><span>joe77, 3.4.2024</span><div>Who pays for the steel?</div><a href=r>reply</a></div></div><div class="foot">&copy; Town Paper, <a href=i>imprint</a></div></body></html>',
        [TITLE, *SAID],
    ),
    "paragraphs are divs": (
        f'<html><body><div id="top"><ul><li><a href=1>Home</a></li><li><a href=2>World</a></li><li><a href=3>Local</a></li></ul></div><div id="c"><div class="text"><h2>{TITLE}</h2>{ps(SAID, "div")}</div></div><div><form action=s><label>Search</label><input><button>Go</button></form></div></body></html>',
        [TITLE, *SAID],
    ),
    "advert within": (
        f'<html><body><main><h1>{TITLE}</h1>{ps(SAID[:2])}<div class="promo">Buy two shoes and get a third for nothing!</div>{ps(SAID[2:])}<div class="share"><a href=1>Tweet</a> <a href=2>Mail</a></div></main><footer><p>&copy; Town Paper</p></footer></body></html>',
        [TITLE, *SAID],
    ),
    "notice": (f'<html><body><div class="zt"><p>We use small files to make this site better.</p><button>Fine</button></div><section class="entry"><h1>{TITLE}</h1>{ps(SAID)}</section><div>&copy; Town Paper</div></body></html>', [TITLE, *SAID]),
    "lists": (f"<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>{TITLE}</h1>{ps(SAID)}<ul>{ps(LISTED, 'li')}</ul></article>{FOOT}", [TITLE, *SAID, *LISTED]),
}


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")


def renamed(column):
    """Pages whose containers' names say nothing."""
    for old, new in (("<(/?)article", "<$1section"), ("<nav>", "<div>"), ("</nav>", "</div>"), ("<footer>", "<div>"), ("</footer>", "</div>"), ('class="ad"', 'class="qq"')):
        column = F.regexp_replace(column, old, new)
    return column


def texts(spark, model, values):
    df = spark.createDataFrame(pd.DataFrame({"k": range(len(values)), "html": values}))
    return [r["text"] for r in htmltext.extract(df, model).orderBy("k").collect()]


def test_layouts(spark, pages):
    model = htmltext.train(pages)
    got = dict(zip(LAYOUTS, texts(spark, model, [p for p, _ in LAYOUTS.values()]), strict=True))
    assert got == {k: "\n\n".join(v) for k, (_, v) in LAYOUTS.items()}


def test_pages_without_telling_names(spark, pages):
    other = pages.withColumn("html", renamed(F.col("html")))
    model = htmltext.train(other)
    want = {r["page_id"]: [b[1] for b in htmltext.leaves(r["html"]) if htmltext.weak_label(b[0])] for r in pages.collect()}
    hit = miss = extra = 0
    for r in htmltext.extract(other, model).collect():
        got, own = r["text"].split("\n\n") if r["text"] else [], want[r["page_id"]]
        hit += len([t for t in own if t in got])
        miss += len([t for t in own if t not in got])
        extra += len([t for t in got if t not in own])
    assert miss <= 0.03 * (hit + miss) and extra <= 0.08 * (hit + miss)


def test_network_against_a_scalar_one():
    p = htmltext.init(7)
    pages = htmltext.composed("one two three four five six".split(), 4, seed=2)

    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    def read(rows, d):
        h, c, out = [0.0] * htmltext.HIDDEN, [0.0] * htmltext.HIDDEN, []
        for x in rows:
            g = [sum(float(a) * b for a, b in zip(x, p[f"{d}x"][:, j], strict=True)) + sum(a * b for a, b in zip(h, p[f"{d}h"][:, j], strict=True)) + p[f"{d}b"][j] for j in range(4 * htmltext.HIDDEN)]
            n = htmltext.HIDDEN
            c = [sigmoid(g[n + j]) * c[j] + sigmoid(g[j]) * math.tanh(g[3 * n + j]) for j in range(n)]
            h = [sigmoid(g[2 * n + j]) * math.tanh(c[j]) for j in range(n)]
            out.append(h)
        return out

    for (x, _), y in zip(pages, htmltext.label([x for x, _ in pages], p), strict=True):
        x = x[:12]
        forward, backward = read(x, "f"), read(x[::-1], "b")[::-1]
        want = [sigmoid(sum(a * b for a, b in zip([*f, *b], p["o"], strict=True)) + p["ob"][0]) for f, b in zip(forward, backward, strict=True)]
        assert np.allclose(want, htmltext.label([x], p)[0])
        assert len(y) >= len(want)


def test_hidden_elements():
    page = '<div title="the hidden truth">a</div><div hidden>b</div><div aria-hidden="true"><p>c</p></div><p class="hidden">d</p><p STYLE=\'visibility: hidden\'>e</p><p data-display="none">f</p>'
    assert [b[1] for b in htmltext.leaves(page)] == ["a", "d", "f"]
