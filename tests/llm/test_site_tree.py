"""The style tree against a plain tree, on sites of any size and pages that tell nothing by their names, and hostile pages."""

import math
import random
import sys
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mnemoframe.llm import site_tree  # noqa: E402


def text(draw, n):
    return " ".join(f"w{draw.randrange(5000)}" for _ in range(n)).replace("w", "v", 1)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("size", [2, 5, 19, 20])
def test_neutral_pages_lose_what_their_site_shares(spark, size):
    draw = random.Random(size)
    own = [text(draw, 40) for _ in range(size)]
    notice, ad = "We use small files on this site to remember what you like", "Buy 7 for the price of 6"
    rows = [(k, "http://a.org/x", f"<div class='c1'><div class='c2'><p>{notice}</p></div><div class='c3'><p>{own[k]}</p><p>{ad} {k}</p></div></div>") for k in range(size)]
    got = {r["page_id"]: r["text"] for r in site_tree.main_texts(pages_of(spark, rows)).collect()}
    assert got == dict(enumerate(own))


@pytest.mark.parametrize("size", [5, 20])
def test_short_articles_under_a_long_notice(spark, size):
    draw = random.Random(size)
    own, notice = [text(draw, 25) for _ in range(size)], text(draw, 200)
    rows = [(k, "http://a.org/x", f"<div><p>{notice}</p><p>{own[k]}</p></div>") for k in range(size)]
    got = {r["page_id"]: r["text"] for r in site_tree.main_texts(pages_of(spark, rows)).collect()}
    assert got == dict(enumerate(own))


def test_copies_stay_whole(spark):
    draw = random.Random(9)
    body = [text(draw, 60) for _ in range(3)]
    rows = [(k, "http://a.org/x", f"<article><h1>Version {'abcdefgh'[k]}</h1>" + "".join(f"<p>{x}</p>" for x in body) + "</article>") for k in range(8)]
    # two pages that share more than they have of their own
    rows += [(20 + k, "http://b.org/x", f"<p>{body[0]}</p><p>{body[1]}</p><p>{text(draw, 30)}</p>") for k in range(2)]
    got = {r["page_id"]: r["text"] for r in site_tree.main_texts(pages_of(spark, rows)).collect()}
    assert all("\n\n".join(body) in got[k] for k in range(8)) and all(body[0] in got[20 + k] and body[1] in got[20 + k] for k in range(2))


def plain_low(pages, importance):
    """Low blocks and nodes of one site by loops over its pages: lists of (node, text) and of children by node."""
    different = {}
    for blocks, children in pages:
        different.setdefault(tuple(site_tree._feature(t) for _, t in blocks), (blocks, children))
    holds = defaultdict(set)
    texts, lists = defaultdict(lambda: defaultdict(list)), defaultdict(Counter)
    for k, (blocks, children) in enumerate(different.values()):
        for node, t in blocks:
            holds[node].add(k)
        for (node, f), n in Counter((node, site_tree._feature(t)) for node, t in blocks).items():
            texts[node][f].append(n)
        for node, c in children.items():
            holds[node].add(k)
            lists[node][" ".join(c)] += 1
    low = set()
    for node, pages_ in holds.items():
        m = len(pages_)
        if m < 2:
            continue
        values, weights = [], []
        for f, ns in texts[node].items():
            total = sum(ns)
            value = 1 + sum(n / total * math.log(n / total) for n in ns) / math.log(m)
            values.append(value * total)
            weights.append(total)
            if value < importance:
                low.add((node, f))
        presentation = -sum(n / m * math.log(n / m) for n in lists[node].values()) / math.log(m)
        if weights and 0.1 * presentation + 0.9 * sum(values) / sum(weights) < importance:
            low.add((node, None))
    return low


def test_low_branches_equal_a_plain_tree(spark):
    draw = random.Random(5)
    shared = [text(draw, 6) for _ in range(4)]
    sources = []
    for k in range(30):
        parts = [f"<p>{draw.choice(shared)}</p>" for _ in range(draw.randint(0, 3))] + [f"<div class='{draw.choice('ab')}'><p>{text(draw, 5)}</p><p>{shared[0]}</p></div>"]
        draw.shuffle(parts)
        sources.append(f"<main><section><p>{shared[1]}</p></section>{''.join(parts)}</main>")
    sources += sources[:3]
    pages = []
    for source in sources:
        page = site_tree.Page(source)
        main = page.main()
        over = set()
        for node, _ in main:
            while node not in over:
                over.add(node)
                node = page.above.get(node, 0)
        pages.append((main, {n: c for n, c in page.children.items() if n in over}))
    for importance in (0.05, 0.3, 0.6):
        rows = spark.createDataFrame([("a.org", x) for x in sources], "host string, html string")
        got = site_tree.low_branches(rows, importance).collect()
        want = plain_low(pages, importance)
        assert want and {(r["node"], r["feature"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("source", [
    "<div>" * 30_000 + "x", '<a "x ' * 30_000, "<a 'x " * 30_001, "<" * 200_000, "<b>" * 20_000 + "<p></p>" * 20_000, "<div>" * 20_000 + "</section>" * 20_000,
    "<script" * 20_000, "</script " * 20_000, "<script>" + "</script" * 20_000, "<!--" * 30_000, "<p>" * 50_000, "<li><div>" * 20_000, '<a x="' + ">" * 100_000, "&" * 100_000, "<div><p>x</p>" * 15_000,
])
def test_hostile_pages_take_linear_time(source):
    start = time.process_time()
    page = site_tree.Page(source)
    page.main()
    assert time.process_time() - start < 4
    assert len(page.stack) <= site_tree.DEPTH + 1


def test_quotes_without_a_partner():
    assert site_tree.Page("<p title=\"x>one</p><p>two").main()[-1][1] == "two"
    assert [t for _, t in site_tree.Page("<p>a</p><a href='>'>b</a><p>it's</p>").main()] == ["a", "b", "it's"]
    assert [t for _, t in site_tree.Page("<p>1 < 2</p><p>x <3</p>").main()] == ["1 < 2", "x <3"]
