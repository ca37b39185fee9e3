"""Voronoi search against brute force; page extraction on known layouts and odd pages."""

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_crf, voronoi
from tidemark.llm.common import table

QUERIES = "vec_id % 50 = 0"


def plain_top(rows, k=5):
    usable = [(i, np.floor(256 * np.array(v, dtype=float)).astype(np.int64)) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in usable), default=0)
    ids = np.array([i for i, _ in usable])
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in usable]).reshape(len(usable), width)
    found = []
    for a in range(len(usable)):
        if ids[a] % 50 == 0:
            scores = x @ x[a]
            order = [b for b in np.lexsort((ids, -scores)) if b != a][:k]
            found += [(int(ids[a]), r + 1, int(ids[b]), int(scores[b])) for r, b in enumerate(order)]
    return sorted(found)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, cell string, score double")


@pytest.mark.parametrize("kind", ["clusters", "copies", "noise"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 4
    if kind == "clusters":
        x = centres[np.arange(1500) % 12] + rng.normal(size=(1500, 8)) * 0.05
    elif kind == "copies":
        x = np.repeat(centres, [900] + [40] * 11, axis=0)
    else:
        x = rng.normal(size=(1200, 8)) * rng.random((1200, 1)) * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = voronoi.top_k(frame(spark, rows), F.expr(QUERIES), pivots=16, block=100, query_part=9)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in found.collect()) == plain_top(rows)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (50, [1.0, -2.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (None, [1.0, 2.0]), (7, [inf, 1.0]), (9, [3.0]),
            (11, []), (12, [-0.001, 0.0]), (13, [1e7, 1e7])]
    found = voronoi.top_k(frame(spark, rows), F.expr(QUERIES))
    assert sorted(tuple(r) for r in found.collect()) == plain_top(rows)
    for few in ([], [(0, [1.0])], [(1, [1.0]), (2, [2.0])]):
        assert voronoi.top_k(frame(spark, few), F.expr(QUERIES)).count() == 0
    # a repeated id is a candidate for its twin, not for itself
    twins = voronoi.top_k(frame(spark, [(50, [1.0]), (50, [2.0])]), F.expr(QUERIES)).collect()
    assert sorted((r.vec_id, r.score) for r in twins) == [(50, 131072), (50, 131072)]


def test_bounds_prune_far_cells(spark):
    """Well parted long and short vectors: not every query goes to every cell, and nothing is lost."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(300, 4)) * 0.01 + s * np.eye(4)[i % 4] for i, s in enumerate((9, 8, 7, 6, 0.1, 0.2))])
    usable = x * 256
    centres = np.array([usable[i * 300] for i in range(6)])
    far = ((usable[:, None] - centres) ** 2).sum(axis=2)
    cell = far.argmin(axis=1)
    away, norm = np.sqrt(far.min(axis=1)), np.sqrt((usable**2).sum(axis=1))
    import pandas as pd
    data = pd.DataFrame({"cell": cell, "away": away, "norm": norm})
    cells = data.groupby("cell").agg(rows=("away", "size"), away_min=("away", "min"), away_max=("away", "max"), norm_max=("norm", "max")).reset_index()
    near = data.sort_values(["cell", "away"]).groupby("cell").head(6)
    bounds = voronoi.Bounds(centres, cells, near, 5)
    least, most = bounds.of_queries(norm, np.sqrt(far), usable @ centres.T)
    scores = usable @ usable.T
    kth = np.sort(scores, axis=1)[:, -5]
    assert (least <= kth + 1e-6).all()
    for c in range(6):
        assert (scores[:, cell == c].max(axis=1) <= most[:, c] + 1e-6).all()
    assert (most < least[:, None]).mean() > 0.3


@pytest.fixture(scope="module")
def model(spark):
    return html_crf.fit(table(spark, "/root/testdata/sf0.01", "pages"))


def test_articles_of_the_table(spark, model):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    found = {r.page_id: r for r in html_crf.extract(pages, model).collect()}
    wrong = 0
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", z)).split()) for z in re.split(r"<(?:/?p|/?h1|br)\b[^>]*>", body))
        want = "\n".join(p for p in parts if p)
        wrong += found[r.page_id].text != want
        assert found[r.page_id].n_chars == len(found[r.page_id].text) and found[r.page_id].url == r.url
    assert wrong <= 2


def test_held_out_layouts(model):
    rng = np.random.default_rng(77)
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split()
    right = total = 0
    for _ in range(200):
        blocks, labels = html_crf.labelled(html_crf.layout(html_crf.made_up_body(rng, words), rng, words))
        found = model.viterbi(model.scores(blocks))
        right += sum(a == b for a, b in zip(found, labels))
        total += len(labels)
    assert right / total > 0.98


def test_a_page_with_everything(model):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><div id="cookie-banner"><p>We use cookies.</p></div>
    <header><h2>Site</h2><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav></header>
    <div class="post-content"><h1>Title</h1><p>Hello&nbsp;world &amp; all,
       this is text.<br>Line two, too<p>Second with a <a href=y>link</a>.<!-- <p>hidden</p> --></div>
    <div class="comments"><div class="comment"><p>Nice post, I liked it.</p></div></div><form><label>Name</label><input></form>
    <aside class="sidebar"><p>Related, more, things.</p></aside><footer>(c) 2020</footer>"""
    assert model.main_text(page) == "Title\nHello world & all, this is text. Line two, too\nSecond with a link."


def test_viterbi_against_all_paths(model):
    from itertools import product
    rng = np.random.default_rng(4)
    for n in (1, 2, 6):
        scores = rng.normal(size=(n, 2)) * 2

        def value(path):
            return model.first[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(model.step[a, b] for a, b in zip(path, path[1:]))

        assert tuple(model.viterbi(scores)) == max(product((0, 1), repeat=n), key=value)


def test_odd_pages(spark, model):
    odd = [None, "", "<", "<p", "plain", "<script>x", "<!-- a", "<p>a</p" * 3, "<article>" + "<p>some words here, yes.</p>" * 20_000, "</p></div><b>", "<div>" * 5000 + "x"]
    pages = spark.createDataFrame([(None if i == 3 else i // 2, None if i == 1 else "u", h, "t", 5) for i, h in enumerate(odd)],
                                  "page_id long, url string, html string, text string, n_chars int")
    found = html_crf.extract(pages, model).collect()
    assert len(found) == len(odd) and all(r.n_chars == len(r.text) for r in found)
    assert max(r.n_chars for r in found) == 20_000 * len("some words here, yes.") + 19_999
    assert html_crf.extract(pages.where("false"), html_crf.fit(pages.where("false"))).count() == 0


@pytest.mark.parametrize("size", [900, 1_100, 10_000, 1_000_000])
def test_tags_of_any_length(size):
    code = "QUJD" * (size // 4)
    page = (f'<!doctype html SYSTEM "{code}"><body><section class="comments" data-props=\'{{"html": "<p>{code}</p>"}}\'><p style="{code}">Said</p></section>'
            f'<p title=it\'s>One <img src="data:image/png;base64,{code}"> two</p><script data-c="{code}">var code = 1;</script>'
            f'<div {"a " * (size // 2)}id="x">Three</div><x-{code}>Four</x-{code}></body>')
    blocks = html_crf.leaf_blocks(page)
    assert [b.text for b in blocks] == ["Said", "One two", "Three", "Four"]
    assert blocks[0].path[1] == ("section", "comments") and blocks[2].path[-1] == ("div", "x")


def test_quotes_without_an_end():
    assert [b.text for b in html_crf.leaf_blocks('<p>One</p><p class="x>Two</p><div>Three</div><')] == ["One", "Two", "Three", "<"]
    start = time.perf_counter()
    for page in ('<a x= "<b>" ' * 20_000 + '"', "<!" * 200_000, "<a" * 200_000, '<a b="' * 100_000, "<p " + "x" * 400_000 + ">y"):
        html_crf.leaf_blocks(page)
    assert time.perf_counter() - start < 10
