"""Ranked search against a plain version."""

import math
import re

import numpy as np
import pytest

from tidemark.llm import strata

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    rows = [(d, terms(t)) for d, t in docs if d is not None]
    rows = [(d, t) for d, t in rows if t]
    n, total, df = len(rows), sum(len(t) for _, t in rows), {}
    for _, t in rows:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, t in rows:
            m, score = 100 - 90 + (90 * len(t) * n) // total, 0
            for x in wanted & set(t):
                tf = t.count(x)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(80)] + ["É", "straße", "ça"]
    share = 1 / np.arange(1, len(words) + 1)
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 60)), p=share / share.sum()))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "... !!"), (None, "w1 w2"), (403, "w5 " * 9000 + "w70"), (404, rows[7][1]), (405, rows[7][1]),
             (7, rows[7][1]), (406, "É-é W3 w4\u0085w5"), (-1, rows[9][1].upper())]
    items = [(0, "w1 w2 W3"), (1, "w70 w71; w72"), (2, "nothing of this"), (3, None), (4, ""), (None, "w1"), (5, "É straße"),
             (6, " ".join(words)), (7, "w5"), (7, "w60"), (8, rows[7][1])]
    return rows, items


def frames(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 3, 1) for i, t in texts[0]], "doc_id long, text string, term string, m int, score int")
    return docs, spark.createDataFrame([(i, t, 1) for i, t in texts[1]], "item_id long, text string, doc_id int")


def result(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(tuple(r) for r in df.collect())


def test_against_a_plain_version(spark, texts, monkeypatch):
    docs, items = frames(spark, texts)
    want = plain(*texts)
    assert result(strata.search(docs.repartition(3), items)) == want
    # blocks of items, units of few documents, little work at once
    monkeypatch.setattr(strata, "UNIT_DOCS", 4)
    monkeypatch.setattr(strata, "UNIT_TERMS", 150)
    monkeypatch.setattr(strata, "CELLS", 50)
    assert result(strata.search(docs, items, block=3)) == want


def test_an_index_of_all_terms_serves_any_items(spark, texts):
    docs, items = frames(spark, texts)
    index = strata.build(docs)
    assert result(strata.search(docs, items, k=3, index=index)) == plain(*texts, k=3)
    # per unit and term one row, postings by falling tf
    for r in index.postings.where("term IS NOT NULL").limit(200).collect():
        assert r["tfs"] == sorted(set(r["tfs"]), reverse=True) and sum(r["lens"]) == len(r["at"])


def test_bounds_leave_strata_out(spark, texts, monkeypatch):
    docs, _ = frames(spark, texts)
    rare = spark.createDataFrame([(1, "w82 ça w75")], "item_id long, text string")
    index = strata.build(docs, strata.terms_of("w82 ça w75"))
    strata_of_terms = {r["m"] for r in index.postings.select("m").distinct().collect()}
    items = strata.Items([1], [[0, 1, 2]], np.array([9, 9, 9]))
    low, high = (items.bounds(m, np.array([0, 1, 2]), np.array([1, 1, 1]))[0] for m in (max(strata_of_terms), min(strata_of_terms)))
    assert 0 < low < high
    assert result(strata.search(docs, rare, index=index)) == plain(texts[0], [(1, "w82 ça w75")])


def test_empty_tables(spark, texts):
    docs, items = frames(spark, texts)
    assert result(strata.search(docs.where("false"), items)) == []
    assert result(strata.search(docs, items.where("false"))) == []
