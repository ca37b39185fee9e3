"""Quality trees and toxicity neighbours: plain counting, brute-force neighbours, held-out accuracy, odd rows."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity
from tidemark.llm.common import table

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
ODD = [(1, None, "a"), (2, "", "a"), (None, "few words", "b"), (3, "again and again " * 200, "b"), (3, "again and again " * 200, "b"),
       (4, "one two three\nfour five\none two three\n\n \n", "c"), (5, "x" * 300_000, "c"), (6, "ÀÉ ß日本\x1c   #*$", "d")]
SCHEMA = "doc_id long, text string, kept string"
HELD = "crc32(CAST(doc_id AS STRING)) % 3 = 1"


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside)}


@pytest.fixture(scope="module")
def trees(spark):
    return quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels").where(f"NOT {HELD}"))


@pytest.fixture(scope="module")
def index(spark):
    return toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), keep=~F.expr(HELD))


def test_statistics_and_base_rule(spark, trees):
    docs = table(spark, SF, "documents").select("doc_id", "text", F.lit("k").alias("kept")).union(spark.createDataFrame(ODD, SCHEMA))
    texts = docs.select("doc_id", "text").collect()
    found = quality.judge(docs.select("doc_id", "text", "kept"), trees).collect()
    assert len(found) == len(texts)
    want = Counter(str((r.doc_id, *plain_statistics(r.text).values())) for r in texts)
    assert Counter(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_held_out_quality(spark):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    found = (quality.judge(docs, quality.fit(docs, labels.where(f"NOT {HELD}"))).join(labels, "doc_id").where(HELD)
             .where("NOT base_failed").select("quality", "kept").collect())
    assert np.mean([r.kept == bool(r.quality) for r in found]) > 0.99
    assert np.mean([r.kept for r in found if r.quality]) > 0.99


def test_trees_are_monotonic_and_flat(trees):
    rng = np.random.default_rng(0)
    x = rng.random((300, len(quality.FEATURES))) * [8, 10, 3, 1, 1, 1, 1, 1, 80]
    for j, (_, sign) in enumerate(quality.FEATURES):
        if sign:
            higher = x.copy()
            higher[:, j] += rng.random(300) * 2
            assert (sign * (trees.margin(higher) - trees.margin(x)) >= -1e-9).all()
    row = x[0]
    total = trees.base
    for root in trees.roots:
        at = root
        while trees.feature[at] >= 0:
            at = (trees.left if row[trees.feature[at]] <= trees.threshold[at] else trees.right)[at]
        total += trees.value[at]
    assert abs(total - trees.margin(x[:1])[0]) < 1e-9


def test_filters_keep_columns(spark, trees, index):
    docs = spark.createDataFrame(ODD, SCHEMA)
    assert quality.keep_good(docs, trees).columns == docs.columns
    assert quality.keep_good(docs, None).where("doc_id = 3").count() == 0
    assert toxicity.drop_toxic(docs, index).count() == len(ODD)
    for empty in (quality.keep_good(docs.where("false"), trees), toxicity.drop_toxic(docs.where("false"), index)):
        assert empty.count() == 0


def test_no_labels(spark):
    docs, labels = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels) is None
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0.0}
    one_kind = spark.createDataFrame([(3, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, one_kind) is None
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, one_kind)).collect()} == {1.0}


def test_held_out_toxicity(spark, index):
    found = toxicity.score(table(spark, SF, "documents"), index).join(table(spark, SF, "labels"), "doc_id").where(HELD).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert not [r for r in found if r.predicted and not r.toxic][3:]


def test_held_out_toxicity_by_language(spark):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    index = toxicity.fit(docs, labels, keep=~F.expr(HELD))
    known = docs.select("doc_id", "lang").join(labels, "doc_id")
    found = toxicity.score(docs, index).join(known, "doc_id").where(HELD).collect()
    for lang in sorted({r.lang for r in found}):
        toxic = [r.predicted for r in found if r.lang == lang and r.toxic]
        clean = [r.predicted for r in found if r.lang == lang and not r.toxic]
        assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.02, lang
    assert np.mean([r.predicted for r in found if not r.toxic]) <= 0.01
    assert all(r.evidence for r in found)  # every text shares words with some example


def test_every_word_of_an_example_is_a_term(spark):
    rows = [(1, "Vile Überwort once", "k"), (2, "calm rareword here", "k"), (3, None, "k"), (4, "calm rareword here", "k")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0)], "doc_id long, toxic int")
    index = toxicity.fit(spark.createDataFrame(rows, SCHEMA), labels)
    assert {"vile", "überwort", "überw*", "once", "calm", "rareword", "here"} <= set(index.vocabulary)
    assert index.ids == [2, 1] or index.ids == [1, 2]  # equal texts are one example, and the empty one holds no posting
    assert (index.gain > 0).all()


def test_clashing_column_names(spark):
    docs = spark.createDataFrame([(1, "vile words", 0.5, 1, "t")], "doc_id long, text string, score double, label int, `a.b` string")
    index = toxicity.build_index([(1, 1, {0: 1}), (2, 0, {1: 1})], {"vile": 0, "calm": 1}, k=1)
    assert toxicity.score(docs, index).columns == ["doc_id", "score", "predicted", "evidence"]
    kept = toxicity.drop_toxic(docs, index, threshold=2.0)
    assert kept.columns == docs.columns and kept.collect() == docs.collect()


def random_index(seed, n=400, terms=60):
    rng = np.random.default_rng(seed)
    vocabulary = {f"t{chr(97 + i // 26)}{chr(97 + i % 26)}": i for i in range(terms)}
    draw = 1 / np.arange(1, terms + 1)
    examples = []
    for i in range(n):
        counts = Counter(rng.choice(terms, int(rng.integers(0, 9)), p=draw / draw.sum()).tolist())
        examples.append((i, int(rng.random() < 0.1 + 0.8 * (3 in counts)), dict(counts)))
    return toxicity.build_index(examples, vocabulary, block=16, k=7), examples, rng


@pytest.mark.parametrize("seed", range(3))
def test_block_max_neighbours_are_exact(seed):
    index, examples, rng = random_index(seed)
    rows = {e[0]: e[2] for e in examples}
    for _ in range(60):
        counts = {int(t): int(rng.integers(1, 4)) for t in rng.choice(60, 5, replace=False)}
        terms, weights = index.vector(counts)
        mine = dict(zip(terms.tolist(), weights))
        every = []
        for position, i in enumerate(index.ids):
            t, w = index.vector(rows[i])
            s = sum(mine.get(a, 0) * b for a, b in zip(t.tolist(), w))
            if s > 0:
                every.append((-round(s, 12), position))
        every.sort()
        at, score = index.nearest(counts)
        assert at.tolist() == [p for _, p in every[:7]]
        assert np.allclose(score, [-s for s, _ in every[:7]])


def test_scores_are_calibrated():
    index, examples, _ = random_index(9, n=3000)
    score = [index.chance(index.vote(*index.nearest(c, leave_out=index.ids.index(i)))) if c else index.without for i, _, c in examples[:600]]
    y = np.array([label for _, label, _ in examples[:600]])
    assert abs(np.mean(score) - y.mean()) < 0.05
    assert np.mean((np.array(score) - y) ** 2) < y.mean() * (1 - y.mean())
