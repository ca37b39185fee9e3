"""Keyword search through the stored index against a plain version."""

import re

import numpy as np
import pytest

from tidemark.operators import lexical


def words(text):
    return set(re.findall(r"[a-z0-9_]{2,}", text or ""))


def plain(questions, chunks, k, min_score=1):
    out = []
    for q, text in questions:
        scored = [(-len(words(text) & words(c)), p, n) for n, c, p in chunks]
        out += [(q, n, -s, r) for r, (s, p, n) in enumerate(sorted(x for x in scored if -x[0] >= min_score)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(150)]
    share = 1 / np.arange(1, 151)
    place = rng.permutation(400)
    chunks = [(f"c{i}", " ".join(rng.choice(vocabulary, int(rng.integers(0, 40)), p=share / share.sum())), int(place[i])) for i in range(398)]
    chunks += [("c398", None, int(place[398])), ("c399", "w1 " * 3000, int(place[399]))]
    questions = [(i, " ".join(rng.choice(vocabulary, 8))) for i in range(40)] + [(90, "w0 w1"), (91, "unknown"), (92, ""), (93, None)]
    return questions, chunks


@pytest.fixture
def small_batches(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "17")
    yield
    spark.conf.set(setting, before)


def frames(spark, texts):
    return (spark.createDataFrame(texts[0], "query_id long, text string"),
            spark.createDataFrame(texts[1], "chunk_id string, content string, position long").repartition(3))


def result(df):
    assert df.columns == ["query_id", "chunk_id", "score", "rank"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("per_pass,cells", [(1024, 2_000_000), (7, 30)])
def test_against_a_plain_version(spark, texts, small_batches, monkeypatch, per_pass, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    questions, chunks = frames(spark, texts)
    assert result(lexical.keyword_search(questions, chunks, 5, per_pass=per_pass)) == plain(*texts, 5)
    assert result(lexical.keyword_search(questions, chunks, 2, min_score=3, per_pass=per_pass)) == plain(*texts, 2, 3)


def test_a_stored_index_reads_the_folders_of_the_words(spark, texts, tmp_path):
    questions, chunks = frames(spark, texts)
    lexical.build_keyword_index(chunks, str(tmp_path / "index"))
    index = lexical.read_keyword_index(spark, str(tmp_path / "index"))
    assert result(lexical.search_index(questions, index, 5)) == plain(*texts, 5)
    read = index.of_words(["w3", "w77"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[part#\d+ (?:INSET|IN) \(?([\d, ]+)", plan.replace("isnotnull(part#", "("))
    assert filters and len(filters.group(1).split(",")) <= 2
    assert {r["code"] for r in read.collect()} == {0, 1}


def test_empty_tables(spark, texts):
    questions, chunks = frames(spark, texts)
    assert result(lexical.keyword_search(questions.where("false"), chunks)) == []
    assert result(lexical.keyword_search(questions, chunks.where("false"))) == []
