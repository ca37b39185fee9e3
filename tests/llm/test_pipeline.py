"""The pipeline's stages, one after another, against their rules."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import queries, simhash
from tidemark.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents")
    kept = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept.append((name, docs))
    return dict(kept)


def test_stages_keep_columns_and_only_drop(stages):
    names = list(stages)
    for before, after in zip(names, names[1:-1]):
        assert stages[after].columns == stages["documents"].columns
        assert 0 < stages[after].count() <= stages[before].count()
        assert stages[after].join(stages[before], "doc_id", "left_anti").isEmpty()
    assert stages["personal_data"].count() == stages["near_copies"].count()


def test_rejected_documents_are_bad(stages, spark):
    gone = stages["documents"].join(stages["quality"], "doc_id", "left_anti")
    labels = table(spark, SF, "labels")
    long_enough = gone.where(F.size(F.split("text", r"\s+")) >= 50).join(labels, "doc_id")
    assert long_enough.where("quality = 0").count() >= 0.8 * long_enough.count()
    toxic = stages["quality"].join(stages["toxicity"], "doc_id", "left_anti").join(labels, "doc_id")
    assert toxic.where("toxic = 1").count() >= 0.8 * toxic.count()


def test_near_copies_stage_is_exact(stages):
    before, after = stages["toxicity"], {r.doc_id for r in stages["near_copies"].collect()}
    assert after == {r.component_id for r in simhash.near_copies(before).collect()}


def test_nothing_personal_is_left(stages):
    pattern = re.compile(r"[a-z]+\.\d+@\S+\.com|(?<!\d)\d{16}(?!\d)|\+1 \(\d{3}\) \d{3}-\d{4}")
    before = {v for r in stages["near_copies"].collect() for v in pattern.findall(r.text)}
    after = {v for r in stages["personal_data"].collect() for v in pattern.findall(r.text)}
    assert before and len(after) == len(before) and not before & after


def test_packing_is_whole(stages):
    rows = stages["packing"].collect()
    docs = {r.doc_id for r in stages["personal_data"].collect()}
    assert {r.doc_id for r in rows} == docs
    assert len({r.sequence_id for r in rows}) <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_run_is_the_stages(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert {tuple(r) for r in found.select(*key).collect()} == {tuple(r) for r in stages["packing"].select(*key).collect()}


def test_every_operator_has_its_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14))
