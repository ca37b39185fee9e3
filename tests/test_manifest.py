"""Chunk store and ledger change together or not at all."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.chunking import chunk_text
from tidemark.sources import manifest, stores


def texts(spark, *names):
    return spark.createDataFrame([(n, f"text of {n}\nsecond line", n) for n in names], "source string, text string, path string").withColumn(
        "hash", F.md5(F.encode("text", "UTF-8")))


def add(spark, store, docs):
    return stores.write_chunks(chunk_text(docs.select("source", "text")), store, files=docs)


def state(spark, store):
    return (sorted(r["source"] for r in stores.read_chunks(spark, store).collect()),
            sorted(r["path"] for r in stores.read_ledger(spark, store).collect()))


def test_chunks_and_ledger_are_published_together(spark, tmp_path):
    store = str(tmp_path / "store")
    assert state(spark, store) == ([], [])
    assert add(spark, store, texts(spark, "a", "b")) == 1
    assert add(spark, store, texts(spark, "b", "c")) == 2
    assert state(spark, store) == (["a", "b", "c"], ["a", "b", "b", "c"])
    fresh = stores.new_files(texts(spark, "c", "d"), stores.read_ledger(spark, store))
    assert [r["path"] for r in fresh.collect()] == ["d"]


@pytest.mark.parametrize("where", ["ledger", "publish"])
def test_a_crash_on_the_way_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch, where):
    store = str(tmp_path / "store")
    add(spark, store, texts(spark, "a"))
    before = state(spark, store)

    def stage(rows, path, table, *rest):
        if table == where:
            raise OSError("lost")
        return staged(rows, path, table, *rest)

    def publish(*args):
        raise OSError("lost")

    staged = manifest.stage
    with monkeypatch.context() as broken:
        broken.setattr(manifest, "stage", stage)
        if where == "publish":
            broken.setattr(manifest, "publish", publish)
        with pytest.raises(OSError):
            add(spark, store, texts(spark, "b"))
    assert state(spark, store) == before
    add(spark, store, texts(spark, "b"))  # once more, after the crash
    assert state(spark, store) == (["a", "b"], ["a", "b"])


def test_of_two_writers_one_has_to_begin_again(spark, tmp_path):
    store = str(tmp_path / "store")
    add(spark, store, texts(spark, "a"))
    base = manifest.current(spark, store)[0]
    mine = manifest.stage(texts(spark, "x").select("hash", "path", F.current_timestamp().alias("imported_at")), store, "ledger")
    add(spark, store, texts(spark, "b"))
    with pytest.raises(manifest.Conflict):
        manifest.publish(spark, store, base, {"ledger": mine})
    # a manifest that comes up between the look and the rename isn't overwritten
    (tmp_path / "store" / "manifests" / f"{base + 2:012d}.json").write_text("{}")
    known = manifest.current
    try:
        manifest.current = lambda *a: (base + 1, {})
        with pytest.raises(manifest.Conflict):
            manifest.publish(spark, store, base + 1, {"ledger": mine})
    finally:
        manifest.current = known
    assert not [f for f in (tmp_path / "store" / "manifests").iterdir() if f.name.startswith("_")]


def test_only_the_buckets_of_new_chunks_are_read(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    add(spark, store, texts(spark, *[f"s{n}" for n in range(200)]))
    seen = []
    read = manifest.read

    def spied(*args):
        df = read(*args)
        if args[2] == "chunks":
            seen.append(df)
        return df

    monkeypatch.setattr(manifest, "read", spied)
    add(spark, store, texts(spark, "s7", "new"))
    assert len(seen) == 1
    buckets = {r["bucket"] for r in chunk_text(texts(spark, "s7", "new").select("source", "text"))
               .select(F.pmod(F.xxhash64("id"), F.lit(stores.BUCKETS)).alias("bucket")).collect()}
    assert len(buckets) <= 2
    plan = seen[0].where(F.col("bucket").isin(list(buckets))).select("id", "hash")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "content" not in text.split("ReadSchema")[1]
    assert len(state(spark, store)[0]) == 201


def test_columns_may_be_added(spark, tmp_path):
    store = str(tmp_path / "store")
    add(spark, store, texts(spark, "a"))
    more = chunk_text(texts(spark, "b").select("source", "text")).withColumn("parser", F.lit("plain"))
    stores.write_chunks(more, store)
    assert {(r["source"], r["parser"]) for r in stores.read_chunks(spark, store).collect()} == {("a", None), ("b", "plain")}
