"""Tables the jobs keep: chunks, import ledger, extraction cache, traces, graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import predicate_of
from tidemark.session import written
from tidemark.sources import manifest

LEDGER = "hash string, path string, imported_at timestamp"
CHUNKS = "id string, content string, keywords array<string>, source string, page int, chunk_index int, chunk_type string"


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, or no rows if it is not there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def new_files(files: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Files whose content hash the ledger does not have; equal files count once."""
    if force:
        return files
    return files.join(ledger.select("hash"), "hash", "left_anti").select(*files.columns)


def mark_imported(files: DataFrame, ledger_path: str) -> None:
    files.select("hash", "path", F.current_timestamp().alias("imported_at")).write.mode("append").parquet(ledger_path)


BUCKETS = 64


def _stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    return manifest.read(spark, path, "chunks", f"{CHUNKS}, hash string, bucket int")


def write_chunks(chunks: DataFrame, path: str, keep_keywords: int = 10, files: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Add the chunks that the store does not have yet and, in the same commit, the ``files`` (hash, path) they come from.

    A chunk is known by its id and the hash of its whole content: the id alone has eight digits of it, which different chunks
    of one place may share. Rows lie in buckets of their id with their hash, so that only the names in the buckets that the
    new chunks fall into are read. Returns the version; a store that another writer has changed meanwhile raises
    ``manifest.Conflict`` and is as it was."""
    spark = chunks.sparkSession
    base = manifest.current(spark, path)[0]
    rows = chunks.withColumn("keywords", F.slice("keywords", 1, keep_keywords)).withColumn("hash", F.unhex(F.sha2("content", 256)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).dropDuplicates(["id", "hash"])
    new = rows = written(rows, "new-chunks", "zstd")
    if manifest.commits(spark, path, "chunks"):
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        have = _stored_chunks(spark, path).where(F.col("bucket").isin(touched)).select("id", F.unhex("hash").alias("hash"))
        # names alone meet the stored ones; texts do where some, but not all, of them are there already
        names = written(rows.select("id", "hash").join(have, ["id", "hash"], "left_anti"), "new-names")
        found = names.count()
        if not found:
            new = rows.where(F.lit(False))
        elif found < rows.count():
            new = rows.join(names, ["id", "hash"], "left_semi")
    # the hash is as long again in hexadecimal: it gets so behind the shuffle
    new = new.select(*chunks.columns, "hash", "bucket").repartition("bucket").withColumn("hash", F.lower(F.hex("hash")))
    added = {"chunks": manifest.stage(new, path, "chunks", "bucket")}
    if files is not None:
        imported = files.select("hash", "path", F.current_timestamp().alias("imported_at"))
        added["ledger"] = manifest.stage(imported, path, "ledger")
    return manifest.publish(spark, path, base, added)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return _stored_chunks(spark, path).drop("hash", "bucket")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The imported files of a chunk store."""
    return manifest.read(spark, path, "ledger", LEDGER)


CACHE = "chunk_id string, schema_version int, source string, payload string"


def write_extraction_cache(rows: DataFrame, path: str) -> None:
    """Append successful results (chunk_id, schema_version, source, payload)."""
    rows.where("source <> 'fallback'").write.mode("append").partitionBy("schema_version").parquet(path)


def read_extraction_cache(spark: SparkSession, path: str, version: int = 2) -> DataFrame:
    """Rows that count as hits: this version (one partition is read), not from the fallback."""
    rows = read_or_empty(spark, path, CACHE)
    return rows.where((F.col("schema_version") == version) & (F.col("source") != "fallback"))


def cache_split(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with payload, misses) of ``chunks(id, …)``."""
    keyed = cache.select(F.col("chunk_id").alias("id"), "payload")
    return chunks.join(keyed, "id"), chunks.join(keyed, "id", "left_anti")


def without_cached(cache: DataFrame, chunk_id: str | None = None) -> DataFrame:
    """The cache without one entry, or without any."""
    return cache.where(F.lit(False)) if chunk_id is None else cache.where(F.col("chunk_id") != chunk_id)


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("total"),
                     F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("size_bytes"))


def write_traces(spans: DataFrame, index: DataFrame, path: str, buckets: int = 64) -> None:
    """Spans in a fixed number of hash buckets, sorted by trace, and the index. A reader of one trace prunes to its
    bucket and, by the files' statistics, to its row groups; a huge trace is spread over several files."""
    bucket = F.pmod(F.xxhash64("trace_id"), F.lit(buckets)).cast("int")
    (spans.withColumn("bucket", bucket).repartitionByRange("bucket", "trace_id", "start_time")
     .sortWithinPartitions("bucket", "trace_id", "start_time").write.mode("append").partitionBy("bucket").parquet(f"{path}/spans"))
    index.write.mode("append").parquet(f"{path}/index")


def read_trace(spark: SparkSession, path: str, trace_id: str, buckets: int = 64) -> DataFrame:
    """The spans of one trace: one bucket is read, with the id pushed to its files."""
    bucket = F.pmod(F.xxhash64(F.lit(trace_id)), F.lit(buckets)).cast("int")
    return spark.read.parquet(f"{path}/spans").where((F.col("bucket") == bucket) & (F.col("trace_id") == trace_id)).drop("bucket")


def write_events_json(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, form: str = "parquet") -> None:
    """Nodes by entity type and edges by predicate, so that readers of one kind prune the rest."""
    nodes.write.mode("overwrite").partitionBy("entity_type").format(form).save(f"{path}/nodes")
    (edges.withColumn("predicate", predicate_of("keywords")).write.mode("overwrite")
     .partitionBy("predicate").format(form).save(f"{path}/edges"))


GRAPHML_KEYS = (("d0", "node", "entity_type"), ("d1", "node", "description"), ("d2", "node", "source_id"),
                ("d3", "edge", "keywords"), ("d4", "edge", "description"), ("d5", "edge", "weight"), ("d6", "edge", "source_id"))


def _as_documents(head: str, tail: str, elements: int):
    """Rows with a head before and a tail behind every ``elements`` of them; without rows, an empty document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = 0  # in the document that was begun last
        yield pd.DataFrame({"value": [head]})
        for batch in batches:
            at = 0
            while at < len(batch):
                if held == elements:
                    yield pd.DataFrame({"value": [tail, head]})
                    held = 0
                piece = batch.iloc[at:at + elements - held]
                yield piece
                at, held = at + len(piece), held + len(piece)
        yield pd.DataFrame({"value": [tail]})
    return run


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, elements: int = 50_000, compression: str | None = None) -> None:
    """The graph as GraphML. Every part file is a whole document of its own with at most ``elements`` nodes and edges, so the
    parts are written and read in parallel: a task reads a file of XML whole, however large it is. As text a graph takes many
    times the room of its tables; with ``compression`` gzip, which readers tell by the files' names, it doesn't."""
    def escaped(column):
        text = F.coalesce(F.col(column).cast("string"), F.lit(""))
        for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(raw), F.lit(entity))
        return text

    def element(df, kind, tag, *attributes):
        opening = [piece for name, column in attributes for piece in (F.lit(f' {name}="'), escaped(column), F.lit('"'))]
        data = [piece for key, owner, column in GRAPHML_KEYS if owner == kind and column in df.columns
                for piece in (F.lit(f'<data key="{key}">'), escaped(column), F.lit("</data>"))]
        return df.select(F.concat(F.lit(f"<{tag}"), *opening, F.lit(">"), *data, F.lit(f"</{tag}>")).alias("value"))
    keys = "".join(f'<key id="{k}" for="{owner}" attr.name="{name}" attr.type="{"double" if name == "weight" else "string"}"/>'
                   for k, owner, name in GRAPHML_KEYS)
    head = ("<?xml version='1.0' encoding='utf-8'?>\n<graphml xmlns=\"http://graphml.graphdrawing.org/xmlns\">"
            f'{keys}<graph edgedefault="directed">')
    rows = element(nodes, "node", "node", ("id", "name")).unionByName(
        element(edges, "edge", "edge", ("source", "src"), ("target", "tgt")))
    documents = rows.mapInPandas(_as_documents(head, "</graph></graphml>", elements), "value string")
    # a file ends where its document does
    documents.write.mode("overwrite").option("maxRecordsPerFile", elements + 2).text(path, compression=compression)


def import_summary(files: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): files, chunks by type, entities, relations and distinct sources."""
    none = F.lit(None).cast("string").alias("kind")

    def total(df, what):
        return df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), none, "n")
    rows = total(files, "files").unionByName(total(chunks, "chunks"))
    rows = rows.unionByName(chunks.groupBy(F.col("chunk_type").alias("kind")).agg(F.count("*").alias("n"))
                            .select(F.lit("chunk_type").alias("what"), "kind", "n"))
    rows = rows.unionByName(total(nodes, "entities")).unionByName(total(edges, "relations"))
    return rows.unionByName(total(chunks.select("source").distinct(), "sources"))
