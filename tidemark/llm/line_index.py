"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at both ends and with A-Z in lower case; keys of at
least ``LEAST`` code points count, known by 128-bit hashes. The index holds, as written tables,

* ``holders``: per document row its distinct keys;
* ``filters``: one cuckoo filter per shard of the keys, with one fingerprint per key in use;
* ``refs``: references per key, in rows that each sum up one batch of documents, added to and never rewritten by inserts;
* ``counts``: the exact number of references and the smallest holder of every key with two or more.

``insert`` streams the new references through the filters. A key the filter doesn't know is settled there: it has one
reference row. Only keys that it may know, from earlier inserts or earlier in the same stream, are counted exactly. A
false alarm of the filter gets its own fingerprint afterwards, so that a later delete can't take another key's. ``delete``
counts the keys of the deleted documents again, takes fingerprints of unused ones out of the filters, and leaves the index
as if the documents had never been there. A very frequent line sends one row per batch of documents to its shard.

Defined results: a null or empty text is one empty line; rows with a null id keep all their lines and take no part;
repeated rows of an id are one document as to which lines go; other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches
from tidemark.llm.cuckoo import Cuckoo
from tidemark.session import written
from tidemark.tables import heavy_join, heavy_keys

LEAST = 10
WHITE = b" \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 50_000
LEAST_SHARDS = 64
PIECE = 1 << 16
REFS = "shard int, key binary, n long, first_doc long, fresh boolean"


def line_keys(text: str | None, least: int = LEAST) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text (UTF-8) and the key of each; None for keys that are too short."""
    lines = (text or "").encode().split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        bare = line.strip(WHITE).lower()
        long_enough = len(bare) >= least and (bare.isascii() or len(bare.decode()) >= least)
        keys.append(xxhash.xxh3_128_digest(bare) if long_enough else None)
    return lines, keys


def _holders(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sorted({k for k in line_keys(t, least)[1] if k}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.binary()))], names=["doc_id", "keys"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, keys array<binary>")


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key[:, 0] >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def _as_numbers(keys: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)


def _combined(holders: DataFrame, shards: int) -> DataFrame:
    """(shard, key, n, first_doc): the references, summed up within each batch of documents."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            if not len(flat):
                continue
            doc = np.repeat(np.asarray(batch.column(0)), np.asarray(lists.value_lengths()))
            raw = np.array(flat.to_pylist(), dtype="V16")
            order = np.lexsort((doc, *np.ascontiguousarray(raw).view(np.uint64).reshape(-1, 2).T))
            raw, doc = raw[order], doc[order]
            pair = raw.view(np.uint64).reshape(-1, 2)
            start = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]).any(axis=1)])
            n = np.diff(np.r_[start, len(raw)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(_shard(pair[start], shards)), pa.array([x.tobytes() for x in raw[start]], pa.binary()),
                 pa.array(n.astype(np.int64)), pa.array(doc[start])], names=["shard", "key", "n", "first_doc"])

    return holders.mapInArrow(run, "shard int, key binary, n long, first_doc long")


def _streamed(rows: DataFrame, filters: DataFrame, bits: int, mode: str) -> DataFrame:
    """Send key rows through the filters of their shards: ``add`` marks keys that may be known and adds the others,
    ``force`` adds all, ``remove`` takes out. Returns the marked rows and, as rows with ``piece``, the filters.

    A task holds one filter at a time; its key rows stream past in Arrow batches."""
    names = ["shard", "piece", "key", "n", "first_doc", "fresh", "seen", "data"]
    fields = "shard int, piece int, key binary, n long, first_doc long, fresh boolean, seen boolean, data binary"
    schema = pa.schema([("shard", pa.int32()), ("piece", pa.int32()), ("key", pa.binary()), ("n", pa.int64()),
                        ("first_doc", pa.int64()), ("fresh", pa.bool_()), ("seen", pa.bool_()), ("data", pa.binary())])

    def pieces(shard: int, known: Cuckoo) -> pa.RecordBatch:
        blob = known.dump()
        cut = [blob[at:at + PIECE] for at in range(0, len(blob), PIECE)]
        size = len(cut)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.int64()),
             pa.nulls(size, pa.int64()), pa.nulls(size, pa.bool_()), pa.nulls(size, pa.bool_()), pa.array(cut, pa.binary())], schema=schema)

    def passed(known: Cuckoo, run: pa.RecordBatch) -> pa.RecordBatch:
        raw = run.column(2).to_pylist()
        keys = _as_numbers(raw)
        if mode == "remove":
            known.remove(keys)
            return run.slice(0, 0)
        back = np.asarray(run.column(2).dictionary_encode().indices)
        first = np.unique(back, return_index=True)[1]
        found = known.contains(keys[first]) if mode == "add" else np.zeros(len(first), dtype=bool)
        known.insert(keys[first[~found]])
        fresh = np.zeros(len(keys), dtype=bool)
        fresh[first[~found]] = True
        seen = ~fresh | (np.asarray(run.column(3)) > 1)
        # a key that comes again in this run: its first row is suspect as well
        seen |= (np.bincount(back, minlength=len(first)) > 1)[back]
        return pa.RecordBatch.from_arrays([run.column(0), run.column(1), run.column(2), run.column(3), run.column(4),
                                           pa.array(fresh), pa.array(seen), run.column(7)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, known = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, schema=schema)
            at, is_key = np.asarray(batch.column(0)), np.asarray(batch.column(1).is_null())
            edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (is_key[1:] != is_key[:-1])])
            for start, end in zip(edges, [*edges[1:], batch.num_rows]):
                part = batch.slice(start, end - start)
                if at[start] != shard:
                    if shard is not None:
                        yield pieces(shard, known if known is not None else Cuckoo.load(b"".join(parts), bits))
                    shard, parts, known = int(at[start]), [], None
                if not is_key[start]:
                    parts.extend(part.column(7).to_pylist())
                    continue
                if known is None:
                    known = Cuckoo.load(b"".join(parts), bits)
                yield passed(known, part)
        if shard is not None:
            yield pieces(shard, known if known is not None else Cuckoo.load(b"".join(parts), bits))

    old = filters.select("shard", "piece", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("n"),
                         F.lit(None).cast("long").alias("first_doc"), F.lit(None).cast("boolean").alias("fresh"),
                         F.lit(None).cast("boolean").alias("seen"), "data")
    new = rows.select("shard", F.lit(None).cast("int").alias("piece"), "key", "n", "first_doc", F.lit(False).alias("fresh"),
                      F.lit(False).alias("seen"), F.lit(None).cast("binary").alias("data"))
    both = old.unionByName(new).select(*names)
    # the pieces of a shard's filter come first and in order, then its keys
    met = both.repartition("shard").sortWithinPartitions("shard", F.col("piece").asc_nulls_last())
    return written(met.mapInArrow(run, fields), f"filters-{mode}")


@dataclass(frozen=True)
class LineIndex:
    """The state after some inserts and deletes; every change gives a new state, the old one stays as it is."""

    holders: DataFrame
    filters: DataFrame
    refs: DataFrame
    counts: DataFrame
    shards: int
    bits: int
    least: int


def empty(spark, bits: int = 32, least: int = LEAST, shards: int = 0) -> LineIndex:
    """``shards=0``: as many as the first insert needs at ``KEYS_PER_SHARD``, or ``LEAST_SHARDS``; filters grow if later inserts bring more."""
    bounded_batches(spark)

    def none(fields: str) -> DataFrame:
        columns = T.StructType.fromDDL(fields).fields
        return spark.range(1).where("false").select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in columns])

    return LineIndex(none("doc_id long, keys array<binary>"), none("shard int, piece int, data binary"), none(REFS),
                     none("shard int, key binary, n long, first_doc long"), shards, bits, least)


def _split(streamed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return streamed.where("piece IS NULL"), streamed.where("piece IS NOT NULL").select("shard", "piece", "data")


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """Add documents with ids that the index doesn't hold yet."""
    new = written(_holders(docs, id_col, text_col, index.least), "line-holders")
    shards = index.shards or max(LEAST_SHARDS, -(-(new.agg(F.sum(F.size("keys"))).first()[0] or 0) // KEYS_PER_SHARD))
    batch, filters = _split(_streamed(_combined(new, shards), index.filters, index.bits, "add"))
    refs = index.refs.unionByName(batch.select("shard", "key", "n", "first_doc", "fresh"))
    suspects = batch.where("seen").select("key").distinct()
    # at most one row per key and batch of documents comes here, and only of keys the filters named
    exact = written(refs.join(suspects, "key", "left_semi").groupBy("shard", "key").agg(
        F.sum("n").alias("n"), F.min("first_doc").alias("first_doc"), F.bool_or("fresh").alias("covered")), "exact-counts")
    false_alarms = written(exact.where("NOT covered").select("shard", "key", F.lit(0).cast("long").alias("n"),
                                                             F.lit(None).cast("long").alias("first_doc")), "false-alarms")
    if not false_alarms.isEmpty():
        forced, filters = _split(_streamed(false_alarms, filters, index.bits, "force"))
        refs = refs.unionByName(forced.select("shard", "key", "n", "first_doc", "fresh"))
    counts = (index.counts.join(exact.select("key"), "key", "left_anti").select("shard", "key", "n", "first_doc")
              .unionByName(exact.where("n >= 2").select("shard", "key", "n", "first_doc")))
    return replace(index, holders=index.holders.unionByName(new), filters=filters, refs=refs,
                   counts=written(counts, "line-counts"), shards=shards)


def delete(index: LineIndex, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """Take out the documents ``ids``; ids that the index doesn't hold change nothing."""
    if not index.shards:
        return index
    ids = ids.select(F.col(id_col).cast("long").alias("doc_id")).dropna().distinct()
    gone = written(index.holders.join(ids, "doc_id", "left_semi"), "deleted-holders")
    holders = written(index.holders.join(ids, "doc_id", "left_anti"), "line-holders")
    touched = written(_combined(gone, index.shards).groupBy("shard", "key").agg(F.sum("n").alias("gone")), "touched-keys")
    pairs = written(holders.select("doc_id", F.explode("keys").alias("key")), "line-pairs")
    left = heavy_join(pairs, touched, ["key"], heavy_keys(pairs, ["key"]))
    exact = written(left.groupBy("shard", "key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")), "exact-counts")
    unused = touched.join(exact, "key", "left_anti").select("shard", "key", F.lit(0).cast("long").alias("n"),
                                                            F.lit(None).cast("long").alias("first_doc"))
    _, filters = _split(_streamed(unused, index.filters, index.bits, "remove"))
    kept = index.refs.join(touched, "key", "left_anti").select("shard", "key", "n", "first_doc", "fresh")
    refs = kept.unionByName(exact.select("shard", "key", "n", "first_doc", F.lit(True).alias("fresh")))
    counts = (index.counts.join(touched, "key", "left_anti").select("shard", "key", "n", "first_doc")
              .unionByName(exact.where("n >= 2").select("shard", "key", "n", "first_doc")))
    return replace(index, holders=holders, filters=filters, refs=written(refs, "line-refs"), counts=written(counts, "line-counts"))


def _later_lines(index: LineIndex) -> DataFrame:
    """(doc_id, keys): per document the keys that a document with a smaller id holds as well."""
    pairs = written(index.holders.select("doc_id", F.explode("keys").alias("key")), "line-pairs")
    shared = index.counts.select("key", "first_doc")
    met = heavy_join(pairs, shared, ["key"], heavy_keys(pairs, ["key"])).where("first_doc < doc_id")
    return met.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def kept_texts(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every row's text without the lines that belong to an earlier document."""
    return _rewritten(index, docs, id_col, text_col, "kept string", lambda kept: pa.array([b.decode() for b in kept], pa.string()))


def kept_digests(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256): the same with the kept text's SHA-256 in its place."""
    return _rewritten(index, docs, id_col, text_col, "kept_sha256 string",
                      lambda kept: pa.array([hashlib.sha256(b).hexdigest() for b in kept], pa.string()))


def _rewritten(index: LineIndex, docs: DataFrame, id_col: str, text_col: str, last: str, make) -> DataFrame:
    least = index.least

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, kept = [], [], []
            for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines, keys = line_keys(text, least) if drop else ((text or "").encode().split(b"\n"), [])
                gone = set(drop or ())
                stay = [line for line, key in zip(lines, keys) if key not in gone] if drop else lines
                total.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()),
                                              make(kept)], names=["doc_id", "n_lines", "n_dropped", last.split()[0]])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = rows.where("doc_id IS NOT NULL").join(_later_lines(index), "doc_id", "left").select("doc_id", "text", "keys")
    unnamed = rows.where("doc_id IS NULL").withColumn("keys", F.lit(None).cast("array<binary>"))
    return named.unionByName(unnamed).mapInArrow(run, f"doc_id long, n_lines long, n_dropped long, {last}")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index all of ``docs`` and give the digests of what stays of them."""
    return kept_digests(insert(empty(docs.sparkSession), docs, id_col, text_col), docs, id_col, text_col)
