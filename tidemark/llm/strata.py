"""Ranked lexical search over a length-stratified index.

Documents of equal normaliser ``m`` form a stratum; a stratum larger than ``UNIT_TERMS`` terms or ``UNIT_DOCS`` documents
is kept in several units. Within a unit every term has one row with its postings by tf, highest first; so the impact
``(10^9 tf) div (1000 tf + 8 m)`` is computed once per tf of a row, and a row's first tf bounds what the term can add there.

``search`` answers a bounded block of items at a time: the bounds of all strata give each item's most promising strata,
these are scored first, and their k-th best score is the threshold below which no other stratum of the item is visited.
Scores are exact.

Defined results: a null or empty text has no terms; rows of documents or items with a null id take no part; documents with
equal ids are ranked one by one, items with equal ids are one item with the terms of all its rows; other columns are
ignored; empty tables give no rows."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches
from tidemark.session import written
from tidemark.tables import top_per_group

UNIT_TERMS = 1_000_000
UNIT_DOCS = 16_384
ITEM_BLOCK = 2_000
SEED_STRATA = 2
#: scores and postings worked on at once in a task
CELLS = 2_000_000

#: every ASCII character but letters and digits separates; A-Z become lower case
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or "").encode().translate(_TERM_BYTES).split()


@dataclass(frozen=True)
class StrataIndex:
    """``postings(m, unit, term, tfs, lens, at, ids)``: per unit a row without a term whose ``ids`` are its documents in
    order, and per term a row: ``lens[i]`` documents, numbered as in ``ids``, hold it ``tfs[i]`` times."""

    postings: DataFrame
    docs: int


def _lengths(docs: DataFrame) -> DataFrame:
    """(n, docs): how many documents have n terms."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, docs = np.unique([len(terms_of(t)) for t in batch.column(0).to_pylist()], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(docs)], names=["n", "docs"])

    return docs.select("text").mapInArrow(run, "n long, docs long").where("n > 0").groupBy("n").agg(F.sum("docs").alias("docs"))


def _normaliser(n, docs: int, terms: int):
    return 100 - 90 + (90 * n * docs) // terms


def build(docs: DataFrame, vocabulary: list[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> StrataIndex:
    """Index every document; with a ``vocabulary`` (bounded: it travels to all tasks) only these terms get postings."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lengths = written(_lengths(rows), "doc-lengths")
    total = lengths.agg(F.sum("docs").alias("docs"), F.sum(F.col("n") * F.col("docs")).alias("terms")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    wanted = pa.array(vocabulary, pa.binary()) if vocabulary is not None else None

    def forward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document m, its different terms, and how often each occurs."""
        seed = 0
        for batch in batches:
            lists = [terms_of(t) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in lists], dtype=np.int64)
            flat = pa.array([t for x in lists for t in x], pa.binary()).dictionary_encode()
            names, code = flat.dictionary, np.asarray(flat.indices).astype(np.int64)
            doc = np.repeat(np.arange(len(lists)), sizes)
            if wanted is not None:
                known = np.asarray(pc.is_in(names, value_set=wanted))
                code, doc = code[known[code]], doc[known[code]]
            pair, tf = np.unique(doc * max(1, len(names)) + code, return_counts=True)
            doc, code = np.divmod(pair, max(1, len(names)))
            some = np.flatnonzero(sizes)
            start, end = np.searchsorted(doc, some), np.searchsorted(doc, some, side="right")
            keep = end > start
            some, start, end = some[keep], start[keep], end[keep]
            offsets = pa.array(np.r_[start, end[-1:]] if len(some) else np.zeros(1), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([_normaliser(int(n), n_docs, n_terms) for n in sizes[some]], pa.int64()), pa.array(seed + some, pa.int64()),
                 batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(offsets, names.take(pa.array(code))),
                 pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], names=["m", "seed", "doc_id", "terms", "tfs"])
            seed += len(lists)

    def invert(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by([("doc_id", "ascending"), ("seed", "ascending")]).combine_chunks()
        lists = unit.column("terms").combine_chunks()
        flat = lists.flatten().dictionary_encode()
        code, tf = np.asarray(flat.indices), np.asarray(unit.column("tfs").combine_chunks().flatten())
        doc = np.repeat(np.arange(unit.num_rows, dtype=np.int32), np.asarray(lists.value_lengths()))
        order = np.lexsort((doc, -tf, code))
        code, tf, doc = code[order], tf[order], doc[order]
        new_term = np.r_[True, code[1:] != code[:-1]]
        step = np.flatnonzero(new_term | np.r_[True, tf[1:] != tf[:-1]])
        lens = np.diff(np.r_[step, len(tf)]).astype(np.int32)
        first = np.flatnonzero(new_term)
        by_step = pa.array(np.r_[np.searchsorted(step, first), len(step)], pa.int32())
        by_doc = pa.array(np.r_[first, len(doc)], pa.int32())
        size = 1 + len(first)
        none = pa.nulls(1, pa.list_(pa.int32()))

        def with_head(values: pa.Array) -> pa.ChunkedArray:
            return pa.chunked_array([none, values])

        return pa.table({
            "m": pa.array(np.full(size, unit.column("m")[0].as_py())), "unit": pa.array(np.full(size, unit.column("unit")[0].as_py(), np.int32)),
            "term": pa.chunked_array([pa.nulls(1, pa.binary()), flat.dictionary.take(pa.array(code[first]))]),
            "tfs": with_head(pa.ListArray.from_arrays(by_step, pa.array(tf[step].astype(np.int32)))),
            "lens": with_head(pa.ListArray.from_arrays(by_step, pa.array(lens))),
            "at": with_head(pa.ListArray.from_arrays(by_doc, pa.array(doc))),
            "ids": pa.chunked_array([pa.array([unit.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                                     pa.nulls(size - 1, pa.list_(pa.int64()))])})

    m = F.expr(f"100 - 90 + (90 * n * {n_docs}L) div {n_terms or 1}L").alias("m")
    units = (lengths.groupBy(m).agg(F.ceil(F.greatest(F.sum(F.col("n") * F.col("docs")) / UNIT_TERMS, F.sum("docs") / UNIT_DOCS))
                                    .cast("int").alias("units")))
    # one row per length of text that has so many documents; the number of lengths is bounded by the longest text
    crowded = F.broadcast(written(units.where("units > 1"), "crowded-strata"))
    by_doc = rows.mapInArrow(forward, "m long, seed long, doc_id long, terms array<binary>, tfs array<int>")
    dealt = by_doc.join(crowded, "m", "left").select(
        "m", F.pmod(F.xxhash64("doc_id", "seed"), F.coalesce("units", F.lit(1))).cast("int").alias("unit"), "doc_id", "seed", "terms", "tfs")
    postings = dealt.groupBy("m", "unit").applyInArrow(
        invert, "m long, unit int, term binary, tfs array<int>, lens array<int>, at array<int>, ids array<long>")
    return StrataIndex(written(postings, "strata"), n_docs)


class Items:
    """A block of items as arrays: which terms each has, by number in the block's vocabulary, and the terms' weights."""

    def __init__(self, ids: list[int], codes: list[list[int]], weights: np.ndarray):
        self.ids = ids
        self.start = np.cumsum([0] + [len(c) for c in codes])[:-1]
        self.end = np.cumsum([len(c) for c in codes])
        self.codes = np.array([c for x in codes for c in x], dtype=np.int64)
        self.weights = weights
        self.item_weights = weights[self.codes]

    def bounds(self, m: int, codes: np.ndarray, top_tf: np.ndarray) -> np.ndarray:
        """Per item the highest score that a document of stratum ``m`` can have if no term occurs more often than its ``top_tf``."""
        most = np.zeros(len(self.weights), dtype=np.int64)
        most[codes] = impact(top_tf, m)
        return np.add.reduceat(self.item_weights * most[self.codes], self.start)


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _best(score: np.ndarray, least: int, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores from ``least`` on, of equal ones the first positions."""
    at = np.flatnonzero(score >= max(least, 1))
    if len(at) > k:
        cut = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= cut]
    return at[np.lexsort((at, -score[at]))][:k]


def _visits(items: Items, k: int, floor: np.ndarray, only: dict[int, np.ndarray] | None):
    """Units stream past, each a head row and its terms; visit the items that may find one of their k best there."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = floor.copy()
        best: dict[int, list[tuple[int, int]]] = {}
        head: tuple[int, int] | None = None
        ids: np.ndarray | None = None
        parts: list[tuple[np.ndarray, ...]] = []

        def visit() -> None:
            if ids is None or not parts:
                return
            m = head[0]
            codes, steps, postings, tfs, lens, at = (np.concatenate(x) for x in zip(*parts))
            bound = items.bounds(m, codes, tfs[np.cumsum(steps) - steps])
            asked = np.arange(len(items.ids)) if only is None else only.get(m, np.zeros(0, dtype=np.int64))
            asked = asked[bound[asked] >= np.maximum(least[asked], 1)]
            if not len(asked):
                return
            gain = np.repeat(impact(tfs, m), lens)
            start = np.cumsum(postings) - postings
            rows = np.full(len(items.weights), -1, dtype=np.int64)
            rows[codes] = np.arange(len(codes))
            # (item, row) pairs of the items' terms that occur here, item by item
            n_terms = items.end[asked] - items.start[asked]
            spot = _ranges(items.start[asked], n_terms)
            who, row = np.repeat(np.arange(len(asked)), n_terms), rows[items.codes[spot]]
            who, weight, row = who[row >= 0], items.item_weights[spot][row >= 0], row[row >= 0]
            work = np.bincount(who, weights=postings[row], minlength=len(asked)) + len(ids)
            for first, last in _cuts(work, CELLS):
                pick = slice(np.searchsorted(who, first), np.searchsorted(who, last))
                n = postings[row[pick]]
                spot = _ranges(start[row[pick]], n)
                score = np.zeros((last - first) * len(ids), dtype=np.int64)
                np.add.at(score, np.repeat((who[pick] - first) * len(ids), n) + at[spot], np.repeat(weight[pick], n) * gain[spot])
                for i, mine in zip(asked[first:last].tolist(), score.reshape(last - first, -1)):
                    found = _best(mine, int(least[i]), k)
                    if len(found):
                        best[i] = sorted(best.get(i, []) + list(zip((-mine[found]).tolist(), ids[found].tolist())))[:k]
                        if len(best[i]) == k:
                            least[i] = max(least[i], -best[i][-1][0])

        for batch in batches:
            if not batch.num_rows:
                continue
            m, unit, code = (np.asarray(batch.column(c)) for c in range(3))
            (o3, tfs), (o4, lens), (o5, at), (o6, docs) = (
                (np.asarray(batch.column(c).offsets), np.asarray(batch.column(c).values)) for c in range(3, 7))
            edges = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (unit[1:] != unit[:-1])])
            for a, b in zip(edges, [*edges[1:], batch.num_rows]):
                if (m[a], unit[a]) != head:
                    visit()
                    head, ids, parts = (int(m[a]), int(unit[a])), None, []
                if code[a] < 0:
                    ids = docs[o6[a]:o6[a + 1]].copy()
                    a += 1
                if a < b:
                    parts.append((code[a:b].copy(), np.diff(o3[a:b + 1]), np.diff(o5[a:b + 1]), tfs[o3[a]:o3[b]].copy(),
                                  lens[o4[a]:o4[b]].copy(), at[o5[a]:o5[b]].copy()))
        visit()
        found = [(items.ids[i], doc, -minus) for i, hits in best.items() for minus, doc in hits]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["item_id", "doc_id", "score"])

    return run


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ..."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _cuts(work: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive stretches whose work sums to about ``most``, of one item at least."""
    block = (np.cumsum(work) // most).astype(np.int64)
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    return list(zip(first.tolist(), [*first[1:].tolist(), len(work)]))


def _strata_bounds(items: Items):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        m = key[0].as_py()
        bound = items.bounds(m, rows.column("code").to_numpy(), rows.column("top_tf").to_numpy())
        hit = np.flatnonzero(bound > 0)
        return pa.table({"item": pa.array(hit), "m": pa.array(np.full(len(hit), m)), "bound": pa.array(bound[hit])})

    return run


def search_block(index: StrataIndex, asked: dict[int, set[bytes]], k: int) -> DataFrame:
    """(item_id, doc_id, score): at least the k best documents of each of a block of items, found in two rounds."""
    spark = index.postings.sparkSession
    vocabulary = sorted(set().union(*asked.values()))
    number = {t: c for c, t in enumerate(vocabulary)}
    codes = spark.createDataFrame(pa.table({"term": pa.array(vocabulary, pa.binary()), "code": pa.array(range(len(vocabulary)), pa.int32())}))
    rows = index.postings.join(F.broadcast(codes), "term", "left").where("term IS NULL OR code IS NOT NULL")
    # the head of a unit (no term) has the number -1
    rows = rows.select("m", "unit", F.coalesce("code", F.lit(-1)).alias("code"), "tfs", "lens", "at", "ids")
    df = dict(rows.where("code >= 0").groupBy("code").agg(F.sum(F.size("at")).alias("df")).collect())
    weights = np.array([math.floor(1000 * math.log((2 * index.docs + 2) / (2 * df.get(c, 0) + 1))) for c in range(len(vocabulary))], dtype=np.int64)
    items = Items(list(asked), [sorted(number[t] for t in ts) for ts in asked.values()], weights)
    tops = rows.where("code >= 0").groupBy("m", "code").agg(F.max(F.element_at("tfs", 1)).alias("top_tf"))
    bounds = tops.groupBy("m").applyInArrow(_strata_bounds(items), "item long, m long, bound long")
    seeds: dict[int, list[int]] = {}
    for seed in top_per_group(bounds, ["item"], [F.desc("bound"), F.asc("m")], SEED_STRATA).select("m", "item").collect():
        seeds.setdefault(seed["m"], []).append(seed["item"])
    units = rows.repartition("m", "unit").sortWithinPartitions("m", "unit", "code")
    out = "item_id long, doc_id long, score long"
    none = np.zeros(len(items.ids), dtype=np.int64)
    only = {m: np.array(sorted(x)) for m, x in seeds.items()}
    first = units.where(F.col("m").isin(list(seeds))).mapInArrow(_visits(items, k, none, only), out)
    reached = {r["item_id"]: r["score"] for r in
               top_per_group(first, ["item_id"], [F.desc("score"), F.asc("doc_id")], k).where(F.col("rank") == k).collect()}
    floor = np.array([reached.get(i, 0) for i in items.ids], dtype=np.int64)
    return units.mapInArrow(_visits(items, k, floor, None), out)


def _blocks(items: DataFrame, size: int) -> Iterator[dict[int, set[bytes]]]:
    """Blocks of at most ``size`` items with their terms, in the order of the ids; items without terms find nothing."""
    ids = items.select("item_id").distinct()
    last = None
    while True:
        rest = ids if last is None else ids.where(F.col("item_id") > last)
        some = [r["item_id"] for r in rest.orderBy("item_id").limit(size).collect()]
        if not some:
            return
        last = some[-1]
        block: dict[int, set[bytes]] = {}
        for row in items.where(F.col("item_id").between(some[0], last)).toLocalIterator():
            block.setdefault(row["item_id"], set()).update(terms_of(row["text"]))
        yield {i: t for i, t in sorted(block.items()) if t}


def search(docs: DataFrame, items: DataFrame, k: int = 10, index: StrataIndex | None = None, block: int = ITEM_BLOCK,
           id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, equal scores by doc_id.

    ``index``: an index of all terms of ``docs`` from ``build``; without one, each block of items gets an index of its terms."""
    spark = docs.sparkSession
    asked = items.where(F.col(item_id_col).isNotNull()).select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    found = None
    for some in _blocks(asked, block):
        if not some:
            continue
        known = index or build(docs, sorted(set().union(*some.values())), id_col, text_col)
        hits = written(search_block(known, some, k), "block-hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.range(0).select(F.col("id").alias("item_id"), F.lit(1).alias("rank"), F.col("id").alias("doc_id"), F.col("id").alias("score"))
    best = top_per_group(found, ["item_id"], [F.desc("score"), F.asc("doc_id")], k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
