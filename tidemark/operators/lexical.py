"""A stored inverted index over chunks, and keyword search that reads only what the questions' words need.

``postings(part, word, block, at)``: chunks are indexed in blocks of neighbours as they are read; ``at`` numbers the block's
chunks that hold the word. ``part`` is a hash of the word and the folder the row lies in. ``chunks(block, at, chunk_id,
position)`` names the chunks. A word adds one to a chunk's score, so the number of a question's words that occur in a block
at all bounds the scores there; blocks whose bound doesn't reach the question's k-th best so far are passed over."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.text import keywords
from tidemark.session import scratch_path, written
from tidemark.tables import top_per_group

PARTS = 64
#: scores and postings worked on at once in a task
CELLS = 2_000_000


@dataclass(frozen=True)
class KeywordIndex:
    postings: DataFrame
    chunks: DataFrame
    parts: int

    def of_words(self, words: list[str]) -> DataFrame:
        """The postings of some words, from the folders they lie in."""
        spark = self.postings.sparkSession
        asked = spark.createDataFrame([(n, w) for n, w in enumerate(words)], "code int, word string")
        asked = asked.withColumn("part", part_of("word", self.parts))
        folders = [r["part"] for r in asked.select("part").distinct().collect()]
        return (self.postings.where(F.col("part").isin(folders)).join(F.broadcast(asked.drop("part")), "word")
                .select("block", "code", "at"))


def part_of(word: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(parts)).cast("int")


def _inverted(schema: T.StructType):
    kinds = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            # the chunks in order of their position: equal scores stay in this order
            batch = pa.Table.from_batches([batch]).sort_by([("position", "ascending"), ("chunk_id", "ascending")]).combine_chunks()
            lists = batch.column("words").combine_chunks()
            flat = lists.flatten().dictionary_encode()
            code = np.asarray(flat.indices)
            at = np.repeat(np.arange(batch.num_rows, dtype=np.int32), lists.value_lengths().fill_null(0).to_numpy())
            order = np.argsort(code, kind="stable")
            start = np.flatnonzero(np.diff(code[order], prepend=-1))
            size = len(start)
            ends = pa.array(np.r_[start, len(order)], pa.int32())
            words = pa.RecordBatch.from_arrays(
                [flat.dictionary.take(pa.array(code[order][start])), pa.array(np.full(size, block)),
                 pa.ListArray.from_arrays(ends, pa.array(at[order])), pa.nulls(size, kinds.field(3).type), pa.nulls(size, kinds.field(4).type)],
                schema=kinds)
            whole = pa.array([0, batch.num_rows], pa.int32())
            names = pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.string()), pa.array([block]), pa.nulls(1, pa.list_(pa.int32())),
                 pa.ListArray.from_arrays(whole, batch.column("chunk_id").combine_chunks()).cast(kinds.field(3).type),
                 pa.ListArray.from_arrays(whole, batch.column("position").combine_chunks()).cast(kinds.field(4).type)], schema=kinds)
            yield words
            yield names
            block += 1

    return run


def build_keyword_index(chunks: DataFrame, path: str, position: str = "position", words: DataFrame | None = None,
                        parts: int = PARTS) -> KeywordIndex:
    """Index ``chunks(chunk_id, content, position)`` below ``path``; with ``words(word)`` only these words."""
    spark = chunks.sparkSession
    rows = chunks.select("chunk_id", F.col(position).alias("position"), F.array_distinct(keywords("content")).alias("words"))
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("block", T.LongType()),
                           T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("ids", T.ArrayType(rows.schema["chunk_id"].dataType)),
                           T.StructField("positions", T.ArrayType(rows.schema["position"].dataType))])
    blocks = rows.mapInArrow(_inverted(schema), schema)
    if words is not None:
        # rows that name a block's chunks have no word: a key of their own spreads them
        key = F.coalesce("word", F.concat(F.lit("\0"), F.col("block").cast("string")))
        wanted = words.select(F.col("word").alias("key")).distinct().withColumn("wanted", F.lit(True))
        blocks = blocks.withColumn("key", key).join(wanted, "key", "left").where("word IS NULL OR wanted").drop("key", "wanted")
    blocks = written(blocks, "keyword-blocks")
    postings = blocks.where("word IS NOT NULL").select("word", "block", "at")
    # a common word has a row per block: its folder is written by several tasks
    (postings.withColumn("part", part_of("word", parts)).repartition("part", F.col("block") % 4)
     .write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings"))
    names = blocks.where("word IS NULL").select("block", F.posexplode(F.arrays_zip("ids", "positions")).alias("at", "name"))
    names.select("block", "at", F.col("name.ids").alias("chunk_id"), F.col("name.positions").alias("position")).write.mode("overwrite").parquet(f"{path}/chunks")
    return read_keyword_index(spark, path, parts)


def read_keyword_index(spark: SparkSession, path: str, parts: int = PARTS) -> KeywordIndex:
    postings = spark.read.schema("word string, block long, at array<int>, part int").parquet(f"{path}/postings")
    return KeywordIndex(postings, spark.read.parquet(f"{path}/chunks"), parts)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ..."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _scored(asked: list[list[int]], n_words: int, k: int, min_score: int):
    """(question, block, at, score) of at least the task's k best chunks per question; rows come block by block."""
    word = np.array([c for codes in asked for c in codes], dtype=np.int64)
    sizes = np.array([len(codes) for codes in asked])
    owner = np.repeat(np.arange(len(asked)), sizes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(asked), min_score)
        best: dict[int, list[tuple[int, int, int]]] = {}
        now, parts = None, []

        def visit() -> None:
            codes, counts, at = (np.concatenate(x) for x in zip(*parts))
            row = np.full(n_words, -1, dtype=np.int64)
            row[codes] = np.arange(len(codes))
            here = row[word] >= 0
            bound = np.bincount(owner[here], minlength=len(asked))
            here &= (bound >= least)[owner]
            who, rows = owner[here], row[word[here]]
            if not len(who):
                return
            start, width = np.cumsum(counts) - counts, int(at.max()) + 1
            done = np.cumsum(counts[rows] + np.r_[True, who[1:] != who[:-1]] * width) // CELLS
            cut = np.flatnonzero(np.r_[True, (done[1:] != done[:-1]) & (who[1:] != who[:-1])])
            for a, b in zip(cut, [*cut[1:], len(who)]):
                first = who[a]
                cell = np.repeat((who[a:b] - first) * width, counts[rows[a:b]]) + at[_ranges(start[rows[a:b]], counts[rows[a:b]])]
                score = np.bincount(cell, minlength=(who[b - 1] - first + 1) * width).reshape(-1, width)
                for q in np.unique(who[a:b]).tolist():
                    mine = score[q - first]
                    hit = np.flatnonzero(mine >= max(least[q], 1))
                    if len(hit) > k:
                        # everything that reaches the k-th best, in the order of the positions
                        hit = hit[mine[hit] >= np.partition(mine[hit], len(hit) - k)[len(hit) - k]]
                    found = best.setdefault(q, [])
                    found += [(-int(mine[h]), now, int(h)) for h in hit]
                    if len(found) >= k:
                        found.sort()
                        least[q] = max(least[q], -found[k - 1][0])
                        # of this block's equal scores the first k are enough; other blocks may hold earlier positions
                        best[q] = _fewest(found, k)

        for batch in batches:
            if not batch.num_rows:
                continue
            block, code, lists = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
            offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
            edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            for a, b in zip(edges, [*edges[1:], len(block)]):
                if block[a] != now:
                    if parts:
                        visit()
                    now, parts = int(block[a]), []
                parts.append((code[a:b].copy(), np.diff(offsets[a:b + 1]), values[offsets[a]:offsets[b]].copy()))
        if parts:
            visit()
        rows = [(q, block, at, -minus) for q, found in best.items() for minus, block, at in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.int64()))],
                                             names=["question", "block", "at", "score"])

    return run


def _fewest(found: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """What may be among the k best: scores from the k-th on, at most k of one score and block."""
    least, kept, seen = found[k - 1][0], [], {}
    for hit in found:
        if hit[0] > least:
            break
        seen[hit[:2]] = seen.get(hit[:2], 0) + 1
        if seen[hit[:2]] <= k:
            kept.append(hit)
    return kept


def _blocks(asked: DataFrame, size: int) -> Iterator[list]:
    """The questions (query_id, words) in blocks of about ``size`` rows by a hash; one block is on the driver at a time."""
    kept = written(asked, "questions")
    blocks = max(1, -(-kept.count() // size))
    for block in range(blocks):
        rows = kept.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        if rows:
            yield rows


def search_index(queries: DataFrame, index: KeywordIndex, k: int = 5, min_score: int = 1, per_pass: int = 1024) -> DataFrame:
    """(query_id, chunk_id, score, rank) like ``keyword_search``, from a stored index. A block of questions reads the folders of
    its words; its k best are written before the next block is looked at."""
    spark = queries.sparkSession
    id_type = queries.schema["query_id"].dataType
    best = None
    for rows in _blocks(queries.select("query_id", F.array_distinct(keywords("text")).alias("words")), per_pass):
        words = sorted({w for r in rows for w in r["words"] or ()})
        number = {w: n for n, w in enumerate(words)}
        ids = spark.createDataFrame([(n, r["query_id"]) for n, r in enumerate(rows)],
                                    T.StructType([T.StructField("question", T.IntegerType()), T.StructField("query_id", id_type)]))
        run = _scored([sorted(number[w] for w in r["words"] or ()) for r in rows], len(words), k, min_score)
        matched = index.of_words(words).repartition("block").sortWithinPartitions("block", "code")
        hits = written(matched.mapInArrow(run, "question int, block long, at int, score long"), "keyword-hits")
        # what can't be among the k best whatever the positions are doesn't ask for them
        places = hits.join(index.chunks, ["block", "at"])
        top = top_per_group(places, ["question"], [F.desc("score"), F.col("position")], k)
        top = written(top.join(F.broadcast(ids), "question").select("query_id", "chunk_id", "score", "rank"), "keyword-best")
        best = top if best is None else best.unionByName(top)
    if best is None:
        return spark.createDataFrame([], T.StructType([
            T.StructField("query_id", id_type), T.StructField("chunk_id", index.chunks.schema["chunk_id"].dataType),
            T.StructField("score", T.LongType()), T.StructField("rank", T.IntegerType())]))
    return best


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int = 5, position: str = "position", min_score: int = 1,
                   per_pass: int = 1024, index: KeywordIndex | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): score = distinct shared words, ties in input order.

    ``queries(query_id, text)``, one row per question, and ``chunks(chunk_id, content, position)``. Without a stored ``index`` of
    the chunks, one of the questions' words is built for the call."""
    if index is None:
        queries = written(queries.select("query_id", "text"), "question-texts")
        words = queries.select(F.explode(keywords("text")).alias("word"))
        index = build_keyword_index(chunks, scratch_path(chunks.sparkSession, "keyword-index"), position, words, parts=8)
    return search_index(queries, index, k, min_score, per_pass)
