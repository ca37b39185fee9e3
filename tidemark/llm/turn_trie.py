"""The prefix trie of conversations, by truncation peeling.

Every distinct sequence of first turns is a node, known by a running 128-bit hash of its turns (role and text). Within a
task a bounded batch of conversations is peeled from its greatest depth: at each level the conversations that end there
join the nodes that survived from below, equal ones merge, the level's nodes are given out with their aggregates, and what
is left loses its last turn and goes to the level above. Conversations with the same origin are peeled together. Nodes that
several batches found are merged by their hash, map-side first, so that a turn that many conversations begin with costs a
row per batch.

Values of whole subtrees (leaves, saved code points) come from a second peeling: a node's own value lies on the path of its
smallest member and is handed up from there.

Defined results: turns are ordered by turn (null first), equal turns by a hash of role and text; null role or text counts as
empty; rows with a null conv_id are left out; repeated rows are further turns; other columns are ignored; an empty table has
no nodes. A conversation longer than ``PEEL_ROWS`` turns is peeled in pieces, one after the other."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches
from tidemark.session import written
from tidemark.tables import Ordered, heavy_join, heavy_keys, in_batches

PEEL_ROWS = 100_000
#: the key of the node without turns
ROOT = bytes(16)
IDS_PER_PART = 1_000


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv_id, at, mark, chars): the turns of every conversation from 0, each with a hash of its role and text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            marks = [xxhash.xxh3_128_digest((role or "").encode() + b"\xff" + text.encode())
                     for role, text in zip(batch.column(2).to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["conv_id", "turn", "mark", "chars"])

    bounded_batches(conversations.sparkSession)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    marked = written(rows.mapInArrow(run, "conv_id long, turn long, mark binary, chars long"), "turns")
    return Ordered(marked, ["conv_id"], ["turn", "mark"]).row_number("at").result().select(
        "conv_id", (F.col("at") - 1).alias("at"), "mark", "chars")


def forked(turns: DataFrame, origin: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Rebuild every conversation: the first ``shared`` turns (at most ``most``) of the conversation ``origin`` names, then its
    own from there on. Returns (origin, conv_id, depth, mark, chars) and all (conv_id)."""
    turns = written(turns.withColumn("origin", origin), "numbered-turns")
    convs = turns.select("conv_id", "origin").distinct().withColumn("shared", shared)
    starts = turns.where((F.col("conv_id") == F.col("origin")) & (F.col("at") < most))
    sizes = starts.groupBy("origin").agg(F.count("*").alias("size"))
    sizes = convs.select("origin").distinct().join(sizes, "origin", "left").select("origin", F.coalesce("size", F.lit(0)).alias("size"))
    first = (convs.join(starts.select("origin", "at", "mark", "chars"), "origin").where("at < shared")
             .select("origin", "conv_id", (F.col("at") + 1).alias("depth"), "mark", "chars"))
    rest = turns.withColumn("shared", shared).where("at >= shared")
    rest = heavy_join(rest, sizes, ["origin"], heavy_keys(turns, ["origin"])).select(
        "origin", "conv_id", (F.least("size", "shared") + F.col("at") - F.col("shared") + 1).alias("depth"), "mark", "chars")
    return first.unionByName(rest), convs.select("conv_id")


def _prefixes(rebuilt: DataFrame) -> DataFrame:
    """(origin, conv_id, depth, key, parent, chars): every conversation's prefixes with their hashes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, key = None, ROOT
        for batch in batches:
            keys, parents = [], []
            for c, mark in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if c != conv:
                    conv, key = c, ROOT
                parents.append(key)
                key = xxhash.xxh3_128_digest(key + mark)
                keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.binary()),
                                              pa.array(parents, pa.binary()), batch.column(4)],
                                             names=["origin", "conv_id", "depth", "key", "parent", "chars"])

    ordered = rebuilt.select("origin", "conv_id", F.col("depth").cast("long").alias("depth"), "mark", "chars")
    ordered = ordered.repartition("origin").sortWithinPartitions("origin", "conv_id", "depth")
    return ordered.mapInArrow(run, "origin long, conv_id long, depth long, key binary, parent binary, chars long")


class Batch:
    """Prefix rows of conversations, each from its deepest row to its first: conversation, depth, key, parent, two values."""

    def __init__(self, parts: list[tuple]):
        conv, depth, key, parent, one, two = zip(*parts)
        self.conv, self.depth, *self.values = (np.concatenate(x) for x in (conv, depth, one, two))
        known = pa.concat_arrays([*key, *parent]).dictionary_encode()
        self.names = known.dictionary
        self.code, self.parent = np.split(np.asarray(known.indices).astype(np.int64), 2)
        self.enters = np.r_[True, self.conv[1:] != self.conv[:-1]]


def _merged(code: np.ndarray, sums: list[np.ndarray], row: np.ndarray, conv: np.ndarray) -> tuple:
    """One node per code: the sums, and a row of its smallest conversation."""
    order = np.lexsort((conv, code))
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[first], [np.add.reduceat(s[order], first) for s in sums], row[order][first], conv[order][first]


def peel(batch: Batch, entering: list[np.ndarray], own: list[np.ndarray]) -> Iterator[tuple]:
    """Level by level from the deepest: (rows, codes, sums, smallest conversations) of the level's nodes.

    Both hold values per row: ``entering`` counts where a conversation comes in, at its deepest row, ``own`` at every row."""
    levels = np.argsort(-batch.depth, kind="stable")
    edges = np.flatnonzero(np.r_[True, batch.depth[levels][1:] != batch.depth[levels][:-1]])
    adds = np.logical_or.reduce([o != 0 for o in own])
    up, conv = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    sums = [np.zeros(0, dtype=np.int64) for _ in own]
    for start, end in zip(edges, [*edges[1:], len(levels)]):
        rows = levels[start:end]
        rows = rows[batch.enters[rows] | adds[rows]]
        new = [np.where(batch.enters[rows], e[rows], 0) + o[rows] for e, o in zip(entering, own)]
        code, sums, row, conv = _merged(np.concatenate([batch.code[up], batch.code[rows]]),
                                        [np.concatenate(x) for x in zip(sums, new)],
                                        np.concatenate([up, rows]), np.concatenate([conv, batch.conv[rows]]))
        yield row, code, sums, conv
        up = row + 1  # strip the last turn: the next row of a conversation is the prefix before


def _peeled(rows: DataFrame, give: Callable, fields: str, most: int) -> DataFrame:
    """Cut prefix rows into batches of whole conversations and hand each to ``give(batch, carried)``, which returns rows and
    what to carry on. A conversation of more than ``most`` rows comes alone, in pieces from its end."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        # the last conversation, its rows and where they start in ``waiting``, the rows before, and what its end left
        conv, own, start, before, carried = None, 0, 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c) if c in (2, 3) else np.asarray(batch.column(c)) for c in range(6)]
            starts = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                if columns[0][a] != conv:
                    before += own
                    if waiting and (carried is not None or before >= most):
                        yield give(Batch(waiting), carried)[0]
                        waiting, before = [], 0
                    conv, own, start, carried = columns[0][a], 0, len(waiting), None
                waiting.append(tuple(c[a:b] for c in columns))
                own += int(b - a)
                if own > most:
                    if start:
                        yield give(Batch(waiting[:start]), None)[0]
                    out, carried = give(Batch(waiting[start:]), carried)
                    yield out
                    waiting, own, start, before = [], 0, 0, 0
        if waiting:
            yield give(Batch(waiting), carried)[0]

    ordered = rows.repartition("origin").sortWithinPartitions("origin", "conv_id", F.desc("depth"))
    return ordered.select("conv_id", "depth", "key", "parent", "one", "two").mapInArrow(run, fields)


def _found(batch: Batch, carried) -> tuple[pa.RecordBatch, bool]:
    """The nodes of a batch: how many of its conversations are members, and the smallest."""
    none = np.zeros(len(batch.conv), dtype=np.int64)
    parts = [(code, batch.depth[row], batch.parent[row], sums[0], conv, batch.values[0][row])
             for row, code, sums, conv in peel(batch, [none + 1], [none])]
    key, depth, parent, n, conv, chars = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([batch.names.take(pa.array(key)), pa.array(depth), batch.names.take(pa.array(parent)), pa.array(n), pa.array(conv), pa.array(chars)],
                                      names=["key", "depth", "parent", "n_convs", "conv_id", "chars"]), True


def _summed(batch: Batch, carried) -> tuple[pa.RecordBatch, list[int]]:
    """Per node of a batch the sums of both values over the rows below it and its own."""
    none = np.zeros(len(batch.conv), dtype=np.int64)
    parts = [(code, *sums) for _, code, sums, _ in peel(batch, [none + c for c in carried or (0, 0)], batch.values)]
    key, one, two = (np.concatenate(x) for x in zip(*parts))
    left = [int(v.sum()) + c for v, c in zip(batch.values, carried or (0, 0))]
    return pa.RecordBatch.from_arrays([batch.names.take(pa.array(key)), pa.array(one), pa.array(two)], names=["key", "n_leaves", "saved_tokens"]), left


def id_digests(members: DataFrame, keys: list[str], id_col: str, out: str) -> DataFrame:
    """Per key the SHA-256 of its ids in ascending order, joined by commas. A key's ids stream past in bounded parts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = ",".join(map(str, ids)).encode()
                if key == now:
                    digest.update(b"," + text)
                    continue
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(text)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field(0).type),
                                              pa.array([d[1] for d in done], pa.string())], names=["key", out])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["key", out])

    parts = in_batches(members, keys, id_col, IDS_PER_PART, "ids")
    ordered = parts.repartition(*keys).sortWithinPartitions(*keys, "part").select(*keys, "ids")
    return ordered.mapInArrow(run, f"key binary, {out} string")


def trie(rebuilt: DataFrame, convs: DataFrame, most: int = PEEL_ROWS) -> DataFrame:
    """The nodes over ``rebuilt`` (origin, conv_id, depth from 1, mark, chars) and ``convs`` (conv_id), which also names
    conversations without turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefixes = written(_prefixes(rebuilt), "prefixes")
    convs = written(convs.select("conv_id"), "conversations")
    partial = _peeled(prefixes.select("*", F.col("chars").alias("one"), F.lit(0).cast("long").alias("two")), _found,
                      "key binary, depth long, parent binary, n_convs long, conv_id long, chars long", most)
    nodes = partial.groupBy("key").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.sum("n_convs").alias("n_convs"),
                                       F.min("conv_id").alias("conv_id"), F.min("chars").alias("chars"))
    nodes = written(nodes, "trie-nodes")
    root = (convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
            .select(F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"),
                    "n_convs", "conv_id", F.lit(0).cast("long").alias("chars")))
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    whole = nodes.unionByName(root).join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    whole = written(whole.withColumn("leaf", (F.col("n_children") == 0).cast("long"))
                    .withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "trie-nodes")
    # a node's values lie on the path of its smallest member: at most one node per conversation and depth
    own = whole.where("depth > 0").select("conv_id", "depth", F.col("leaf").alias("one"), F.col("saved").alias("two"))
    paths = prefixes.join(own, ["conv_id", "depth"], "left").fillna(0, ["one", "two"])
    sums = _peeled(paths, _summed, "key binary, n_leaves long, saved_tokens long", most)
    all_sums = whole.agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).where("n_leaves IS NOT NULL")
    sums = (sums.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
            .unionByName(all_sums.select(F.lit(ROOT).alias("key"), "n_leaves", "saved_tokens")))
    last = prefixes.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    ends = convs.join(last, "conv_id", "left").select(F.coalesce("key", F.lit(ROOT)).alias("key"), "conv_id")
    digests = id_digests(written(ends, "ends"), ["key"], "conv_id", "ends_sha256")
    done = whole.join(sums, "key").join(digests, "key", "left")
    above = whole.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = written(done.select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent",
                                F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "trie-nodes")
    linked = heavy_join(below.where("depth > 0"), above, ["parent"], heavy_keys(below, ["parent"]))
    top = below.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return linked.unionByName(top, allowMissingColumns=True).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def forked_trie(conversations: DataFrame, most: int = PEEL_ROWS) -> DataFrame:
    """The trie of the conversations rebuilt so that those of a hundred share beginnings: c takes its first crc32(c) % 6 turns
    from c - c % 100."""
    turns = numbered_turns(conversations)
    rebuilt, convs = forked(turns, F.expr("conv_id - conv_id % 100"), F.expr("crc32(CAST(conv_id AS STRING)) % 6"), 5)
    return trie(written(rebuilt, "rebuilt"), convs, most)
