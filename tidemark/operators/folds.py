"""Numbering the groups of a greedy fold, in parallel.

Rows of a key, in order, are packed greedily: each row either joins the group before it or opens a new one, depending on a
small whole number that the rows before have left (how full the group is). What a block of rows does to every possible number
is a table, and tables of consecutive blocks compose; so each sorted block works out its table on its own, the few tables of a
key are run through in order, and then every block numbers its rows knowing where it starts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import written

#: (states, value) -> (new states, which opened a group); works on an array of states
Step = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def filling(size: int) -> tuple[Step, int]:
    """A group takes rows until their lengths reach ``size``; the row that reaches it is its last."""
    def step(state: np.ndarray, value: int) -> tuple[np.ndarray, np.ndarray]:
        opens = state >= size
        return np.minimum(np.where(opens, 0, state) + value, size), opens
    return step, size


def joining(min_chars: int, size: int) -> tuple[Step, int]:
    """A row of fewer than ``min_chars`` joins the group before it while both lengths sum to ``size`` at most; a line break goes
    between them."""
    def step(state: np.ndarray, value: int) -> tuple[np.ndarray, np.ndarray]:
        opens = (state + value > size) | (value >= min_chars)
        return np.minimum(np.where(opens, value, state + 1 + value), size + 1), opens
    return step, size + 1


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of another key begin."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def numbered_groups(rows: DataFrame, keys: list[str], order: list[str], value: str, fold: tuple[Step, int], name: str) -> DataFrame:
    """``keys``, ``order`` and the number ``name`` (from 0) of each row's group. Keys and order must be a total order of the rows
    and not null; the last state of ``fold`` is the one that a key starts from, in which every row opens a group."""
    step, start = fold
    slim = rows.select(*keys, *order, F.col(value).cast("long").alias("_value"))
    ranged = slim.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    blocks = written(ranged.withColumn("_block", F.spark_partition_id()), "fold-blocks")
    key_fields = [slim.schema[k] for k in keys]
    states = np.arange(start + 1)

    def columns(block: pa.Table) -> list[np.ndarray]:
        return [np.asarray(block.column(k).combine_chunks().dictionary_encode().indices) for k in keys]

    def tables(block: pa.Table) -> pa.Table:
        """Of a block's first and last key what the block does to each state: where it ends and how many groups it opens."""
        block = block.sort_by([(c, "ascending") for c in (*keys, *order)]).combine_chunks()
        first = _edges(*columns(block))
        values = block.column("_value").to_pylist()
        ends = [*first[1:], block.num_rows]
        out, opened = [], []
        chosen = sorted({0, len(first) - 1})
        for at in chosen:
            state, count = states.copy(), np.zeros(len(states), dtype=np.int64)
            for v in values[first[at]:ends[at]]:
                state, opens = step(state, v)
                count += opens
            out.append(state.tolist())
            opened.append(count.tolist())
        head = block.take(pa.array([first[at] for at in chosen]))
        return pa.table({**{k: head.column(k) for k in keys}, "_block": head.column("_block"),
                         "_state": pa.array(out, pa.list_(pa.int64())), "_opened": pa.array(opened, pa.list_(pa.int64()))})

    def carried(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        """The state and number that each block of a key starts from."""
        found = found.sort_by("_block")
        state, number, rows = start, 0, []
        for after, opened in zip(found.column("_state").to_pylist(), found.column("_opened").to_pylist()):
            rows.append((state, number))
            state, number = after[state], number + opened[state]
        return pa.table({"_block": found.column("_block"), **{k: found.column(k) for k in keys},
                         "_from": pa.array([r[0] for r in rows], pa.int64()), "_number": pa.array([r[1] for r in rows], pa.int64())})

    table_schema = T.StructType([*key_fields, T.StructField("_block", T.IntegerType()), T.StructField("_state", T.ArrayType(T.LongType())),
                                 T.StructField("_opened", T.ArrayType(T.LongType()))])
    carry_schema = T.StructType([T.StructField("_block", T.IntegerType()), *key_fields, T.StructField("_from", T.LongType()),
                                 T.StructField("_number", T.LongType())])
    # a key's rows here are its blocks; only a block's first and last key can go on in another block
    carries = (blocks.groupBy("_block").applyInArrow(tables, table_schema).groupBy(*keys).applyInArrow(carried, carry_schema))
    carries = written(carries.where("_number > 0"), "fold-carries")
    result_schema = T.StructType([*key_fields, *[slim.schema[o] for o in order], T.StructField(name, T.LongType())])

    def number(block: pa.Table, carry: pa.Table) -> pa.Table:
        block = block.sort_by([(c, "ascending") for c in (*keys, *order)]).combine_chunks()
        first = _edges(*columns(block))
        values = block.column("_value").to_pylist()
        numbers = np.zeros(block.num_rows, dtype=np.int64)
        # a key that goes on from the block before is the first one here
        begin = (carry.column("_from")[0].as_py(), carry.column("_number")[0].as_py()) if carry.num_rows else (start, 0)
        for at, (a, b) in enumerate(zip(first, [*first[1:], block.num_rows])):
            state, count = (np.array([begin[0]]), begin[1]) if at == 0 else (np.array([start]), 0)
            for row in range(a, b):
                state, opens = step(state, values[row])
                count += int(opens[0])
                numbers[row] = count - 1
        return pa.table({**{c: block.column(c) for c in (*keys, *order)}, name: pa.array(numbers)})

    return blocks.groupBy("_block").cogroup(carries.groupBy("_block")).applyInArrow(number, result_schema)
