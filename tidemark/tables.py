"""Joins and windows that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

HOT_ROWS = 1_000_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """For heavy work per row: a table that comes in fewer scan partitions than there are cores
    (a small file, one row group) is spread over all of them. Anything larger is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                  rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key. Spark limits each map task to ``k`` rows per key
    before the shuffle (WindowGroupLimit), so a hot key ships few rows."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the smallest ``order`` per key, by a partial aggregate: each map task
    sends one row per key, whatever the key's size."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


#: pairs of a product that one task makes, about, and tasks at most
PAIRS_PER_TASK, PRODUCT_TASKS = 100_000_000, 10_000


def salted_join(many: DataFrame, few: DataFrame, on: list[str], salt_by: list[str],
                splits: int | None = None) -> DataFrame:
    """Equi-join whose key has few values: the product of the two sides is cut into a grid of ``splits`` cells, which are
    dealt over all tasks. The rows of ``many`` are cut into rows of the grid and repeated for its columns, those of ``few``
    (the smaller side) the other way round. Both sides are counted first, so that cells and tasks follow the size of the
    product and neither side is repeated more than that takes.

    The number of tasks is named: what is shuffled says nothing about the size of the product, and by its size alone
    adaptive execution would put it into one task. There are several cells to a task, so that no task gets many more. No
    side is broadcast: Spark doesn't see that repeating makes a side larger, and would gather it in the driver."""
    ours, theirs = (row["n"] for row in many.agg(F.count("*").alias("n")).union(few.agg(F.count("*").alias("n"))).collect())
    tasks = max(4 * many.sparkSession.sparkContext.defaultParallelism, min(ours * theirs // PAIRS_PER_TASK, PRODUCT_TASKS))
    if splits is None:
        splits = 4 * tasks
    cols = min(max(round(math.sqrt(splits * theirs / max(ours, 1))), 1), splits)
    rows = math.ceil(splits / cols)

    def part(columns: list[str], parts: int) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    # one column names the cell, and the keys are compared behind it: a constant key would drop out of what the join is dealt by
    kinds = many.select(*on).unionByName(few.select(*on)).dtypes
    cell = F.xxhash64(*[F.col(name).cast(kind) for name, kind in kinds], "_r", "_c")
    left = many.dropna(subset=on).withColumn("_r", part(salt_by, rows)).withColumn("_c", every(cols)).withColumn("_cell", cell)
    right = few.dropna(subset=on).withColumn("_c", part(few.columns, cols)).withColumn("_r", every(rows)).withColumn("_at", cell)
    left, right = left.drop("_r", "_c"), right.drop("_r", "_c").withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = [F.coalesce(F.col(c) == F.col(f"_on_{c}"), F.lit(False)) for c in on]
    pairs = left.repartition(tasks, "_cell").join(right.repartition(tasks, "_at").hint("merge"), [F.col("_cell") == F.col("_at"), *same])
    return pairs.select(*on, *[c for c in many.columns if c not in on], *[c for c in few.columns if c not in on])


class Ordered:
    """Ordered window functions over ``keys`` that survive a hot key.

    If no key has more than ``hot_rows`` rows this is an ordinary window. Otherwise the
    rows are range-sorted by (keys, order) and written, each sorted partition becomes a
    block, and every function is computed per (keys, block) and then corrected by the
    totals of the earlier blocks: a few rows per key. ``order`` must be a total order
    within each key; key columns must not be null."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_ROWS):
        self.keys, self.order = list(keys), list(order)
        # an empty grouping (no keys) counts the whole table in one row
        sizes = df.groupBy(*self.keys).agg(F.count("*").alias("_n"))
        self.split = not sizes.where(F.col("_n") > hot_rows).isEmpty()
        if self.split:
            ranged = df.repartitionByRange(*self.keys, *self.order)
            df = written(ranged.withColumn("_block", F.spark_partition_id()), "ordered")
        else:
            df = df.withColumn("_block", F.lit(0))
        self.df = df

    def _with(self, name: str, inner: Column, total: Column | None, combine) -> "Ordered":
        df = self.df.withColumn(name, inner)
        if self.split:
            before = (Window.partitionBy(*self.keys).orderBy("_block")
                      .rowsBetween(Window.unboundedPreceding, -1))
            blocks = self.df.groupBy(*self.keys, "_block").agg(total.alias("_total"))
            blocks = blocks.withColumn("_before", combine[0](F.col("_total")).over(before)).drop("_total")
            df = df.join(blocks, [*self.keys, "_block"])
            df = df.withColumn(name, combine[1](F.col(name), F.col("_before"))).drop("_before")
        self.df = df
        return self

    def _window(self):
        return Window.partitionBy(*self.keys, "_block").orderBy(*self.order)

    def row_number(self, name: str) -> "Ordered":
        return self._with(name, F.row_number().over(self._window()), F.count("*"),
                          (F.sum, lambda own, earlier: (own + F.coalesce(earlier, F.lit(0))).cast("int")))

    def running_sum(self, name: str, value: Column, inclusive: bool = True) -> "Ordered":
        rows = self._window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        own = F.coalesce(F.sum(value).over(rows), F.lit(0))
        return self._with(name, own, F.sum(value),
                          (F.sum, lambda mine, earlier: mine + F.coalesce(earlier, F.lit(0))))

    def running_max(self, name: str, value: Column) -> "Ordered":
        rows = self._window().rowsBetween(Window.unboundedPreceding, 0)
        return self._with(name, F.max(value).over(rows), F.max(value),
                          (F.max, F.greatest))

    def lag(self, name: str, value: Column) -> "Ordered":
        boxed = F.struct(value.alias("v"))
        last = F.max_by(boxed, F.struct(*self.order))
        rows = self._window()
        return self._with(
            f"_{name}", F.lag(boxed).over(rows), last,
            (lambda c: F.last(c), lambda mine, earlier: F.coalesce(mine, earlier)))._unbox(name)

    def _unbox(self, name: str) -> "Ordered":
        self.df = self.df.withColumn(name, F.col(f"_{name}.v")).drop(f"_{name}")
        return self

    def result(self) -> DataFrame:
        return self.df.drop("_block")


def in_batches(df: DataFrame, keys: list[str], item: str, size: int, out: str) -> DataFrame:
    """Arrays of at most ``size`` items per key in the order of the items: part 0 holds the first ``size``, and so on.

    Yields keys, part, parts, total and the array ``out``, in the same layout for groups of any size; read part by
    part the items are sorted. No row grows with its key."""
    numbered = Ordered(df.select(*keys, item), keys, [item]).row_number("_n").result()
    parts = (numbered.groupBy(*keys, F.floor((F.col("_n") - 1) / size).cast("int").alias("part"))
             .agg(F.sort_array(F.collect_list(item)).alias(out)))
    totals = df.groupBy(*keys).agg(F.count("*").alias("total"))
    # a handful of part rows per key meet one row of totals
    return parts.join(totals, keys).select(*keys, "part", F.ceil(F.col("total") / size).cast("int").alias("parts"), "total", out)


def split_hot_join(many: DataFrame, few: DataFrame, on: list[str], salt_by: list[str],
                   rows_per_task: int = 100_000) -> DataFrame:
    """Inner equi-join that cuts up crowded keys of ``many``.

    Keys with more than ``rows_per_task`` rows are counted first (map-side). Without any
    it is a plain join; otherwise each of them is hashed over as many tasks as its size
    needs and its rows of ``few`` are repeated that often."""
    crowded = (many.groupBy(*on).count().where(F.col("count") > rows_per_task)
               .select(*on, F.ceil(F.col("count") / rows_per_task).cast("int").alias("_splits")))
    if crowded.isEmpty():
        return many.join(few, on)
    crowded = written(crowded, "crowded-keys")
    one = F.coalesce("_splits", F.lit(1))
    left = (many.join(crowded, on, "left")
            .withColumn("_salt", F.pmod(F.xxhash64(*salt_by), one).cast("int")).drop("_splits"))
    right = (few.join(crowded, on, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_splits"))
    return left.join(right, [*on, "_salt"]).drop("_salt")


def heavy_keys(df: DataFrame, on: list[str], shares: int = 4096, least: int = 10_000) -> DataFrame:
    """(keys, n, bound) of the keys with more than ``bound`` rows: 1/``shares`` of the rows of ``df``, and at least ``least``.

    At most ``shares`` keys can have that many, whatever the table's size, so they may go through the driver and be
    broadcast. Counted map-side; null keys, which join nothing, are left out. Without heavy keys the table is known to be
    empty, and the optimizer drops what a join does for them."""
    sizes = df.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("n"))
    # whatever has more than 1/shares of the rows is among the first ``shares`` keys by size
    first = sizes.where(F.col("n") > least).orderBy(F.desc("n"), *on).limit(shares)
    rows = first.collect()
    bound = max(least, df.count() // shares) if rows else least
    rows = [(*r, bound) for r in rows if r["n"] > bound]
    if not rows:
        return first.withColumn("bound", F.lit(bound)).where(F.lit(False))
    return df.sparkSession.createDataFrame(rows, first.withColumn("bound", F.lit(0).cast("long")).schema)


def heavy_join(many: DataFrame, few: DataFrame, on: list[str], heavy: DataFrame) -> DataFrame:
    """Inner equi-join with ``few``, which has at most one row per key: rows of the ``heavy`` keys of ``many`` stay in
    their map tasks and meet the few rows of these keys there, the others are shuffled."""
    keys = F.broadcast(heavy.select(*on))
    bright = F.broadcast(few.join(keys, on, "left_semi"))
    return many.join(bright, on).unionByName(many.join(keys, on, "left_anti").join(few.join(keys, on, "left_anti"), on))


def semi_join(many: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``many`` whose key is in ``keys``. Rows of heavy keys are looked up in their map tasks."""
    return heavy_join(many, keys.select(*on).distinct(), on, heavy_keys(many, on))


def dealt_sides(left: DataFrame, right: DataFrame, on: list[str], shares: int = 4096, least: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Both tables with the cell (``_r``, ``_c``) of their key's grid that each row goes to, for ``matrix_join``."""
    cuts = [heavy_keys(df, on, shares, least).select(*on, F.ceil(F.col("n") / F.col("bound")).cast("int").alias(name))
            for df, name in ((left, "_rows"), (right, "_cols"))]
    grid = F.broadcast(cuts[0].join(cuts[1], on, "full"))

    def placed(df: DataFrame, own: str, own_cut: str, other: str, other_cut: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*df.columns), F.coalesce(own_cut, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other_cut, F.lit(1)) - 1))
        return df.join(grid, on, "left").withColumn(own, part).withColumn(other, every).drop("_rows", "_cols")

    return placed(left, "_r", "_rows", "_c", "_cols"), placed(right, "_c", "_cols", "_r", "_rows")


def matrix_join(left: DataFrame, right: DataFrame, on: list[str], shares: int = 4096, least: int = 10_000) -> DataFrame:
    """Inner equi-join for keys that are crowded on both sides.

    A key with more than 1/``shares`` of the rows of a side is cut there into parts of about that size (by a hash of the
    whole row), and the product of the parts of both sides is dealt out cell by cell: a left row goes to the cells of its
    row, a right row to those of its column. Other keys have one cell. At most ``shares`` keys per side are cut, so what
    is broadcast is bounded. Each table is read three times, twice for its keys only."""
    ours, theirs = dealt_sides(left, right, on, shares, least)
    return ours.join(theirs, [*on, "_r", "_c"]).drop("_r", "_c")
