"""Exact top-k inner products by a Voronoi join.

Pivots (a bounded sample of the vectors) cut the space into cells; every vector goes to its nearest pivot. Small summaries
per cell (rows, radii, lengths, and the few rows best placed around the pivot) give each group of queries that share a pivot, and then
each query, a score that its k-th best surely reaches, and each cell a score that none of its rows can pass. A query is
sent only to the cells that may still matter, and is solved there against blocks of bounded size; the k best of each block meet
in a last top-k. Cells with many rows are cut into blocks and many queries into parts, so no task grows with the table.

Components are scaled and floored to integers, so scores are exact. Vectors that are null or hold a null or non-finite component,
and rows with a null id, take no part. Shorter vectors count as filled up with zeros. A row never meets itself; another row with the
same id is a candidate like any other. Equal scores go to the smaller id. Fewer candidates than k give fewer rows; without queries or
candidates the result is empty. Only the id and vector columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written
from tidemark.tables import top_per_group

BLOCK = 8192
QUERY_PART = 16_384
PIVOTS = 64


def _matrix(binary: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(binary), dtype="<i8").reshape(len(binary), dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while every sum stays below 2^53, else in 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def prepare(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding",
            scale: float = 256.0) -> DataFrame:
    """(row, id, is_query, v, size): usable rows with their floored components."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad)
    floored = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return usable.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                         F.coalesce(queries, F.lit(False)).alias("is_query"), floored.alias("v"), F.size(v).alias("size"))


def _placed(pivots: np.ndarray, dim: int):
    """Each vector with its cell, its distance to the pivot and its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            x = np.zeros((batch.num_rows, dim), dtype="<i8")
            sizes = np.array(batch.column(4))
            flat = np.array(lists.flatten(), dtype=np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            x[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            square = (x.astype(float) ** 2).sum(axis=1)
            far = square[:, None] - 2.0 * (x.astype(float) @ pivots.T) + (pivots ** 2).sum(axis=1)
            cell = far.argmin(axis=1).astype(np.int32)
            away = np.sqrt(np.maximum(far[np.arange(len(x)), cell], 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell),
                 pa.array(away), pa.array(np.sqrt(square))], names=["row", "id", "is_query", "v", "cell", "away", "norm"])
    return run


class Bounds:
    """What the summaries say about scores; a little slack covers rounding."""

    def __init__(self, pivots: np.ndarray, cells: pd.DataFrame, near: pd.DataFrame, k: int):
        self.pivots, self.k = pivots, k
        self.cells = cells  # cell, rows, away_min, away_max, norm_max
        self.near_cell, self.near_away, self.near_norm = (near[c].to_numpy() for c in ("cell", "away", "norm"))
        self.slack = 1e-6 * (1 + float(cells["norm_max"].max()) ** 2)

    def _kth(self, low: np.ndarray) -> np.ndarray:
        """The (k+1)-th largest: one of the rows may be the query itself."""
        if low.shape[1] <= self.k:
            return np.full(len(low), -np.inf)
        return np.partition(low, -(self.k + 1), axis=1)[:, -(self.k + 1)] - self.slack

    def of_queries(self, norm: np.ndarray, to_pivot: np.ndarray, dot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries with distances and products to all pivots: the score that the k-th best reaches at least, and
        per cell the score that none of its rows passes."""
        reach = to_pivot[:, self.near_cell] + self.near_away
        least = self._kth((norm[:, None] ** 2 + self.near_norm ** 2 - reach ** 2) / 2)
        c = self.cells
        at = c["cell"].to_numpy()
        gap = np.maximum(np.maximum(to_pivot[:, at] - c["away_max"].to_numpy(), c["away_min"].to_numpy() - to_pivot[:, at]), 0)
        top = c["norm_max"].to_numpy()
        most = np.minimum((norm[:, None] ** 2 + top ** 2 - gap ** 2) / 2, norm[:, None] * top)
        most = np.minimum(most, dot[:, at] + norm[:, None] * c["away_max"].to_numpy())
        return least, most + self.slack

    def of_groups(self, groups: pd.DataFrame) -> dict[int, np.ndarray]:
        """Per group of queries (cell, away_max, norm_min, norm_max): the positions of the cells it may need."""
        between = np.sqrt(np.maximum(((self.pivots[:, None] - self.pivots[None]) ** 2).sum(axis=2), 0))
        c, needed = self.cells, {}
        at, top = c["cell"].to_numpy(), c["norm_max"].to_numpy()
        for g in groups.itertuples():
            reach = g.away_max + between[g.cell, self.near_cell] + self.near_away
            least = self._kth(((g.norm_min ** 2 + self.near_norm ** 2 - reach ** 2) / 2)[None])[0]
            apart = between[g.cell, at]
            gap = np.maximum(np.maximum(apart - g.away_max - c["away_max"], c["away_min"] - apart - g.away_max), 0).to_numpy()
            most = np.minimum((g.norm_max ** 2 + top ** 2 - gap ** 2) / 2, g.norm_max * top) + self.slack
            needed[int(g.cell)] = np.flatnonzero(most >= least)
        return needed


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 256.0, pivots: int = PIVOTS, block: int = BLOCK, query_part: int = QUERY_PART) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each row for which ``queries`` holds, over
    all other rows. At most ``pivots`` rows serve as pivots; what goes through the driver is bounded by them."""
    usable = written(prepare(vectors, queries, id_col, vector_col, scale), "vectors")
    spark = usable.sparkSession
    size = usable.agg(F.max("size").alias("dim"), F.count_if("is_query").alias("q")).first()
    dim, parts = size["dim"] or 0, max(1, -(-size["q"] // query_part))
    if not size["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = usable.orderBy(F.xxhash64("row"), "row").select("v").limit(pivots).collect()
    centres = np.unique(np.array([list(r["v"]) + [0] * (dim - len(r["v"])) for r in chosen], dtype=float).reshape(len(chosen), dim), axis=0)
    placed = written(usable.mapInArrow(_placed(centres, dim), "row long, id long, is_query boolean, v binary, cell int, "
                                                              "away double, norm double"), "placed")
    cells = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.min("away").alias("away_min"), F.max("away").alias("away_max"),
                                       F.max("norm").alias("norm_max")).orderBy("cell").toPandas()
    # around each pivot: the k + 1 nearest rows
    near = top_per_group(placed.select("cell", "away", "norm", "row"), ["cell"], [F.asc("away"), F.asc("row")], k + 1).toPandas()
    groups = (placed.where("is_query").groupBy("cell").agg(F.max("away").alias("away_max"), F.min("norm").alias("norm_min"),
                                                           F.max("norm").alias("norm_max")).toPandas())
    bounds = Bounds(centres, cells, near, k)
    needed = bounds.of_groups(groups)
    cuts = {int(c): -(-int(n) // block) for c, n in zip(cells["cell"], cells["rows"])}

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_ids = bounds.cells["cell"].to_numpy()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1).to_pylist(), dim).astype(float)
            norm = np.sqrt((x ** 2).sum(axis=1))
            dot = x @ centres.T
            far = np.sqrt(np.maximum(norm[:, None] ** 2 - 2 * dot + (centres ** 2).sum(axis=1), 0))
            least, most = bounds.of_queries(norm, far, dot)
            group = np.array(batch.column(2))
            allowed = np.zeros(most.shape, dtype=bool)
            for g in np.unique(group):
                allowed[np.ix_(group == g, needed[int(g)])] = True
            row, cell = np.nonzero(allowed & (most >= least[:, None]))
            times = np.array([cuts[int(c)] for c in cell_ids])[cell]
            row, cell = np.repeat(row, times), np.repeat(cell_ids[cell], times)
            salt = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(3).take(pa.array(row)), batch.column(1).take(pa.array(row)),
                 pa.array(least[row]), pa.array(cell.astype(np.int32)), pa.array(salt.astype(np.int32)), batch.column(4).take(pa.array(row))],
                names=["row", "id", "v", "least", "cell", "salt", "part"])

    part = F.pmod(F.xxhash64("row", F.lit("part")), F.lit(parts)).cast("int").alias("part")
    asked = (placed.where("is_query").select("row", "v", "cell", "id", part)
             .mapInArrow(sent, "row long, id long, v binary, least double, cell int, salt int, part int"))
    salts = F.create_map(*[x for c, n in cuts.items() for x in (F.lit(c), F.lit(n))])
    salt = F.pmod(F.xxhash64("row", F.lit("salt")), F.element_at(salts, F.col("cell"))).cast("int").alias("salt")
    data = placed.select("row", "id", "v", "cell", salt, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_row", "query_id", "vec_id", "row", "score")})
        if not len(q) or not len(d):
            return empty
        d = d.sort_values(["id", "row"], kind="stable")
        x, rows, ids = _matrix(d["v"].tolist(), dim), d["row"].to_numpy(), d["id"].to_numpy()
        out = []
        for at in range(0, len(q), 512):
            some = q.iloc[at:at + 512]
            scores = _products(_matrix(some["v"].tolist(), dim), x)
            low = np.iinfo(np.int64).min
            scores[some["row"].to_numpy()[:, None] == rows] = low
            take = min(k, scores.shape[1])
            # columns are in id order: of equal scores at the cut the first ones stay
            cut = np.partition(scores, -take, axis=1)[:, -take]
            hit_q, hit_d = np.nonzero((scores >= cut[:, None]) & (scores > low) & (scores >= some["least"].to_numpy()[:, None]))
            value = scores[hit_q, hit_d]
            order = np.lexsort((hit_d, -value, hit_q))
            hit_q, hit_d, value = hit_q[order], hit_d[order], value[order]
            first = np.searchsorted(hit_q, hit_q)
            keep = np.arange(len(hit_q)) - first < k
            hit_q, hit_d, value = hit_q[keep], hit_d[keep], value[keep]
            out.append(pd.DataFrame({"query_row": some["row"].to_numpy()[hit_q], "query_id": some["id"].to_numpy()[hit_q],
                                     "vec_id": ids[hit_d], "row": rows[hit_d], "score": value}))
        return pd.concat(out, ignore_index=True) if out else empty

    keys = ["cell", "salt", "part"]
    met = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(
        solve, "query_row long, query_id long, vec_id long, row long, score long")
    best = top_per_group(met, ["query_row"], [F.desc("score"), F.asc("vec_id"), F.asc("row")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
