"""Points in boundaries and points near points, as equi-joins on grid cells."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import EARTH_RADIUS_KM, KM_PER_DEGREE, haversine_km, inside_edges, ring_edges
from tidemark.session import written
from tidemark.tables import matrix_join

FINEST_LEVEL = 24


#: rounds in which every border cell is cut into four, and further rounds for cells that still have many edges
SURE_ROUNDS, MORE_ROUNDS, FEW_EDGES = 2, 4, 32
SLACK = 1e-9


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value * F.pow(F.lit(2.0), level) / 360.0)


def _clip(level: int, cx: int, cy: int, edges: np.ndarray, passed: int) -> tuple | None:
    """The cell with the edges (x1, y1, x2, y2) that its points need: those of its latitudes that aren't west of it. An edge east
    of the cell that spans all its latitudes is crossed by every ray and only counted (``passed``). If no edge comes near, the
    whole cell is inside or outside: an inner cell loses its edges, an outer cell is None."""
    size = 360.0 / 2.0 ** level
    west, south, east, north = cx * size - SLACK, cy * size - SLACK, (cx + 1) * size + SLACK, (cy + 1) * size + SLACK
    x_low, x_high = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
    y_low, y_high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    needed = (y_high >= south) & (y_low <= north) & (x_high >= west)
    spans = needed & (x_low > east) & (y_low < south) & (y_high > north)
    passed += int(spans.sum())
    near = bool((needed & (x_low <= east)).any())
    edges = edges[needed & ~spans]
    if not near:
        y = (cy + 0.5) * size  # all of them are east of the cell
        passed += int(((edges[:, 1] > y) != (edges[:, 3] > y)).sum())
        return (level, cx, cy, edges[:0], passed) if passed % 2 else None
    return level, cx, cy, edges, passed


def _cover(edges: np.ndarray) -> list[tuple]:
    """Cells of one boundary."""
    if not len(edges):
        return []
    (x0, y0), (x1, y1) = edges[:, :2].min(axis=0), edges[:, :2].max(axis=0)
    span = max(x1 - x0, y1 - y0)
    level = max(0, min(FINEST_LEVEL, math.floor(math.log2(720.0 / span)))) if span > 0 else FINEST_LEVEL
    size = 360.0 / 2.0 ** level
    cells = [(level, cx, cy, edges, 0) for cx in range(math.floor(x0 / size), math.floor(x1 / size) + 1)
             for cy in range(math.floor(y0 / size), math.floor(y1 / size) + 1)]
    cells = [c for c in (_clip(*c) for c in cells) if c]
    for cut in range(SURE_ROUNDS + MORE_ROUNDS):
        few, after = 0 if cut < SURE_ROUNDS else FEW_EDGES, []
        for cell in cells:
            level, cx, cy, mine, passed = cell
            if len(mine) <= few or level >= FINEST_LEVEL:
                after.append(cell)
            else:
                quarters = (_clip(level + 1, 2 * cx + x, 2 * cy + y, mine, passed) for x in (0, 1) for y in (0, 1))
                after += [q for q in quarters if q]
        cells = after
    return cells


def _covers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edge = pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten()
        corners = np.stack([np.asarray(c, dtype=np.float64) for c in flat.flatten()], axis=1) if len(flat) else np.zeros((0, 4))
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
        for row, end in enumerate(ends):
            cells = _cover(corners[ends[row - 1] if row else 0:end])
            for at in range(0, len(cells), 1000):
                level, cx, cy, edges, passed = zip(*cells[at:at + 1000])
                kept = np.concatenate(edges)
                offsets = pa.array(np.cumsum([0] + [len(e) for e in edges]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([row] * len(level))), pa.array(level, pa.int32()), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(kept[:, c]) for c in range(4)], fields=list(edge))),
                     pa.array(passed, pa.int32())], names=["year", "level", "cx", "cy", "edges", "passed"])


def boundary_cells(boundaries: DataFrame) -> DataFrame:
    """(year, level, cx, cy, edges, passed): each boundary as cells of a quadtree. Inner cells have no edges and are as large
    as they can be, border cells have the few edges that decide for their points.

    A boundary begins with at most 3x3 cells over its bounding box; border cells are cut into four, again where many edges
    are left."""
    shapes = boundaries.select("year", ring_edges(F.col("rings")).alias("edges"))
    edge = "struct<x1: double, y1: double, x2: double, y2: double>"
    shapes = shapes.select("year", F.col("edges").cast(f"array<{edge}>").alias("edges"))
    return shapes.mapInArrow(_covers, f"year {boundaries.schema['year'].dataType.simpleString()}, level int, cx bigint, cy bigint, "
                                      f"edges array<{edge}>, passed int")


def points_in_boundaries(points: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(year, point_id) for points strictly inside the boundary ``rings`` of a year.

    An equi-join on quadtree cells: a point has one cell per level in use. In inner cells of a boundary it needs no further
    test, in border cells the edges nearby decide. A cell with very many points is cut over several tasks."""
    covered = written(boundary_cells(boundaries), "boundary-cells")
    # the levels in use are at most FINEST_LEVEL + 1 integers
    levels = sorted(row.level for row in covered.select("level").distinct().collect())
    located = (points.select("point_id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
               .where("lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)")
               .withColumn("level", F.explode(F.lit(levels).cast("array<int>")))
               .withColumn("cx", _cell(F.col("lon"), F.col("level")))
               .withColumn("cy", _cell(F.col("lat"), F.col("level"))))
    inner = (F.size("edges") == 0)
    return (matrix_join(located, covered, ["level", "cx", "cy"])
            .where(inner | inside_edges(F.col("edges"), F.col("lon"), F.col("lat"), F.col("passed")))
            .select("year", "point_id"))


def near_pairs(points: DataFrame, km: float = 5.0, rows_per_task: int = 4096, carry: str = "point_id") -> DataFrame:
    """Pairs ``id_a < id_b`` closer than ``km`` (strict), with ``distance_km`` and the column
    ``carry`` of both as ``label_a`` and ``label_b``.

    Latitude bands are ``km`` high; each band has its own number of longitude cells at
    least ``km`` wide. A point looks into the cells its reach touches in the three bands
    around it, across the date line and, near a pole, across the whole band. Cells with
    more than ``rows_per_task`` points are split: one side hashed, the other repeated."""
    step = km / KM_PER_DEGREE
    reach = math.degrees(km / EARTH_RADIUS_KM)
    top = math.floor(90.0 / step)

    def lon_cells(band: Column) -> Column:
        # the parallel nearest to the pole decides, so no cell is narrower than km
        edge = F.least(F.abs(band * step), F.abs((band + 1) * step))
        edge = F.when(band * (band + 1) <= 0, F.lit(0.0)).otherwise(edge)
        narrowest = F.cos(F.radians(F.least(F.abs(edge) + step, F.lit(90.0))))
        return F.greatest(F.lit(1), F.floor(F.lit(360.0 / step) * narrowest).cast("int"))

    def lon_cell(lon: Column, count: Column) -> Column:
        return F.floor((lon + 180.0) / (F.lit(360.0) / count))

    base = (points.where("lon is not null and lat is not null")
            .select("point_id", F.col(carry).alias("label"), "lon", "lat",
                    F.floor(F.col("lat") / step).cast("int").alias("band"))
            .withColumn("cells", lon_cells(F.col("band")))
            .withColumn("cell", F.pmod(lon_cell(F.col("lon"), F.col("cells")), F.col("cells")).cast("int")))

    # only crowded cells are kept: at most rows / rows_per_task of them
    crowded = (base.groupBy("band", "cell").count().where(F.col("count") > rows_per_task)
               .select("band", "cell", F.ceil(F.col("count") / rows_per_task).cast("int").alias("splits")))
    if crowded.isEmpty():
        def with_splits(df):
            return df.withColumn("splits", F.lit(1))
    else:
        crowded = written(crowded, "crowded-cells")

        def with_splits(df):
            return df.join(crowded, ["band", "cell"], "left").withColumn("splits", F.coalesce("splits", F.lit(1)))

    homes = (with_splits(base)
             .withColumn("salt", F.pmod(F.xxhash64("point_id"), F.col("splits")).cast("int"))
             .select("band", "cell", "salt", F.col("point_id").alias("id_b"), F.col("label").alias("label_b"),
                     F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b")))

    # how far in longitude the circle of radius km reaches at this latitude
    ratio = F.sin(F.lit(math.radians(reach))) / F.cos(F.radians("lat"))
    touches_pole = F.abs(F.col("lat")) + reach >= 90.0
    # a hair of slack: the exact distance test decides
    width = F.when(touches_pole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), ratio))) + 1e-9)
    looks = (base.withColumn("width", width)
             .withColumn("band", F.explode(F.sequence(
                 F.greatest(F.col("band") - 1, F.lit(-top - 1)), F.least(F.col("band") + 1, F.lit(top)))))
             .withColumn("cells", lon_cells(F.col("band"))))
    first = lon_cell(F.col("lon") - F.col("width"), F.col("cells"))
    last = F.least(lon_cell(F.col("lon") + F.col("width"), F.col("cells")), first + F.col("cells") - 1)
    looks = (looks.withColumn("_at", F.explode(F.sequence(first, last)))
             .withColumn("cell", F.pmod("_at", F.col("cells")).cast("int")))
    looks = (with_splits(looks)
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
             .select("band", "cell", "salt", F.col("point_id").alias("id_a"), F.col("label").alias("label_a"),
                     F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a")))
    distance = haversine_km("lon_a", "lat_a", "lon_b", "lat_b")
    return (looks.join(homes, ["band", "cell", "salt"])
            # the cheap test on latitude spares the trigonometry for a third of the candidates
            .where((F.col("id_a") < F.col("id_b")) & (F.abs(F.col("lat_a") - F.col("lat_b")) <= reach * (1 + 1e-9)))
            .select("id_a", "id_b", "label_a", "label_b", distance.alias("distance_km"))
            .where(F.col("distance_km") < km))


def adjacent_points(points: DataFrame, km: float = 5.0, **options) -> DataFrame:
    """``near_pairs`` in both directions: (src_id, tgt_id, distance_km)."""
    pairs = near_pairs(points, km, **options)
    both = F.array(F.struct(F.col("id_a").alias("src_id"), F.col("id_b").alias("tgt_id")),
                   F.struct(F.col("id_b").alias("src_id"), F.col("id_a").alias("tgt_id")))
    return pairs.select(F.inline(both), "distance_km")
