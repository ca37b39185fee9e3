"""Time series, comparisons and summaries over enriched events, as evidence rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.text import point_description
from tidemark.operators.transitions import boundary_counts, boundary_name
from tidemark.tables import Ordered, in_batches, top_per_group

METRICS = ("boundary_points", "entries", "exits", "net_change", "point_type_distribution")


def year_changes(years: DataFrame, membership: DataFrame, events: DataFrame,
                 first: int | None = None, last: int | None = None) -> DataFrame:
    """(year, point_count, entries, exits, net_change) for every year that has a boundary."""
    counts = boundary_counts(years, membership)
    if first is not None:
        counts = counts.where(F.col("year").between(first, last))
    changes = events.groupBy(F.col("year_after").alias("year")).agg(
        F.count_if(F.col("event_type") == "entry").alias("entries"),
        F.count_if(F.col("event_type") == "exit").alias("exits"))
    zero = F.lit(0)
    return (counts.join(changes, "year", "left")
            .select("year", "point_count", F.coalesce("entries", zero).alias("entries"),
                    F.coalesce("exits", zero).alias("exits"))
            .withColumn("net_change", F.col("entries") - F.col("exits")))


def type_distribution(years: DataFrame, points: DataFrame, events: DataFrame,
                      first: int | None = None, last: int | None = None) -> DataFrame:
    """(year, land_use_code, n) of the points that entered."""
    came = events.where("event_type = 'entry'").select(F.col("year_after").alias("year"), "point_id")
    if first is not None:
        came = came.where(F.col("year").between(first, last))
    came = came.join(F.broadcast(years.select("year").distinct()), "year", "left_semi")
    code = F.coalesce(F.nullif(F.col("land_use_code"), F.lit("")), F.lit("unknown"))
    return (came.join(points.select("point_id", "land_use_code"), "point_id", "left")
            .groupBy("year", code.alias("land_use_code")).agg(F.count("*").alias("n")))


def _distribution_text(distribution: DataFrame) -> DataFrame:
    pair = F.concat("land_use_code", F.lit(":"), F.col("n").cast("string"))
    return distribution.groupBy("year").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("land_use_code", pair.alias("p")))),
                                 lambda s: s.p), ", ").alias("text"),
        F.sum("n").alias("total"))


def time_series(years: DataFrame, membership: DataFrame, points: DataFrame, events: DataFrame,
                metric: str, first: int, last: int, preview: int = 5) -> DataFrame:
    """(year, value, line): one row per year with a boundary; ``line`` is the evidence text."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    rows = year_changes(years, membership, events, first, last)
    head = F.format_string("(%d年) " + metric + "=%d", "year", "value")
    if metric == "boundary_points":
        return rows.select("year", F.col("point_count").alias("value")).withColumn("line", head)
    if metric == "net_change":
        return rows.select("year", F.col("net_change").alias("value")).withColumn("line", head)
    if metric == "point_type_distribution":
        texts = _distribution_text(type_distribution(years, points, events, first, last))
        return rows.select("year").join(texts, "year", "left").select(
            "year", F.coalesce("total", F.lit(0)).alias("value"),
            F.concat(F.format_string("(%d年, 共%d个) ", "year", F.coalesce("total", F.lit(0))),
                     F.coalesce("text", F.lit(vocab.NONE_WORD))).alias("line"))
    kind = "entry" if metric == "entries" else "exit"
    some = top_per_group(events.where(F.col("event_type") == kind)
                         .select(F.col("year_after").alias("year"), "point_name"),
                         ["year"], [F.col("point_name")], preview)
    names = some.groupBy("year").agg(F.array_join(F.array_sort(F.collect_list("point_name")), ", ").alias("names"))
    more = F.when(F.col("value") > preview, F.format_string(" 等%d个", "value")).otherwise("")
    return (rows.select("year", F.col(metric).alias("value")).join(names, "year", "left")
            .select("year", "value", F.concat(head, F.coalesce(F.concat(F.lit(" → "), "names", more), F.lit("")))
                    .alias("line")))


def compare_periods(years: DataFrame, membership: DataFrame, points: DataFrame, events: DataFrame,
                    year_a: int, year_b: int, names_per_line: int = 1000) -> DataFrame:
    """(line_no, line): counts, member names and entry types of two years side by side, or
    one line naming the years that are missing. A long name list goes over several lines."""
    asked = years.sparkSession.createDataFrame([(1, year_a), (2, year_b)], "slot int, year int")
    have = asked.join(years.select(F.col("year").cast("int").alias("year")).distinct(), "year", "left_semi")
    missing = asked.join(have, ["slot", "year"], "left_anti")
    absent = missing.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "year"))),
                                                  lambda s: s.year.cast("string")), ", ").alias("names"))
    absent = absent.where("names <> ''").select(
        F.lit(0).alias("block"), F.lit(0).alias("slot"), F.lit(0).alias("part"),
        F.concat(F.lit("(缺少年份数据: "), "names", F.lit(")")).alias("text"))
    # both years or nothing: drop the answer if a year is missing
    have = have.join(missing.select(F.lit(1).alias("_gone")), F.lit(True), "left_anti")
    changes = year_changes(years, membership, events)
    counts = have.join(changes, "year").select(
        F.lit(1).alias("block"), "slot", F.lit(0).alias("part"),
        F.format_string("(%d年) 进入=%d, 退出=%d, 净变化=%+d, 边界内=%d个点",
                        "year", "entries", "exits", "net_change", "point_count").alias("text"))

    def listed(kind, block, title):
        mine = events.where(F.col("event_type") == kind).select(F.col("year_after").alias("year"), "point_name")
        parts = in_batches(mine.join(F.broadcast(have), "year"), ["year", "slot"], "point_name", names_per_line, "names")
        rows = have.join(parts.select("year", "part", "names"), "year", "left")
        return rows.select(F.lit(block).alias("block"), "slot", F.coalesce("part", F.lit(0)).alias("part"),
                           F.concat(F.format_string(f"(%d年{title}) ", "year"),
                                    F.coalesce(F.array_join("names", ", "), F.lit(vocab.NONE_WORD))).alias("text"))

    types = _distribution_text(type_distribution(years, points, events))
    typed = have.join(types, "year", "left").select(
        F.lit(3).alias("block"), "slot", F.lit(0).alias("part"),
        F.concat(F.format_string("(%d年进入类型) ", "year"), F.coalesce("text", F.lit(vocab.NONE_WORD))).alias("text"))
    lines = (absent.unionByName(counts).unionByName(listed("entry", 2, "进入点位")).unionByName(typed))
    # six lines and one more per thousand names: small enough for one window
    order = lines.withColumn("line_no", F.row_number().over(Window.orderBy("block", "slot", "part")))
    number = F.when(F.col("block") == 0, "").otherwise(F.format_string("[E%d] ", "line_no"))
    return order.select("line_no", F.concat(number, "text").alias("line"))


def year_summary(years: DataFrame, membership: DataFrame, points: DataFrame, events: DataFrame,
                 year: int) -> DataFrame:
    """(line_no, line) of one year: the boundary, then all points entered, then all left."""
    counts = boundary_counts(years, membership).where(F.col("year") == year)
    boundary = counts.select(
        F.lit(0).alias("block"), F.lit("").alias("point_name"), F.lit("").alias("point_id"),
        F.concat(F.lit("(Boundary) "), boundary_name(F.col("year")),
                 F.format_string(" — %d年的城市边界状态，边界内共 %d 个点位", "year", "point_count")).alias("text"))
    label = F.when(F.col("event_type") == "entry", "(Point/进入) ").otherwise("(Point/退出) ")
    text = points.select("point_id", point_description().alias("description"))
    members = (events.where(F.col("year_after") == year).select("point_id", "point_name", "event_type")
               .join(text, "point_id", "left")
               .select(F.when(F.col("event_type") == "entry", 1).otherwise(2).alias("block"), "point_name", "point_id",
                       F.concat(label, "point_name", F.lit(" — "),
                                F.coalesce("description", F.lit(vocab.DEFAULT_POINT_TEXT))).alias("text")))
    lines = boundary.unionByName(members).withColumn("_all", F.lit(1))
    numbered = Ordered(lines, ["_all"], ["block", "point_name", "point_id"]).row_number("line_no").result()
    return numbered.select("line_no", F.concat(F.format_string("[E%d] ", "line_no"), "text").alias("line"))


def timeline(years: DataFrame, membership: DataFrame, points: DataFrame, events: DataFrame, first: int, last: int,
             entered: int = 3, left: int = 2, chars: int = 100) -> DataFrame:
    """(line_no, year, line): counts per year with the first few points of each direction."""
    rows = year_changes(years, membership, events, first, last)
    heads = rows.select("year", F.lit(0).alias("block"), F.lit(0).alias("rank"), F.format_string(
        "(Boundary/%d年) 边界内%d个点, 进入%d, 退出%d", "year", "point_count", "entries", "exits").alias("text"))
    some = top_per_group(events.where(F.col("year_after").between(first, last))
                         .select(F.col("year_after").alias("year"), "event_type", "point_name", "point_id"),
                         ["year", "event_type"], [F.col("point_name"), F.col("point_id")], max(entered, left))
    some = some.where(F.when(F.col("event_type") == "entry", F.col("rank") <= entered).otherwise(F.col("rank") <= left))
    text = points.select("point_id", F.substring(point_description(), 1, chars).alias("description"))
    entry = F.col("event_type") == "entry"
    details = some.join(text, "point_id", "left").select(
        "year", F.when(entry, 1).otherwise(2).alias("block"), "rank",
        F.concat(F.when(entry, "(Point/进入/").otherwise("(Point/退出/"), F.format_string("%d年) ", "year"),
                 "point_name", F.lit(" — "), F.coalesce("description", F.lit(vocab.DEFAULT_POINT_TEXT))).alias("text"))
    # a handful of lines per calendar year
    numbered = heads.unionByName(details).withColumn(
        "line_no", F.row_number().over(Window.orderBy("year", "block", "rank")))
    return numbered.select("line_no", "year", F.concat(F.format_string("[E%d] ", "line_no"), "text").alias("line"))
