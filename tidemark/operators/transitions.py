"""Change events from yearly membership: who entered, who left, and how the years chain.

``years(year)`` lists every year present (a year may have no members) and
``membership(year, point_id)`` the members. Adjacent means neighbours in the sorted list
of years present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.text import change_rate
from tidemark.tables import Ordered, in_batches, split_hot_join


def neighbours(years: DataFrame) -> DataFrame:
    """(year, year_before, year_after) over the distinct years present."""
    order = Window.orderBy("year")
    return (years.select(F.col("year").cast("int").alias("year")).dropna().distinct()
            .select("year", F.lag("year").over(order).alias("year_before"),
                    F.lead("year").over(order).alias("year_after")))


def transitions(years: DataFrame, membership: DataFrame) -> DataFrame:
    """(point_id, event_type, year_before, year_after), one shuffle on ``point_id``.

    A point's years are gathered as a set, so duplicate rows of a busy point fold together map-side and its cell
    holds each year once. A year of the set whose predecessor among all years is not in it is an entry; one whose
    successor is not is an exit. Spark broadcasts the distinct years itself where they are few."""
    member = (membership.select(F.col("year").cast("int").alias("year"), "point_id")
              .join(neighbours(years), "year"))
    stay = F.struct("year", "year_before", "year_after")
    seen = member.groupBy("point_id").agg(F.collect_set(stay).alias("stays"))
    present = F.transform("stays", lambda s: s["year"])

    def changes(kind, edge, before, after):
        missing = F.filter("stays", lambda s: s[edge].isNotNull() & ~F.array_contains(present, s[edge]))
        return F.transform(missing, lambda s: F.struct(
            F.lit(kind).alias("event_type"), s[before].alias("year_before"), s[after].alias("year_after")))

    both = F.concat(changes("entry", "year_before", "year_before", "year"),
                    changes("exit", "year_after", "year", "year_after"))
    return seen.select("point_id", F.inline(both))


def entered(years: DataFrame, membership: DataFrame) -> DataFrame:
    return transitions(years, membership).where("event_type = 'entry'").select("year_after", "point_id")


def exited(years: DataFrame, membership: DataFrame) -> DataFrame:
    return transitions(years, membership).where("event_type = 'exit'").select("year_after", "point_id")


def points_ever_seen(membership: DataFrame) -> DataFrame:
    return membership.select("point_id").distinct()


def enrich_events(events: DataFrame, points: DataFrame) -> DataFrame:
    """Transitions to full event rows. Ids are a hash of (type, year, point): the same
    input gives the same ids."""
    info = points.select("point_id", F.col("name").alias("_name"), "lon", "lat",
                         F.col("point_type").alias("_type"))
    entry = F.col("event_type") == "entry"
    name = F.coalesce("_name", "point_id")
    sides = [F.when(entry, a).otherwise(b) for a, b in (("outside", "inside"), ("inside", "outside"))]
    words = [F.when(entry, a).otherwise(b) for a, b in (("外部", "内部"), ("内部", "外部"))]
    key = F.concat_ws("|", "event_type", F.col("year_after").cast("string"), "point_id")
    return events.join(info, "point_id", "left").select(
        F.concat(F.lit("stte_"), F.substring(F.sha2(key, 256), 1, 16)).alias("event_id"),
        "event_type",
        F.make_date("year_after", F.lit(1), F.lit(1)).alias("event_date"),
        F.concat(F.col("year_after").cast("string"), F.lit(vocab.YEAR_MARK)).alias("label"),
        "point_id", name.alias("point_name"),
        F.concat(F.lit("boundary_"), F.col("year_before").cast("string")).alias("boundary_before"),
        F.concat(F.lit("boundary_"), F.col("year_after").cast("string")).alias("boundary_after"),
        sides[0].alias("relation_before"), sides[1].alias("relation_after"),
        F.when(entry, "high").otherwise("medium").alias("significance"),
        F.concat(F.lit("点'"), name, F.lit("'在"), F.col("year_before").cast("string"), F.lit("年位于边界"), words[0],
                 F.lit("，"), F.col("year_after").cast("string"), F.lit("年变为边界"), words[1]).alias("description"),
        "lon", "lat", F.coalesce("_type", F.lit("unknown")).alias("point_type"),
        "year_before", "year_after")


def event_by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.where(F.col("event_id") == event_id)


def events_by_type(events: DataFrame, event_type: str) -> DataFrame:
    return events.where(F.col("event_type") == event_type)


def event_name(year: Column, event_type: Column) -> Column:
    word = F.when(event_type == "entry", vocab.ENTER_WORD).otherwise(vocab.EXIT_WORD)
    return F.concat(year.cast("string"), F.lit(vocab.YEAR_MARK), word, F.lit(vocab.EVENT_WORD))


def boundary_name(year: Column) -> Column:
    return F.concat(year.cast("string"), F.lit(vocab.YEAR_MARK + vocab.BOUNDARY_WORD))


def event_groups(events: DataFrame) -> DataFrame:
    """Events of one year and direction as one row with a count; the names are in
    ``event_member_parts``."""
    return (events.groupBy("year_after", "event_type").agg(F.count("*").alias("member_count"))
            .withColumn("name", event_name(F.col("year_after"), F.col("event_type"))))


def event_member_parts(events: DataFrame, part_size: int = 1_000) -> DataFrame:
    """(year_after, event_type, part, parts, total, members): sorted names, ``part_size``
    to a row, in order from part to part."""
    return in_batches(events, ["year_after", "event_type"], "point_name", part_size, "members")


def boundary_counts(years: DataFrame, membership: DataFrame) -> DataFrame:
    """Members per year, listed duplicates included, years without members as 0."""
    counts = membership.groupBy("year").agg(F.count("point_id").alias("n"))
    return (years.select("year").distinct().join(counts, "year", "left")
            .select("year", F.coalesce("n", F.lit(0)).alias("point_count")))


def transition_edges(years: DataFrame) -> DataFrame:
    """Each year's boundary to that of the year before it."""
    before, after = F.col("year_before"), F.col("year")
    return neighbours(years).where("year_before is not null").select(
        boundary_name(after).alias("src"), boundary_name(before).alias("tgt"),
        F.format_string("从%d年边界转换到%d年边界", before, after).alias("description"),
        F.lit(vocab.KEYWORDS_TRANSITION).alias("keywords"))


def boundary_changes(boundaries: DataFrame) -> DataFrame:
    """Area change against the previous state; one row per year, so one small window."""
    order = Window.orderBy("year")
    change = F.col("area_km2") - F.col("previous_area")
    return (boundaries.select("year", "area_km2", F.lag("year").over(order).alias("previous_year"),
                              F.lag("area_km2").over(order).alias("previous_area"))
            .where("previous_year is not null")
            .select("previous_year", "year", "previous_area", "area_km2",
                    change.alias("area_change"),
                    change_rate(change, F.col("previous_area")).alias("change_rate"),
                    F.when(change > 0, "expansion").when(change < 0, "contraction")
                    .otherwise("restructuring").alias("change_type")))


def cluster_stats(events: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Count, dominant type (the first seen wins a tie) and time span per cluster."""
    kinds = events.groupBy(key, "event_type").agg(
        F.count("*").alias("n"), F.min(F.struct(time, tie)).alias("first_seen"),
        F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    return kinds.groupBy(key).agg(
        F.sum("n").alias("event_count"),
        F.min_by("event_type", F.struct(-F.col("n"), "first_seen")).alias("dominant_type"),
        F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))


def event_sequence(events: DataFrame, key: str, time: str, tie: str, **options) -> DataFrame:
    """Events numbered in time order within their sequence."""
    return Ordered(events, [key], [time, tie], **options).row_number("position").result()


def temporal_relation(a_start, a_end, b_start, b_end) -> Column:
    """Label of period a against period b; a period that starts or ends with the other is
    starts or finishes, one that lies strictly inside is during."""
    a0, a1, b0, b1 = (F.col(c) if isinstance(c, str) else c for c in (a_start, a_end, b_start, b_end))
    return (F.when((a0 == b0) & (a1 == b1), "equals").when(a1 < b0, "before").when(a0 > b1, "after")
            .when(a1 == b0, "meets").when((a0 == b0) & (a1 < b1), "starts").when((a1 == b1) & (a0 > b0), "finishes")
            .when((a0 > b0) & (a1 < b1), "during").otherwise("overlaps"))


def touching_periods(a: DataFrame, b: DataFrame, bucket_days: int = 30) -> DataFrame:
    """(a_id, b_id, relation) for every pair of periods that share at least one moment.

    Periods (id, start, end) are laid into buckets of ``bucket_days`` and meet in an equi-join;
    a pair counts in the first bucket both have. (The pairs that do not touch are before or
    after each other: ``temporal_relation`` labels those without a join.)"""
    width = bucket_days * 86_400

    def laid(df, side):
        low, high = (F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / width) for c in ("start", "end"))
        return df.select(F.col("id").alias(f"{side}_id"), F.col("start").alias(f"{side}_start"),
                         F.col("end").alias(f"{side}_end"), low.alias(f"{side}_low"),
                         F.explode(F.sequence(low, high)).alias("bucket"))
    pairs = split_hot_join(laid(a, "a"), laid(b, "b"), ["bucket"], ["a_id"])
    pairs = pairs.where((F.col("bucket") == F.greatest("a_low", "b_low"))
                        & (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")))
    return pairs.select("a_id", "b_id", temporal_relation("a_start", "a_end", "b_start", "b_end").alias("relation"))
