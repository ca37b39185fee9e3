"""Node and edge tables built from change events, points and structured policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.text import point_description
from tidemark.operators.spatial import near_pairs
from tidemark.operators.transitions import (boundary_counts, boundary_name, event_member_parts, event_name,
                                            transition_edges)

NODE_COLUMNS = ["name", "entity_type", "description", "source_id"]
EDGE_COLUMNS = ["src", "tgt", "keywords", "description", "weight", "source_id"]


def _nodes(df: DataFrame, entity_type: str, source: str) -> DataFrame:
    return df.select("name", F.lit(entity_type).alias("entity_type"), "description",
                     F.lit(source).alias("source_id"))


def _edges(df: DataFrame, keywords: str, source: str) -> DataFrame:
    return df.select("src", "tgt", F.lit(keywords).alias("keywords"), "description",
                     F.lit(1.0).alias("weight"), F.lit(source).alias("source_id"))


def point_nodes(membership: DataFrame, points: DataFrame, detail: str = "full",
                source: str = "gis_data") -> DataFrame:
    """A node per point that is a member in any year; unknown points keep their id as name."""
    info = (membership.select("point_id").distinct().join(points, "point_id", "left")
            .withColumn("name", F.coalesce("name", "point_id")))
    if detail == "brief":
        text = F.concat(F.lit("地理点: "), F.col("name"), F.lit(", 类型: "), F.coalesce("point_type", F.lit("unknown")))
    else:
        text = point_description()
    return _nodes(info.select("name", text.alias("description")), "Point", source)


def boundary_nodes(years: DataFrame, membership: DataFrame, detail: str = "full",
                   source: str = "gis_data") -> DataFrame:
    if detail == "brief":
        rows = years.select("year").distinct().withColumn("text", F.format_string("%d年的城市边界状态", "year"))
    else:
        rows = boundary_counts(years, membership).withColumn(
            "text", F.format_string("%d年的城市边界状态，边界内共 %d 个点位", "year", "point_count"))
    return _nodes(rows.select(boundary_name(F.col("year")).alias("name"), F.col("text").alias("description")),
                  "Boundary", source)


def event_nodes(events: DataFrame) -> DataFrame:
    """A node per (year, direction) with its size. Who its members are is in ``event_texts``, in the same layout
    for groups of any size, and in the INVOLVES_POINT edges."""
    groups = events.groupBy("year_after", "event_type").agg(F.count("*").alias("total"))
    return _nodes(groups.select(event_name(F.col("year_after"), F.col("event_type")).alias("name"), _event_head().alias("description")),
                  vocab.EVENT_TYPE, "stte_events")


def _event_head():
    side = F.when(F.col("event_type") == "entry", "内").otherwise("外")
    word = F.when(F.col("event_type") == "entry", vocab.ENTER_WORD).otherwise(vocab.EXIT_WORD)
    return F.concat(F.format_string("%d年共有 %d 个点", "year_after", "total"), word, F.lit("边界"), side)


def event_texts(events: DataFrame, names_per_part: int = 1_000) -> DataFrame:
    """(name, part, parts, text): the event's size and all its members' sorted names, ``names_per_part`` to a row."""
    parts = event_member_parts(events, names_per_part)
    return parts.select(event_name(F.col("year_after"), F.col("event_type")).alias("name"), "part", "parts",
                        F.concat(_event_head(), F.lit("："), F.array_join("members", ", ")).alias("text"))


def adjacency_edges(membership: DataFrame, points: DataFrame, km: float = 5.0,
                    source: str = "gis_data") -> DataFrame:
    members = membership.select("point_id").distinct().join(points, "point_id").withColumn(
        "name", F.coalesce("name", "point_id"))
    pairs = near_pairs(members, km, carry="name")
    text = F.concat(F.lit("点'"), "label_a", F.lit("'与点'"), "label_b",
                    F.format_string("'地理相邻（距离 %.2f 公里）", "distance_km"))
    both = F.array(F.struct(F.col("label_a").alias("src"), F.col("label_b").alias("tgt")),
                   F.struct(F.col("label_b").alias("src"), F.col("label_a").alias("tgt")))
    return _edges(pairs.select(F.inline(both), text.alias("description")), vocab.KEYWORDS_ADJACENT, source)


def boundary_edges(events: DataFrame) -> DataFrame:
    """ON_BOUNDARY per event group."""
    boundary = events.select("year_after", "event_type").distinct().select(
        event_name(F.col("year_after"), F.col("event_type")).alias("src"), boundary_name(F.col("year_after")).alias("tgt"),
        F.format_string("该事件发生在%d年城市边界上", "year_after").alias("description"))
    return _edges(boundary, vocab.KEYWORDS_ON_BOUNDARY, "stte_events")


def member_edges(events: DataFrame) -> DataFrame:
    """INVOLVES_POINT per event."""
    members = events.select(event_name(F.col("year_after"), F.col("event_type")).alias("src"), F.col("point_name").alias("tgt"),
                            F.concat(F.lit("事件涉及点'"), "point_name", F.lit("'")).alias("description"))
    return _edges(members, vocab.KEYWORDS_INVOLVES, "stte_events")


def gis_edges(years: DataFrame, membership: DataFrame, points: DataFrame, events: DataFrame, km: float = 5.0,
              source: str = "gis_data", predicates: tuple[str, ...] | None = None) -> DataFrame:
    """The edges of the change graph, or only those of some predicates: what the others need isn't worked out."""
    kinds = {
        "ADJACENT_TO": lambda: adjacency_edges(membership, points, km, source),
        "TRANSITION_FROM": lambda: transition_edges(years).select(*EDGE_COLUMNS[:4], F.lit(1.0).alias("weight"), F.lit(source).alias("source_id")),
        "ON_BOUNDARY": lambda: boundary_edges(events),
        "INVOLVES_POINT": lambda: member_edges(events),
    }
    edges = None
    for kind in kinds if predicates is None else predicates:
        part = kinds[kind]()
        edges = part if edges is None else edges.unionByName(part)
    return edges


def build_gis_graph(years: DataFrame, membership: DataFrame, points: DataFrame, events: DataFrame, km: float = 5.0,
                    detail: str = "full", predicates: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """The change graph: Point, Boundary and event nodes with their four kinds of edges, or with some kinds only.
    ``events`` are enriched events; ``detail="brief"`` gives short descriptions."""
    source = "year_points_data" if detail == "brief" else "gis_data"
    nodes = (point_nodes(membership, points, detail, source)
             .unionByName(boundary_nodes(years, membership, detail, source))
             .unionByName(event_nodes(events)))
    return nodes, gis_edges(years, membership, points, events, km, source, predicates)


def build_policy_graph(policies: DataFrame, goals: DataFrame, measures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``policies(title, abstract)``, ``goals``/``measures(title, description)``."""
    source = "policy_data"
    nodes = _nodes(policies.select(F.col("title").alias("name"), F.coalesce("abstract", F.lit("")).alias("description")),
                   "Policy", source)
    edges = None
    for rows, kind, keywords, text in ((goals, "PolicyGoal", vocab.KEYWORDS_HAS_GOAL, "政策包含目标"),
                                       (measures, "PolicyMeasure", vocab.KEYWORDS_HAS_MEASURE, "政策包含措施")):
        nodes = nodes.unionByName(_nodes(rows.select(F.col("description").alias("name"), "description"), kind, source))
        part = _edges(rows.select(F.col("title").alias("src"), F.col("description").alias("tgt"),
                                  F.lit(text).alias("description")), keywords, source)
        edges = part if edges is None else edges.unionByName(part)
    return nodes, edges
