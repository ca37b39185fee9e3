"""Spans: indexes, statistics, trees.

``spans(name, trace_id, span_id, parent_id, start_time, end_time, duration_ms, attributes, status)``"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written
from tidemark.tables import top_per_group


def _attribute(*names: str) -> Column:
    """The first filled one of several attributes, else ''."""
    return F.coalesce(*[F.nullif(F.try_element_at("attributes", F.lit(n)), F.lit("")) for n in names], F.lit(""))


def is_root() -> Column:
    return F.coalesce("parent_id", F.lit("")) == ""


def is_error() -> Column:
    return F.contains(F.upper(F.coalesce("status", F.lit(""))), F.lit("ERROR"))


def trace_index(spans: DataFrame, question=("city.question", "chat.question"),
                session=("city.session_id", "chat.session_id"), user=("city.user_id",),
                agent: str = "gen_ai.agent.name") -> DataFrame:
    """One row per trace that has a root span (the first one, if several). Everything is a
    partial aggregate, so a huge trace costs its map tasks one row each."""
    root = F.struct("start_time", "end_time", "duration_ms", F.col("name").alias("root_name"),
                    _attribute(*question).alias("question"), _attribute(*session).alias("session_id"),
                    _attribute(*user).alias("user_id"))
    grouped = spans.groupBy("trace_id").agg(
        F.min_by(F.when(is_root(), root), F.when(is_root(), F.struct("start_time", "span_id"))).alias("root"),
        F.array_sort(F.collect_set(F.nullif(_attribute(agent), F.lit("")))).alias("agents"),
        F.count("*").alias("span_count"), F.bool_or(is_error()).alias("has_error"))
    return grouped.where("root is not null").select("trace_id", "root.*", "agents", "span_count", "has_error")


def visible_traces(index: DataFrame, sessions: DataFrame, user: str, session_id: str | None = None) -> DataFrame:
    """Traces of the user's sessions; those without a session are visible to everyone."""
    mine = sessions.where(F.col("user_id") == user).select("session_id").distinct().withColumn("_mine", F.lit(True))
    seen = index.join(mine, "session_id", "left").where("session_id = '' or _mine").drop("_mine")
    if session_id is not None:
        seen = seen.where(F.col("session_id") == session_id)
    return seen.select(*index.columns)


def latest_traces(index: DataFrame, n: int = 50) -> DataFrame:
    """The newest traces, newest first."""
    return index.orderBy(F.desc("start_time"), F.desc("trace_id")).limit(n)


def trace_stats(index: DataFrame) -> DataFrame:
    """One row: count, mean duration (one decimal), errors and calls per agent."""
    calls = (index.select(F.explode("agents").alias("agent")).groupBy("agent").agg(F.count("*").alias("n"))
             # one entry per agent name
             .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", "n")))).alias("agent_calls")))
    totals = index.agg(F.count("*").alias("count"),
                       F.coalesce(F.round(F.avg("duration_ms"), 1), F.lit(0.0)).alias("avg_duration_ms"),
                       F.count_if("has_error").alias("error_count"))
    return totals.withColumn("_k", F.lit(1)).join(calls.withColumn("_k", F.lit(1)), "_k").drop("_k")


def agent_calls(index: DataFrame) -> DataFrame:
    return index.select(F.explode("agents").alias("agent")).groupBy("agent").agg(F.count("*").alias("calls"))


def trace_summary(spans: DataFrame) -> DataFrame:
    """(trace_id, span_count, root_ms, root_names): the names of the first three roots."""
    totals = spans.groupBy("trace_id").agg(
        F.count("*").alias("span_count"),
        F.coalesce(F.sum(F.when(is_root(), F.col("duration_ms"))), F.lit(0.0)).alias("root_ms"))
    first = top_per_group(spans.where(is_root()).select("trace_id", "name", "start_time", "span_id"),
                          ["trace_id"], [F.col("start_time"), F.col("span_id")], 3)
    names = first.groupBy("trace_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), ", ").alias("root_names"))
    return totals.join(names, "trace_id", "left").withColumn("root_names", F.coalesce("root_names", F.lit("")))


def slow_spans(spans: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` longest spans."""
    return spans.orderBy(F.desc("duration_ms"), "start_time", "span_id").limit(k)


def flat_spans(spans: DataFrame) -> DataFrame:
    """All spans by start time (a range sort), with the columns of the flat listing."""
    return spans.select(F.substring("name", 1, 48).alias("name"), F.round("duration_ms", 1).alias("duration_ms"),
                        F.replace("status", F.lit("StatusCode."), F.lit("")).alias("status"),
                        "trace_id", "span_id", "start_time").orderBy("start_time", "span_id")


def span_tree(spans: DataFrame) -> DataFrame:
    """Spans with ``depth``, ``root_id`` and ``path`` (start times and ids from the root down;
    sorting by (trace_id, path) is tree order). A span whose parent is not in its trace is a root.

    Pointer doubling: after round n every span knows its ancestor 2^n levels up, so a tree of
    depth d takes log2(d) joins on the unique key (trace_id, span_id), however large a trace
    is. Each round is written, which keeps the plan short. It ends when no span climbs any more: spans in a cycle never meet
    a root, so they alone stay open, and they come out with depth null."""
    step = F.concat(F.lpad(F.col("start_time").cast("string"), 20, "0"), F.lit(":"), F.col("span_id"))
    ids = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("known"))
    up = F.when(F.col("known"), F.col("parent_id"))
    links = written(
        spans.select("trace_id", "span_id", "parent_id", step.alias("path")).join(ids, ["trace_id", "parent_id"], "left")
        .select("trace_id", "span_id", up.alias("up"), F.when(up.isNull(), 0).otherwise(1).alias("hops"),
                F.col("span_id").alias("top"), "path"), "span-links")
    still = None
    while True:
        open_links = links.where("up is not null")
        before, still = still, open_links.count()
        # a round closes at least one open span unless all of them lead into cycles
        if not still or still == before:
            break
        # only spans that still climb are joined; the others are done
        above = links.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("hops").alias("_hops"),
                             F.col("path").alias("_path"), F.col("top").alias("_top"))
        climbed = open_links.join(above, ["trace_id", "up"]).select(
            "trace_id", "span_id", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops"),
            F.col("_top").alias("top"), F.concat_ws("/", "_path", "path").alias("path"))
        links = written(links.where("up is null").unionByName(climbed), "span-links")
    whole = F.col("up").isNull()
    tree = links.select("trace_id", "span_id", F.when(whole, F.col("hops")).alias("depth"),
                        F.when(whole, F.col("top")).alias("root_id"), F.when(whole, F.col("path")).alias("path"))
    return (spans.select("trace_id", "span_id", "parent_id", "name", "start_time", "duration_ms", "status")
            .join(tree, ["trace_id", "span_id"]))


def tree_lines(tree: DataFrame) -> DataFrame:
    """The printed form of each span: indent, name, duration and any status but OK."""
    status = F.replace("status", F.lit("StatusCode."), F.lit(""))
    indent = F.when(F.col("depth") == 0, "").otherwise(F.concat(F.repeat(F.lit("│  "), F.col("depth") - 1), F.lit("└─ ")))
    tag = F.when(status.isin("OK", "UNSET"), "").otherwise(F.concat(F.lit(" ["), status, F.lit("]")))
    return tree.where("depth is not null").select("trace_id", "path", F.concat(
        indent, "name", F.format_string("  (%.1fms)", "duration_ms"), tag).alias("line"))


def parallelism(spans: DataFrame, task: str = "trace_id") -> DataFrame:
    """(task, wall_ms, longest_ms, ratio) over the sub-task spans given; times in ns."""
    wall = (F.max("end_time") - F.min("start_time")) / F.lit(1e6)
    longest = F.max("duration_ms")
    return spans.groupBy(task).agg(wall.alias("wall_ms"), longest.alias("longest_ms")).withColumn(
        "ratio", F.when(F.col("longest_ms") > 0, F.col("wall_ms") / F.col("longest_ms")).otherwise(1.0))
