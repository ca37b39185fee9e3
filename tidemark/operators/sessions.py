"""Chat sessions, tasks and their token accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.tables import first_per_key, top_per_group

COUNTERS = ("input", "output", "cache_creation", "cache_read", "calls", "time")
UNFINISHED = ("pending", "running")


def token_totals(usage: DataFrame, task: str = "task_id", sub_task: str = "agent") -> DataFrame:
    """The six counters per sub-task, per task and overall in one pass; ``level`` says which."""
    level = F.when(F.grouping(task) == 1, "all").when(F.grouping(sub_task) == 1, "task").otherwise("sub_task")
    return usage.rollup(task, sub_task).agg(
        level.alias("level"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


def estimate_cost(prices: dict[str, float] = vocab.TOKEN_PRICES):
    """Cost of a row's tokens; prices are per million."""
    cost = F.lit(0.0)
    for name, price in prices.items():
        cost = cost + F.col(name) / F.lit(1e6) * F.lit(price)
    return cost


def query_stats(turns: DataFrame, prices: dict[str, float] = vocab.TOKEN_PRICES) -> DataFrame:
    """One row: number of queries, total tokens and total cost."""
    return turns.agg(F.count("*").alias("queries"),
                     F.coalesce(F.sum(F.col("input") + F.col("output")), F.lit(0)).alias("tokens"),
                     F.coalesce(F.sum(estimate_cost(prices)), F.lit(0.0)).alias("cost"))


def session_list(sessions: DataFrame, messages: DataFrame, user: str | None = None, n: int = 50,
                 title_chars: int = 40, default_title: str = "(空会话)") -> DataFrame:
    """The newest ``n`` sessions per user: title, number of user and assistant messages.

    ``sessions(session_id, user_id, title, updated_at)``, ``messages(session_id, position, role, content)``.
    An empty title falls back on the first user message."""
    if user is not None:
        sessions = sessions.where(F.col("user_id") == user)
    newest = top_per_group(sessions, ["user_id"], [F.desc("updated_at"), F.col("session_id")], n)
    asked = F.col("role") == "user"
    counts = messages.groupBy("session_id").agg(
        F.count_if(F.col("role").isin("user", "assistant")).alias("n"),
        F.min_by(F.when(asked, F.substring("content", 1, title_chars)), F.when(asked, F.col("position"))).alias("first"))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("first"), F.lit("")), F.lit(default_title))
    return newest.join(counts, "session_id", "left").select(
        "user_id", "rank", "session_id", title.alias("title"), F.coalesce("n", F.lit(0)).alias("message_count"), "updated_at")


def recent_messages(messages: DataFrame, n: int = 6, chars: int = 300,
                    labels=(("user", "用户"), ("assistant", "助手"))) -> DataFrame:
    """(session_id, text): the last ``n`` user and assistant messages, oldest first, one per line."""
    spoken = messages.where(F.col("role").isin("user", "assistant")).select(
        "session_id", "position", "role", F.substring("content", 1, chars).alias("content"))
    last = top_per_group(spoken, ["session_id"], [F.desc("position")], n)
    label = F.when(F.col("role") == labels[0][0], labels[0][1]).otherwise(labels[1][1])
    line = F.struct("position", F.concat(label, F.lit("："), "content").alias("line"))
    return last.groupBy("session_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(line)), lambda s: s.line), "\n").alias("text"))


def supersede(tasks: DataFrame, session: str = "session_id", start: str = "started_at", task: str = "task_id") -> DataFrame:
    """Tasks with ``is_current`` (the newest of its session) and the status after newer ones
    began: an unfinished older task is superseded. One aggregate per session, joined back."""
    newest = tasks.groupBy(session).agg(F.max_by(task, F.struct(start, task)).alias("_current"))
    current = F.col(task) == F.col("_current")
    old = ~current & F.col("status").isin(*UNFINISHED)
    return (tasks.join(newest, session)
            .withColumn("is_current", current)
            .withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).drop("_current"))


def latest_sub_results(rows: DataFrame, order: str = "finished_at", tie: str = "row_id") -> DataFrame:
    """The latest row per (task_id, agent)."""
    latest = rows.withColumn("_o", F.struct(order, tie))
    rest = [c for c in rows.columns if c not in ("task_id", "agent")]
    return (latest.groupBy("task_id", "agent").agg(F.max_by(F.struct(*rest), "_o").alias("_r"))
            .select("task_id", "agent", "_r.*").select(*rows.columns))


def needs_recheck(sub_results: DataFrame) -> DataFrame:
    """(task_id, all_failed, missing): missing dimensions as ``agent(status)``."""
    done = F.col("status") == "done"
    lack = F.when(~done, F.concat("agent", F.lit("("), "status", F.lit(")")))
    return sub_results.groupBy("task_id").agg((~F.bool_or(done)).alias("all_failed"),
                                              F.array_sort(F.collect_set(lack)).alias("missing"))


def upsert_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions after saving ``new``: title, user and updated_at replaced, created_at kept."""
    old = sessions.select("session_id", *[F.col(c).alias(f"_{c}") for c in ("user_id", "title", "created_at", "updated_at")])
    fresh = F.col("_new").isNotNull()
    joined = new.withColumn("_new", F.lit(True)).join(old, "session_id", "full_outer")
    return joined.select("session_id",
                         F.when(fresh, F.col("user_id")).otherwise(F.col("_user_id")).alias("user_id"),
                         F.when(fresh, F.col("title")).otherwise(F.col("_title")).alias("title"),
                         F.coalesce("_created_at", "created_at").alias("created_at"),
                         F.when(fresh, F.col("updated_at")).otherwise(F.col("_updated_at")).alias("updated_at"))


def replace_messages(messages: DataFrame, saved_sessions: DataFrame, new: DataFrame) -> DataFrame:
    """All messages of the saved sessions are replaced by ``new``."""
    kept = messages.join(saved_sessions.select("session_id").distinct(), "session_id", "left_anti")
    return kept.select(*messages.columns).unionByName(new.select(*messages.columns))


def delete_session(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages without those in ``gone(session_id)``."""
    gone = gone.select("session_id").distinct()
    return (sessions.join(gone, "session_id", "left_anti").select(*sessions.columns),
            messages.join(gone, "session_id", "left_anti").select(*messages.columns))
