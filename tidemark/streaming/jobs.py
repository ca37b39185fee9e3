"""Structured Streaming forms of the incremental behaviours.

Rows of one key and micro-batch are put in order before they touch the state; the
trigger's file or offset limit bounds them. State per key is small and fixed in size."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import vocab
from tidemark.functions.text import extract_topics, normalize_question
from tidemark.operators.chunking import chunk_text
from tidemark.operators.sessions import estimate_cost
from tidemark.operators.traces import _attribute, is_error, is_root
from tidemark.operators.transitions import transitions
from tidemark.sources.stores import new_files, read_ledger, read_or_empty, write_chunks


def _stateful(df: DataFrame, key: str, fn, output: str, state: str, mode: str,
              timeout: str = GroupStateTimeout.NoTimeout) -> DataFrame:
    return df.groupBy(key).applyInPandasWithState(fn, output, state, mode, timeout)


def _in_order(batches, *order: str) -> pd.DataFrame:
    frames = list(batches)
    return pd.concat(frames).sort_values(list(order)) if frames else pd.DataFrame()


def stream_import(files: DataFrame, store: str, checkpoint: str, size: int = 700, overlap: int = 80, **trigger) -> StreamingQuery:
    """Import (path, source, text) rows into a chunk store: a content hash is processed once. Chunks and ledger are published
    by one commit, so a batch that is run again finds its files in the ledger, or nothing of itself."""
    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        hashed = batch.withColumn("hash", F.md5(F.encode("text", "UTF-8")))
        hashed = hashed.groupBy("hash").agg(F.min_by(F.struct("path", "source", "text"), "path").alias("f")).select("hash", "f.*")
        fresh = new_files(hashed, read_ledger(spark, store)).persist()
        try:
            write_chunks(chunk_text(fresh.select("source", "text"), size, overlap), store, files=fresh)
        finally:
            fresh.unpersist()
    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


INDEX = ("trace_id string, start_time bigint, end_time bigint, duration_ms double, root_name string, question string, "
         "session_id string, user_id string, agents array<string>, span_count bigint, has_error boolean")
ROOT_FIELDS = ("start_time", "end_time", "duration_ms", "root_name", "question", "session_id", "user_id")


def _root_order(root: str) -> tuple:
    """The first root span by start and id; those without come last."""
    fields = json.loads(root)
    start, span = fields.get("start_time"), fields.get("span_id")
    return start is None, start or 0, span is None, span or ""


def stream_trace_index(spans: DataFrame, event_time: str = "ts", late: str = "1 hour") -> DataFrame:
    """One index row per trace when its root span arrives, over the spans seen so far. Later
    roots of the trace are ignored. The watermark on ``event_time`` lets old traces go."""
    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        indexed, count, error, agents = state.get if state.exists else (False, 0, False, "")
        names, roots, latest = set(filter(None, agents.split("\n"))), [], 0
        for rows in batches:
            count += len(rows)
            for span in rows["span"]:
                facts, _, root = span.rpartition("\n")
                at, _, agent = facts[1:].partition(" ")
                error, latest = error or facts[0] == "E", max(latest, int(at or 0))
                if agent:
                    names.add(agent)
                if root:
                    roots.append(root)
        emit = bool(roots) and not indexed
        state.update((indexed or emit, count, error, "\n".join(sorted(names))))
        deadline = max(latest, state.getCurrentWatermarkMs()) + 1
        state.setTimeoutTimestamp(deadline)
        if emit:
            root = roots[0] if len(roots) == 1 else min(roots, key=_root_order)
            found = json.dumps({"trace_id": key[0], "agents": sorted(names), "span_count": count, "has_error": error})
            yield pd.DataFrame({"found": [f'{found[:-1]}, "root": {root}}}']})

    # pandas makes a frame for every trace, and its time goes by columns: a span is one text of a mark for an error, its
    # time, its agent and, in a last line, the JSON of what the index shows of a root
    root = F.struct("start_time", "span_id", "end_time", "duration_ms", F.col("name").alias("root_name"),
                    _attribute("city.question", "chat.question").alias("question"),
                    _attribute("city.session_id", "chat.session_id").alias("session_id"), _attribute("city.user_id").alias("user_id"))
    span = F.concat(F.when(is_error(), "E").otherwise(" "), F.coalesce(F.unix_millis(event_time).cast("string"), F.lit("")), F.lit(" "),
                    _attribute("gen_ai.agent.name"), F.lit("\n"), F.when(is_root(), F.to_json(root)).otherwise(""))
    rows = spans.withWatermark(event_time, late).select("trace_id", event_time, span.alias("span"))
    found = _stateful(rows, "trace_id", step, "found string", "indexed boolean, count bigint, error boolean, agents string",
                      "append", GroupStateTimeout.EventTimeTimeout)
    kinds = dict(field.split() for field in INDEX.split(", "))
    shown = ", ".join(f"{c}:{kinds[c]}" for c in ROOT_FIELDS)
    index = found.select(F.from_json("found", f"trace_id string, root struct<{shown}>, agents array<string>, "
                                              "span_count bigint, has_error boolean").alias("i"))
    return index.select(*[F.col(f"i.root.{c}" if c in ROOT_FIELDS else f"i.{c}").alias(c) for c in kinds])


def stream_questions(questions: DataFrame, cap: int = 50, chars: int = 200, **topics) -> DataFrame:
    """Per user, after each batch: the last ``cap`` questions without repeats, the total and
    the topic counts. ``questions(user_id, position, question)``; use update mode."""
    def step(key, batches, state: GroupState):
        kept, total, counts = state.get if state.exists else ("[]", 0, "{}")
        kept, counts = json.loads(kept), json.loads(counts)
        for row in _in_order(batches, "position").itertuples():
            total += 1
            if not kept or kept[-1][1] != row.norm:
                kept = (kept + [[row.short, row.short_norm]])[-cap:]
            for topic in row.topics:
                counts[topic] = counts.get(topic, 0) + 1
        state.update((json.dumps(kept), total, json.dumps(counts)))
        yield pd.DataFrame([{"user_id": key[0], "recent": [q for q, _ in kept], "total": total,
                             "topics": [{"topic": t, "n": n} for t, n in counts.items()]}])

    short = F.substring("question", 1, chars)
    rows = questions.select("user_id", "position", short.alias("short"), normalize_question(short).alias("short_norm"),
                            normalize_question("question").alias("norm"), extract_topics("question", **topics).alias("topics"))
    kind = questions.schema["user_id"].dataType.simpleString()
    return _stateful(rows, "user_id", step,
                     f"user_id {kind}, recent array<string>, total bigint, topics array<struct<topic:string,n:bigint>>",
                     "kept string, total bigint, counts string", "update")


def profile_due(questions: DataFrame, first: int = 5, every: int = 10) -> DataFrame:
    """(user_id, total): when a user's profile should be worked out, at ``first`` questions and
    then after each ``every`` more."""
    def step(key, batches, state: GroupState):
        total, done = state.get if state.exists else (0, 0)
        due = []
        for rows in batches:
            for _ in range(len(rows)):
                total += 1
                if total >= first and (done == 0 or total - done >= every):
                    done = total
                    due.append({"user_id": key[0], "total": total})
        state.update((total, done))
        yield pd.DataFrame(due, columns=["user_id", "total"])
    kind = questions.schema["user_id"].dataType.simpleString()
    return _stateful(questions.select("user_id"), "user_id", step, f"user_id {kind}, total bigint",
                     "total bigint, done bigint", "append")


def stream_notes(notes: DataFrame, cap: int = 100, chars: int = 500, compact_above: int = 60) -> DataFrame:
    """Per user, after each batch: the newest ``cap`` notes and whether they need compaction.
    ``notes(user_id, position, note)``; use update mode."""
    def step(key, batches, state: GroupState):
        kept = json.loads(state.get[0]) if state.exists else []
        kept = (kept + [n.strip()[:chars] for n in _in_order(batches, "position")["note"] if n and n.strip()])[-cap:]
        state.update((json.dumps(kept),))
        yield pd.DataFrame([{"user_id": key[0], "notes": kept, "needs_compaction": len(kept) > compact_above}])
    kind = notes.schema["user_id"].dataType.simpleString()
    return _stateful(notes, "user_id", step, f"user_id {kind}, notes array<string>, needs_compaction boolean",
                     "kept string", "update")


def stream_supersede(tasks: DataFrame) -> DataFrame:
    """(session_id, task_id, superseded): after each batch the newest task of a session, and the
    tasks it put aside. ``tasks(session_id, task_id, started_at)`` with ``started_at`` in ms."""
    def step(key, batches, state: GroupState):
        started, current = state.get if state.exists else (-1, "")
        out = []
        for row in _in_order(batches, "started_at", "task_id").itertuples():
            newer = (row.started_at, row.task_id) > (started, current)
            gone = current if newer else row.task_id
            if newer:
                started, current = int(row.started_at), row.task_id
            if gone:
                out.append({"session_id": key[0], "task_id": gone, "superseded": True})
        state.update((started, current))
        out.append({"session_id": key[0], "task_id": current, "superseded": False})
        yield pd.DataFrame(out)
    kind = tasks.schema["session_id"].dataType.simpleString()
    return _stateful(tasks.select("session_id", "task_id", "started_at"), "session_id", step,
                     f"session_id {kind}, task_id string, superseded boolean", "started bigint, current string", "update")


def stream_usage(turns: DataFrame, prices: dict[str, float] = vocab.TOKEN_PRICES) -> DataFrame:
    """Running number of queries, tokens and cost; use update or complete mode."""
    return turns.groupBy().agg(F.count("*").alias("queries"), F.sum(F.col("input") + F.col("output")).alias("tokens"),
                               F.sum(estimate_cost(prices)).alias("cost"))


def stream_transitions(snapshots: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Change events from yearly snapshots (year, point_id) as they arrive; a row without
    point_id announces an empty year.

    The newest year stays open: when more of its rows come, its events are found anew. Below ``path``, per batch: ``events``, ``years``
    (those whose events the batch found), ``late`` (rows of years older than the newest before the batch), and in two
    folders that take turns ``state``, the rows of the two newest years. ``transition_events`` reads what holds. A batch
    that is run again overwrites its own folders."""
    schema = snapshots.schema

    def step(batch: DataFrame, number: int) -> None:
        before, slot = _state_before(batch.sparkSession, f"{path}/state", number, schema)
        last = before.agg(F.max("year").alias("y")).head()["y"]
        fresh = batch if last is None else batch.where(F.col("year") >= last)
        if last is not None:
            batch.where(F.col("year") < last).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        rows = before.unionByName(fresh.select(*schema.names)).distinct().persist()
        try:
            found = transitions(rows.select("year"), rows.where("point_id is not null"))
            years = rows.select("year").distinct()
            newest = [r.year for r in years.orderBy(F.desc("year")).limit(2).collect()]
            if last is not None:
                # of the two kept years the older one is closed
                years, found = years.where(F.col("year") >= last), found.where(F.col("year_after") >= last)
            found.write.mode("overwrite").parquet(f"{path}/events/batch={number}")
            years.write.mode("overwrite").parquet(f"{path}/years/batch={number}")
            (rows.where(F.col("year").isin(newest)).select(*schema.names, F.lit(number).alias("batch"))
             .write.mode("overwrite").parquet(f"{path}/state/slot={slot}"))
        finally:
            rows.unpersist()
    return snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def transition_events(spark: SparkSession, path: str) -> DataFrame:
    """The events that hold: each year's from the last batch that found them."""
    holds = spark.read.parquet(f"{path}/years").groupBy(F.col("year").alias("year_after")).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/events").join(holds, ["year_after", "batch"], "left_semi").drop("batch")


def _state_before(spark: SparkSession, state: str, number: int, schema) -> tuple[DataFrame, int]:
    """The rows kept by the latest batch before ``number``, and the folder that this batch may overwrite."""
    numbered = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("slot", T.IntegerType())])
    kept = read_or_empty(spark, state, numbered).where(F.col("batch") < number)
    newest = kept.groupBy("batch", "slot").count().orderBy(F.desc("batch")).limit(1).collect()
    if not newest:
        return kept.where(F.lit(False)).drop("batch", "slot"), number % 2
    return kept.where(F.col("slot") == newest[0].slot).drop("batch", "slot"), 1 - newest[0].slot
