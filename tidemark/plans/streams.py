"""The streaming jobs replayed over the tables in four batches; the oracle is the batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.plans import inputs as i, logs, texts
from tidemark.plans.inputs import CHANGES_SQL
from tidemark.session import scratch_dir
from tidemark.sources import stores
from tidemark.streaming import jobs
from tidemark.streaming.runs import finish, latest, replay

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


@query(f"WITH {logs.INDEX_SQL} SELECT * FROM idx")
def stream_trace_index(spark, folder):
    spans = logs.spans(spark, folder).withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "number", F.substring("span_id", 2, 20).cast("long"))
    stream = replay(spans, F.col("number")).drop("number")
    rows = finish(jobs.stream_trace_index(stream), "append").drop("batch")
    return rows.withColumn("agents", F.array_join("agents", ","))


@query(f"""WITH {logs.COMPACT_SQL} SELECT user_id, (SELECT count(*) FROM events e WHERE e.user_id = k.user_id) AS total,
  md5(string_agg(question, '|' ORDER BY position)) AS recent,
  (SELECT count(*) FROM events e WHERE e.user_id = k.user_id AND contains(event_type, 'error')) AS errors FROM kept k WHERE newest <= 50 GROUP BY user_id""")
def stream_questions(spark, folder):
    questions = i.table(spark, folder, "events").select("user_id", F.col("event_id").alias("position"),
                                                        F.concat("event_type", F.lit(" the  Thing")).alias("question"))
    stream = jobs.stream_questions(replay(questions, F.col("position")), city_pattern="(zzz)", domain=("error", "view"))
    rows = latest(finish(stream, "update"), "user_id")
    errors = F.filter("topics", lambda t: t.topic == "error")
    return rows.select("user_id", "total", F.md5(F.array_join("recent", "|")).alias("recent"),
                       F.coalesce(F.try_element_at(errors, F.lit(1))["n"], F.lit(0)).alias("errors"))


@query("SELECT user_id, unnest(generate_series(5, n, 10)) AS total FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) WHERE n >= 5")
def stream_profile_due(spark, folder):
    questions = i.table(spark, folder, "events").select("user_id", "event_id")
    return finish(jobs.profile_due(replay(questions, F.col("event_id"))), "append").drop("batch")


@query("""WITH n AS (SELECT conv_id % 25 AS user_id, conv_id * 100 + turn AS position, text, row_number() OVER (PARTITION BY conv_id % 25 ORDER BY conv_id * 100 + turn DESC) AS newest
   FROM conversations WHERE trim(text) <> '')
  SELECT user_id, md5(string_agg(substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 500), '|' ORDER BY position)) AS notes, count(*) > 6 AS needs_compaction FROM n WHERE newest <= 10 GROUP BY user_id""")
def stream_notes(spark, folder):
    notes = i.table(spark, folder, "conversations").select((F.col("conv_id") % 25).alias("user_id"),
                                                           (F.col("conv_id") * 100 + F.col("turn")).alias("position"), F.col("text").alias("note"))
    rows = latest(finish(jobs.stream_notes(replay(notes, F.col("position")), cap=10, compact_above=6), "update"), "user_id")
    return rows.select("user_id", F.md5(F.encode(F.array_join("notes", "|"), "UTF-8")).alias("notes"), "needs_compaction")


@query("""SELECT user_id AS session_id, CAST(event_id AS VARCHAR) AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 1 AS superseded FROM events""")
def stream_supersede(spark, folder):
    tasks = i.table(spark, folder, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").cast("string").alias("task_id"),
                                                    F.unix_micros(F.col("ts").cast("timestamp")).alias("started_at"))
    stream = jobs.stream_supersede(replay(tasks, F.col("task_id").cast("long")))
    # current in one batch, put aside in a later one
    rows = finish(stream, "update").groupBy("session_id", "task_id").agg(F.bool_or("superseded").alias("superseded"))
    return rows


@query(f"WITH {logs.USAGE_SQL} SELECT count(*) AS queries, sum(input + output)::BIGINT AS tokens, round(sum(input / 1e6 * 1.0 + output / 1e6 * 2.0 + cache_read / 1e6 * 0.1), 6) AS cost FROM usage")
def stream_usage(spark, folder):
    usage = logs.usage(spark, folder)
    rows = finish(jobs.stream_usage(replay(usage, F.col("task_id"))), "complete")
    last = rows.agg(F.max_by(F.struct("queries", "tokens", "cost"), "batch").alias("r")).select("r.*")
    return last.withColumn("cost", F.round("cost", 6))


@query(CHANGES_SQL + " SELECT point_id, event_type, year_before, year_after FROM transitions")
def stream_transitions(spark, folder):
    snapshots = i.membership(spark, folder).distinct()
    path = f"{scratch_dir(spark)}/tidemark/transitions-{uuid.uuid4().hex}"
    jobs.stream_transitions(replay(snapshots, F.col("year")), path, f"{path}/checkpoint", availableNow=True).awaitTermination()
    return jobs.transition_events(spark, path)


@query(ORACLES["stream_transitions"])
def stream_split_years(spark, folder):
    """As above, but the rows of a year arrive in several batches."""
    snapshots = i.membership(spark, folder).distinct()
    path = f"{scratch_dir(spark)}/tidemark/transitions-{uuid.uuid4().hex}"
    # by year and, within it, by a hash of the point: batches are cut in the middle of years
    place = F.col("year") + F.pmod(F.xxhash64("point_id"), F.lit(1000)) / 1000
    jobs.stream_transitions(replay(snapshots, place, slices=9), path, f"{path}/checkpoint", availableNow=True).awaitTermination()
    return jobs.transition_events(spark, path)


@query(texts.CHUNKS_SQL.replace("FROM documents)", "FROM (SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, text FROM documents GROUP BY text))", 1)
       + """ SELECT DISTINCT source || '_1_' || chunk_index || '_' || substr(md5(content), 1, 8) AS id, md5(content) AS content FROM chunks c JOIN pieces p ON p.doc_id = c.doc_id""")
def stream_import(spark, folder):
    files = i.table(spark, folder, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "source", "text", "doc_id")
    path = f"{scratch_dir(spark)}/tidemark/import-{uuid.uuid4().hex}"
    stream = replay(files, F.col("doc_id")).drop("doc_id")
    jobs.stream_import(stream, f"{path}/store", f"{path}/checkpoint", availableNow=True).awaitTermination()
    return stores.read_chunks(spark, f"{path}/store").select("id", F.md5(F.encode("content", "UTF-8")).alias("content"))
