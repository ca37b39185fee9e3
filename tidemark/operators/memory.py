"""What is remembered per user: questions, topics, feedback, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import extract_topics, normalize_question, question_hash
from tidemark.tables import Ordered, top_per_group


def compact_questions(questions: DataFrame, cap: int = 50, chars: int = 200, **options) -> DataFrame:
    """(user_id, position, question, kept, total): the last ``cap`` questions after dropping one
    that equals the question before it; ``total`` counts all of them.

    ``questions(user_id, position, question)``."""
    ordered = Ordered(questions.select("user_id", "position", "question"), ["user_id"], ["position"], **options)
    rows = ordered.lag("_previous", normalize_question(F.substring("question", 1, chars))).result()
    norm = normalize_question(F.col("question"))
    kept = rows.where(F.col("_previous").isNull() | (norm != F.col("_previous")))
    last = top_per_group(kept.select("user_id", "position", F.substring("question", 1, chars).alias("question")),
                         ["user_id"], [F.desc("position")], cap, "newest")
    totals = questions.groupBy("user_id").agg(F.count("*").alias("total"))
    return last.join(totals, "user_id").select("user_id", "position", "newest", "question", "total")


def topic_counts(questions: DataFrame, **topics) -> DataFrame:
    """(user_id, topic, n, first_seen): number of questions that mention the topic."""
    said = questions.select("user_id", "position", F.posexplode(extract_topics("question", **topics)).alias("at", "topic"))
    return said.groupBy("user_id", "topic").agg(F.count("*").alias("n"), F.min(F.struct("position", "at")).alias("first_seen"))


def top_topics(counts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent topics per user; of equals the one seen first."""
    return top_per_group(counts, ["user_id"], [F.desc("n"), F.col("first_seen")], k)


def relevant_notes(notes: DataFrame, questions: DataFrame, k: int = 5, **topics) -> DataFrame:
    """(user_id, rank, note, overlap): notes by topics shared with the user's current
    question, of equals the later one first. ``notes(user_id, position, note, topics)``,
    ``questions(user_id, question)``: one current question per user."""
    asked = questions.select("user_id", extract_topics("question", **topics).alias("_asked"))
    scored = notes.join(asked, "user_id").withColumn("overlap", F.size(F.array_intersect("topics", "_asked")))
    return top_per_group(scored, ["user_id"], [F.desc("overlap"), F.desc("position")], k).select(
        "user_id", "rank", "note", "overlap")


def bad_topics(recent: DataFrame, feedback: DataFrame, k: int = 5, **topics) -> DataFrame:
    """(user_id, rank, topic): the first distinct topics of recent questions rated bad.
    ``recent(user_id, position, question)`` as stored, ``feedback(user_id, question_hash, rating)``."""
    rated = feedback.where("rating = 'bad'").select("user_id", F.col("question_hash").alias("_h")).distinct()
    bad = recent.withColumn("_h", question_hash("question")).join(rated, ["user_id", "_h"], "left_semi")
    said = bad.select("user_id", "position", F.posexplode(extract_topics("question", **topics)).alias("at", "topic"))
    first = said.groupBy("user_id", "topic").agg(F.min(F.struct("position", "at")).alias("first_seen"))
    return top_per_group(first, ["user_id"], [F.col("first_seen")], k).select("user_id", "rank", "topic")


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """(user_id, question_hash, rating): the last rating per question; others than good and
    bad count as neutral. ``feedback(user_id, position, question, rating)``."""
    rating = F.when(F.col("rating").isin("good", "bad"), F.col("rating")).otherwise("neutral")
    return feedback.groupBy("user_id", question_hash("question").alias("question_hash")).agg(
        F.max_by(rating, "position").alias("rating"))


def kept_notes(notes: DataFrame, cap: int = 100, chars: int = 500, compact_above: int = 60) -> DataFrame:
    """The newest ``cap`` non-blank notes per user, cut to ``chars``; ``needs_compaction`` says
    whether the user has more than ``compact_above`` of them."""
    filled = notes.where(F.trim("note") != "").withColumn("note", F.substring(F.trim("note"), 1, chars))
    last = top_per_group(filled, ["user_id"], [F.desc("position")], cap, "newest")
    many = last.groupBy("user_id").agg((F.count("*") > compact_above).alias("needs_compaction"))
    return last.join(many, "user_id")


def _joined(rows: DataFrame, order: str, value: str, glue: str, out: str) -> DataFrame:
    return rows.groupBy("user_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]), glue).alias(out))


def memory_context(users: DataFrame, questions: DataFrame, notes: DataFrame, feedback: DataFrame, recent_n: int = 3,
                   notes_k: int = 5, **topics) -> DataFrame:
    """(user_id, text): role, expertise, relevant notes, last questions, favourite topics and
    topics of badly rated questions, one line each, empty ones left out.

    ``users(user_id, role, expertise, question)`` holds the current question. Every list is
    cut to its few rows per user before it is gathered."""
    recent = compact_questions(questions)
    lines = [
        (F.when(F.coalesce("role", F.lit("")) != "", F.concat(F.lit("用户角色: "), "role"))),
        (F.when(F.size("expertise") > 0, F.concat(F.lit("专业领域: "), F.array_join("expertise", ", ")))),
    ]
    best = _joined(relevant_notes(notes, users.select("user_id", "question"), notes_k, **topics), "rank", "note", " | ", "_notes")
    last = _joined(recent.where(F.col("newest") <= recent_n), "position", "question", "; ", "_recent")
    top = _joined(top_topics(topic_counts(questions, **topics)), "rank", "topic", ", ", "_topics")
    bad = _joined(bad_topics(recent, latest_feedback(feedback), **topics), "rank", "topic", ", ", "_bad")
    rows = users
    for part in (best, last, top, bad):
        rows = rows.join(part, "user_id", "left")
    # notes are only looked up for a question
    lines += [F.when(F.coalesce("question", F.lit("")) != "", F.concat(F.lit("历史记忆: "), "_notes")),
              F.concat(F.lit("最近问题: "), "_recent"), F.concat(F.lit("关注主题: "), "_topics"),
              F.concat(F.lit("用户曾对以下类型回答不满意，需更谨慎(强引用来源): "), "_bad")]
    return rows.select("user_id", F.concat_ws("\n", *lines).alias("text"))
