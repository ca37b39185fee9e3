"""Routing of questions and scoring of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.text import answer_status, contains_any, hit_count, split_answer_evidence
from tidemark.tables import first_per_key


def keyword_scores(question, routing: dict = vocab.ROUTING) -> Column:
    """struct of one score per category: keyword hits over keywords, three decimals.
    Keywords match literally, also those that look like patterns."""
    return F.struct(*[F.bround(hit_count(question, words) / F.lit(float(max(len(words), 1))), 3).alias(name)
                      for name, words in routing.items()])


def keyword_route(question, routing: dict = vocab.ROUTING, default: str = vocab.DEFAULT_ROUTE) -> Column:
    """Categories with any keyword in the question, else the default."""
    hit = F.filter(F.array(*[F.when(contains_any(question, words), F.lit(name)) for name, words in routing.items()]),
                   lambda c: c.isNotNull())
    return F.when(F.size(hit) > 0, F.array_sort(hit)).otherwise(F.array(F.lit(default)))


def route(questions: DataFrame, model_scores: DataFrame | None = None, routing: dict = vocab.ROUTING,
          alpha: float = 0.3, threshold: float = 0.3, default: str = vocab.DEFAULT_ROUTE,
          report_phrases=vocab.REPORT_PHRASES) -> DataFrame:
    """``questions(question_id, question)`` with ``scores`` and the sorted ``categories``.

    With ``model_scores(question_id, <category>…)`` the score is alpha * keywords +
    (1 - alpha) * model. Below the threshold a category is left out; a report request
    takes all of them."""
    names = list(routing)
    rows = questions.withColumn("scores", keyword_scores("question", routing))
    if model_scores is not None:
        given = model_scores.select("question_id", F.struct(*names).alias("_m"))
        rows = rows.join(given, "question_id", "left")
        fused = [F.when(F.col("_m").isNull(), F.col(f"scores.{n}")).otherwise(
            F.bround(F.lit(alpha) * F.col(f"scores.{n}") + F.lit(1 - alpha) * F.coalesce(f"_m.{n}", F.lit(0.0)), 3)).alias(n)
            for n in names]
        rows = rows.withColumn("scores", F.struct(*fused)).drop("_m")
    chosen = F.filter(F.array(*[F.when(F.col(f"scores.{n}") >= threshold, F.lit(n)) for n in sorted(names)]),
                      lambda c: c.isNotNull())
    chosen = F.when(F.size(chosen) > 0, chosen).otherwise(F.array(F.lit(default)))
    report = contains_any("question", report_phrases)
    everything = F.array(*[F.lit(n) for n in sorted(names)])
    return rows.withColumn("is_report", report).withColumn("categories", F.when(report, everything).otherwise(chosen))


def eval_scores(results: DataFrame) -> DataFrame:
    """Scores per result row (got_agents, expected_agents, text, expected_entities,
    forbidden_entities, relation_recall, min_relations)."""
    def occurring(names):
        return F.size(F.filter(names, lambda e: F.contains(F.coalesce("text", F.lit("")), e)))
    total = F.size("expected_entities")
    one, zero = F.lit(1.0), F.lit(0.0)
    same = (F.size(F.array_except("got_agents", "expected_agents")) == 0) & \
           (F.size(F.array_except("expected_agents", "got_agents")) == 0)
    scored = (results.withColumn("routing_score", F.when(same, one).otherwise(zero))
              .withColumn("entity_score", F.when(total > 0, occurring("expected_entities") / F.nullif(total, F.lit(0))).otherwise(zero))
              .withColumn("hallucination", occurring("forbidden_entities") > 0)
              .withColumn("relation_score", F.when(F.col("min_relations") > 0, F.least(
                  F.col("relation_recall") / F.nullif(F.col("min_relations"), F.lit(0)), one)).otherwise(one)))
    honest = F.when(F.col("hallucination"), zero).otherwise(one)
    return scored.withColumn("overall", F.col("routing_score") * 0.3 + F.col("entity_score") * 0.3
                             + honest * 0.2 + F.col("relation_score") * 0.2)


def eval_report(scored: DataFrame) -> DataFrame:
    """Mean scores per category and, with category null, over all cases."""
    return scored.rollup("category").agg(
        F.count("*").alias("cases"), F.avg("routing_score").alias("routing_score"),
        F.avg("entity_score").alias("entity_score"), F.avg("relation_score").alias("relation_score"),
        F.coalesce(F.avg(F.when(F.col("latency_s") > 0, F.col("latency_s"))), F.lit(0.0)).alias("latency_s"),
        F.count_if("hallucination").alias("hallucinations"), F.avg("overall").alias("overall"))


def routing_errors(cases: DataFrame, routing: dict = vocab.ROUTING, default: str = vocab.DEFAULT_ROUTE) -> DataFrame:
    """(agent, kind, n, sample, keywords): agents that were expected and not routed to
    (missing), and the reverse (extra) with the keywords that fired.

    ``cases(case_id, question, expected_agents)``."""
    rows = cases.withColumn("got", keyword_route("question", routing, default))

    def side(kind, left, right):
        return rows.select("case_id", "question", F.lit(kind).alias("kind"),
                           F.explode(F.array_except(left, right)).alias("agent"))
    wrong = side("missing", "expected_agents", "got").unionByName(side("extra", "got", "expected_agents"))
    fired = F.create_map(*[x for name, words in routing.items() for x in (
        F.lit(name), F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("question"), w)))])
    wrong = wrong.withColumn("hits", F.when(F.col("kind") == "extra", F.try_element_at(fired, F.col("agent"))))
    counted = wrong.groupBy("agent", "kind").agg(F.count("*").alias("n"),
                                                 F.min_by(F.substring("question", 1, 60), "case_id").alias("sample"))
    # at most one row per keyword of the vocabulary
    words = (wrong.select("agent", "kind", F.explode("hits").alias("word")).distinct()
             .groupBy("agent", "kind").agg(F.array_sort(F.collect_list("word")).alias("keywords")))
    return counted.join(words, ["agent", "kind"], "left")


def retrieval_report(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per case, overall) for ``results(case_id, text, expected_entities, elapsed_s)``.

    A case passes if every expected name is in its evidence, there is an evidence id and the
    answer is not degraded; with no expected name it passes if it degrades honestly."""
    parts = results.withColumn("_s", split_answer_evidence("text"))
    has_section = F.contains("text", F.lit("[evidence]"))
    answer = F.when(has_section, F.trim(F.replace(F.substring_index("text", "[evidence]", 1), F.lit("[answer]"), F.lit(""))))\
        .otherwise(F.trim("text"))
    evidence = F.when(has_section, F.substr("text", F.instr("text", "[evidence]") + 10)).otherwise("")
    rows = (parts.drop("_s").withColumn("answer", answer).withColumn("evidence", evidence)
            .withColumn("n_evidence", F.regexp_count("evidence", F.lit(r"\[E\d+\]")))
            .withColumn("degraded", answer_status("answer") == "degraded"))
    all_hit = F.forall("expected_entities", lambda e: F.contains("evidence", e))
    passed = F.when(F.size("expected_entities") == 0,
                    F.col("degraded") | F.contains("answer", F.lit("未")) | (F.col("n_evidence") == 0)
                    ).otherwise(all_hit & (F.col("n_evidence") > 0) & ~F.col("degraded"))
    cases = rows.select("case_id", passed.alias("passed"), "n_evidence", "degraded", "elapsed_s")
    overall = cases.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"),
                        F.avg(F.col("passed").cast("double")).alias("pass_rate"),
                        F.avg("elapsed_s").alias("mean_elapsed_s"), F.avg("n_evidence").alias("mean_evidence"))
    return cases, overall
