"""Citation audits over answers and the tool output behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.text import literal_map, strip
from tidemark.tables import Ordered, top_per_group

ID = r"\[([ED]\d+)\]"
LABELLED = r"\[([^\]\-]+)-([ED]\d+)\]"


def evidence_part(output) -> Column:
    """The text behind the first ``[evidence]``, or null without one."""
    output = F.col(output) if isinstance(output, str) else output
    at = F.instr(output, "[evidence]")
    return F.when(at > 0, F.substr(output, at + 10))


def output_ids(output) -> Column:
    """Ids in the evidence section of a tool output, else anywhere in it."""
    output = F.coalesce(F.col(output) if isinstance(output, str) else output, F.lit(""))
    return F.array_distinct(F.regexp_extract_all(F.coalesce(evidence_part(output), output), F.lit(ID), F.lit(1)))


def legal_ids(tool_calls: DataFrame, evidence: DataFrame) -> DataFrame:
    """(task_id, agent, id). What the tools really returned; an agent whose tools returned no
    id falls back on its recorded evidence. ``tool_calls(task_id, agent, output)``."""
    real = tool_calls.select("task_id", "agent", F.explode(output_ids("output")).alias("id")).distinct()
    recorded = (evidence.where("id <> ''").select("task_id", "agent", "id").distinct()
                .join(real.select("task_id", "agent").distinct(), ["task_id", "agent"], "left_anti"))
    return real.unionByName(recorded)


def citations(summaries: DataFrame, labels: dict[str, str] = vocab.CITATION_LABELS) -> DataFrame:
    """(task_id, position, label, id, agent): each ``[label-E1]`` in the summary text; an
    unknown label has no agent."""
    text = F.coalesce("text", F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(LABELLED), F.lit(1)).alias("label"),
                         F.regexp_extract_all(text, F.lit(LABELLED), F.lit(2)).alias("id"))
    rows = summaries.select("task_id", F.posexplode(pairs).alias("position", "c"))
    return rows.select("task_id", "position", "c.label", "c.id",
                       F.try_element_at(literal_map(labels), F.col("c.label")).alias("agent"))


def citation_status(summaries: DataFrame, legal: DataFrame, labels=vocab.CITATION_LABELS) -> DataFrame:
    """Citations with ``status`` valid, fabricated or unknown_label."""
    cited = citations(summaries, labels)
    checked = cited.join(legal.select("task_id", "agent", "id").distinct().withColumn("ok", F.lit(True)),
                         ["task_id", "agent", "id"], "left")
    status = F.when(F.col("agent").isNull(), "unknown_label").when(F.col("ok"), "valid").otherwise("fabricated")
    return checked.select("task_id", "position", "label", "id", "agent", status.alias("status"))


def citation_audit(summaries: DataFrame, tool_calls: DataFrame, evidence: DataFrame,
                   labels=vocab.CITATION_LABELS) -> DataFrame:
    """Per task: totals, fabricated and unknown citations, and the share that is not valid.
    Unknown labels count in the total; without citations the rate is 0."""
    status = citation_status(summaries, legal_ids(tool_calls, evidence), labels)

    def listed(kind):
        # the citations of one summary text
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == kind, F.struct("position", "label", "id")))),
                           lambda c: F.concat_ws("-", c.label, c.id))
    counted = status.groupBy("task_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "valid").alias("valid"),
        listed("fabricated").alias("fabricated"), listed("unknown_label").alias("unknown_label"))
    nothing = F.array().cast("array<string>")
    return (summaries.select("task_id").distinct().join(counted, "task_id", "left").select(
        "task_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("valid", F.lit(0)).alias("valid"),
        F.coalesce("fabricated", nothing).alias("fabricated"), F.coalesce("unknown_label", nothing).alias("unknown_label"),
        F.coalesce(1 - F.col("valid") / F.col("total"), F.lit(0.0)).alias("rate")))


def citation_audit_by_agent(summaries: DataFrame, tool_calls: DataFrame, evidence: DataFrame,
                            labels=vocab.CITATION_LABELS) -> DataFrame:
    """(task_id, agent, cited, valid, fabricated) for every agent with results or citations."""
    legal = legal_ids(tool_calls, evidence)
    status = citation_status(summaries, legal, labels).where("agent is not null")
    counted = status.groupBy("task_id", "agent").agg(
        F.count("*").alias("cited"), F.count_if(F.col("status") == "valid").alias("valid"))
    agents = (tool_calls.select("task_id", "agent").union(evidence.select("task_id", "agent"))
              .union(counted.select("task_id", "agent")).distinct())
    zero = F.lit(0)
    return (agents.join(counted, ["task_id", "agent"], "left")
            .select("task_id", "agent", F.coalesce("cited", zero).alias("cited"), F.coalesce("valid", zero).alias("valid"))
            .withColumn("fabricated", F.col("cited") - F.col("valid")))


def _replaced(text: Column, ids: Column, make) -> Column:
    """Text with every ``[id]`` of the array replaced by ``make(id)``."""
    return F.aggregate(ids, text, lambda acc, i: F.replace(acc, F.concat(F.lit("["), i, F.lit("]")), make(i)))


def evidence_blocks(tool_calls: DataFrame, output_chars: int = 1500) -> DataFrame:
    """(task_id, call_no, block): what each tool call really returned, as text to append."""
    part = evidence_part("output")
    block = (F.when(part.isNotNull(), F.concat(F.lit("--- 工具 `"), "name", F.lit("` 的实际证据 ---\n"), strip(part)))
             .when(F.size(output_ids("output")) > 0,
                   F.concat(F.lit("--- 工具 `"), "name", F.lit("` 的输出 ---\n"), F.substring("output", 1, output_chars))))
    return tool_calls.select("task_id", "call_no", block.alias("block")).where("block is not null")


def self_audit(answers: DataFrame, tool_calls: DataFrame, threshold: float = 0.3,
               output_chars: int = 1500) -> DataFrame:
    """(task_id, cited_total, fabricated_count, fabricated_ids, rate, text).

    Ids no tool returned are marked in the text; above the threshold (strict) all evidence of the task's tools is
    appended, whether it names ids or not. A task without tool calls or citations is left as it is. ``answers(task_id, text)``,
    ``tool_calls(task_id, call_no, name, output)``."""
    ids = output_ids("output")
    # ids are compared first; evidence text is gathered only for the tasks that need it
    legal = tool_calls.select("task_id", F.explode(ids).alias("id")).distinct()
    cited = answers.select("task_id", F.explode(F.regexp_extract_all("text", F.lit(ID), F.lit(1))).alias("id"))
    cited = cited.groupBy("task_id", "id").agg(F.count("*").alias("times"))
    checked = cited.join(legal.withColumn("ok", F.lit(True)), ["task_id", "id"], "left")
    counts = checked.groupBy("task_id").agg(
        F.sum("times").alias("cited_total"),
        F.coalesce(F.sum(F.when(F.col("ok").isNull(), F.col("times"))), F.lit(0)).alias("fabricated_count"),
        F.array_sort(F.collect_set(F.when(F.col("ok").isNull(), F.col("id")))).alias("fabricated_ids"))
    have = tool_calls.select("task_id").distinct().withColumn("called", F.lit(True))
    zero, none = F.lit(0), F.array().cast("array<string>")
    rows = (answers.join(have, "task_id", "left").join(counts, "task_id", "left").select(
        "task_id", "text",
        *[F.when(F.col("called"), F.col(c)).alias(c) for c in ("cited_total", "fabricated_count", "fabricated_ids")])
        .select("task_id", "text", F.coalesce("cited_total", zero).alias("cited_total"),
                F.coalesce("fabricated_count", zero).alias("fabricated_count"),
                F.coalesce("fabricated_ids", none).alias("fabricated_ids"))
        .withColumn("rate", F.when(F.col("cited_total") > 0, F.col("fabricated_count") / F.nullif(F.col("cited_total"), zero))
                    .otherwise(0.0)))
    over = rows.where(F.col("rate") > threshold).select("task_id")
    blocks = evidence_blocks(tool_calls, output_chars).join(over, "task_id", "left_semi")
    blocks = blocks.groupBy("task_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call_no", "block"))), lambda b: b.block), "\n\n")
        .alias("blocks"))
    first = top_per_group(legal.join(over, "task_id", "left_semi"), ["task_id"], [F.col("id")], 30)
    usable = first.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("usable"))
    marked = _replaced(F.col("text"), F.col("fabricated_ids"),
                       lambda i: F.concat(F.lit("[⚠"), i, F.lit("-引用无效]")))
    warning = F.concat(
        F.lit("\n\n---\n⚠ **SubAgent 自检（防幻觉）**：本次回答含 "), F.col("fabricated_count").cast("string"), F.lit("/"),
        F.col("cited_total").cast("string"), F.lit(" 处凭空引用 （"),
        F.array_join(F.slice("fabricated_ids", 1, 5), ", "), F.lit("），已被替换为 [⚠X-引用无效] 标记。\n工具实际可引用编号："),
        F.coalesce("usable", F.lit("")), F.lit("\n以下是工具返回的完整原始证据：\n\n"), F.col("blocks"))
    return (rows.join(blocks, "task_id", "left").join(usable, "task_id", "left").select(
        "task_id", "cited_total", "fabricated_count", "fabricated_ids", "rate",
        F.concat(marked, F.when(F.col("blocks").isNotNull(), warning).otherwise("")).alias("text")))


def renumber_evidence(tool_calls: DataFrame, key: str = "session_id", order: str = "call_no", **options) -> DataFrame:
    """Tool outputs with ids that run on over the calls of a session.

    Within a call ids are numbered by first appearance; the offset is the number of distinct
    ids in the calls before it, E and D apart. Adds ``offset_e`` and ``offset_d``."""
    # numbers are compared as integers, so leading zeros go first
    text = F.regexp_replace(F.coalesce("output", F.lit("")), r"\[([ED])0+(?=\d)(\d+)\]", "[$1$2]")
    rows = tool_calls.withColumn("output", text)
    for letter in "ED":
        found = F.array_distinct(F.regexp_extract_all("output", F.lit(rf"\[{letter}(\d+)\]"), F.lit(1)))
        rows = rows.withColumn(f"_ids_{letter}", found)
    ordered = Ordered(rows, [key], [order], **options)
    for letter in "ED":
        ordered.running_sum(f"offset_{letter.lower()}", F.size(f"_ids_{letter}"), inclusive=False)
    rows = ordered.result()

    def renamed(text, letter):
        offset, ids = F.col(f"offset_{letter.lower()}"), F.col(f"_ids_{letter}")
        # the mark keeps a new id from being replaced again
        pairs = F.transform(ids, lambda i, at: F.struct(
            F.concat(F.lit(f"[{letter}"), i, F.lit("]")).alias("old"),
            F.concat(F.lit(f"[\u0001{letter}"), (offset + at + 1).cast("string"), F.lit("]")).alias("new")))
        return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p.old, p.new))
    new = F.replace(renamed(renamed(F.col("output"), "E"), "D"), F.lit("\u0001"), F.lit(""))
    return rows.withColumn("output", new).drop("_ids_E", "_ids_D")
