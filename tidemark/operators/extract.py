"""Entities and relations out of chunks: by rules, from model replies, and merged."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import vocab
from tidemark.functions.scan import json_candidate
from tidemark.functions.text import (clean_text, contains_any, normalize_entity_type, normalize_relation_type,
                                     reject_reason, strip)
from tidemark.operators.graph import import_source_id, source_id
from tidemark.session import written
from tidemark.tables import first_per_key

RAW_ENTITY = "struct<name:string,type:string,description:string>"


class Rules:
    """Patterns and dictionaries of the rule extractor; the defaults are for planning texts."""

    def __init__(self, policy=vocab.POLICY_NAME_PATTERN, district=vocab.DISTRICT_PATTERN,
                 infrastructure=vocab.INFRASTRUCTURE_TERMS, land_use=vocab.LAND_USE_TERMS,
                 goal_words=vocab.GOAL_WORDS, goal_break=vocab.GOAL_SENTENCE_BREAK,
                 markers=vocab.NAME_MARKERS, leading_verbs=vocab.LEADING_VERBS):
        self.policy, self.district = policy, district
        self.infrastructure, self.land_use = infrastructure, land_use
        self.goal_words, self.goal_break = goal_words, goal_break
        self.markers, self.leading_verbs = markers, leading_verbs


def _entity(name: Column, kind: str, description: str, rules: Rules) -> Column:
    name = clean_text(name)
    if kind in ("District", "Infrastructure", "LandUse"):
        for marker in rules.markers:
            name = F.substring_index(name, marker, -1)
    if rules.leading_verbs:
        name = F.regexp_replace(name, f"^({'|'.join(rules.leading_verbs)})+", "")
    return F.struct(name.alias("name"), F.lit(kind).alias("type"), F.lit(description).alias("description"))


def rule_entities(content, rules: Rules = Rules()) -> Column:
    """array<struct<name,type,description>> found by patterns and dictionaries, in order."""
    text = F.col(content) if isinstance(content, str) else content

    def found(names, kind, description):
        return F.transform(names, lambda n: _entity(n, kind, description, rules))

    def matches(pattern, most):
        return F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), 1, most)

    def terms(words):
        return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))

    goals = F.filter(F.split(text, rules.goal_break), lambda s: contains_any(s, rules.goal_words))
    goals = F.filter(F.slice(F.transform(goals, strip), 1, 3), lambda s: F.length(s).between(6, 80))
    everything = F.concat(
        found(matches(rules.policy, 5), "Policy", "Policy or planning document mentioned in the chunk"),
        found(matches(rules.district, 10), "District", "Spatial district mentioned in the chunk"),
        found(terms(rules.infrastructure), "Infrastructure", "Infrastructure mentioned in the chunk"),
        found(terms(rules.land_use), "LandUse", "Land-use category mentioned in the chunk"),
        found(goals, "PolicyGoal", "Policy goal inferred from sentence"))
    return F.filter(everything, lambda e: e["name"] != "")


def rule_extract(chunks: DataFrame, rules: Rules = Rules(), key: str = "id",
                 content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Raw entities and relations per chunk. The first policy of a chunk has a HAS_GOAL edge
    to its goals and an AFFECTS edge to everything else. Row-wise, no shuffle; the findings are
    written, so that the patterns run once for both results."""
    found = written(chunks.select(F.col(key).alias("chunk_id"), rule_entities(content, rules).alias("found")), "findings")
    entities = found.select("chunk_id", F.posexplode("found").alias("position", "e")).select(
        "chunk_id", "position", "e.*")
    policies = F.filter("found", lambda e: e["type"] == "Policy")
    edges = (found.where(F.size(policies) > 0)
             .select("chunk_id", F.get(policies, F.lit(0))["name"].alias("source"), F.posexplode("found").alias("position", "e"))
             .where(F.col("e.name") != F.col("source")))
    kind = F.when(F.col("e.type") == "PolicyGoal", "HAS_GOAL").otherwise("AFFECTS")
    relations = edges.select("chunk_id", "position", "source", F.col("e.name").alias("target"), kind.alias("type"),
                             F.concat("source", F.lit(" mentions "), F.col("e.name")).alias("description"))
    return entities, relations


def fallback_extract(chunks: DataFrame, districts=vocab.FALLBACK_DISTRICTS,
                     infrastructure=vocab.FALLBACK_INFRASTRUCTURE, quoted: str = vocab.QUOTED_POLICY_PATTERN,
                     labels=("杭州市行政区/规划片区: ", "政策/规划文件: ", "基础设施: "), key: str = "id",
                     content: str = "content") -> DataFrame:
    """The cautious extractor: listed districts, quoted policy titles, listed infrastructure;
    each name once per chunk, no relations."""
    text = F.col(content)

    def listed(words, kind, label):
        hits = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
        return F.transform(hits, lambda w: F.struct(w.alias("name"), F.lit(kind).alias("type"),
                                                    F.concat(F.lit(label), w).alias("description")))
    titles = F.filter(F.transform(F.regexp_extract_all(text, F.lit(quoted), F.lit(1)), strip),
                      lambda t: F.length(t) >= 3)
    titles = F.transform(titles, lambda t: F.struct(t.alias("name"), F.lit("Policy").alias("type"),
                                                    F.concat(F.lit(labels[1]), t).alias("description")))
    found = F.concat(listed(districts, "District", labels[0]), titles,
                     listed(infrastructure, "Infrastructure", labels[2]))
    # first of each name: arrays are short, one chunk's worth
    names = F.transform(found, lambda e: e["name"])
    once = F.filter(found, lambda e, i: F.array_position(names, e["name"]) == i + 1)
    return (chunks.select(F.col(key).alias("chunk_id"), F.posexplode(once).alias("position", "e"))
            .select("chunk_id", "position", F.col("e.name").alias("name"), F.col("e.type").alias("entity_type"),
                    F.col("e.description").alias("description")))


def _first_filled(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def _with_missing(df: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def normalize_extracted(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean raw rows of (chunk_id, position, …), taking each value from the first filled of
    its alias columns. One entity per chunk and name, one relation per chunk and triple;
    an endpoint that is no entity of its chunk is added as ``Unknown``."""
    entities = _with_missing(entities, ["name", "entity_name", "title", "label", "type", "entity_type",
                                        "description", "desc", "evidence"])
    relations = _with_missing(relations, ["source", "src_id", "from", "target", "tgt_id", "to", "type", "relation",
                                          "keywords", "description", "desc", "weight"])
    name = clean_text(_first_filled("name", "entity_name", "title", "label"))
    described = _first_filled("description", "desc", "evidence")
    named = entities.select("chunk_id", "position", name.alias("name"),
                            normalize_entity_type(_first_filled("type", "entity_type")).alias("entity_type"),
                            clean_text(F.coalesce(described, name)).alias("description")).where("name <> ''")
    named = first_per_key(named, ["chunk_id", "name"], [F.col("position")])
    kind = normalize_relation_type(_first_filled("type", "relation", "keywords"))
    weight = F.col("weight").cast("double")
    rels = relations.select(
        "chunk_id", "position", clean_text(_first_filled("source", "src_id", "from")).alias("src"),
        clean_text(_first_filled("target", "tgt_id", "to")).alias("tgt"), kind.alias("predicate"),
        clean_text(F.coalesce(_first_filled("description", "desc"), kind)).alias("description"),
        F.when(weight != 0, weight).otherwise(1.0).alias("weight"))
    rels = rels.where("src <> '' and tgt <> '' and src <> tgt")
    rels = first_per_key(rels, ["chunk_id", "src", "tgt", "predicate"], [F.col("position")])
    ends = rels.select("chunk_id", "position", F.explode(F.array("src", "tgt")).alias("name"))
    inferred = (ends.groupBy("chunk_id", "name").agg(F.min("position").alias("position"))
                .join(named.select("chunk_id", "name"), ["chunk_id", "name"], "left_anti")
                .select("chunk_id", "position", "name", F.lit("Unknown").alias("entity_type"),
                        F.lit("Entity inferred from a relationship endpoint").alias("description")))
    return named.unionByName(inferred), rels


def import_extract(chunks: DataFrame, responses: DataFrame, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """The importer's way: a chunk's reply (chunk_id, response) is scanned for JSON; a chunk
    without a usable reply goes through the rules. ``chunks(id, content, source, page, chunk_index)``.
    Both results carry the importer's ``source_id``."""
    entity = ("struct<name:string,entity_name:string,title:string,label:string,type:string,entity_type:string,"
              "description:string,desc:string,evidence:string>")
    relation = ("struct<source:string,src_id:string,`from`:string,target:string,tgt_id:string,`to`:string,type:string,"
                "relation:string,keywords:string,description:string,desc:string,weight:string>")
    shape = (f"entities array<{entity}>, nodes array<{entity}>, relationships array<{relation}>, "
             f"relations array<{relation}>, edges array<{relation}>")
    blocks = responses.select("chunk_id", json_candidate("response").alias("block"))
    # a bare list holds entities
    block = F.when(F.col("block").startswith("["), F.concat(F.lit('{"entities":'), "block", F.lit("}"))).otherwise(F.col("block"))
    parsed = blocks.select("chunk_id", F.from_json(block, shape).alias("j"))

    def filled(*names):
        return F.coalesce(*[F.when(F.size(F.col(f"j.{n}")) > 0, F.col(f"j.{n}")) for n in names])
    parsed = parsed.select("chunk_id", filled("entities", "nodes").alias("es"),
                           filled("relationships", "relations", "edges").alias("rs"))
    # read several times below, so the replies are scanned once and kept
    parsed = written(parsed, "parsed-replies")
    raw_entities = parsed.select("chunk_id", F.posexplode("es").alias("position", "e")).select("chunk_id", "position", "e.*")
    raw_relations = parsed.select("chunk_id", F.posexplode("rs").alias("position", "r")).select("chunk_id", "position", "r.*")
    entities, relations = normalize_extracted(raw_entities, raw_relations)
    answered = entities.select("chunk_id").union(relations.select("chunk_id")).distinct()
    rest = chunks.join(answered.withColumnRenamed("chunk_id", "id"), "id", "left_anti")
    more = normalize_extracted(*rule_extract(rest, rules))
    where = chunks.select(F.col("id").alias("chunk_id"),
                          import_source_id(F.col("source"), F.col("page"), F.col("chunk_index")).alias("source_id"))
    return (entities.unionByName(more[0]).join(where, "chunk_id"),
            relations.unionByName(more[1]).join(where, "chunk_id"))


def names_in_text(content, names) -> Column:
    """array<boolean>: which of the names, an array, the content has. Each different name is looked up once per text, by
    Python's search, which skips most characters; Spark's goes byte by byte, through every whole text without the name."""
    def found(contents: pd.Series, lists: pd.Series) -> pd.Series:
        def looked_up(text, names):
            if text is None or names is None:
                return None
            words = set(text.split())
            known = {n: n in words or n in text for n in set(names)}
            return [known[n] for n in names]
        return pd.Series([looked_up(*row) for row in zip(contents, lists)], dtype=object)
    return F.pandas_udf(found, "array<boolean>")(content, names)


def validate_entities(raw: DataFrame, contents: DataFrame | None = None, types=vocab.ENTITY_TYPES,
                      sentence_types=vocab.SENTENCE_TYPES, verbs=vocab.VERB_PREFIXES,
                      connectives=vocab.CONNECTIVES) -> DataFrame:
    """Raw (chunk_id, position, entity_name, entity_type, description) with ``name`` and
    ``reason``; an empty reason means accepted. ``contents(chunk_id, content)``; without it raw rows have ``in_text``,
    whether their chunk's content has the name (``names_in_text``, before a chunk's entities become rows): nothing is
    shuffled then."""
    name = strip(F.coalesce("entity_name", F.lit("")))
    sentence = F.col("entity_type").isin(*sentence_types)
    name = F.when(sentence, F.substring(name, 1, 40)).otherwise(name)
    # the name is worked out below the join: above it, a filter on the reason would repeat
    # the expression at each of its uses
    rows = raw.withColumn("name", name)
    if contents is not None:
        rows = rows.join(contents, "chunk_id").withColumn("in_text", F.contains("content", "name"))
    reason = (F.when(~F.coalesce(F.col("entity_type").isin(*types), F.lit(False)), "invalid type")
              .when(sentence, F.when(F.length("name") < 2, "empty").otherwise(""))
              .otherwise(reject_reason("name", None, verbs, connectives, "in_text")))
    text = strip(F.coalesce("description", F.lit("")))
    return rows.select("chunk_id", "position", "name", "entity_type",
                       F.when(text == "", F.concat("entity_type", F.lit(": "), "name")).otherwise(text).alias("description"),
                       reason.alias("reason"))


def validate_relations(raw: DataFrame, accepted: DataFrame, types=vocab.RELATION_TYPES) -> DataFrame:
    """Raw (chunk_id, position, src, tgt, type, description, weight) whose type is known and
    whose ends are accepted names of the same chunk. A chunk's different names are one row, which meets its relations in
    another: relations that lie together by chunk, as behind a window, are not shuffled again. A task holds one chunk's."""
    rows = raw.where(F.col("type").isin(*types)).withColumn("src", strip("src")).withColumn("tgt", strip("tgt"))
    rows = rows.where("src <> '' and tgt <> '' and chunk_id is not null")
    names = accepted.where("name is not null and chunk_id is not null").groupBy("chunk_id").agg(F.collect_set("name").alias("_names"))
    listed = rows.groupBy("chunk_id").agg(F.collect_list(F.struct("position", "src", "tgt", "type", "description", "weight")).alias("_rows"))

    def known(names: pd.Series, src: pd.Series, tgt: pd.Series) -> pd.Series:
        def looked_up(names, src, tgt):
            names = set(names)
            return [a in names and b in names for a, b in zip(src, tgt)]
        return pd.Series([looked_up(*row) for row in zip(names, src, tgt)], dtype=object)
    kept = F.pandas_udf(known, "array<boolean>")("_names", "_rows.src", "_rows.tgt")
    rows = listed.join(names, "chunk_id").select("chunk_id", "_rows", kept.alias("_kept"))
    rows = rows.select("chunk_id", F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_kept").alias("k"))).alias("z"))
    rows = rows.where("z.k").select("chunk_id", "z.r.*")
    text = strip(F.coalesce("description", F.lit("")))
    return rows.select("chunk_id", "position", "src", "tgt", F.col("type").alias("predicate"),
                       F.when(text == "", F.concat_ws(" ", "src", "type", "tgt")).otherwise(text).alias("description"),
                       F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))


def merge_entities(raw: DataFrame, priority: dict[str, int] = vocab.TYPE_PRIORITY,
                   order: tuple[str, ...] = ("chunk_no", "position")) -> DataFrame:
    """One row per name: the type of highest priority, and of equals the first seen."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in priority.items() for x in p]),
                                       F.col("entity_type")), F.lit(0))
    return first_per_key(raw, ["name"], [-rank, *[F.col(c) for c in order]])


def merge_relations(raw: DataFrame, order: tuple[str, ...] = ("chunk_no", "position")) -> DataFrame:
    """The first row per (src, tgt, predicate)."""
    return first_per_key(raw, ["src", "tgt", "predicate"], [F.col(c) for c in order])


def build_document_graph(chunks: DataFrame, responses: DataFrame, priority: dict[str, int] = vocab.TYPE_PRIORITY,
                         types=vocab.ENTITY_TYPES, relation_types=vocab.RELATION_TYPES,
                         **fallback) -> tuple[DataFrame, DataFrame]:
    """Document nodes and edges from ``chunks(id, chunk_no, content, source, page)`` and
    supplied replies ``responses(chunk_id, response)``. A reply that is no JSON object, or
    is missing, sends its chunk to the fallback extractor."""
    shape = ("entities array<struct<entity_name:string,entity_type:string,description:string>>, "
             "relationships array<struct<src:string,tgt:string,type:string,description:string,weight:double>>")
    # an opening fence line goes, and then a last line that is a fence: either may be there without the other's end
    reply = strip("response")
    opened = F.regexp_replace(reply, r"\A```[^\n]*(?:\n|\z)", "")
    fenced = F.when(reply.startswith("```"), F.regexp_replace(opened, r"(?:\A|\n)[^\S\n]*```[^\S\n]*\z", "")).otherwise(reply)
    rows = chunks.join(responses.withColumnRenamed("chunk_id", "id"), "id", "left").withColumn(
        "json", F.when(F.try_parse_json(fenced).isNotNull() & F.ltrim(fenced).startswith("{") & strip(fenced).endswith("}"), fenced))
    read = rows.where("json is not null").select(F.col("id").alias("chunk_id"), "content", F.from_json("json", shape).alias("j"))
    names = F.transform("j.entities", lambda e: strip(F.coalesce(e["entity_name"], F.lit(""))))
    listed = F.arrays_zip(F.col("j.entities").alias("e"), names_in_text("content", names).alias("in_text"))
    raw_entities = (read.where("chunk_id is not null").select("chunk_id", F.posexplode(listed).alias("position", "l"))
                    .select("chunk_id", "position", "l.e.*", "l.in_text"))
    raw_relations = read.select("chunk_id", F.posexplode("j.relationships").alias("position", "r")).select("chunk_id", "position", "r.*")
    entities = validate_entities(raw_entities, types=types).where("reason = ''").drop("reason")
    relations = validate_relations(raw_relations, entities, relation_types)
    found = fallback_extract(rows.where("json is null"), **fallback)
    where = chunks.select(F.col("id").alias("chunk_id"), "chunk_no",
                          source_id(F.col("source"), F.col("page")).alias("source_id"))
    nodes = merge_entities(entities.unionByName(found).join(where, "chunk_id"), priority)
    edges = merge_relations(relations.join(where, "chunk_id"))
    return (nodes.select("name", "entity_type", "description", "source_id"),
            edges.select("src", "tgt", F.col("predicate").alias("keywords"), "description", "weight", "source_id"))
