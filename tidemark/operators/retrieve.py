"""Retrieval for a table of questions: keyword, vector and graph-aware, as evidence rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark import vocab
from tidemark.operators.graph import source_id
from tidemark.session import written
from tidemark.tables import Ordered, first_per_key, top_per_group

#: questions that meet the whole table in one pass
QUESTIONS_PER_PASS = 1024


def _passes(queries: DataFrame, size: int):
    """``queries`` (one row per query_id) in blocks of about ``size`` rows by a hash, as lists of rows. Each block is
    bounded, so it may travel to every task; the table that is searched stays where it is."""
    kept = written(queries, "questions")
    blocks = max(1, -(-kept.count() // size))
    for block in range(blocks):
        yield kept.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def document_lines(hits: DataFrame, chunks: DataFrame, chars: int = 300) -> DataFrame:
    """Keyword hits as text: source, page and the beginning of the chunk."""
    text = F.concat(F.lit("["), "source", F.lit(" 第"), F.col("page").cast("string"), F.lit("页]\n"),
                    F.substring("content", 1, chars), F.lit("..."))
    return (hits.join(chunks.select("chunk_id", "source", "page", "content"), "chunk_id")
            .select("query_id", "rank", "chunk_id", text.alias("line")))


def _best_of_task(asks: np.ndarray, ids: list, k: int):
    """Exact top-k per question over the vectors of one task."""
    length = np.linalg.norm(asks, axis=1)

    def run(batches):
        best = [(np.zeros(0), np.zeros(0, dtype=object)) for _ in ids]
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            items = np.array(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            lengths = length[:, None] * np.linalg.norm(items, axis=1)[None, :]
            scores = np.divide(asks @ items.T, lengths, out=np.zeros_like(lengths), where=lengths > 0)
            for row, mine in enumerate(scores):
                # everything that reaches the k-th best score, ties included
                floor = np.partition(mine, -k)[-k] if len(mine) > k else -np.inf
                at = np.flatnonzero(mine >= floor)
                value, name = np.concatenate([best[row][0], mine[at]]), np.concatenate([best[row][1], names[at]])
                order = sorted(range(len(value)), key=lambda i: (-value[i], name[i]))[:k]
                best[row] = value[order], name[order]
        yield [(ids[row], name, float(value)) for row, (values, found) in enumerate(best) for value, name in zip(values, found)]
    return run


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 5, per_pass: int = QUESTIONS_PER_PASS) -> DataFrame:
    """(query_id, item_id, score, rank) by cosine similarity, ties by item id.

    ``queries(query_id, vector)``, one row per question, ``vectors(item_id, vector)``. Blocks of questions of bounded size meet the
    vectors where these lie; each task sends its k best per question and no vector moves."""
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                           T.StructField("item_id", vectors.schema["item_id"].dataType), T.StructField("score", T.DoubleType())])
    kinds = to_arrow_schema(schema)

    def found(rows):
        if not rows:
            return vectors.select("item_id", "vector").where("false").mapInArrow(lambda batches: iter(()), schema)
        search = _best_of_task(np.array([row.vector for row in rows], dtype=np.float64), [row.query_id for row in rows], k)

        def run(batches):
            for best in search(batches):
                columns = list(zip(*best)) if best else [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)
        return vectors.select("item_id", "vector").mapInArrow(run, schema)

    # a block's best are written before the next block is collected
    return _union([written(top_per_group(found(rows), ["query_id"], [F.desc("score"), F.col("item_id")], k), "vector-hits")
                   for rows in _passes(queries.select("query_id", "vector"), per_pass)])


def chunk_evidence(hits: DataFrame, chunks: DataFrame, chars: int = 400) -> DataFrame:
    """(query_id, rank, line): ``[D1] (Chunk:source) text``, numbered from 1 per question."""
    text = F.concat(F.format_string("[D%d] (Chunk:", "rank"), F.coalesce("source", F.lit("unknown")), F.lit(") "),
                    F.substring(F.coalesce("content", F.lit("")), 1, chars))
    return (hits.join(chunks.select(F.col("chunk_id").alias("item_id"), "source", "content"), "item_id")
            .select("query_id", "rank", text.alias("line")))


def _hits(queries: DataFrame, vectors: DataFrame, k: int, item: str) -> DataFrame:
    """The nearest items, k rows per question; several joins read them, so they are written."""
    hits = vector_search(queries, vectors, k)
    return written(hits.select("query_id", F.col("item_id").alias(item), "rank", "score"), "hits")


def _ends(edges: DataFrame) -> DataFrame:
    """Every edge once per end, under ``_name``."""
    return edges.withColumn("_name", F.explode(F.array_distinct(F.array("src", "tgt"))))


def local_search(queries: DataFrame, node_vectors: DataFrame, nodes: DataFrame, edges: DataFrame,
                 k: int = 5, edges_per_node: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities nearest to the question, and the edges that touch them.

    ``edges_per_node`` keeps only a node's first edges by (src, tgt, keywords). For a reader of
    the first n relations by (rank, src, tgt, keywords) n of them are enough: whatever of
    the node comes before such a relation also ranks before it. So a hub ships n edges."""
    hits = _hits(queries, node_vectors, k, "name")
    entities = hits.join(nodes, "name")
    ends = _ends(edges)
    if edges_per_node is not None:
        order = Window.partitionBy("_name").orderBy("src", "tgt", "keywords")
        ends = ends.withColumn("_n", F.dense_rank().over(order)).where(F.col("_n") <= edges_per_node).drop("_n")
    touching = ends.join(hits.select("query_id", "rank", F.col("name").alias("_name")), "_name").drop("_name")
    relations = first_per_key(touching, ["query_id", "src", "tgt", "keywords"], [F.col("rank")])
    return entities, relations


def global_search(queries: DataFrame, edge_vectors: DataFrame, nodes: DataFrame, edges: DataFrame,
                  k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Edges nearest to the question (``edge_vectors`` and ``edges`` share ``edge_id``), and
    their end points."""
    hits = _hits(queries, edge_vectors, k, "edge_id")
    found = hits.join(edges, "edge_id")
    ends = found.select("query_id", "rank", "score", F.explode(F.array("src", "tgt")).alias("name"))
    ends = first_per_key(ends, ["query_id", "name"], [F.col("rank"), -F.col("score")])
    return ends.join(nodes, "name"), found.select("query_id", "src", "tgt", "keywords", "description", "weight",
                                                  *[c for c in ("source_id",) if c in edges.columns], "rank")


ENTITY_COLUMNS = {"query_id": None, "name": "string", "rank": "int", "entity_type": "string", "description": "string",
                  "source_id": "string"}
RELATION_COLUMNS = {"query_id": None, "src": "string", "tgt": "string", "keywords": "string", "description": "string",
                    "source_id": "string", "rank": "int"}


def _no_rows(queries: DataFrame, columns: dict) -> DataFrame:
    return queries.where(F.lit(False)).select(*[
        F.col(c) if kind is None else F.lit(None).cast(kind).alias(c) for c, kind in columns.items()])


def search(queries: DataFrame, graph: dict[str, DataFrame], mode: str = "hybrid", k: int = 5,
           shown: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, chunks) for ``mode`` naive, local, global or hybrid.

    ``graph`` has nodes, edges (with edge_id), chunks (chunk_id, source, page, content) and
    node_vectors, edge_vectors, chunk_vectors (item_id, vector). With ``shown`` a reader of the
    first ``shown`` rows per question and kind gets the same rows, and hubs and sources with
    very many edges or chunks are cut to that many before they are joined."""
    if mode == "naive":
        return _no_rows(queries, ENTITY_COLUMNS), _no_rows(queries, RELATION_COLUMNS), naive_chunks(queries, graph, k)
    if mode not in ("local", "global", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}; naive, local, global or hybrid")
    nodes, edges, chunks = graph["nodes"], graph["edges"], graph["chunks"]
    parts, origins = [], []
    if mode in ("local", "hybrid"):
        local = local_search(queries, graph["node_vectors"], nodes, edges, k, shown)
        parts.append(local)
        # where a node's edges come from: distinct before the join, however many there are
        node_sources = _ends(edges).select(F.col("_name").alias("name"), "source_id").distinct()
        origins.append(local[0].select("query_id", "name", "rank").join(node_sources, "name").select("query_id", "source_id", "rank"))
    if mode in ("global", "hybrid"):
        found = global_search(queries, graph["edge_vectors"], nodes, edges, k)
        parts.append(found)
        origins.append(found[1].select("query_id", "source_id", "rank"))
    entities, relations = (p.select(*columns) for p, columns in zip(parts[0], (list(ENTITY_COLUMNS), list(RELATION_COLUMNS))))
    for more in parts[1:]:
        entities = entities.unionByName(more[0].select(*ENTITY_COLUMNS))
        relations = relations.unionByName(more[1].select(*RELATION_COLUMNS))
    entities = first_per_key(entities, ["query_id", "name"], [F.col("rank")])
    relations = first_per_key(relations, ["query_id", "src", "tgt", "keywords"], [F.col("rank")])
    # provenance: the chunks the entities and relations came from
    sources = entities.select("query_id", "source_id", "rank")
    for origin in origins:
        sources = sources.unionByName(origin)
    sources = sources.groupBy("query_id", "source_id").agg(F.min("rank").alias("rank"))
    keyed = chunks.withColumn("source_id", source_id(F.col("source"), F.col("page")))
    if shown is not None:
        # all chunks of a source rank alike, so its first ones are all that can be shown
        first = top_per_group(keyed.select("source_id", "chunk_id"), ["source_id"], [_chunk_order()], shown, "_n")
        # written, so that its true size is known and chunk texts need no shuffle while it is small
        first = written(first.select("source_id", "chunk_id"), "first-chunks")
        keyed = keyed.join(first, ["source_id", "chunk_id"], "left_semi")
    back = sources.join(keyed, "source_id").select("query_id", "chunk_id", "source", "content", "rank")
    return entities, relations, back


def _chunk_order():
    """Chunk ids in an order that suits numbers as well as text."""
    return F.lpad(F.col("chunk_id").cast("string"), 40, " ")


def naive_chunks(queries: DataFrame, graph: dict[str, DataFrame], k: int = 5) -> DataFrame:
    hits = vector_search(queries, graph["chunk_vectors"], k).withColumnRenamed("item_id", "chunk_id")
    return hits.join(graph["chunks"], "chunk_id").select("query_id", "chunk_id", "source", "content", "rank")


def evidence_budget(entities: DataFrame, relations: DataFrame, chunks: DataFrame, items: int = 20,
                    reserved: int = 5, chars: int = 200, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, position, kind, line) within the budget: entities first, relations fill the
    rest of ``items - reserved`` (all of ``items`` where a question has no chunk), then up to
    ``reserved`` chunks. ``[E…]`` and ``[D…]`` share one counter. With ``queries`` a question
    without any evidence gets the line that says so.

    Every kind is cut to the budget per question before anything is counted or joined."""
    def cut(column="description"):
        return F.substring(F.coalesce(column, F.lit("")), 1, chars)

    def ranked(df, kind, order, text):
        return df.select("query_id", F.lit(kind).alias("kind"), "rank", F.concat_ws("\u0001", *order).alias("tie"), text.alias("text"))

    e = ranked(entities, 1, ["name"], F.concat(F.lit("(Entity:"), F.coalesce("entity_type", F.lit("?")), F.lit(") "),
                                               "name", F.lit(" — "), cut()))
    r = ranked(relations, 2, ["src", "tgt", "keywords"], F.concat(
        F.lit("(Relation:"), F.coalesce("keywords", F.lit("")), F.lit(") "), "src", F.lit(" → "), "tgt", F.lit(" — "), cut()))
    d = ranked(chunks, 3, [_chunk_order()], F.concat(
        F.lit("(Chunk:"), F.coalesce("source", F.lit("?")), F.lit(") "), cut("content")))
    rows = e.unionByName(r).unionByName(d)
    if queries is not None:
        asked = queries.select("query_id", F.lit(0).alias("kind"), F.lit(1).alias("rank"), F.lit("").alias("tie"),
                               F.lit(vocab.NO_EVIDENCE).alias("text"))
        rows = rows.unionByName(asked)
    best = top_per_group(rows, ["query_id", "kind"], [F.col("rank"), F.col("tie")],
                         max(items, reserved), "at")
    # at most items rows per question and kind from here on
    row = F.struct("kind", "at", "text")
    packed = (best.where((F.col("kind") < 3) | (F.col("at") <= reserved))
              .groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows")))
    documents = F.filter("rows", lambda x: x.kind == 3)
    facts = F.filter("rows", lambda x: (x.kind > 0) & (x.kind < 3))
    budget = F.when(F.size(documents) > 0, max(0, items - reserved)).otherwise(items)
    evidence = F.concat(F.slice(facts, F.lit(1), budget), documents)
    shown = packed.select("query_id", F.posexplode(F.when(F.size(evidence) > 0, evidence).otherwise(F.col("rows")))
                          .alias("p", "x"))
    letter = F.when(F.col("x.kind") == 3, "D").otherwise("E")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("none", "entity", "relation", "chunk")]), F.col("x.kind") + 1)
    nothing = F.col("x.kind") == 0
    return shown.select("query_id", F.when(nothing, 0).otherwise(F.col("p") + 1).alias("position"), kind.alias("kind"),
                        F.when(nothing, F.col("x.text")).otherwise(F.concat(
                            F.lit("["), letter, (F.col("p") + 1).cast("string"), F.lit("] "), F.col("x.text"))).alias("line"))


def number_evidence(rows: DataFrame, key: str = "query_id", order: str = "position", text: str = "text",
                    letter: str = "E") -> DataFrame:
    """``[E1] …`` in order per question."""
    numbered = Ordered(rows, [key], [order]).row_number("number").result()
    return numbered.select(key, "number", F.concat(F.lit(f"[{letter}"), F.col("number").cast("string"), F.lit("] "), text)
                           .alias("line"))


def query_with_evidence(queries: DataFrame, graph: dict[str, DataFrame], mode: str = "hybrid", k: int = 5,
                        **budget) -> DataFrame:
    """Evidence rows per question. A question for which the graph modes find no chunk gets
    the five nearest ones; a question without any evidence gets the line that says so."""
    entities, relations, chunks = search(queries, graph, mode, k, max(budget.get("items", 20), budget.get("reserved", 5)))
    if mode != "naive":
        without = queries.join(chunks.select("query_id"), "query_id", "left_anti")
        chunks = chunks.unionByName(naive_chunks(without, graph, 5))
    return evidence_budget(entities, relations, chunks, queries=queries, **budget)


def policy_queries(queries: DataFrame, prefix: str = vocab.POLICY_QUERY_PREFIX) -> DataFrame:
    """Questions with the fixed phrase for policy search in front; embed these, then query."""
    return queries.withColumn("text", F.concat(F.lit(prefix), "text"))


def policy_search(queries: DataFrame, graph: dict[str, DataFrame], embed, **options) -> DataFrame:
    """``query_with_evidence`` on prefixed questions; ``embed`` maps (query_id, text) rows to
    (query_id, vector) rows."""
    return query_with_evidence(embed(policy_queries(queries)), graph, "hybrid", **options)
