"""Queries that answer a table of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lexical, retrieve as r
from tidemark.plans import inputs as i
from tidemark.plans.texts import documents
from tidemark.session import scratch_path, written

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


TOKENS_SQL = r"list_distinct(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}'))"
KEYWORD_SQL = f"""WITH q AS (SELECT item_id AS query_id, unnest({TOKENS_SQL}) AS w FROM benchmark), c AS (SELECT doc_id AS chunk_id, unnest({TOKENS_SQL}) AS w FROM documents),
  s AS (SELECT query_id, chunk_id, count(*) AS score FROM q JOIN c USING (w) GROUP BY ALL),
  hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s)"""


def _questions_and_chunks(spark, folder):
    questions = i.table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    chunks = documents(spark, folder).select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("position"), F.col("text").alias("content"))
    return questions, chunks


@query(KEYWORD_SQL + " SELECT query_id, chunk_id, score, rank FROM hits WHERE rank <= 5")
def keyword_search(spark, folder):
    return lexical.keyword_search(*_questions_and_chunks(spark, folder), 5)


@query(KEYWORD_SQL + " SELECT query_id, chunk_id, score, rank FROM hits WHERE rank <= 3")
def stored_keyword_search(spark, folder):
    """The index of all words is built once and read again for the questions."""
    questions, chunks = _questions_and_chunks(spark, folder)
    path = scratch_path(spark, "stored-index")
    lexical.build_keyword_index(chunks, path)
    return lexical.search_index(questions, lexical.read_keyword_index(spark, path), 3)


@query(KEYWORD_SQL + """ SELECT query_id, rank, chunk_id, '[' || source || ' 第1页]' || chr(10) || substr(text, 1, 300) || '...' AS line
  FROM hits JOIN documents ON doc_id = chunk_id WHERE rank <= 5""")
def document_lines(spark, folder):
    chunks = documents(spark, folder).select(F.col("doc_id").alias("chunk_id"), "source", F.lit(1).alias("page"), F.col("text").alias("content"))
    return r.document_lines(lexical.keyword_search(*_questions_and_chunks(spark, folder), 5), chunks)


# the questions of the vector queries are the mean vectors of the labels
CENTROIDS_SQL = """dims AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
  centroids AS (SELECT label AS query_id, list(x ORDER BY d) AS vector FROM (SELECT label, d, avg(x) AS x FROM dims GROUP BY label, d) GROUP BY label),
  scored AS (SELECT query_id, vec_id, list_cosine_similarity(c.vector, e.embedding::DOUBLE[]) AS score FROM centroids c, embeddings e),
  hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)"""


def centroids(spark, folder):
    dims = i.table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    means = dims.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # one entry per dimension
    vectors = means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s.x).alias("vector"))
    # stands for a table of question vectors, which the searches read several times
    return written(vectors, "question-vectors")


@query(f"WITH {CENTROIDS_SQL} SELECT query_id, vec_id AS item_id, round(score, 6) AS score, rank FROM hits WHERE rank <= 10")
def vector_search(spark, folder):
    vectors = i.table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return r.vector_search(centroids(spark, folder), vectors, 10).withColumn("score", F.round("score", 6))


# vectors as nodes, consecutive ones as edges, documents of the same number as chunks
GRAPH_SQL = f"""{CENTROIDS_SQL},
  nodes AS (SELECT 'V' || lpad(CAST(vec_id AS VARCHAR), 12, '0') AS name, 'L' || label AS entity_type, 'vector ' || vec_id AS description,
     CASE WHEN label = 0 THEN 'none_p1' ELSE 'src' || (vec_id % 3) || '_p1' END AS source_id, vec_id FROM embeddings),
  edges AS (SELECT name AS src, 'V' || lpad(CAST(vec_id + 1 AS VARCHAR), 12, '0') AS tgt, 'NEXT, order' AS keywords, 'step ' || vec_id AS description, source_id, vec_id AS edge_id FROM nodes),
  top AS (SELECT query_id, rank, n.* FROM hits h JOIN nodes n ON n.vec_id = h.vec_id WHERE rank <= 5),
  local_e AS (SELECT query_id, name, entity_type, description, source_id, rank FROM top),
  local_r AS (SELECT query_id, src, tgt, keywords, e.description, e.source_id, min(rank) AS rank FROM top t JOIN edges e ON e.src = t.name OR e.tgt = t.name GROUP BY ALL),
  global_r AS (SELECT query_id, src, tgt, keywords, e.description, e.source_id, rank FROM top t JOIN edges e ON e.edge_id = t.vec_id),
  global_e AS (SELECT query_id, n.name, n.entity_type, n.description, n.source_id, min(rank) AS rank FROM (SELECT query_id, rank, unnest([src, tgt]) AS name FROM global_r) g JOIN nodes n ON n.name = g.name GROUP BY ALL)"""


def _evidence_sql(entities: str, relations: str) -> str:
    return f"""WITH {GRAPH_SQL}, e AS ({entities}), rel AS ({relations}),
  src AS (SELECT query_id, source_id, min(rank) AS rank FROM (SELECT query_id, source_id, rank FROM e UNION ALL SELECT query_id, source_id, rank FROM rel) GROUP BY ALL),
  back AS (SELECT query_id, d.doc_id AS chunk_id, d.source, d.text AS content, rank FROM src JOIN documents d ON d.source || '_p1' = src.source_id),
  naive AS (SELECT query_id, d.doc_id AS chunk_id, d.source, d.text AS content, rank FROM hits h JOIN documents d ON d.doc_id = h.vec_id WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM back)),
  c AS (SELECT * FROM back UNION ALL SELECT * FROM naive),
  ranked AS (
   SELECT query_id, 1 AS kind, row_number() OVER (PARTITION BY query_id ORDER BY rank, name) AS pos, '(Entity:' || entity_type || ') ' || name || ' — ' || description AS text FROM e
   UNION ALL SELECT query_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY rank, src, tgt, keywords), '(Relation:' || keywords || ') ' || src || ' → ' || tgt || ' — ' || description FROM rel
   UNION ALL SELECT query_id, 3, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id), '(Chunk:' || source || ') ' || substr(content, 1, 200) FROM c),
  facts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind, pos) AS n FROM ranked WHERE kind < 3),
  shown AS (SELECT query_id, kind, pos, text FROM facts WHERE n <= CASE WHEN query_id IN (SELECT query_id FROM c) THEN 15 ELSE 20 END
   UNION ALL SELECT query_id, kind, pos, text FROM ranked WHERE kind = 3 AND pos <= 5),
  numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY kind, pos) AS INT) AS position FROM shown)
  SELECT query_id, position, CASE kind WHEN 1 THEN 'entity' WHEN 2 THEN 'relation' ELSE 'chunk' END AS kind,
   '[' || CASE kind WHEN 3 THEN 'D' ELSE 'E' END || position || '] ' || text AS line FROM numbered"""


def vector_graph(spark, folder):
    vectors = i.table(spark, folder, "embeddings")

    def name(column):
        return F.concat(F.lit("V"), F.lpad(column.cast("string"), 12, "0"))
    source = F.when(F.col("label") == 0, "none_p1").otherwise(F.concat(F.lit("src"), (F.col("vec_id") % 3).cast("string"), F.lit("_p1")))
    nodes = vectors.select(name(F.col("vec_id")).alias("name"), F.concat(F.lit("L"), "label").alias("entity_type"),
                           F.concat(F.lit("vector "), "vec_id").alias("description"), source.alias("source_id"))
    edges = vectors.select(name(F.col("vec_id")).alias("src"), name(F.col("vec_id") + 1).alias("tgt"), F.lit("NEXT, order").alias("keywords"),
                           F.concat(F.lit("step "), "vec_id").alias("description"), F.lit(1.0).alias("weight"), source.alias("source_id"),
                           F.col("vec_id").alias("edge_id"))
    chunks = documents(spark, folder).select(F.col("doc_id").alias("chunk_id"), "source", F.lit(1).alias("page"), F.col("text").alias("content"))

    def as_vectors(item):
        return vectors.select(item.alias("item_id"), F.col("embedding").alias("vector"))
    return {"nodes": nodes, "edges": edges, "chunks": chunks, "node_vectors": as_vectors(name(F.col("vec_id"))),
            "edge_vectors": as_vectors(F.col("vec_id")), "chunk_vectors": as_vectors(F.col("vec_id"))}


def _evidence(mode):
    def run(spark, folder):
        return r.query_with_evidence(centroids(spark, folder), vector_graph(spark, folder), mode)
    return run


for _mode, _e, _r in (("local", "SELECT * FROM local_e", "SELECT * FROM local_r"), ("global", "SELECT * FROM global_e", "SELECT * FROM global_r"),
                      ("hybrid", "SELECT query_id, name, entity_type, description, source_id, min(rank) AS rank FROM (SELECT * FROM local_e UNION ALL SELECT * FROM global_e) GROUP BY ALL",
                       "SELECT query_id, src, tgt, keywords, description, source_id, min(rank) AS rank FROM (SELECT * FROM local_r UNION ALL SELECT * FROM global_r) GROUP BY ALL")):
    QUERIES[f"evidence_{_mode}"] = _evidence(_mode)
    ORACLES[f"evidence_{_mode}"] = _evidence_sql(_e, _r)

QUERIES["evidence_naive"] = _evidence("naive")
ORACLES["evidence_naive"] = f"""WITH {CENTROIDS_SQL} SELECT query_id, 0 AS position, 'none' AS kind, '(未检索到结构化证据)' AS line FROM centroids
  WHERE query_id NOT IN (SELECT query_id FROM hits JOIN documents ON doc_id = vec_id WHERE rank <= 5) UNION ALL SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS position, 'chunk' AS kind,
  '[D' || row_number() OVER (PARTITION BY query_id ORDER BY rank) || '] (Chunk:' || source || ') ' || substr(text, 1, 200) AS line
  FROM hits JOIN documents ON doc_id = vec_id WHERE rank <= 5"""


@query(f"""WITH {CENTROIDS_SQL} SELECT query_id, rank, '[D' || rank || '] (Chunk:' || source || ') ' || substr(text, 1, 400) AS line
  FROM hits JOIN documents ON doc_id = vec_id WHERE rank <= 5""")
def chunk_evidence(spark, folder):
    graph = vector_graph(spark, folder)
    return r.chunk_evidence(r.vector_search(centroids(spark, folder), graph["chunk_vectors"], 5), graph["chunks"])


@query("""SELECT conv_id AS query_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS number,
  '[E' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '] ' || text AS line FROM conversations""")
def number_evidence(spark, folder):
    return r.number_evidence(i.table(spark, folder, "conversations").withColumnRenamed("conv_id", "query_id"), order="turn")


@query("SELECT item_id AS query_id, '政策文档相关内容: ' || text AS text FROM benchmark")
def policy_queries(spark, folder):
    return r.policy_queries(i.table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query(_evidence_sql("SELECT query_id, name, entity_type, description, source_id, min(rank) AS rank FROM (SELECT * FROM local_e UNION ALL SELECT * FROM global_e) GROUP BY ALL",
                     "SELECT query_id, src, tgt, keywords, description, source_id, min(rank) AS rank FROM (SELECT * FROM local_r UNION ALL SELECT * FROM global_r) GROUP BY ALL"))
def policy_search(spark, folder):
    # the embedding of a question is an input: here the mean vector of its label
    vectors = centroids(spark, folder)
    asked = vectors.select("query_id", F.concat(F.lit("label "), "query_id").alias("text"))
    return r.policy_search(asked, vector_graph(spark, folder), lambda q: q.select("query_id").join(vectors, "query_id"))
