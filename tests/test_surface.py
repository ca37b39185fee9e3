"""Functions under their SQL names, the tool table, and the package's own rules."""

from pyspark.sql import functions as F

from tidemark.functions import sql, text as tx
from tidemark.operators.chunking import packed_paragraphs, packed_sentences
from tidemark.toolset import TOOLS


def test_sql_functions(spark):
    names = sql.register(spark)
    assert "chunk_text" in names
    row = spark.sql("""SELECT haversine_km(0, 0, 0, 1) AS km, predicate_of('A, b') AS p, land_use_code('x | 用地:R2 | y') AS u,
      question_hash('q') AS h, normalize_question(' A  b ') AS n, chunk_id('s', 1, 2, 'text') AS c,
      duration_years(timestamp'2020-01-01', timestamp'2024-01-01') AS y""").collect()[0]
    assert round(row.km, 3) == 111.195 and (row.p, row.u, row.n) == ("A", "R2", "ab") and round(row.y, 3) == 4.0
    same = spark.range(1).select(tx.question_hash(F.lit("q")).alias("h"), tx.chunk_id(F.lit("s"), F.lit(1), F.lit(2), F.lit("text")).alias("c")).collect()[0]
    assert (row.h, row.c) == (same.h, same.c)


def test_sql_chunks_equal_the_column_form(spark):
    sql.register(spark)
    texts = ["one\n two \n\nthree four\nfive", "", "x" * 50 + "\nshort", "a\nb\nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    docs.createOrReplaceTempView("surface_docs")
    got = spark.sql("SELECT doc_id, c.chunk_index, c.content FROM surface_docs, LATERAL chunk_text(text, 12, 3) c")
    want = docs.select("doc_id", F.posexplode(packed_paragraphs("text", 12, 3)).alias("chunk_index", "content"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    texts = ["One! Two two? Three; four", "short", "", "。" * 30, "no mark at all but long " * 4 + "! end "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    docs.createOrReplaceTempView("surface_docs")
    got = spark.sql("SELECT doc_id, c.chunk_index, c.content FROM surface_docs, LATERAL pack_sentences(text, 12, 3) c")
    want = docs.select("doc_id", F.posexplode(packed_sentences("text", 12, 3)).alias("chunk_index", "content"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tools(spark):
    assert len(TOOLS) == 13
    nodes = spark.createDataFrame([("a", "Point", "d"), ("b", "Point", "e")], "name string, entity_type string, description string")
    assert [(r.name, r.total) for r in TOOLS["list_all_entities"](nodes).collect()] == [("a", 2), ("b", 2)]
    assert TOOLS["get_entity_info"](nodes, "b").count() == 1
    chunks = spark.createDataFrame([(1, "f", 1, "red gear and bolt", 1), (2, "f", 2, "blue", 2)], "chunk_id int, source string, page int, content string, position int")
    asked = spark.createDataFrame([(7, "which gear or bolt")], "query_id int, text string")
    assert [r.line for r in TOOLS["retrieve_document_content"](asked, chunks).collect()] == ["[f 第1页]\nred gear and bolt..."]
