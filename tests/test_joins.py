"""Joins for heavy keys, and the graph operators that use them."""

import pytest
from pyspark.sql import functions as F

from tidemark import tables
from tidemark.operators import graph as g
from tidemark.session import written

NODE = "name string, entity_type string, description string, source_id string"
EDGE = "src string, tgt string, keywords string, description string, weight double, source_id string"


def sides(spark):
    """Key 1 has 1200 x 900 rows, key 2 many on the left only, key 3 many on the right only; null joins nothing."""
    left = spark.range(4000).selectExpr("CASE WHEN id < 1200 THEN 1 WHEN id < 2500 THEN 2 WHEN id < 2510 THEN NULL ELSE id END AS k", "id AS a")
    right = spark.range(3000).selectExpr("CASE WHEN id < 900 THEN 1 WHEN id < 1900 THEN 3 WHEN id = 1900 THEN 2 WHEN id = 1901 THEN NULL ELSE id END AS k", "id AS b")
    return written(left.unionByName(spark.createDataFrame([(3, -1)], "k long, a long")), "left"), written(right, "right")


@pytest.mark.parametrize("least", [10, 10_000])
def test_matrix_join_equals_a_plain_join(spark, least):
    left, right = sides(spark)
    found, want = tables.matrix_join(left, right, ["k"], 64, least), left.join(right, "k")
    assert found.count() == want.count()
    assert found.exceptAll(want).isEmpty()


def test_no_cell_of_a_matrix_join_is_crowded(spark):
    """100,000 x 100,000 rows of one key: every cell gets a tenth of each side, all cells together every pair once."""
    left, right = (written(spark.range(100_000).selectExpr("id % 1 AS k", f"id AS {n}"), n) for n in "ab")
    ours, theirs = tables.dealt_sides(left, right, ["k"])
    a, b = (x.groupBy("k", "_r", "_c").count().cache() for x in (ours, theirs))
    assert a.agg(F.max("count")).first()[0] < 11_000 and b.agg(F.max("count")).first()[0] < 11_000
    pairs = a.join(b, ["k", "_r", "_c"]).agg(F.sum(a["count"] * b["count"]), F.count("*")).first()
    assert tuple(pairs) == (10**10, 100)


def test_heavy_keys_are_bounded_in_number(spark):
    rows = written(spark.range(10_000).selectExpr("id % 3000 AS k", "id"), "rows")
    assert tables.heavy_keys(rows, ["k"], shares=4, least=1).count() == 0
    some = written(spark.range(10_000).selectExpr("id % 3 AS k"), "rows")
    assert sorted(r["k"] for r in tables.heavy_keys(some, ["k"], shares=4, least=1).collect()) == [0, 1, 2]


@pytest.mark.parametrize("least", [3, 10_000])
def test_semi_join(spark, least, monkeypatch):
    monkeypatch.setattr(tables.heavy_keys, "__defaults__", (4096, least))
    many = written(spark.range(100).selectExpr("id % 7 AS k", "id % 10 AS v"), "many")
    keys = spark.createDataFrame([(2,), (2,), (5,), (None,), (99,)], "k long")
    found = tables.semi_join(many, keys, ["k"]).select("k", "v")
    want = many.where("k IN (2, 5)").select("k", "v")
    assert found.count() == want.count() and found.exceptAll(want).isEmpty()


@pytest.fixture(scope="module")
def hub(spark):
    """A hub event H with 300 points, each named twice, one of them on two boundaries; other events lead nowhere."""
    edges = [("H", f"p{i}", "INVOLVES_POINT, x") for i in range(300)] * 2 + [("E", "p1", "INVOLVES_POINT"), ("F", "p2", "INVOLVES_POINT")]
    edges += [("H", "B1", "ON_BOUNDARY"), ("H", "B2", "ON_BOUNDARY"), ("E", "B1", "ON_BOUNDARY"), ("G", "B1", "ON_BOUNDARY"), ("B1", "B0", "TRANSITION_FROM")]
    nodes = [(f"p{i}", "Point") for i in range(299)] + [("p299", "Thing")] + [(x, "STTE_Event") for x in "HEFG"] + [(x, "Boundary") for x in ("B0", "B1", "B2")]
    return (spark.createDataFrame([(n, k, "", "s") for n, k in nodes], NODE),
            spark.createDataFrame([(s, t, k, "", 1.0, "s") for s, t, k in edges], EDGE))


@pytest.mark.parametrize("least", [2, 10_000])
def test_two_hop_through_a_hub(spark, hub, least, monkeypatch):
    monkeypatch.setattr(tables.heavy_keys, "__defaults__", (4096, least))
    found = sorted(map(tuple, g.two_hop(*hub, "INVOLVES_POINT", "ON_BOUNDARY").collect()))
    assert found == sorted([(f"p{i}", "H", b) for i in range(300) for b in ("B1", "B2")] + [("p1", "E", "B1")])
    typed = g.path(*hub, [("INVOLVES_POINT", "in"), ("ON_BOUNDARY", "out"), ("TRANSITION_FROM", "any")], ["Point", None, "Boundary", "Boundary"])
    assert sorted(map(tuple, typed.collect())) == sorted([(f"p{i}", "H", "B1", "B0") for i in range(299)] + [("p1", "E", "B1", "B0")])
    assert sorted(map(tuple, g.path(*hub, [("TRANSITION_FROM", "any")]).collect())) == [("B0", "B1"), ("B1", "B0")]
    points = g.points_of_event(*hub).groupBy("event").count().collect()
    assert {r["event"]: r["count"] for r in points} == {"H": 598, "E": 1, "F": 1}


def test_edges_are_reduced_before_they_are_made_distinct(spark, hub):
    plan = g.two_hop(*hub, "INVOLVES_POINT", "ON_BOUNDARY")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_chunks_of_a_crowded_place(spark, monkeypatch):
    monkeypatch.setattr(tables.dealt_sides, "__defaults__", (4096, 10))
    rows = spark.range(200).selectExpr("concat('n', id) AS name", "CASE WHEN id < 150 THEN 'doc_p1' ELSE 'doc' END AS source_id")
    chunks = spark.range(120).selectExpr("concat('c', id) AS id", "'doc' AS source", "CAST(id % 2 AS INT) AS page", "'text' AS content")
    found = g.chunks_of(rows, chunks)
    assert found.columns == ["source_id", "name", "chunk_id", "content"]
    assert {r["source_id"]: r["count"] for r in found.groupBy("source_id").count().collect()} == {"doc_p1": 150 * 60, "doc": 50 * 60}
    assert found.distinct().count() == 200 * 60


@pytest.mark.parametrize("least", [2, 10_000])
def test_subgraphs_around_a_hub(spark, hub, least, monkeypatch):
    monkeypatch.setattr(tables.heavy_keys, "__defaults__", (4096, least))
    nodes, edges = g.filter_by_type(*hub, "Boundary")
    assert sorted(r["name"] for r in nodes.collect()) == ["B0", "B1", "B2"]
    assert edges.columns == hub[1].columns and [(r["src"], r["tgt"]) for r in edges.collect()] == [("B1", "B0")]
    nodes, edges = g.search_subgraph(*hub, "P299")
    assert sorted(r["name"] for r in nodes.collect()) == ["H", "p299"] and edges.count() == 2


def test_a_product_of_small_tables_is_dealt_over_the_cores(spark):
    many = spark.range(1000).select(F.col("id").alias("a"), F.lit(1).alias("k"))
    few = spark.range(50).select(F.col("id").alias("b"), F.lit(1).alias("k"))
    pairs = tables.salted_join(many, few, ["k"], ["a"])
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 50_000 and pairs.distinct().count() == 50_000
    assert len(sizes) > spark.sparkContext.defaultParallelism and max(sizes) < 5_000


def test_no_side_of_a_product_is_gathered_in_the_driver(spark, monkeypatch):
    """A small side looks small to Spark even when it is repeated for every cell: without a word against it, it is broadcast."""
    many = written(spark.range(400).selectExpr("CAST(id % 3 AS INT) AS k", "NULLIF(id % 50, 7) AS a"), "many")
    few = written(spark.range(90).selectExpr("CAST(NULLIF(id % 4, 3) AS INT) AS k", "NULLIF(id % 20, 0) AS b"), "few")
    monkeypatch.setattr(tables, "PAIRS_PER_TASK", 1_000, raising=False)
    pairs = tables.salted_join(many, few, ["k"], ["a"])
    got, want = pairs.collect(), many.join(few, "k").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 8_000
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    # 36,000 pairs at most: more tasks than the 32 that there are for the cores
    assert tables.salted_join(many, few, ["k"], ["a"]).rdd.getNumPartitions() == 36


def test_a_search_works_out_its_edges_once(spark):
    """The edges that come in are read by one job, whatever is asked of the result."""
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for row in rows:
            seen.add(len(row))
            yield row
    nodes = spark.createDataFrame([(n, "Point", "", "") for n in "abcd"], NODE)
    edges = spark.createDataFrame([("a", "b", "NEAR", "", 1.0, ""), ("b", "c", "NEAR", "", 1.0, ""), ("c", "d", "NEAR", "", 1.0, "")], EDGE)
    found = g.search_subgraph(nodes, edges.mapInPandas(count, edges.schema), "A")
    assert sorted(r.name for r in found[0].collect()) == ["a", "b"]
    assert [(r.src, r.tgt) for r in found[1].collect()] == [("a", "b")]
    assert seen.value == 3
