"""Audits, sessions, traces, memory, evaluation, retrieval, stores and streams."""

import json
import random
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit as au, evaluate as ev, memory as me, retrieve as r, sessions as se, traces as tc
from tidemark.sources import files, stores
from tidemark.streaming import jobs
from tidemark.streaming import runs
from tidemark.streaming.runs import finish, latest, replay
from tidemark.tables import Ordered, split_hot_join


# -- ordered windows and joins under skew ------------------------------------------------

@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("hot_rows", [10_000, 5])
def test_ordered_functions(spark, keys, hot_rows):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{n % 4}", n, rng.choice([None, 1, 2, 5])) for n in range(200)]
    df = spark.createDataFrame(rows, "k string, n int, v int")
    ordered = Ordered(df, keys, ["n"], hot_rows).row_number("rn").running_sum("total", F.col("v"))
    ordered.running_sum("before", F.coalesce("v", F.lit(0)), inclusive=False).running_max("top", F.struct("v", "n")).lag("prev", F.col("v"))
    assert ordered.split == (hot_rows == 5)
    got = {row.n: row for row in ordered.result().collect()}
    assert len(got) == 200
    seen = {}
    for k, n, v in rows:
        mine = seen.setdefault(k if keys else None, [])
        assert got[n].rn == len(mine) + 1
        assert got[n].before == sum(x or 0 for x, _ in mine)
        assert got[n].prev == (mine[-1][0] if mine else None)
        mine.append((v, n))
        assert got[n].total == sum(x or 0 for x, _ in mine)
        assert tuple(got[n].top) == max(mine, key=lambda p: (p[0] is not None, p[0] or 0, p[1]))


def test_split_hot_join(spark):
    many = spark.createDataFrame([("a" if n < 80 else "b", n) for n in range(100)], "k string, n int")
    few = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, m int")
    plain = sorted(map(tuple, many.join(few, ["k"]).collect()))
    assert sorted(map(tuple, split_hot_join(many, few, ["k"], ["n"], rows_per_task=10).collect())) == plain


# -- audits --------------------------------------------------------------------------------

def audit(spark, text, calls=(), evidence=()):
    summaries = spark.createDataFrame([("t", text)], "task_id string, text string")
    calls = spark.createDataFrame([("t", a, o) for a, o in calls], "task_id string, agent string, output string")
    evidence = spark.createDataFrame([("t", a, i) for a, i in evidence], "task_id string, agent string, id string")
    return au.citation_audit(summaries, calls, evidence).collect()[0]


def test_citation_audit(spark):
    calls = [("SpatialEventAgent", "[answer] [E9]\n[evidence]\n[E1] a\n[E2] b")]
    recorded = [("SpatialEventAgent", "E20"), ("GraphReasoningAgent", "D1")]
    good = audit(spark, "x [空间分析-E1] [空间分析-E2] [图谱推理-D1]", calls, recorded)
    assert (good.total, good.valid, good.fabricated, good.rate) == (3, 3, [], 0.0)
    bad = audit(spark, "x [空间分析-E20] [空间分析-E9] [空间分析-E1]", calls, recorded)
    assert (bad.total, bad.valid, bad.fabricated) == (3, 1, ["空间分析-E20", "空间分析-E9"]) and abs(bad.rate - 2 / 3) < 1e-9
    unknown = audit(spark, "[政策分析-E1]", calls)
    assert (unknown.total, unknown.valid, unknown.unknown_label, unknown.rate) == (1, 0, ["政策分析-E1"], 1.0)
    assert audit(spark, "no citation").rate == 0.0


def test_self_audit_threshold(spark):
    answers = spark.createDataFrame([("over", "[E1] [E8] [E9]"), ("under", "[E1] [E1] [E1] [E1] [E9]"), ("none", "[E9]"), ("plain", "text")],
                                    "task_id string, text string")
    calls = spark.createDataFrame([(t, 0, "tool", "[evidence]\n[E1] fact") for t in ("over", "under", "plain")],
                                  "task_id string, call_no int, name string, output string")
    got = {row.task_id: row for row in au.self_audit(answers, calls).collect()}
    assert abs(got["over"].rate - 2 / 3) < 1e-9 and "[⚠E8-引用无效]" in got["over"].text and "的实际证据 ---\n[E1] fact" in got["over"].text
    assert got["under"].rate == 0.2 and got["under"].text == "[E1] [E1] [E1] [E1] [⚠E9-引用无效]"
    assert got["none"].text == "[E9]" and got["none"].cited_total == 0
    assert got["plain"].text == "text"


def test_self_audit_appends_every_block(spark):
    """Evidence without ids is appended too, and so is that of any number of calls."""
    answers = spark.createDataFrame([("no ids", "[E1]"), ("many", "[E0]"), ("nothing", "[E1]")], "task_id string, text string")
    calls = [("no ids", 0, "t", "[evidence]\nno ids here"), ("nothing", 0, "t", "plain")] + [("many", n, "t", f"[evidence]\n[E{n + 1}] x") for n in range(1001)]
    got = {r.task_id: r for r in au.self_audit(answers, spark.createDataFrame(calls, "task_id string, call_no int, name string, output string")).collect()}
    assert got["no ids"].rate == 1.0 and got["no ids"].text.endswith("--- 工具 `t` 的实际证据 ---\nno ids here")
    assert got["nothing"].text == "[⚠E1-引用无效]"
    assert got["many"].text.count("的实际证据") == 1001 and got["many"].text.endswith("[E1001] x")


@pytest.mark.parametrize("hot_rows", [1000, 2])
def test_renumber_evidence(spark, hot_rows):
    calls = [("s", 0, "[E1] a [E2] b [D1] d"), ("s", 1, "[E1] c [E2] d, again [E1]"), ("s", 2, "none"), ("s", 3, "[E3] x [E1] y [D1] z"), ("o", 0, "[E7]")]
    df = spark.createDataFrame(calls, "session_id string, call_no int, output string")
    got = {(row.session_id, row.call_no): row.output for row in au.renumber_evidence(df, hot_rows=hot_rows).collect()}
    assert got == {("s", 0): "[E1] a [E2] b [D1] d", ("s", 1): "[E3] c [E4] d, again [E3]", ("s", 2): "none", ("s", 3): "[E5] x [E6] y [D2] z", ("o", 0): "[E1]"}


# -- tokens, routing, evaluation --------------------------------------------------------------

def test_cost(spark):
    df = spark.createDataFrame([(10000, 5000, 8000)], "input int, output int, cache_read int")
    assert df.select(se.estimate_cost().alias("c")).collect()[0].c == pytest.approx(0.0208)


def test_route(spark):
    df = spark.createDataFrame([(1, "边界的扩张趋势"), (2, "x"), (3, "请撰写报告")], "question_id int, question string")
    model = spark.createDataFrame([(1, 0.9, 0.1, 0.5), (2, 0.0, 0.0, 0.0)], "question_id int, SpatialEventAgent double, GraphReasoningAgent double, TemporalReasoningAgent double")
    got = {row.question_id: row for row in ev.route(df, model).collect()}
    assert got[1].categories == ["SpatialEventAgent", "TemporalReasoningAgent"] and got[2].categories == ["GraphReasoningAgent"]
    assert len(got[3].categories) == 3 and got[3].is_report
    assert got[1].scores.SpatialEventAgent == pytest.approx(round(0.3 * round(2 / 18, 3) + 0.7 * 0.9, 3))
    # keywords that look like patterns match literally, so they never fire
    dotted = spark.createDataFrame([("对比2020年",)], "q string").select(ev.keyword_route("q").alias("r")).collect()[0].r
    assert dotted == ["GraphReasoningAgent"]


# -- spans ---------------------------------------------------------------------------------------

def test_span_tree_deep_and_cyclic(spark):
    rows = [("t", f"s{n}", f"s{n - 1}" if n else None, n) for n in range(40)] + [("t", "x", "y", 1), ("t", "y", "x", 2), ("u", "o", "gone", 5)]
    df = spark.createDataFrame([(f"n{i}", t, s, p, at, at + 1, 1.0, {"a": "b"}, "OK") for i, (t, s, p, at) in enumerate(rows)], files.SPANS)
    tree = {row.span_id: row for row in tc.span_tree(df).collect()}
    assert len(tree) == len(rows)
    assert all(tree[f"s{n}"].depth == n and tree[f"s{n}"].root_id == "s0" for n in range(40))
    assert tree["x"].depth is None and tree["y"].depth is None and tree["o"].depth == 0
    paths = sorted(tree[f"s{n}"].path for n in range(40))
    assert [p.split(":")[-1] for p in paths] == [f"s{n}" for n in range(40)]


# -- memory -----------------------------------------------------------------------------------------

def test_compact_questions(spark):
    asked = ["A b", "a B", "c", "C ", "A b", "d" * 300]
    df = spark.createDataFrame([("u", n, q) for n, q in enumerate(asked)], "user_id string, position int, question string")
    for hot_rows in (1000, 2):
        rows = me.compact_questions(df, cap=3, hot_rows=hot_rows).orderBy("position").collect()
        assert [row.question for row in rows] == ["c", "A b", "d" * 200] and rows[0].total == 6


# -- retrieval ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("per_part", [20_000, 7])
def test_vector_search_equals_brute_force(spark, per_part):
    rng = np.random.default_rng(5)
    vectors, asks = rng.normal(size=(50, 6)), rng.normal(size=(4, 6))
    vectors[10] = vectors[3]  # a tie
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vectors)], "item_id int, vector array<double>")
    queries = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(asks)] + [(9, vectors[3].tolist())], "query_id int, vector array<double>")
    got = {}
    for row in r.vector_search(queries, df, 3, per_part).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.item_id)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for n, ask in [*enumerate(asks), (9, vectors[3])]:
        scores = unit @ (ask / np.linalg.norm(ask))
        assert got[n] == sorted(range(50), key=lambda i: (-round(scores[i], 12), i))[:3]


def test_evidence_budget(spark):
    entities = spark.createDataFrame([(1, n, f"e{n:02d}", "T", "d" * 300) for n in range(30)], "query_id int, rank int, name string, entity_type string, description string")
    relations = spark.createDataFrame([(q, n, "a", f"b{n}", "K", "d") for q in (1, 2) for n in range(30)], "query_id int, rank int, src string, tgt string, keywords string, description string")
    chunks = spark.createDataFrame([(1, n, n, "f", "text") for n in range(9)], "query_id int, rank int, chunk_id int, source string, content string")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    rows = r.evidence_budget(entities, relations, chunks, queries=queries).orderBy("query_id", "position").collect()
    one = [row for row in rows if row.query_id == 1]
    assert [row.kind for row in one] == ["entity"] * 15 + ["chunk"] * 5 and one[15].line.startswith("[D16] (Chunk:f)")
    assert len(one[0].line) == len("[E1] (Entity:T) e00 — ") + 200
    assert [row.kind for row in rows if row.query_id == 2] == ["relation"] * 20
    assert [row.line for row in rows if row.query_id == 3] == ["(未检索到结构化证据)"]


# -- sources and stores -----------------------------------------------------------------------------------

def test_membership_formats(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]
    yearly = tmp_path / "yearly.json"
    yearly.write_text(json.dumps({"year_points": {"2020": ["a"], "2021": ["a", "b"], "2022": []}, "point_info": {"a": {"name": "A", "lon": 1.5, "population_served": 3}}}))
    years, members, points = files.read_membership(spark, str(yearly))
    assert sorted(row.year for row in years.collect()) == [2020, 2021, 2022] and members.count() == 3
    assert points.collect()[0].name == "A" and points.collect()[0].population_served == 3
    geo = tmp_path / "geo.json"
    geo.write_text(json.dumps({"type": "FeatureCollection", "years": [2020, 2021], "year_boundaries": {
        "2020": {"type": "Polygon", "coordinates": square}, "2021": {"type": "MultiPolygon", "coordinates": [square]}},
        "features": [{"geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {}},
                     {"geometry": {"type": "Point", "coordinates": [2, 2]}, "properties": {}},
                     {"geometry": {"type": "Point", "coordinates": [9, 9]}, "properties": {"id": "far", "type": "park"}}]}))
    _, members, points = files.read_membership(spark, str(geo))
    assert {(row.year, row.point_id) for row in members.collect()} == {(2020, "point_0"), (2021, "point_0")}
    assert {(row.point_id, row.name, row.point_type) for row in points.collect()} == {("point_0", "点1", "unknown"), ("far", "点2", "park")}
    apart = tmp_path / "apart.json"
    apart.write_text(json.dumps({"points": [{"id": "p", "lon": 2, "lat": 2, "point_type": "x"}, {}], "boundaries": [
        {"year": 2020, "geometry": {"type": "Polygon", "coordinates": [[[8, 8], [9, 8], [9, 9]]]}}, {"geometry": {"type": "Polygon", "coordinates": square}},
        {"year": 2020, "geometry": {"type": "Polygon", "coordinates": square}}]}))
    years, members, points = files.read_membership(spark, str(apart))
    assert {(row.year, row.point_id) for row in members.collect()} == {(2020, "p")} and years.count() == 1
    assert {(row.point_id, row.lon, row.point_type) for row in points.collect()} == {("p", 2.0, "x"), ("point_1", 0.0, "unknown")}
    other = tmp_path / "other.json"
    other.write_text('{"points": []}')
    with pytest.raises(ValueError):
        files.read_membership(spark, str(other))


def test_policies(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps([{"id": "x", "abstract": "a", "goals": [{"description": "g"}, {"id": "g2"}, {"description": ""}]}, {"title": "T", "measures": [{"description": "m"}]}]))
    policies, goals, measures = files.read_policies(spark, str(path))
    assert {row.title for row in policies.collect()} == {"x", "T"}
    assert {(row.title, row.description) for row in goals.collect()} == {("x", "g"), ("x", "g2")}
    assert [(row.title, row.description) for row in measures.collect()] == [("T", "m")]


GRAPHML = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d5" for="edge" attr.name="weight" attr.type="double"/>
<key id="d4" for="edge" attr.name="keywords" attr.type="string"/><key id="d1" for="node" attr.name="description" attr.type="string"/>
<key id="d0" for="node" attr.name="entity_type" attr.type="string"/><graph edgedefault="undirected">
<node id="a"><data key="d0">Point</data><data key="d1">x &amp; y</data></node><node id="b"><data key="d1"></data></node>
<edge source="a" target="b"><data key="d5">2.5</data><data key="d4">NEAR, z</data></edge><edge source="b" target="a"></edge></graph></graphml>"""


def test_graphml(spark, tmp_path):
    path = tmp_path / "g.graphml"
    path.write_text(GRAPHML)
    nodes, edges = files.read_graphml(spark, str(path))
    assert {(row.name, row.entity_type, row.description) for row in nodes.collect()} == {("a", "Point", "x & y"), ("b", "Unknown", "")}
    assert {(row.src, row.tgt, row.predicate, row.weight) for row in edges.collect()} == {("a", "b", "NEAR", 2.5), ("b", "a", "related", 1.0)}


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([('a "<&>', "Point", "x\ny", "s"), ("b", "Boundary", "", "s")], "name string, entity_type string, description string, source_id string")
    edges = spark.createDataFrame([('a "<&>', "b", "NEAR, z", "d", 0.5, "s")], "src string, tgt string, keywords string, description string, weight double, source_id string")
    stores.write_graphml(nodes, edges, str(tmp_path / "g"))
    got_nodes, got_edges = files.read_graphml(spark, str(tmp_path / "g"))
    assert {tuple(row) for row in got_nodes.collect()} == {tuple(row) for row in nodes.collect()}
    assert {tuple(row) for row in got_edges.drop("predicate").collect()} == {tuple(row) for row in edges.collect()}


@pytest.mark.parametrize("n", [0, 1, 4, 7])
def test_graphml_documents_are_bounded(spark, tmp_path, n):
    nodes = spark.createDataFrame([(f"n{k}", "Point", "", "s") for k in range(n)], "name string, entity_type string, description string, source_id string").coalesce(1)
    edges = spark.createDataFrame([("n0", f"n{k}", "NEAR, z", "d", 0.5, "s") for k in range(n)],
                                  "src string, tgt string, keywords string, description string, weight double, source_id string").coalesce(1)
    stores.write_graphml(nodes, edges, str(tmp_path / "g"), elements=2)
    held = [len(ElementTree.fromstring(file.read_bytes()).findall(".//{*}node") + ElementTree.fromstring(file.read_bytes()).findall(".//{*}edge"))
            for file in (tmp_path / "g").glob("part-*")]
    assert sum(held) == 2 * n and max(held, default=0) == min(n, 2)
    got_nodes, got_edges = files.read_graphml(spark, str(tmp_path / "g"))
    assert {tuple(row) for row in got_nodes.collect()} == {tuple(row) for row in nodes.collect()}
    assert {tuple(row) for row in got_edges.drop("predicate").collect()} == {tuple(row) for row in edges.collect()}


def test_graphml_files_take_little_room(spark, tmp_path, monkeypatch):
    """Documents are compressed where the query writes them; an element as text is longer than all of its row in the tables."""
    from tidemark.plans import files as queries, graphs
    nodes = spark.createDataFrame([(f'n{k} "<&>', "Point", "x\ny", "s") for k in range(300)], "name string, entity_type string, description string, source_id string")
    edges = spark.createDataFrame([(f'n{k} "<&>', f'n{k % 7} "<&>', "NEAR, z", "d", 0.5, "s") for k in range(3000)],
                                  "src string, tgt string, keywords string, description string, weight double, source_id string")
    monkeypatch.setattr(graphs, "trade_graph", lambda spark, folder: (nodes, edges.where("src IS NOT NULL")))
    monkeypatch.setattr(queries, "_folder", lambda spark, name: str(tmp_path / name))
    got = {tuple(row) for row in queries.graphml_files(spark, "").collect()}
    assert got == {(f'n{k} "<&>', f'n{k % 7} "<&>', "NEAR", 0.5, "Point") for k in range(3000)}
    stores.write_graphml(nodes, edges, str(tmp_path / "plain"))
    room = [sum(file.stat().st_size for file in (tmp_path / name).glob("part-*")) for name in ("graphml", "plain")]
    assert room[0] * 5 < room[1]


def test_sessions_are_settled_on_reading(spark, tmp_path):
    sub = {"agent_name": "G", "status": "running", "answer": "", "evidence": [{"id": "E1", "text": "t"}], "tool_calls": [{"name": "f", "input": {"q": 1}, "output": "o", "truncated": False}]}
    session = {"session_id": "s", "created_at": "2026", "current_task_id": "t2", "turns": [
        {"task_id": "t1", "question": "q", "status": "done", "result": "R"}, {"task_id": "t2", "question": "q2", "status": "pending", "sub_results": {"G": sub}}]}
    (tmp_path / "s.json").write_text(json.dumps(session))
    turns, subs, calls, evidence = files.read_sessions(spark, str(tmp_path))
    assert {(row.task_id, row.status, row.aggregated) for row in turns.collect()} == {("t1", "done", "R"), ("t2", "failed", None)}
    assert [(row.agent, row.status) for row in subs.collect()] == [("G", "failed")]
    assert [(row.name, json.loads(row.input)) for row in calls.collect()] == [("f", {"q": 1})] and [row.id for row in evidence.collect()] == ["E1"]


def test_spans_in_three_forms(spark, tmp_path):
    span = {"name": "n", "trace_id": "t", "span_id": "s", "parent_id": None, "start_time": 1, "end_time": 2, "duration_ms": 0.5, "attributes": {"k": 3}, "status": "OK"}
    for name, text, want in (("array", json.dumps([span, span], indent=1), 2), ("one", json.dumps(span, indent=1), 1),
                             ("lines", json.dumps(span) + "\n{broken\n" + json.dumps(span) + "\n", 2)):
        path = tmp_path / f"{name}.json"
        path.write_text(text)
        rows = files.read_spans(spark, str(path)).collect()
        assert len(rows) == want and rows[0].attributes == {"k": "3"}


def test_import_ledger_and_chunk_store(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("one\ntwo")
    (folder / "b.TXT").write_text("three")
    (folder / "c.pdf").write_text("no")
    docs = files.read_documents(spark, str(tmp_path / "in"))
    assert {row.source for row in docs.collect()} == {"a.txt", "b.TXT"}
    ledger = str(tmp_path / "ledger")
    found = files.file_hashes(spark, str(tmp_path / "in"), "*.{txt,TXT}")
    fresh = stores.new_files(found, stores.read_or_empty(spark, ledger, stores.LEDGER))
    assert fresh.count() == 2
    stores.mark_imported(fresh, ledger)
    assert stores.new_files(found, stores.read_or_empty(spark, ledger, stores.LEDGER)).isEmpty()
    assert stores.new_files(found, stores.read_or_empty(spark, ledger, stores.LEDGER), force=True).count() == 2
    from tidemark.operators.chunking import chunk_text
    store = str(tmp_path / "chunks")
    for _ in range(2):
        stores.write_chunks(chunk_text(docs.select("source", "text")), store)
    assert stores.read_chunks(spark, store).count() == 2
    # two chunks of one id but different content both stay
    twins = stores.read_chunks(spark, store).limit(1)
    twins = twins.unionByName(twins.withColumn("content", F.lit("other content")))
    for _ in range(2):
        stores.write_chunks(twins, store)
    assert stores.read_chunks(spark, store).count() == 3


def test_extraction_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = [("a", 2, "llm", "x"), ("b", 1, "llm", "y"), ("c", 2, "fallback", "z")]
    stores.write_extraction_cache(spark.createDataFrame(rows, stores.CACHE), path)
    cache = stores.read_extraction_cache(spark, path)
    assert [row.chunk_id for row in cache.collect()] == ["a"]
    hits, misses = stores.cache_split(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), cache)
    assert hits.count() == 1 and misses.count() == 2


def test_traces_and_graph_export(spark, tmp_path):
    df = spark.createDataFrame([("n", t, f"{t}{i}", None, i, i + 1, 1.0, {"a": "b"}, "OK") for t in "xy" for i in range(3)], files.SPANS)
    stores.write_traces(df, tc.trace_index(df), str(tmp_path / "traces"))
    assert spark.read.parquet(str(tmp_path / "traces" / "spans")).where("trace_id = 'x'").count() == 3
    one = stores.read_trace(spark, str(tmp_path / "traces"), "y")
    assert sorted(r.span_id for r in one.collect()) == ["y0", "y1", "y2"]
    assert len(list((tmp_path / "traces" / "spans").glob("bucket=*"))) <= 2
    nodes = spark.createDataFrame([("a", "Point")], "name string, entity_type string")
    edges = spark.createDataFrame([("a", "a", "NEAR, z")], "src string, tgt string, keywords string")
    stores.export_graph(nodes, edges, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph" / "edges")).collect()[0].predicate == "NEAR"


# -- streams -------------------------------------------------------------------------------------------------

def test_late_year_goes_to_the_side(spark, tmp_path):
    rows = [(1, 2020, "a"), (1, 2021, "b"), (2, 2019, "z"), (3, 2023, None)]
    df = spark.createDataFrame(rows, "arrival int, year int, point_id string")
    stream = replay(df, F.col("arrival"), 3, files=1).select("year", "point_id")
    path = str(tmp_path / "out")
    jobs.stream_transitions(stream, path, f"{path}/checkpoint", availableNow=True).awaitTermination()
    events = {(e.year_after, e.event_type, e.point_id) for e in spark.read.parquet(f"{path}/events").collect()}
    assert events == {(2021, "entry", "b"), (2021, "exit", "a"), (2023, "exit", "b")}
    assert [row.year for row in spark.read.parquet(f"{path}/late").collect()] == [2019]


def test_stream_questions_keeps_a_short_list(spark):
    asked = ["a", "a ", "b", "a", "c"]
    df = spark.createDataFrame([("u", n, q) for n, q in enumerate(asked)], "user_id string, position int, question string")
    rows = latest(finish(jobs.stream_questions(replay(df, F.col("position"), 2, files=1), cap=2), "update"), "user_id").collect()
    assert rows[0].recent == ["a", "c"] and rows[0].total == 5


def test_python_workers_of_streams_hold_few_rows(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, n = spark.conf.get(setting), 16 * runs.RESULT_ROWS
    rows = replay(spark.range(n), F.col("id"), slices=1)
    sizes = finish(rows.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long"), "append")
    assert tuple(sizes.agg(F.sum("n"), F.max("n")).head()) == (n, runs.RESULT_ROWS)
    assert spark.conf.get(setting) == before


def test_trace_index_sends_few_columns_to_python(spark, monkeypatch):
    """The first of two roots counts, with what the spans of its batch tell; a later batch adds no second row."""
    sent, stateful = [], jobs._stateful
    monkeypatch.setattr(jobs, "_stateful", lambda df, *a: sent.append(df.columns) or stateful(df, *a))
    spans = [("r2", "t", "b", None, 7, 9, 1.5, {"chat.question": "q2"}, "OK", 1), ("r1", "t", "a", "", 7, 8, 0.1, {"chat.question": 'q "1"\n'}, "OK", 1),
             ("s", "t", "c", "a", 8, 9, 0.5, {"gen_ai.agent.name": "A\nx y"}, "StatusCode.ERROR", 1), ("r0", "t", "d", None, 1, 2, 0.5, {}, "OK", 9),
             ("u", "u", "e", "gone", 1, 2, 0.5, {}, "OK", 1), ("v", "v", "f", None, None, None, None, {"gen_ai.agent.name": "B"}, "OK", 9)]
    df = spark.createDataFrame(spans, "name string, trace_id string, span_id string, parent_id string, start_time bigint, end_time bigint, "
                                      "duration_ms double, attributes map<string,string>, status string, n int")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n")))
    rows = finish(jobs.stream_trace_index(replay(df, F.col("n"), slices=2, files=1).drop("n")), "append").drop("batch")
    assert sorted(map(tuple, rows.collect())) == [("t", 7, 8, 0.1, "r1", 'q "1"\n', "", "", ["A\nx y"], 3, True),
                                                  ("v", None, None, None, "v", "", "", "", ["B"], 1, False)]
    assert len(sent[0]) == 3


def test_only_names_of_known_chunks_are_compared(spark, tmp_path, monkeypatch):
    kept, written = {}, stores.written
    monkeypatch.setattr(stores, "written", lambda df, name, *a: kept.setdefault(name, df.columns) and written(df, name, *a))

    def chunks(*names):
        return spark.createDataFrame([(n, f"text {n}", ["k"], "s", 1, 0, "text") for n in names], stores.CHUNKS)
    for names in ("ab", "ab", "abc", "cd", ""):
        stores.write_chunks(chunks(*names), str(tmp_path / "s"))
    rows = stores.read_chunks(spark, str(tmp_path / "s"))
    assert sorted((r.id, r.content) for r in rows.collect()) == [(n, f"text {n}") for n in "abcd"]
    assert kept["new-names"] == ["id", "hash"]
