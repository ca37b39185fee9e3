"""Change events, places and series on small tables with known answers."""

import itertools
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import build, graph, series, spatial, transitions as tr

POINTS = ("point_id string, name string, lon double, lat double, point_type string, district string, sub_district string, "
          "planning_zone string, control_line string, land_use_code string, planning_function string, "
          "development_stage string, population_served int, entry_year int, change_reason string")


def snapshot(spark, yearly):
    years = spark.createDataFrame([(y,) for y in yearly], "year int")
    members = spark.createDataFrame([(y, p) for y, ps in yearly.items() for p in ps], "year int, point_id string")
    return years, members


def point(point_id, lon=None, lat=None, **more):
    row = dict.fromkeys(("sub_district", "planning_zone", "control_line", "planning_function", "development_stage",
                         "population_served", "entry_year", "change_reason", "district", "land_use_code", "point_type"))
    row.update(more)
    names = [f.split()[0] for f in POINTS.split(", ")]
    row.update(point_id=point_id, name=more.get("name", f"N{point_id}"), lon=lon, lat=lat)
    return tuple(row[n] for n in names)


def found(spark, yearly):
    rows = tr.transitions(*snapshot(spark, yearly)).collect()
    return sorted((r.year_after, r.event_type, r.point_id) for r in rows)


@pytest.mark.parametrize("yearly, want", [
    ({2022: "AB", 2023: "ABC"}, [(2023, "entry", "C")]),
    ({2022: "ABC", 2023: "AB"}, [(2023, "exit", "C")]),
    ({2022: "ABC", 2023: "ABD", 2024: "ABE"},
     [(2023, "entry", "D"), (2023, "exit", "C"), (2024, "entry", "E"), (2024, "exit", "D")]),
    ({2022: "AB", 2023: "BA"}, []),
    ({2022: "AB"}, []),
    ({2020: "A", 2023: "AB", 2025: ""}, [(2023, "entry", "B"), (2025, "exit", "A"), (2025, "exit", "B")]),
])
def test_transitions(spark, yearly, want):
    assert found(spark, yearly) == want


def test_many_and_odd_years(spark):
    """Any int is a year, and more years than a number has bits are like few."""
    rng = random.Random(2)
    yearly = {y: rng.sample("ABCDEF", rng.randint(0, 6)) for y in [-44, 0, 12_000, *range(1900, 1980)]}
    order = sorted(yearly)
    want = [(b, kind, p) for a, b in itertools.pairwise(order)
            for kind, gone, new in (("entry", yearly[a], yearly[b]), ("exit", yearly[b], yearly[a])) for p in set(new) - set(gone)]
    assert sorted(found(spark, yearly)) == sorted(want)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(1990, 1999), st.lists(st.sampled_from("ABCDEF"), max_size=8), min_size=2, max_size=5))
def test_entries_minus_exits_is_the_change_in_members(spark, yearly):
    changes = found(spark, yearly)
    for before, after in itertools.pairwise(sorted(yearly)):
        net = sum({"entry": 1, "exit": -1}[kind] for year, kind, _ in changes if year == after)
        assert net == len(set(yearly[after])) - len(set(yearly[before]))


def test_enriched_event(spark):
    years, members = snapshot(spark, {2022: "A", 2023: "AB"})
    points = spark.createDataFrame([point("B", 1.0, 2.0, name="Bee", point_type="park")], POINTS)
    row = tr.enrich_events(tr.transitions(years, members), points).collect()[0]
    assert (row.point_name, row.point_type, row.significance, row.relation_after) == ("Bee", "park", "high", "inside")
    assert str(row.event_date) == "2023-01-01" and row.boundary_before == "boundary_2022"
    assert row.description == "点'Bee'在2022年位于边界外部，2023年变为边界内部"


def test_event_members_in_parts_stay_whole(spark):
    rows = [(2023, "entry", f"p{n:03d}") for n in range(100)]
    events = spark.createDataFrame(rows, "year_after int, event_type string, point_name string")
    parts = tr.event_member_parts(events, part_size=10).collect()
    assert len(parts) > 5 and all(p.total == 100 for p in parts)
    assert sorted(n for p in parts for n in p.members) == sorted(r[2] for r in rows)


def test_temporal_relation_labels(spark):
    spans = [(1, 2, 1, 2), (1, 2, 3, 4), (3, 4, 1, 2), (1, 2, 2, 3), (1, 2, 1, 3), (2, 3, 1, 3), (2, 3, 1, 4), (1, 3, 2, 4)]
    df = spark.createDataFrame([(n, *s) for n, s in enumerate(spans)], "n int, a int, b int, c int, d int")
    got = [r.r for r in df.orderBy("n").select(tr.temporal_relation("a", "b", "c", "d").alias("r")).collect()]
    assert got == ["equals", "before", "after", "meets", "starts", "finishes", "during", "overlaps"]


# -- places -------------------------------------------------------------------------

def distance(a, b):
    lon1, lat1, lon2, lat2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("area, rows_per_task", [
    ((10, 10.2, 40, 40.2), 4096), ((10, 10.2, 40, 40.2), 3), ((-180, 180, 89.5, 90), 4096), ((-180, 180, -90, -89.6), 2),
    ((179.9, 180.1, -0.1, 0.1), 4096), ((-0.05, 0.05, 59.9, 60.1), 5)])
def test_near_pairs_equal_brute_force(spark, area, rows_per_task):
    rng = random.Random(7)
    where = {}
    for n in range(60):
        lon = rng.uniform(area[0], area[1])
        where[f"p{n:02d}"] = ((lon + 180) % 360 - 180, rng.uniform(area[2], area[3]))
    where["p90"] = where["p00"]  # two points in one place
    rows = [(k, *v) for k, v in where.items()] + [("nowhere", None, 3.0)]
    points = spark.createDataFrame(rows, "point_id string, lon double, lat double")
    got = {(r.id_a, r.id_b) for r in spatial.near_pairs(points, 5.0, rows_per_task).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(where), 2) if distance(where[a], where[b]) < 5.0}
    assert got == want and want


def test_adjacency_is_symmetric_and_strict(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.01, 0.0), ("c", 0.5, 0.0)], "point_id string, lon double, lat double")
    exact = distance((0, 0), (0.01, 0))
    assert spatial.adjacent_points(points, exact).isEmpty()
    got = {(r.src_id, r.tgt_id) for r in spatial.adjacent_points(points, exact + 1e-9).collect()}
    assert got == {("a", "b"), ("b", "a")}


def test_points_in_boundaries(spark):
    square = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]]
    ring_with_hole = square + [[[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0], [1.0, 1.0]]]
    boundaries = spark.createDataFrame([(2020, square), (2021, ring_with_hole), (2022, [])], "year int, rings array<array<array<double>>>")
    points = spark.createDataFrame([("in", 2.0, 2.0), ("edge", 4.0, 2.0), ("corner", 0.0, 0.0), ("rim", 0.5, 2.0), ("out", 5.0, 5.0)],
                                   "point_id string, lon double, lat double")
    got = {(r.year, r.point_id) for r in spatial.points_in_boundaries(points, boundaries).collect()}
    assert got == {(2020, "in"), (2020, "rim"), (2021, "rim")}


def _inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def test_cells_of_many_shapes_decide_as_whole_rings_do(spark):
    """Stars of few and many corners, with holes, spikes and grid-aligned edges; points in, out, on corners and on cell lines."""
    rng = random.Random(3)

    def star(x, y, r, n):
        return [[x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)]
                for i in range(n)]

    shapes = {2000 + n: [star(rng.uniform(-170, 170), rng.uniform(-80, 80), 10 ** rng.uniform(-3, 1.5), rng.choice((3, 7, 40, 400)))] for n in range(12)}
    shapes[2050] = [star(10, 10, 5, 60), star(10, 10, 1, 9)]
    shapes[2051] = [[[0.0, 0.0], [45.0, 0.0], [45.0, 45.0], [22.5, 5.625], [0.0, 45.0]]]
    shapes[2052] = [[[-5.625, -5.625], [5.625, -5.625], [5.625, 5.625], [-5.625, 5.625]], [[-1.0, -1.0], [1.0, -1.0], [1.0, 1.0], [-1.0, 1.0]]]
    places = [(0.0, 0.0), (22.5, 5.625), (5.625, 0.0), (1.0, 0.5), (0.5, 1.0), (2.8125, 2.8125)]
    for rings in shapes.values():
        x0, y0 = rings[0][0]
        r = max(math.dist((x0, y0), c) for c in rings[0]) * 1.2
        places += [(x0 + rng.uniform(-r, r), y0 + rng.uniform(-r, r)) for _ in range(60)] + [tuple(rings[0][1])]
    points = spark.createDataFrame([(n, *p) for n, p in enumerate(places)] + [(-1, float("nan"), 1.0), (-2, None, 1.0)], "point_id long, lon double, lat double")
    boundaries = spark.createDataFrame(list(shapes.items()), "year int, rings array<array<array<double>>>")
    got = {(r.year, r.point_id) for r in spatial.points_in_boundaries(points, boundaries).collect()}
    want = {(year, n) for year, rings in shapes.items() for n, p in enumerate(places) if _inside(rings, *p)}
    assert got == want and len(want) > 200
    cells = spatial.boundary_cells(boundaries).selectExpr("year", "size(edges) AS n", "level").toPandas()
    assert (cells.groupby("year").size() >= 12).all()
    assert (cells.n == 0).sum() > 100  # inner cells need no test
    assert cells.n.max() < 100  # of 400 edges


# -- graph and series ------------------------------------------------------------------

@pytest.fixture(scope="module")
def city(spark):
    years, members = snapshot(spark, {2020: "AB", 2021: "ABCD", 2022: "ACDE"})
    where = {"A": (120.1, 30.2), "B": (120.11, 30.21), "C": (120.5, 30.2), "D": (120.9, 30.5), "E": (121.0, 30.9)}
    points = spark.createDataFrame([point(p, *xy, land_use_code="S" if p == "C" else "R2", district="West", point_type="住区")
                                    for p, xy in where.items()], POINTS)
    events = tr.enrich_events(tr.transitions(years, members), points)
    return years, members, points, events


def test_graph_counts(spark, city):
    nodes, edges = build.build_gis_graph(*city)
    kinds = {r.entity_type: r.n for r in graph.type_counts(nodes).collect()}
    assert kinds == {"Point": 5, "Boundary": 3, "STTE_Event": 3}
    predicates = {r.predicate: r.n for r in graph.predicate_counts(edges).collect()}
    assert predicates == {"ADJACENT_TO": 2, "TRANSITION_FROM": 2, "ON_BOUNDARY": 3, "INVOLVES_POINT": 4}
    assert graph.undirected(edges).count() == edges.count() - 1


def test_event_texts_name_all_members_in_parts(spark, city):
    heads = {r.name: r.description for r in build.event_nodes(city[3]).collect()}
    assert heads == {"2021年进入边界事件": "2021年共有 2 个点进入边界内", "2022年进入边界事件": "2022年共有 1 个点进入边界内",
                     "2022年退出边界事件": "2022年共有 1 个点退出边界外"}
    texts = {(r.name, r.part, r.parts): r.text for r in build.event_texts(city[3], names_per_part=1).collect()}
    assert texts == {("2021年进入边界事件", 0, 2): "2021年共有 2 个点进入边界内：NC", ("2021年进入边界事件", 1, 2): "2021年共有 2 个点进入边界内：ND",
                     ("2022年进入边界事件", 0, 1): "2022年共有 1 个点进入边界内：NE", ("2022年退出边界事件", 0, 1): "2022年共有 1 个点退出边界外：NB"}
    whole = {r.name: r.text for r in build.event_texts(city[3]).collect()}
    assert whole["2021年进入边界事件"] == "2021年共有 2 个点进入边界内：NC, ND"


def test_undirected_keeps_the_same_row(spark):
    edges = spark.createDataFrame([("a", "b", "2"), ("b", "a", "1"), ("a", "b", "3"), ("c", "c", "x")], "src string, tgt string, keywords string")
    for parts in (1, 3):
        kept = sorted(map(tuple, graph.undirected(edges.repartition(parts)).collect()))
        assert kept == [("a", "b", "2"), ("c", "c", "x")]


def test_series_lines(spark, city):
    lines = [r.line for r in series.time_series(*city, "entries", 2019, 2030).orderBy("year").collect()]
    assert lines == ["(2020年) entries=0", "(2021年) entries=2 → NC, ND", "(2022年) entries=1 → NE"]
    kinds = [r.line for r in series.time_series(*city, "point_type_distribution", 2021, 2021).collect()]
    assert kinds == ["(2021年, 共2个) R2:1, S:1"]
    assert series.time_series(*city, "exits", 2030, 2035).isEmpty()
    with pytest.raises(ValueError):
        series.time_series(*city, "colour", 2020, 2021)


def test_compare_periods(spark, city):
    lines = [r.line for r in series.compare_periods(*city, 2021, 2022).orderBy("line_no").collect()]
    assert lines[0] == "[E1] (2021年) 进入=2, 退出=0, 净变化=+2, 边界内=4个点"
    assert lines[2] == "[E3] (2021年进入点位) NC, ND" and len(lines) == 6
    missing = [r.line for r in series.compare_periods(*city, 2019, 2022).collect()]
    assert missing == ["(缺少年份数据: 2019)"]


def test_point_card(spark, city):
    nodes, edges = build.build_gis_graph(*city)
    lines = [r.line for r in graph.point_detail(nodes, edges, "NB").orderBy("line_no").collect()]
    assert lines == ["[E1] (Entity:Point) NB — 行政区:West | 经纬度:(120.1100,30.2100) | 用地:R2 | 类型:住区",
                     "[E2] (STTE_Event) 2022年退出边界事件 — 2022年共有 1 个点退出边界外", "[E3] (Adjacent:1个邻居) NA"]
    wrong = graph.point_detail(nodes, edges, "2021年城市边界").collect()[0].line
    assert wrong == "「2021年城市边界」存在但不是 Point 类型 (实际: Boundary)"


def test_hub_neighbours_go_over_several_lines(spark):
    nodes = spark.createDataFrame([("hub", "Point", "d", "")] + [(f"n{i}", "Point", "", "") for i in range(20)],
                                  "name string, entity_type string, description string, source_id string")
    edges = spark.createDataFrame([("hub", f"n{i}", "ADJACENT_TO, x", "", 1.0, "") for i in range(20)],
                                  "src string, tgt string, keywords string, description string, weight double, source_id string")
    cards = graph.point_cards(nodes, edges, nodes.where("name = 'hub'"), neighbours_per_line=5).collect()
    lines = [c.line.split(") ")[1].split(", ") for c in sorted(cards, key=lambda c: c.line_no) if "Adjacent" in c.line]
    assert [len(names) for names in lines] == [5, 5, 5, 5]
    assert [n for names in lines for n in names] == sorted(f"n{i}" for i in range(20))
    assert sorted(c.line_no for c in cards) == list(range(1, len(cards) + 1))


def test_measure_rule_is_decided_before_the_point_is_tried(spark):
    from tidemark.operators import link
    rows = [("居住产业园", "PolicyMeasure", ""), ("产业升级", "PolicyMeasure", ""), ("P", "Point", "功能:数字产业"),
            ("扩大城市", "PolicyGoal", ""), ("2021年进入边界事件", "STTE_Event", ""), ("2021年退出边界事件", "STTE_Event", ""),
            ("2021年城市边界", "Boundary", ""), ("2021年规划", "Policy", ""), ("地铁1号线", "Infrastructure", ""),
            ("西湖区", "District", ""), ("Q", "Point", "行政区:西湖区 | 用地:S（交通）")]
    nodes = spark.createDataFrame(rows, "name string, entity_type string, description string")
    got = {(r.src, r.tgt, r.predicate, r.weight) for r in link.link_graph(nodes).collect()}
    assert got == {("产业升级", "P", "TARGETS", 0.75), ("扩大城市", "2021年进入边界事件", "DRIVES", 0.8),
                   ("2021年规划", "2021年城市边界", "APPLIES_TO", 1.0), ("地铁1号线", "Q", "LOCATED_IN", 0.65),
                   ("西湖区", "Q", "GOVERNS", 0.9)}
    more = {(r.src, r.tgt, r.weight) for r in link.link_infrastructure(
        spark.createDataFrame([("杭州西站", "Infrastructure", ""), ("杭州西站枢纽", "Point", "x")], nodes.schema), name_overlap=True).collect()}
    assert more == {("杭州西站", "杭州西站枢纽", 0.85)}


def test_links_are_distinct_without_being_grouped(spark):
    from tidemark.operators import link
    rows = [("产业升级", "PolicyMeasure", ""), ("P", "Point", "功能:数字产业"), ("P", "Point", "行政区:西湖区 | 功能:产业"), ("扩大城市", "PolicyGoal", ""),
            ("2021年进入边界事件", "STTE_Event", ""), ("2021年城市边界", "Boundary", ""), ("2021年规划", "Policy", ""), ("2021年规划", "PolicyMeasure", ""),
            ("地铁1号线", "Infrastructure", ""), ("西湖区", "District", ""), ("Q", "Point", "行政区:西湖区 | 用地:S（交通）"), ("Q", "Point", "西湖区 | 用地:S（交通）")]
    links = link.link_graph(spark.createDataFrame(rows + rows, "name string, entity_type string, description string"))
    got = sorted((r.src, r.tgt, r.predicate) for r in links.collect())
    assert got == sorted({("产业升级", "P", "TARGETS"), ("扩大城市", "2021年进入边界事件", "DRIVES"), ("2021年规划", "2021年城市边界", "APPLIES_TO"),
                          ("地铁1号线", "Q", "LOCATED_IN"), ("西湖区", "Q", "GOVERNS"), ("西湖区", "P", "GOVERNS")})
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union"), plan[:200]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_few_names_go_to_the_texts_and_products_are_not_broadcast(spark, tmp_path, monkeypatch, most):
    """Nodes are stored by type; the size that Spark sees of one type is that of all, so it would shuffle every gram."""
    from tidemark.operators import link
    rows = [(f"Z{k}", "District", "") for k in range(3)] + [(f"p{k}", "Point", f"行政区:Z{k % 4} | 用地:S（交通）") for k in range(40)]
    rows += [(f"地铁{k}号线", "Infrastructure", "") for k in range(20)] + [(f"n{k}", "Policy", "x" * 100) for k in range(5)]
    nodes = spark.createDataFrame(rows, "name string, entity_type string, description string")
    nodes.write.partitionBy("entity_type").parquet(str(tmp_path / "nodes"))
    monkeypatch.setattr(link, "BROADCAST_BYTES", most, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = link.link_graph(spark.read.parquet(str(tmp_path / "nodes")))
        plan = links._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = links.select("src", "tgt", "predicate").collect()
    assert sorted(map(tuple, got)) == sorted([(f"Z{k % 4}", f"p{k}", "GOVERNS") for k in range(40) if k % 4 < 3]
                                             + [(f"地铁{n}号线", f"p{k}", "LOCATED_IN") for n in range(20) for k in range(40)])
    assert ("BroadcastHashJoin [gram" in plan) == (most > 0)
    assert "SortMergeJoin [_cell" in plan and "BroadcastHashJoin [_cell" not in plan


def test_missing_years(spark, city):
    assert [r.year for r in graph.missing_years(city[0], 2019, 2023).orderBy("year").collect()] == [2019, 2023]
