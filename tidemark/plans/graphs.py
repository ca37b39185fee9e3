"""Queries over node and edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import build, graph as g, link, transitions as tr
from tidemark.plans import inputs as i

from tidemark.plans.inputs import CHANGES_SQL, DESCRIPTION_SQL, EVENT_NAME_SQL
from tidemark.session import scratch_dir, written
from tidemark.sources.stores import export_graph

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


# -- the change graph --------------------------------------------------------------

def gis_graph(spark, folder, detail="full"):
    years, membership, points = i.years(spark, folder), i.membership(spark, folder), i.points(spark, folder)
    events = tr.enrich_events(tr.transitions(years, membership), points)
    return build.build_gis_graph(years, membership, points, events, 5.0, detail)


def stored_graph(spark, folder, *predicates):
    """The change graph as its readers find it: nodes by entity type, edges by predicate, of all or of some predicates. What
    both are made of is written before, so that it is worked out once."""
    years, membership, points = i.years(spark, folder), i.membership(spark, folder).distinct(), i.points(spark, folder)
    points = written(points, "points")
    events = written(tr.enrich_events(tr.transitions(years, membership), points), "events")
    path = f"{scratch_dir(spark)}/graph-{uuid.uuid4().hex}"
    export_graph(*build.build_gis_graph(years, i.membership(spark, folder), points, events, predicates=predicates or None), path)
    return tuple(spark.read.parquet(f"{path}/{part}") for part in ("nodes", "edges"))


HAVERSINE_SQL = """2 * 6371e0 * asin(sqrt(least(1e0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"""
GIS_SQL = CHANGES_SQL + f""", member_points AS (SELECT * FROM points WHERE point_id IN (SELECT point_id FROM membership)),
pairs AS (SELECT least(a.point_id, b.point_id) = a.point_id AS first, a.name AS name_a, b.name AS name_b, {HAVERSINE_SQL} AS d
  FROM member_points a JOIN member_points b ON a.point_id < b.point_id),
near AS (SELECT * FROM pairs WHERE d < 5),
gis_nodes AS (
  SELECT name, 'Point' AS entity_type, {DESCRIPTION_SQL} AS description, 'gis_data' AS source_id FROM member_points
  UNION ALL SELECT y.year || '年城市边界', 'Boundary', y.year || '年的城市边界状态，边界内共 '
    || (SELECT count(*) FROM membership m WHERE m.year = y.year) || ' 个点位', 'gis_data' FROM years y
  UNION ALL SELECT {EVENT_NAME_SQL}, 'STTE_Event', year_after || '年共有 ' || count(*) || ' 个点'
    || CASE event_type WHEN 'entry' THEN '进入边界内' ELSE '退出边界外' END,
    'stte_events' FROM events_full GROUP BY year_after, event_type),
gis_edges AS (
  SELECT unnest([name_a, name_b]) AS src, unnest([name_b, name_a]) AS tgt, 'ADJACENT_TO, 地理相邻' AS keywords,
    '点''' || name_a || '''与点''' || name_b || printf('''地理相邻（距离 %.2f 公里）', d) AS description, 1e0 AS weight, 'gis_data' AS source_id FROM near
  UNION ALL SELECT year_after || '年城市边界', year_before || '年城市边界', 'TRANSITION_FROM, 时间演变',
    '从' || year_before || '年边界转换到' || year_after || '年边界', 1e0, 'gis_data' FROM chain WHERE year_after IS NOT NULL
  UNION ALL SELECT DISTINCT {EVENT_NAME_SQL}, year_after || '年城市边界', 'ON_BOUNDARY, 事件归属边界', '该事件发生在' || year_after || '年城市边界上', 1e0, 'stte_events' FROM events_full
  UNION ALL SELECT {EVENT_NAME_SQL}, point_name, 'INVOLVES_POINT, 空间事件', '事件涉及点''' || point_name || '''', 1e0, 'stte_events' FROM events_full)"""


@query(GIS_SQL + " SELECT * FROM gis_nodes")
def gis_nodes(spark, folder):
    return gis_graph(spark, folder)[0]


@query(GIS_SQL + f""", numbered AS (SELECT *, row_number() OVER (PARTITION BY year_after, event_type ORDER BY point_name) - 1 AS n,
    count(*) OVER (PARTITION BY year_after, event_type) AS total FROM events_full)
  SELECT {EVENT_NAME_SQL} AS name, CAST(n // 1000 AS INT) AS part, CAST((any_value(total) + 999) // 1000 AS INT) AS parts,
    year_after || '年共有 ' || any_value(total) || ' 个点' || CASE event_type WHEN 'entry' THEN '进入边界内' ELSE '退出边界外' END
    || '：' || string_agg(point_name, ', ' ORDER BY point_name) AS text FROM numbered GROUP BY year_after, event_type, n // 1000""")
def event_texts(spark, folder):
    years, membership, points = i.years(spark, folder), i.membership(spark, folder), i.points(spark, folder)
    return build.event_texts(tr.enrich_events(tr.transitions(years, membership), points))


@query(GIS_SQL + " SELECT * FROM gis_edges")
def gis_edges(spark, folder):
    return gis_graph(spark, folder)[1]


@query(GIS_SQL + f""" SELECT name, 'Point' AS entity_type, '地理点: ' || name || ', 类型: ' || point_type AS description, 'year_points_data' AS source_id FROM member_points
  UNION ALL SELECT year || '年城市边界', 'Boundary', year || '年的城市边界状态', 'year_points_data' FROM years
  UNION ALL SELECT {EVENT_NAME_SQL}, 'STTE_Event', year_after || '年共有 ' || count(*) || ' 个点'
    || CASE event_type WHEN 'entry' THEN '进入边界内' ELSE '退出边界外' END, 'stte_events' FROM events_full GROUP BY year_after, event_type""")
def gis_nodes_brief(spark, folder):
    return gis_graph(spark, folder, "brief")[0]


@query(GIS_SQL + f" SELECT {EVENT_NAME_SQL} AS event, point_name AS point FROM events_full")
def points_of_event(spark, folder):
    return g.points_of_event(*stored_graph(spark, folder, "INVOLVES_POINT"))


CARDS_SQL = GIS_SQL + f""", own AS (SELECT name AS point, 0 AS kind, '' AS key, '(Entity:Point) ' || name || ' — ' || description AS text FROM gis_nodes WHERE entity_type = 'Point'),
 involved AS (SELECT e.tgt AS point, 1 AS kind, e.src AS key, '(STTE_Event) ' || e.src || ' — ' || n.description AS text
   FROM gis_edges e JOIN gis_nodes n ON n.name = e.src WHERE e.keywords LIKE 'INVOLVES_POINT%'),
 adjacent AS (SELECT src AS point, 2 AS kind, lpad(CAST(min(n) AS VARCHAR), 12, '0') AS key, '(Adjacent:' || any_value(total) || '个邻居) ' || string_agg(tgt, ', ' ORDER BY tgt) AS text
   FROM (SELECT src, tgt, row_number() OVER (PARTITION BY src ORDER BY tgt) - 1 AS n, count(*) OVER (PARTITION BY src) AS total
     FROM (SELECT DISTINCT src, tgt FROM gis_edges WHERE keywords LIKE 'ADJACENT_TO%')) GROUP BY src, n // 1000),
 cards AS (SELECT *, CAST(row_number() OVER (PARTITION BY point ORDER BY kind, key) AS INT) AS line_no
   FROM (SELECT * FROM own UNION ALL SELECT * FROM involved UNION ALL SELECT * FROM adjacent))"""


@query(CARDS_SQL + " SELECT point, line_no, '[E' || line_no || '] ' || text AS line FROM cards")
def point_cards(spark, folder):
    nodes, edges = stored_graph(spark, folder)
    return g.point_cards(nodes, edges, nodes.where("entity_type = 'Point'"))


@query(CARDS_SQL + " SELECT point, line_no, '[E' || line_no || '] ' || text AS line FROM cards WHERE point = 'Customer#000000007'")
def point_detail(spark, folder):
    return g.point_detail(*stored_graph(spark, folder), "Customer#000000007")


@query("SELECT 'Nowhere' AS point, 0 AS line_no, '未在 GIS 图谱找到点位「Nowhere」' AS line")
def point_detail_missing(spark, folder):
    return g.point_detail(*stored_graph(spark, folder), "Nowhere")


@query(GIS_SQL + f" SELECT point_name AS n0, {EVENT_NAME_SQL} AS n1, year_after || '年城市边界' AS n2 FROM events_full")
def two_hop(spark, folder):
    return g.two_hop(*stored_graph(spark, folder, "INVOLVES_POINT", "ON_BOUNDARY"), "INVOLVES_POINT", "ON_BOUNDARY")


@query(GIS_SQL + f""" SELECT DISTINCT {EVENT_NAME_SQL} AS n0, year_after || '年城市边界' AS n1, year_before || '年城市边界' AS n2 FROM events_full""")
def path_query(spark, folder):
    return g.path(*stored_graph(spark, folder, "ON_BOUNDARY", "TRANSITION_FROM"), [("ON_BOUNDARY", "out"), ("TRANSITION_FROM", "out")], ["STTE_Event", "Boundary", "Boundary"])


@query(GIS_SQL + " SELECT src, tgt, keywords, description, weight, source_id FROM gis_edges WHERE keywords LIKE 'ADJACENT_TO%'")
def filter_by_type(spark, folder):
    return g.filter_by_type(*stored_graph(spark, folder), "Point")[1].drop("predicate")


@query(GIS_SQL + """ SELECT min(a) AS a, max(b) AS b, count(*) AS n FROM (SELECT DISTINCT least(src, tgt) AS a, greatest(src, tgt) AS b FROM gis_edges) GROUP BY a, b""")
def undirected_pairs(spark, folder):
    flat = g.undirected(gis_graph(spark, folder)[1])
    return flat.groupBy(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg(F.count("*").alias("n"))


# -- the trade graph: customers, suppliers, nations and regions ----------------------

TRADE_SQL = f"""WITH {i.POINTS_SQL},
nodes AS (
  SELECT name, 'Point' AS entity_type, {DESCRIPTION_SQL} AS description, 'customer_p1' AS source_id FROM points
  UNION ALL SELECT s_name, 'Infrastructure', 'Supplier with balance ' || CAST(floor(s_acctbal) AS BIGINT), 'supplier_p1' FROM supplier
  UNION ALL SELECT n_name, 'District', 'Nation ' || n_name || ' of ' || r_name, 'nation_p1' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, 'Region', '', 'region_p1' FROM region),
edges AS MATERIALIZED (
  SELECT c_name AS src, n_name AS tgt, 'LOCATED_IN, place' AS keywords, c_name || ' is in ' || n_name AS description, 1e0 AS weight, 'customer_p1' AS source_id
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_name, r_name, 'PART_OF, place', n_name || ' belongs to ' || r_name, 1e0, 'nation_p1' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_name, s_name, 'TRADES_WITH, trade', c_name || ' buys from ' || s_name, count(*) * 1e0, 'lineitem_p1'
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY c_name, s_name)"""


def trade_graph(spark, folder):
    def t(name):
        return i.table(spark, folder, name)
    from tidemark.functions.text import point_description
    nation, region = t("nation"), t("region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    def columns(name, kind, text, source):
        return [name.alias("name"), F.lit(kind).alias("entity_type"), text.alias("description"), F.lit(source).alias("source_id")]
    nodes = i.points(spark, folder).select(*columns(F.col("name"), "Point", point_description(), "customer_p1"))
    nodes = nodes.unionByName(t("supplier").select(*columns(F.col("s_name"), "Infrastructure", F.concat(
        F.lit("Supplier with balance "), F.floor("s_acctbal").cast("string")), "supplier_p1")))
    nodes = nodes.unionByName(places.select(*columns(F.col("n_name"), "District", F.concat(
        F.lit("Nation "), "n_name", F.lit(" of "), "r_name"), "nation_p1")))
    nodes = nodes.unionByName(region.select(*columns(F.col("r_name"), "Region", F.lit(""), "region_p1")))

    def edge(src, tgt, keywords, verb, weight, source):
        return [F.col(src).alias("src"), F.col(tgt).alias("tgt"), F.lit(keywords).alias("keywords"),
                F.concat(F.col(src), F.lit(verb), F.col(tgt)).alias("description"), weight.alias("weight"), F.lit(source).alias("source_id")]
    one = F.lit(1.0)
    edges = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        *edge("c_name", "n_name", "LOCATED_IN, place", " is in ", one, "customer_p1"))
    edges = edges.unionByName(places.select(*edge("n_name", "r_name", "PART_OF, place", " belongs to ", one, "nation_p1")))
    # counted per (customer, supplier) key before any name is attached
    sold = (t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("o_custkey", "l_suppkey").agg(F.count("*").cast("double").alias("n")))
    sold = (sold.join(t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
            .join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")))
    return nodes, edges.unionByName(sold.select(*edge("c_name", "s_name", "TRADES_WITH, trade", " buys from ", F.col("n"), "lineitem_p1")))


SEARCH_SQL = TRADE_SQL + """, hits AS (SELECT name FROM nodes WHERE contains(lower(name), 'nation_1') OR contains(lower(description), 'of asia')),
  ends AS (SELECT src, tgt FROM edges JOIN hits ON src = name UNION SELECT src, tgt FROM edges JOIN hits ON tgt = name),
  selected AS (SELECT name FROM hits UNION SELECT src FROM ends UNION SELECT tgt FROM ends)"""


@query(TRADE_SQL + """ SELECT DISTINCT p.tgt AS n0, p.src AS n1, l.src AS n2, t.tgt AS n3 FROM edges p JOIN edges l ON l.tgt = p.src JOIN edges t ON t.src = l.src
  WHERE p.keywords LIKE 'PART_OF%' AND l.keywords LIKE 'LOCATED_IN%' AND t.keywords LIKE 'TRADES_WITH%'""")
def path_through_hubs(spark, folder):
    """From regions down to the suppliers that their customers buy from: every nation is a hub of both of its steps."""
    nodes, edges = trade_graph(spark, folder)
    return g.path(nodes, written(edges, "edges"), [("PART_OF", "in"), ("LOCATED_IN", "in"), ("TRADES_WITH", "out")],
                  ["Region", "District", "Point", "Infrastructure"])


@query(SEARCH_SQL.replace("OR contains(lower(description), 'of asia')", "OR contains(lower(description), 'nation_1')") + " SELECT name, entity_type FROM nodes WHERE name IN (SELECT name FROM selected)")
def search_nodes(spark, folder):
    return g.search_subgraph(*trade_graph(spark, folder), "Nation_1")[0].select("name", "entity_type")


@query(SEARCH_SQL.replace("contains(lower(name), 'nation_1')", "contains(lower(name), 'of asia')") + " SELECT e.* FROM edges e JOIN selected a ON e.src = a.name JOIN selected b ON e.tgt = b.name")
def search_edges(spark, folder):
    return g.search_subgraph(*trade_graph(spark, folder), "of Asia")[1]


@query(TRADE_SQL + """ SELECT name AS id, entity_type AS type, substr(description, 1, 40) AS description FROM nodes""")
def project_nodes(spark, folder):
    return g.project_graph(*trade_graph(spark, folder), 40, 25)[0]


@query(TRADE_SQL + """ SELECT src AS source, tgt AS target, split_part(keywords, ',', 1) AS type, substr(description, 1, 25) AS description, weight FROM edges""")
def project_edges(spark, folder):
    return g.project_graph(*trade_graph(spark, folder), 40, 25)[1]


DEGREE_SQL = TRADE_SQL + """, ends AS (SELECT src AS name FROM edges UNION ALL SELECT tgt FROM edges WHERE src <> tgt),
  degrees AS (SELECT n.name, n.entity_type, (SELECT count(*) FROM ends e WHERE e.name = n.name) AS degree FROM nodes n),
  kept AS (SELECT * FROM degrees ORDER BY degree DESC, name LIMIT 130)"""


@query(DEGREE_SQL + " SELECT name, entity_type, degree FROM kept")
def limit_by_degree(spark, folder):
    return g.limit_by_degree(*trade_graph(spark, folder), 130)[0].select("name", "entity_type", "degree")


@query(DEGREE_SQL + " SELECT src, tgt, weight FROM edges WHERE src IN (SELECT name FROM kept) AND tgt IN (SELECT name FROM kept)")
def limit_by_degree_edges(spark, folder):
    return g.limit_by_degree(*trade_graph(spark, folder), 130)[1].select("src", "tgt", "weight")


@query(TRADE_SQL + " SELECT name, (SELECT count(*) FROM nodes) AS total FROM nodes ORDER BY name LIMIT 50")
def list_entities(spark, folder):
    return g.list_entities(trade_graph(spark, folder)[0])


@query(TRADE_SQL + " SELECT entity_type, count(*) AS n FROM nodes GROUP BY entity_type")
def type_counts(spark, folder):
    return g.type_counts(trade_graph(spark, folder)[0])


@query(TRADE_SQL + " SELECT split_part(keywords, ',', 1) AS predicate, count(*) AS n FROM edges GROUP BY 1")
def predicate_counts(spark, folder):
    return g.predicate_counts(trade_graph(spark, folder)[1])


@query(TRADE_SQL + " SELECT 'trade' AS graph, (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def graph_sizes(spark, folder):
    return g.graph_sizes(trade=trade_graph(spark, folder))


@query(TRADE_SQL + " SELECT * FROM nodes WHERE name = 'NATION_3'")
def entity_info(spark, folder):
    return g.entity_info(trade_graph(spark, folder)[0], "NATION_3")


@query(TRADE_SQL + " SELECT * FROM edges WHERE (src = 'ASIA' AND tgt = 'NATION_2') OR (src = 'NATION_2' AND tgt = 'ASIA')")
def relation_info(spark, folder):
    return g.relation_info(trade_graph(spark, folder)[1], "ASIA", "NATION_2")


@query(TRADE_SQL + """, retyped AS (SELECT s_name AS name, CASE WHEN s_acctbal > 0 THEN 'District' ELSE 'Indicator' END AS entity_type, 'renewed' AS description, 'new' AS source_id FROM supplier)
  SELECT * FROM nodes WHERE name NOT IN (SELECT name FROM retyped) UNION ALL SELECT * FROM retyped""")
def merge_last(spark, folder):
    return g.merge_nodes(trade_graph(spark, folder)[0], _retyped(spark, folder), "last")


@query(TRADE_SQL + """, retyped AS (SELECT s_name AS name, CASE WHEN s_acctbal > 0 THEN 'District' ELSE 'Indicator' END AS entity_type, 'renewed' AS description, 'new' AS source_id FROM supplier)
  SELECT * FROM nodes WHERE name NOT IN (SELECT name FROM retyped WHERE entity_type = 'District') UNION ALL SELECT * FROM retyped WHERE entity_type = 'District'""")
def merge_priority(spark, folder):
    return g.merge_nodes(trade_graph(spark, folder)[0], _retyped(spark, folder), "priority")


def _retyped(spark, folder):
    return i.table(spark, folder, "supplier").select(
        F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, "District").otherwise("Indicator").alias("entity_type"),
        F.lit("renewed").alias("description"), F.lit("new").alias("source_id"))


@query(TRADE_SQL + """, heavy AS (SELECT src, tgt, 'TRADES_WITH, bulk' AS keywords, 'bulk' AS description, weight * 10 AS weight, 'new' AS source_id FROM edges WHERE weight > 2)
  SELECT e.src, e.tgt, coalesce(h.keywords, e.keywords) AS keywords, coalesce(h.description, e.description) AS description,
   coalesce(h.weight, e.weight) AS weight, coalesce(h.source_id, e.source_id) AS source_id FROM edges e LEFT JOIN heavy h ON h.src = e.src AND h.tgt = e.tgt""")
def merge_edges(spark, folder):
    nodes, edges = trade_graph(spark, folder)
    heavy = edges.where("weight > 2").withColumn("keywords", F.lit("TRADES_WITH, bulk")).withColumn(
        "description", F.lit("bulk")).withColumn("weight", F.col("weight") * 10).withColumn("source_id", F.lit("new"))
    return g.merge_graph((nodes, edges), (nodes.where("false"), heavy))[1]


@query("SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1998)")
def missing_after_write(spark, folder):
    customers = i.table(spark, folder, "customer").select("c_custkey", F.col("c_name").alias("name"))
    active = i.table(spark, folder, "orders").where("year(o_orderdate) = 1998").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return g.missing_after_write(active.select("name").distinct(), customers)


@query("""SELECT source || '_p' || (doc_id % 3) AS source_id, 'chunk-' || doc_id AS chunk_id, n.label
  FROM documents JOIN (SELECT source || '_p1' AS source_id, count(*) AS label FROM documents GROUP BY 1) n ON n.source_id = source || '_p' || (doc_id % 3)""")
def chunks_of(spark, folder):
    docs = i.table(spark, folder, "documents")
    chunks = docs.select(F.concat(F.lit("chunk-"), "doc_id").alias("id"), "source", (F.col("doc_id") % 3).alias("page"),
                         F.col("text").alias("content"))
    entities = docs.groupBy(g.source_id(F.col("source"), F.lit(1)).alias("source_id")).agg(F.count("*").alias("label"))
    return g.chunks_of(entities, chunks).select("source_id", "chunk_id", "label")


# -- policies and links -----------------------------------------------------------------

POLICY_SQL = """policies AS (SELECT DISTINCT p_brand AS title, 'Parts of ' || p_brand AS abstract FROM part),
 goals AS (SELECT DISTINCT p_brand AS title, 'grow ' || p_name AS description FROM part),
 measures AS (SELECT DISTINCT p_brand AS title, p_type || ' measure of ' || (1990 + p_size % 12) AS description FROM part)"""


def _policies(spark, folder):
    part = i.table(spark, folder, "part")
    year = (F.lit(1990) + F.col("p_size") % 12).cast("string")
    return (part.select(F.col("p_brand").alias("title"), F.concat(F.lit("Parts of "), "p_brand").alias("abstract")).distinct(),
            part.select(F.col("p_brand").alias("title"), F.concat(F.lit("grow "), "p_name").alias("description")).distinct(),
            part.select(F.col("p_brand").alias("title"), F.concat("p_type", F.lit(" measure of "), year).alias("description")).distinct())


@query(f"""WITH {POLICY_SQL} SELECT title AS name, 'Policy' AS entity_type, abstract AS description, 'policy_data' AS source_id FROM policies
  UNION ALL SELECT description, 'PolicyGoal', description, 'policy_data' FROM goals
  UNION ALL SELECT description, 'PolicyMeasure', description, 'policy_data' FROM measures""")
def policy_nodes(spark, folder):
    return build.build_policy_graph(*_policies(spark, folder))[0]


@query(f"""WITH {POLICY_SQL} SELECT title AS src, description AS tgt, 'HAS_GOAL, 政策目标' AS keywords, '政策包含目标' AS description, 1e0 AS weight, 'policy_data' AS source_id FROM goals
  UNION ALL SELECT title, description, 'HAS_MEASURE, 政策措施', '政策包含措施', 1e0, 'policy_data' FROM measures""")
def policy_edges(spark, folder):
    return build.build_policy_graph(*_policies(spark, folder))[1]


# points, nations as districts, planning zones as concepts, years as boundaries and events, part texts as goals and measures
LINK_SQL = f"""WITH {i.YEARS_SQL}, {i.POINTS_SQL}, {POLICY_SQL},
pts AS (SELECT name, {DESCRIPTION_SQL} AS description FROM points),
years_links AS (SELECT m.name AS src, y.year || '年城市边界' AS tgt, 'APPLIES_TO' AS predicate, 1e0 AS weight
  FROM (SELECT DISTINCT description AS name FROM measures) m, years y WHERE contains(m.name, CAST(y.year AS VARCHAR))),
goal_links AS (SELECT gl.name AS src, y.year || '年进入边界事件' AS tgt, 'DRIVES' AS predicate, 8e-1 AS weight
  FROM (SELECT DISTINCT description AS name FROM goals) gl, years y WHERE contains(gl.name, 'bolt') OR contains(gl.name, 'gear')),
district_links AS (SELECT n_name AS src, p.name AS tgt, 'GOVERNS' AS predicate, 9e-1 AS weight FROM nation, pts p WHERE contains(p.description, n_name)),
concept_links AS (SELECT z.name AS src, p.name AS tgt, 'CONTAINS' AS predicate, 7e-1 AS weight
  FROM (SELECT DISTINCT planning_zone AS name FROM points) z, pts p WHERE contains(p.description, z.name)),
ruled AS (SELECT name, CASE WHEN contains(name, 'ECONOMY') OR contains(name, 'SMALL') THEN 0 WHEN contains(name, 'MEASURE') OR contains(name, 'LARGE') THEN 1
   WHEN contains(name, 'measure of 199') THEN 2 END AS rule FROM (SELECT DISTINCT description AS name FROM measures)),
measure_links AS (SELECT r.name AS src, p.name AS tgt, 'TARGETS' AS predicate, 75e-2 AS weight FROM ruled r, pts p
  WHERE (rule = 0 AND (contains(p.description, '用地:M') OR contains(p.description, 'planned'))) OR (rule = 1 AND contains(p.description, '用地:B2'))
     OR (rule = 2 AND contains(p.description, 'furniture'))),
infra_links AS (SELECT s_name AS src, p.name AS tgt, 'LOCATED_IN' AS predicate, 65e-2 AS weight FROM supplier, pts p
  WHERE contains(s_name, '7') AND contains(p.description, '用地:H1'))"""
RULES = ((("ECONOMY", "SMALL"), ("用地:M", "planned")), (("MEASURE", "LARGE"), ("用地:B2",)), (("measure of 199",), ("furniture",)))


def link_nodes(spark, folder):
    points = build.point_nodes(i.points(spark, folder).select("point_id"), i.points(spark, folder))
    years = i.years(spark, folder)
    _, goals, measures = _policies(spark, folder)

    def typed(df, kind, description=F.lit("")):
        return df.select("name", F.lit(kind).alias("entity_type"), description.alias("description"), F.lit("").alias("source_id"))
    nodes = points
    for more in (
            typed(i.table(spark, folder, "nation").select(F.col("n_name").alias("name")), "District"),
            typed(i.points(spark, folder).select(F.col("planning_zone").alias("name")).distinct(), "SpatialConcept"),
            typed(years.select(tr.boundary_name(F.col("year")).alias("name")), "Boundary"),
            typed(years.select(tr.event_name(F.col("year"), F.lit("entry")).alias("name")), "STTE_Event"),
            typed(goals.select(F.col("description").alias("name")).distinct(), "PolicyGoal"),
            typed(measures.select(F.col("description").alias("name")).distinct(), "PolicyMeasure"),
            typed(i.table(spark, folder, "supplier").select(F.col("s_name").alias("name")), "Infrastructure")):
        nodes = nodes.unionByName(more)
    return nodes


LINK_COLUMNS = ("src", "tgt", "predicate", "weight")


@query(LINK_SQL + " SELECT * FROM years_links")
def link_policy_years(spark, folder):
    return link.link_policy_years(link_nodes(spark, folder)).select(*LINK_COLUMNS)


@query(LINK_SQL + " SELECT * FROM goal_links")
def link_goal_events(spark, folder):
    return link.link_goal_events(link_nodes(spark, folder), ("bolt", "gear")).select(*LINK_COLUMNS)


@query(LINK_SQL + " SELECT * FROM district_links")
def link_districts(spark, folder):
    return link.link_districts(link_nodes(spark, folder)).select(*LINK_COLUMNS)


@query(LINK_SQL + " SELECT * FROM concept_links")
def link_concepts(spark, folder):
    return link.link_concepts(link_nodes(spark, folder)).select(*LINK_COLUMNS)


@query(LINK_SQL + " SELECT * FROM measure_links")
def link_measures(spark, folder):
    return link.link_measures(link_nodes(spark, folder), RULES).select(*LINK_COLUMNS)


@query(LINK_SQL + " SELECT * FROM infra_links")
def link_infrastructure(spark, folder):
    return link.link_infrastructure(link_nodes(spark, folder), ("7",), ("用地:H1",)).select(*LINK_COLUMNS)


@query(LINK_SQL + """ SELECT * FROM years_links UNION ALL SELECT * FROM goal_links UNION ALL SELECT * FROM district_links
  UNION ALL SELECT * FROM measure_links UNION ALL SELECT * FROM concept_links UNION ALL SELECT * FROM infra_links""")
def link_graph(spark, folder):
    # by type, because every rule reads one or two of the eight
    path = f"{scratch_dir(spark)}/link-nodes-{uuid.uuid4().hex}"
    link_nodes(spark, folder).write.partitionBy("entity_type").parquet(path)
    found = link.link_graph(spark.read.parquet(path), growth_words=("bolt", "gear"), measure_rules=RULES, transport_names=("7",),
                            transport_points=("用地:H1",))
    return found.select(*LINK_COLUMNS)
