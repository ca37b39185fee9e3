"""Queries over change events and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import involves_expansion, is_entry, is_exit
from tidemark.operators import series, spatial, transitions as tr
from tidemark.plans import inputs as i
from tidemark.plans.inputs import CHANGES_SQL, DESCRIPTION_SQL, EVENT_NAME_SQL

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def _all(spark, folder):
    years, membership, points = i.years(spark, folder), i.membership(spark, folder), i.points(spark, folder)
    return years, membership, points, tr.enrich_events(tr.transitions(years, membership), points)


@query(CHANGES_SQL + " SELECT point_id, event_type, year_before, year_after FROM transitions")
def transitions(spark, folder):
    return tr.transitions(i.years(spark, folder), i.membership(spark, folder))


@query(CHANGES_SQL + """ SELECT event_type, CAST(year_after AS VARCHAR) || '-01-01' AS event_date,
  CAST(year_after AS VARCHAR) || '年' AS label, point_id, point_name,
  'boundary_' || year_before AS boundary_before, 'boundary_' || year_after AS boundary_after,
  CASE event_type WHEN 'entry' THEN 'outside' ELSE 'inside' END AS relation_before,
  CASE event_type WHEN 'entry' THEN 'inside' ELSE 'outside' END AS relation_after,
  CASE event_type WHEN 'entry' THEN 'high' ELSE 'medium' END AS significance,
  '点''' || point_name || '''在' || year_before || '年位于边界' || CASE event_type WHEN 'entry' THEN '外部' ELSE '内部' END
   || '，' || year_after || '年变为边界' || CASE event_type WHEN 'entry' THEN '内部' ELSE '外部' END AS description,
  round(lon, 6) AS lon, round(lat, 6) AS lat, point_type, year_before, year_after,
  'stte_' || substr(sha256(event_type || '|' || year_after || '|' || point_id), 1, 16) AS event_id FROM events_full""")
def enriched_events(spark, folder):
    events = _all(spark, folder)[3]
    return events.withColumn("event_date", F.col("event_date").cast("string")).withColumn(
        "lon", F.round("lon", 6)).withColumn("lat", F.round("lat", 6))


@query(CHANGES_SQL + """ SELECT event_type, point_id, year_after, event_type = 'entry' AS is_entry,
  event_type = 'exit' AS is_exit, event_type IN ('entry', 'expansion', 'merger') AS expands FROM transitions""")
def event_flags(spark, folder):
    events = tr.transitions(i.years(spark, folder), i.membership(spark, folder))
    return events.select("event_type", "point_id", "year_after", is_entry().alias("is_entry"), is_exit().alias("is_exit"),
                         involves_expansion().alias("expands"))


@query(CHANGES_SQL + f""" SELECT year_after, event_type, count(*) AS member_count, {EVENT_NAME_SQL} AS name
  FROM transitions GROUP BY year_after, event_type""")
def event_groups(spark, folder):
    return tr.event_groups(tr.transitions(i.years(spark, folder), i.membership(spark, folder)))


@query(CHANGES_SQL + """ SELECT year_after, event_type, CAST(n // 1000 AS INT) AS part, any_value(total) AS total,
  string_agg(point_name, ', ' ORDER BY point_name) AS names
  FROM (SELECT *, row_number() OVER (PARTITION BY year_after, event_type ORDER BY point_name) - 1 AS n,
    count(*) OVER (PARTITION BY year_after, event_type) AS total FROM events_full) GROUP BY year_after, event_type, n // 1000""")
def event_members(spark, folder):
    parts = tr.event_member_parts(_all(spark, folder)[3])
    return parts.select("year_after", "event_type", "part", "total", F.array_join("members", ", ").alias("names"))


@query(CHANGES_SQL + """ SELECT y.year, count(m.point_id) AS point_count FROM years y LEFT JOIN membership m ON m.year = y.year
  GROUP BY y.year""")
def boundary_counts(spark, folder):
    return tr.boundary_counts(i.years(spark, folder), i.membership(spark, folder))


@query(CHANGES_SQL + """ SELECT year_after || '年城市边界' AS src, year_before || '年城市边界' AS tgt,
  '从' || year_before || '年边界转换到' || year_after || '年边界' AS description, 'TRANSITION_FROM, 时间演变' AS keywords
  FROM chain WHERE year_after IS NOT NULL""")
def transition_edges(spark, folder):
    return tr.transition_edges(i.years(spark, folder))


@query("""WITH b AS (SELECT CAST(year(o_orderdate) AS INT) AS year, round(sum(o_totalprice) / 1e6, 3) AS area_km2 FROM orders GROUP BY 1),
  c AS (SELECT lag(year) OVER (ORDER BY year) AS previous_year, year, lag(area_km2) OVER (ORDER BY year) AS previous_area, area_km2 FROM b)
  SELECT previous_year, year, previous_area, area_km2, round(area_km2 - previous_area, 3) AS area_change,
   round((area_km2 - previous_area) / previous_area, 6) AS change_rate,
   CASE WHEN area_km2 > previous_area THEN 'expansion' WHEN area_km2 < previous_area THEN 'contraction' ELSE 'restructuring' END AS change_type
  FROM c WHERE previous_year IS NOT NULL""")
def boundary_changes(spark, folder):
    areas = i.table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.round(F.sum("o_totalprice") / 1e6, 3).alias("area_km2"))
    return tr.boundary_changes(areas).withColumn("area_change", F.round("area_change", 3)).withColumn(
        "change_rate", F.round("change_rate", 6))


@query("""WITH k AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS first_seen, min(event_id) AS tie, max(ts) AS last_seen
   FROM events GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_seen, tie) AS rn FROM k)
  SELECT user_id, CAST(sum(n) AS BIGINT) AS event_count, max(CASE WHEN rn = 1 THEN event_type END) AS dominant_type,
   epoch_us(min(first_seen)) AS first_us, epoch_us(max(last_seen)) AS last_us FROM r GROUP BY user_id""")
def cluster_stats(spark, folder):
    stats = tr.cluster_stats(i.table(spark, folder, "events"), "user_id", "ts", "event_id")
    return stats.select("user_id", "event_count", "dominant_type", F.unix_micros(F.col("first_time").cast("timestamp")).alias("first_us"),
                        F.unix_micros(F.col("last_time").cast("timestamp")).alias("last_us"))


@query("""SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS position
  FROM events""")
def event_sequence(spark, folder):
    return tr.event_sequence(i.table(spark, folder, "events"), "user_id", "ts", "event_id").select(
        "user_id", "event_id", "event_type", "position")


@query("SELECT DISTINCT 'P' || CAST(o_custkey AS VARCHAR) AS point_id FROM orders")
def points_ever_seen(spark, folder):
    return tr.points_ever_seen(i.membership(spark, folder))


@query(CHANGES_SQL + " SELECT year_after, point_id FROM transitions WHERE event_type = 'entry'")
def entered_points(spark, folder):
    return tr.entered(i.years(spark, folder), i.membership(spark, folder))


@query(CHANGES_SQL + " SELECT year_after, point_id FROM transitions WHERE event_type = 'exit'")
def exited_points(spark, folder):
    return tr.exited(i.years(spark, folder), i.membership(spark, folder))


YEAR_CHANGES_SQL = """year_changes AS (SELECT y.year, (SELECT count(*) FROM membership m WHERE m.year = y.year) AS point_count,
   (SELECT count(*) FROM transitions t WHERE t.year_after = y.year AND event_type = 'entry') AS entries,
   (SELECT count(*) FROM transitions t WHERE t.year_after = y.year AND event_type = 'exit') AS exits FROM years y)"""


@query(CHANGES_SQL + f", {YEAR_CHANGES_SQL} SELECT year, point_count, entries, exits, entries - exits AS net_change FROM year_changes")
def year_changes(spark, folder):
    years, membership, _, _ = _all(spark, folder)
    return series.year_changes(years, membership, tr.transitions(years, membership))


def _series(metric):
    def run(spark, folder):
        years, membership, points, events = _all(spark, folder)
        return series.time_series(years, membership, points, events, metric, 1990, 2010)
    return run


for _metric, _value in (("boundary_points", "point_count"), ("net_change", "entries - exits")):
    QUERIES[f"series_{_metric}"] = _series(_metric)
    ORACLES[f"series_{_metric}"] = CHANGES_SQL + f""", {YEAR_CHANGES_SQL} SELECT year, {_value} AS value,
      '(' || year || '年) {_metric}=' || ({_value}) AS line FROM year_changes"""
for _metric, _kind in (("entries", "entry"), ("exits", "exit")):
    QUERIES[f"series_{_metric}"] = _series(_metric)
    ORACLES[f"series_{_metric}"] = CHANGES_SQL + f""", {YEAR_CHANGES_SQL},
      named AS (SELECT year_after AS year, point_name, row_number() OVER (PARTITION BY year_after ORDER BY point_name) AS rn
        FROM events_full WHERE event_type = '{_kind}'),
      preview AS (SELECT year, string_agg(point_name, ', ' ORDER BY rn) AS names FROM named WHERE rn <= 5 GROUP BY year)
      SELECT c.year, {_metric} AS value, '(' || c.year || '年) {_metric}=' || {_metric}
        || coalesce(' → ' || names || CASE WHEN {_metric} > 5 THEN ' 等' || {_metric} || '个' ELSE '' END, '') AS line
      FROM year_changes c LEFT JOIN preview p ON p.year = c.year"""

DISTRIBUTION_SQL = """dist AS (SELECT year_after AS year, land_use_code, count(*) AS n FROM transitions t JOIN points p USING (point_id)
    WHERE event_type = 'entry' GROUP BY ALL),
  dist_text AS (SELECT year, string_agg(land_use_code || ':' || n, ', ' ORDER BY land_use_code) AS text,
    CAST(sum(n) AS BIGINT) AS total FROM dist GROUP BY year)"""
QUERIES["series_point_types"] = _series("point_type_distribution")
ORACLES["series_point_types"] = CHANGES_SQL + f""", {DISTRIBUTION_SQL}
  SELECT y.year, coalesce(total, 0) AS value, '(' || y.year || '年, 共' || coalesce(total, 0) || '个) ' || coalesce(text, '无') AS line
  FROM years y LEFT JOIN dist_text d ON d.year = y.year"""


@query(CHANGES_SQL + f", {DISTRIBUTION_SQL} SELECT year, land_use_code, n FROM dist")
def type_distribution(spark, folder):
    years, membership, points, events = _all(spark, folder)
    return series.type_distribution(years, points, events)


@query(CHANGES_SQL + f""", {YEAR_CHANGES_SQL}, {DISTRIBUTION_SQL}, slots AS (SELECT 1 AS slot, 1997 AS year UNION ALL SELECT 2, 2000),
  lines AS (
    SELECT 1 AS block, slot, 0 AS part, printf('(%d年) 进入=%d, 退出=%d, 净变化=', year, entries, exits)
      || CASE WHEN entries >= exits THEN '+' ELSE '' END || (entries - exits) || printf(', 边界内=%d个点', point_count) AS text
      FROM slots JOIN year_changes USING (year)
    UNION ALL SELECT 2, slot, coalesce(part, 0), '(' || s.year || '年进入点位) ' || coalesce(names, '无') FROM slots s LEFT JOIN
      (SELECT year_after AS year, n // 1000 AS part, string_agg(point_name, ', ' ORDER BY point_name) AS names FROM
        (SELECT *, row_number() OVER (PARTITION BY year_after ORDER BY point_name) - 1 AS n FROM events_full WHERE event_type = 'entry')
        GROUP BY year_after, n // 1000) e ON e.year = s.year
    UNION ALL SELECT 3, slot, 0, '(' || s.year || '年进入类型) ' || coalesce((SELECT text FROM dist_text d WHERE d.year = s.year), '无') FROM slots s)
  SELECT CAST(row_number() OVER (ORDER BY block, slot, part) AS INT) AS line_no,
    '[E' || row_number() OVER (ORDER BY block, slot, part) || '] ' || text AS line FROM lines""")
def compare_periods(spark, folder):
    years, membership, points, events = _all(spark, folder)
    return series.compare_periods(years, membership, points, events, 1997, 2000)


@query("SELECT 1 AS line_no, '(缺少年份数据: 1900, 2100)' AS line")
def compare_missing_years(spark, folder):
    years, membership, points, events = _all(spark, folder)
    return series.compare_periods(years, membership, points, events, 1900, 2100)


@query(CHANGES_SQL + f""", lines AS (
   SELECT 0 AS block, '' AS point_name, '' AS point_id, '(Boundary) 1998年城市边界 — 1998年的城市边界状态，边界内共 '
     || (SELECT count(*) FROM membership WHERE year = 1998) || ' 个点位' AS text
   UNION ALL SELECT CASE event_type WHEN 'entry' THEN 1 ELSE 2 END, point_name, e.point_id,
     CASE event_type WHEN 'entry' THEN '(Point/进入) ' ELSE '(Point/退出) ' END || point_name || ' — ' || d.text
   FROM events_full e JOIN (SELECT point_id, {DESCRIPTION_SQL} AS text FROM points) d ON d.point_id = e.point_id WHERE year_after = 1998)
  SELECT CAST(row_number() OVER (ORDER BY block, point_name, point_id) AS INT) AS line_no,
   '[E' || row_number() OVER (ORDER BY block, point_name, point_id) || '] ' || text AS line FROM lines""")
def year_summary(spark, folder):
    years, membership, points, events = _all(spark, folder)
    return series.year_summary(years, membership, points, events, 1998)


@query(CHANGES_SQL + f""", {YEAR_CHANGES_SQL}, ranked AS (SELECT year_after AS year, event_type, point_name, point_id,
    row_number() OVER (PARTITION BY year_after, event_type ORDER BY point_name, point_id) AS rn FROM events_full),
  lines AS (
   SELECT year, 0 AS block, 0 AS rn, printf('(Boundary/%d年) 边界内%d个点, 进入%d, 退出%d', year, point_count, entries, exits) AS text FROM year_changes
   UNION ALL SELECT year, CASE event_type WHEN 'entry' THEN 1 ELSE 2 END, rn,
    CASE event_type WHEN 'entry' THEN '(Point/进入/' ELSE '(Point/退出/' END || year || '年) ' || point_name || ' — ' || substr(d.text, 1, 100)
    FROM ranked r JOIN (SELECT point_id, {DESCRIPTION_SQL} AS text FROM points) d ON d.point_id = r.point_id
    WHERE rn <= CASE event_type WHEN 'entry' THEN 3 ELSE 2 END)
  SELECT CAST(row_number() OVER (ORDER BY year, block, rn) AS INT) AS line_no, year,
   '[E' || row_number() OVER (ORDER BY year, block, rn) || '] ' || text AS line FROM lines""")
def timeline(spark, folder):
    years, membership, points, events = _all(spark, folder)
    return series.timeline(years, membership, points, events, 1990, 2010)


@query("SELECT y.year FROM (SELECT unnest(range(1990, 2006))::INT AS year) y WHERE y.year NOT IN (SELECT year(o_orderdate) FROM orders)")
def missing_years(spark, folder):
    from tidemark.operators.graph import missing_years as missing
    return missing(i.years(spark, folder), 1990, 2005)


def _rings(spark, folder):
    """A concave boundary per year around the first rows of points, growing with the orders."""
    grown = i.table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    top = F.lit(20.0) + (F.col("year") % 5 + 1) * 0.015 + F.col("n") * 1e-9
    corners = [(-179.9, 20.001), (-176.1, 20.011), (-176.2, top), (-177.5, 20.012), (-179.7, top)]
    ring = F.array(*[F.array(F.lit(x), y if not isinstance(y, float) else F.lit(y)) for x, y in corners])
    return grown.select("year", F.array(ring).alias("rings"))


@query(CHANGES_SQL + """, grown AS (SELECT CAST(year(o_orderdate) AS INT) AS year, 20e0 + (year(o_orderdate) % 5 + 1) * 15e-3 + count(*) * 1e-9 AS top
    FROM orders GROUP BY year(o_orderdate)),
  corners AS (SELECT year, unnest([1, 2, 3, 4, 5]) AS at, unnest([-179.9e0, -176.1e0, -176.2e0, -177.5e0, -179.7e0]) AS x,
    unnest([20.001e0, 20.011e0, top, 20.012e0, top]) AS y FROM grown),
  edges AS (SELECT a.year, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corners a JOIN corners b ON a.year = b.year AND b.at = a.at % 5 + 1)
  SELECT e.year, p.point_id FROM points p CROSS JOIN edges e GROUP BY e.year, p.point_id
  HAVING count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1""")
def points_in_boundaries(spark, folder):
    return spatial.points_in_boundaries(i.points(spark, folder), _rings(spark, folder))


@query(CHANGES_SQL + """ SELECT a.point_id AS src_id, b.point_id AS tgt_id, round(2 * 6371e0 * asin(sqrt(least(1e0,
    pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))), 6) AS distance_km
  FROM points a JOIN points b ON a.point_id <> b.point_id WHERE 2 * 6371e0 * asin(sqrt(least(1e0,
    pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))) < 5""")
def adjacent_points(spark, folder):
    return spatial.adjacent_points(i.points(spark, folder), 5.0).withColumn("distance_km", F.round("distance_km", 6))


PERIODS_SQL = """a AS (SELECT o_custkey AS id, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders GROUP BY o_custkey),
  b AS (SELECT CAST(year(o_orderdate) AS INT) AS id, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders GROUP BY 1)"""


@query(f"""WITH {PERIODS_SQL} SELECT a.id AS a_id, b.id AS b_id, CASE WHEN a.s = b.s AND a.e = b.e THEN 'equals' WHEN a.e < b.s THEN 'before'
   WHEN a.s > b.e THEN 'after' WHEN a.e = b.s THEN 'meets' WHEN a.s = b.s AND a.e < b.e THEN 'starts' WHEN a.e = b.e AND a.s > b.s THEN 'finishes'
   WHEN a.s > b.s AND a.e < b.e THEN 'during' ELSE 'overlaps' END AS relation FROM a, b WHERE a.s <= b.e AND b.s <= a.e""")
def temporal_relations(spark, folder):
    orders = i.table(spark, folder, "orders")

    def periods(key):
        return orders.groupBy(key.alias("id")).agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    return tr.touching_periods(periods(F.col("o_custkey")), periods(F.year("o_orderdate")), bucket_days=180)
