"""The analytics inputs derived from the test tables, for Spark and as SQL for the oracle.

Customers are the points, a customer with an order in a year is a member of that year.
Positions are laid out at a constant density: rows of 360 points about two kilometres apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import partition_for


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")  # see session.local_session
    path = f"{folder}/{name}.parquet"
    partition_for(spark, path)
    return spark.read.parquet(path)


def _position(key: str, div: str) -> tuple[str, str]:
    def quotient(a, b):
        return f"({a} div {b})" if div == "div" else f"({a} // {b})"
    lon = (f"-180e0 + ({quotient(key, 720000)} % 50) * 7.2e0 + ({key} % 360) * 2e-2"
           f" + (({key} * 7919) % 10007) / 1.0007e4 * 2e-2")
    lat = f"20e0 + ({quotient(key, 360)} % 2000) * 2e-2 + (({key} * 104729) % 10009) / 1.0009e4 * 2e-2"
    return lon, lat


def _points_select(div: str, text: str) -> str:
    lon, lat = _position("c_custkey", div)
    return f"""SELECT 'P' || CAST(c_custkey AS {text}) AS point_id, c_name AS name, {lon} AS lon, {lat} AS lat,
        lower(c_mktsegment) AS point_type, n_name AS district, '' AS sub_district,
        'Zone ' || CAST(c_nationkey % 5 AS {text}) AS planning_zone, c_mktsegment AS planning_function,
        substr(c_mktsegment, 1, 1) || CAST(c_nationkey % 3 + 1 AS {text}) AS land_use_code, '' AS control_line,
        CASE WHEN c_acctbal < 0 THEN 'planned' ELSE 'built' END AS development_stage,
        CAST(floor(abs(c_acctbal)) AS INT) AS population_served, CAST(NULL AS INT) AS entry_year, '' AS change_reason,
        c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def years(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(F.year("o_orderdate").alias("year")).distinct()


def membership(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("year"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("point_id"))


def points(spark, folder) -> DataFrame:
    return spark.sql(_points_select("div", "STRING").replace("FROM customer JOIN nation", "FROM {customer} JOIN {nation}"),
                     customer=table(spark, folder, "customer"), nation=table(spark, folder, "nation"))


YEARS_SQL = "years AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders)"
MEMBERSHIP_SQL = ("membership AS (SELECT CAST(year(o_orderdate) AS INT) AS year, 'P' || CAST(o_custkey AS VARCHAR) AS point_id "
                  "FROM orders)")
POINTS_SQL = f"points AS ({_points_select('//', 'VARCHAR')})"
# neighbours in the list of years, then set differences both ways
TRANSITIONS_SQL = """chain AS (SELECT year AS year_before, lead(year) OVER (ORDER BY year) AS year_after FROM years),
members AS (SELECT DISTINCT year, point_id FROM membership),
transitions AS (
  SELECT m.point_id, 'entry' AS event_type, c.year_before, c.year_after FROM chain c JOIN members m ON m.year = c.year_after
  WHERE NOT EXISTS (SELECT 1 FROM members b WHERE b.year = c.year_before AND b.point_id = m.point_id)
  UNION ALL
  SELECT m.point_id, 'exit', c.year_before, c.year_after FROM chain c JOIN members m ON m.year = c.year_before
  WHERE c.year_after IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM members b WHERE b.year = c.year_after AND b.point_id = m.point_id))"""
EVENTS_SQL = """events_full AS (SELECT t.*, coalesce(p.name, t.point_id) AS point_name, p.lon, p.lat,
  coalesce(p.point_type, 'unknown') AS point_type FROM transitions t LEFT JOIN points p USING (point_id))"""
CHANGES_SQL = f"WITH {YEARS_SQL}, {MEMBERSHIP_SQL}, {POINTS_SQL}, {TRANSITIONS_SQL}, {EVENTS_SQL}"
EVENT_NAME_SQL = "CAST(year_after AS VARCHAR) || '年' || CASE event_type WHEN 'entry' THEN '进入' ELSE '退出' END || '边界事件'"
DESCRIPTION_SQL = """'行政区:' || district || ' | 规划片区:' || planning_zone
  || printf(' | 经纬度:(%.4f,%.4f)', lon, lat) || ' | 功能:' || planning_function || ' | 用地:' || land_use_code
  || ' | 类型:' || point_type || ' | 阶段:' || development_stage
  || CASE WHEN population_served <> 0 THEN ' | 服务人口:' || CAST(population_served AS VARCHAR) ELSE '' END"""
