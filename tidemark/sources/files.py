"""Readers for the input formats; each returns plain DataFrames with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scan import escape_controls
from tidemark.functions.text import predicate_of
from tidemark.operators.spatial import points_in_boundaries

POINT_FIELDS = ("id string, name string, lon double, lat double, point_type string, district string, "
                "sub_district string, planning_zone string, control_line string, land_use_code string, "
                "planning_function string, development_stage string, population_served int, entry_year int, "
                "change_reason string")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_year_points(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``{"year_points": {year: [id]}, "point_info": {id: {…}}}`` to (years, membership, points)."""
    doc = _json(spark, path, f"year_points map<string,array<string>>, point_info map<string,struct<{_colons(POINT_FIELDS)}>>")
    lists = doc.select(F.explode("year_points").alias("year", "ids")).withColumn("year", F.col("year").cast("int"))
    info = doc.select(F.explode("point_info").alias("point_id", "p"))
    fields = [c for c in info.select("p.*").columns if c != "id"]
    return (lists.select("year"), lists.select("year", F.explode("ids").alias("point_id")),
            info.select("point_id", *[F.col(f"p.{c}") for c in fields]))


def _colons(fields: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (f.split() for f in fields.split(", ")))


def rings_of(geometry: Column) -> Column:
    """Rings of a GeoJSON Polygon or MultiPolygon struct<type, coordinates as JSON text>."""
    polygon = F.from_json(geometry["coordinates"], "array<array<array<double>>>")
    many = F.flatten(F.from_json(geometry["coordinates"], "array<array<array<array<double>>>>"))
    return F.when(geometry["type"] == "MultiPolygon", many).otherwise(polygon)


GEOMETRY = "struct<type:string,coordinates:string>"


def read_geojson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A FeatureCollection with ``years`` and ``year_boundaries`` to (points, boundaries)."""
    # coordinates of points are read as numbers: for nested JSON as text Spark seeks the file again at every value. Of other
    # shapes, which drop out, the numbers are nested deeper and read as null
    features = _json(spark, path, "features array<struct<geometry:struct<type:string,coordinates:array<double>>,"
                                  "properties:struct<id:string,name:string,type:string>>>")
    doc = _json(spark, path, f"years array<int>, year_boundaries map<string,{GEOMETRY}>")
    only_points = F.filter("features", lambda f: f.geometry.type == "Point")
    rows = features.select(F.posexplode(only_points).alias("n", "f"))
    at = F.col("f.geometry.coordinates")
    points = rows.select(
        F.coalesce("f.properties.id", F.format_string("point_%d", "n")).alias("point_id"),
        F.coalesce("f.properties.name", F.format_string("点%d", F.col("n") + 1)).alias("name"),
        F.get(at, F.lit(0)).alias("lon"), F.get(at, F.lit(1)).alias("lat"), F.coalesce("f.properties.type", F.lit("unknown")).alias("point_type"))
    years = doc.select(F.explode("years").alias("year"), "year_boundaries")
    shape = F.try_element_at("year_boundaries", F.col("year").cast("string"))
    return points, years.select("year", rings_of(shape).alias("rings"))


def read_separated(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``{"points": […], "boundaries": […]}`` to (points, boundaries); of a repeated year the
    later boundary counts, one without a year does not."""
    doc = _json(spark, path, "points array<struct<id:string,name:string,lon:double,lat:double,type:string,point_type:string>>, "
                             f"boundaries array<struct<year:int,geometry:{GEOMETRY}>>")
    rows = doc.select(F.posexplode("points").alias("n", "p"))
    points = rows.select(
        F.coalesce("p.id", F.format_string("point_%d", "n")).alias("point_id"),
        F.coalesce("p.name", F.format_string("点%d", F.col("n") + 1)).alias("name"),
        F.coalesce("p.lon", F.lit(0.0)).alias("lon"), F.coalesce("p.lat", F.lit(0.0)).alias("lat"),
        F.coalesce("p.type", "p.point_type", F.lit("unknown")).alias("point_type"))
    shapes = doc.select(F.posexplode("boundaries").alias("n", "b")).where("b.year <> 0")
    last = shapes.groupBy(F.col("b.year").alias("year")).agg(F.max_by("b.geometry", "n").alias("geometry"))
    return points, last.select("year", rings_of(F.col("geometry")).alias("rings"))


def read_membership(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(years, membership, points) from whichever of the three formats the file has."""
    probe = _json(spark, path, "year_points string, type string, points string, boundaries string")
    seen = probe.select(F.col("year_points").isNotNull().alias("y"), F.col("type"),
                        (F.col("points").isNotNull() & F.col("boundaries").isNotNull()).alias("s")).head()
    if seen is not None and seen["y"]:
        return read_year_points(spark, path)
    if seen is not None and seen["type"] == "FeatureCollection":
        points, boundaries = read_geojson(spark, path)
    elif seen is not None and seen["s"]:
        points, boundaries = read_separated(spark, path)
    else:
        raise ValueError("unsupported format: need year_points, a FeatureCollection, or points and boundaries")
    return boundaries.select("year"), points_in_boundaries(points, boundaries), points


def read_policies(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A JSON array of policies to (policies, goals, measures)."""
    item = "array<struct<id:string,description:string>>"
    docs = _json(spark, path, f"id string, title string, abstract string, goals {item}, measures {item}")
    docs = docs.withColumn("title", F.coalesce("title", "id", F.lit("未知政策")))

    def items(column):
        rows = docs.select("title", F.explode(column).alias("i"))
        return rows.select("title", F.coalesce("i.description", "i.id").alias("description")).where("description <> ''")
    return docs.select("title", F.coalesce("abstract", F.lit("")).alias("abstract")), items("goals"), items("measures")


def read_documents(spark: SparkSession, folder: str, boundary: str | None = None) -> DataFrame:
    """(path, source, text) of every .txt file below the folder; unreadable files are skipped. With a ``boundary``, which
    no text may have in it, a file holds any number of texts, each of them followed by the boundary."""
    rows = spark.read.option("ignoreCorruptFiles", True).text(
        folder, wholetext=boundary is None, lineSep=boundary, recursiveFileLookup=True, pathGlobFilter="*.[tT][xX][tT]")
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("path"), F.regexp_replace(path, "^.*/", "").alias("source"), F.col("value").alias("text"))


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(hash, path, bytes) of the files below the folder."""
    rows = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern).load(folder))
    return rows.select(F.md5("content").alias("hash"), "path", F.col("length").alias("bytes"))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """GraphML to (nodes, edges) by Spark's XML source. The ``<key>`` table of the header names
    the attributes: a handful of rows."""
    def rows(tag, schema):
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    def number(column):
        return F.when(column != "", column.cast("double"))
    keys = rows("key", "_id string, _for string, `_attr.name` string").distinct().collect()
    data = "data array<struct<_key:string,_VALUE:string>>"

    def attribute(kind, name):
        mine = [k["_id"] for k in keys if k["_for"] in (kind, "all") and k["_attr.name"] == name]
        if not mine:
            return F.lit(None).cast("string")
        return F.get(F.filter("data", lambda d: d["_key"].isin(mine)), F.lit(0))["_VALUE"]
    spark_nodes = rows("node", f"_id string, {data}")
    nodes = spark_nodes.select(F.col("_id").alias("name"),
                               F.coalesce(attribute("node", "entity_type"), F.lit("Unknown")).alias("entity_type"),
                               F.coalesce(attribute("node", "description"), F.lit("")).alias("description"),
                               attribute("node", "source_id").alias("source_id"))
    raw = rows("edge", f"_source string, _target string, {data}")
    edges = raw.select(F.col("_source").alias("src"), F.col("_target").alias("tgt"),
                       F.coalesce(attribute("edge", "keywords"), F.lit("")).alias("keywords"),
                       F.coalesce(attribute("edge", "description"), F.lit("")).alias("description"),
                       F.coalesce(number(attribute("edge", "weight")), F.lit(1.0)).alias("weight"),
                       attribute("edge", "source_id").alias("source_id"))
    predicate = F.coalesce(F.nullif(predicate_of("keywords"), F.lit("")), F.lit("related"))
    return nodes, edges.withColumn("predicate", predicate)


SUB_RESULT = ("struct<agent_name:string,status:string,answer:string,evidence:array<struct<id:string,text:string>>,"
              "tool_calls:array<struct<name:string,input:string,output:string,truncated:boolean>>,"
              "error:string,started_at:string,finished_at:string>")
TURN = (f"struct<task_id:string,session_id:string,question:string,status:string,intent:string,"
        f"sub_results:map<string,{SUB_RESULT}>,aggregated:string,result:string,citation_audit:string,error:string,"
        f"started_at:string,finished_at:string>")


def read_sessions(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Session files, or with ``lines`` files with a session in every line, to (turns, sub_results, tool_calls, evidence).
    What was pending or running when the file was written reads as failed; an old turn's result stands in for its text."""
    docs = (spark.read.schema(f"session_id string, created_at string, current_task_id string, tenant_id string, turns array<{TURN}>")
            .option("multiLine", not lines).option("recursiveFileLookup", True).json(path))

    def settled(column):
        return F.when(F.col(column).isin("pending", "running"), "failed").otherwise(F.col(column))
    open_task = F.col("t.status").isin("pending", "running")
    raw = docs.select("session_id", "current_task_id", F.coalesce("tenant_id", F.lit("")).alias("tenant_id"),
                      F.explode("turns").alias("t"))
    turns = raw.select(
        "session_id", "current_task_id", "tenant_id", "t.task_id", "t.question", settled("t.status").alias("status"),
        "t.intent", F.coalesce("t.aggregated", "t.result").alias("aggregated"), "t.citation_audit",
        F.when(open_task, "进程重启时任务未完成").otherwise(F.col("t.error")).alias("error"), "t.started_at", "t.finished_at")
    subs = raw.select("session_id", "t.task_id", F.explode("t.sub_results").alias("agent", "s"))
    sub_results = subs.select("session_id", "task_id", "agent", settled("s.status").alias("status"), "s.answer", "s.error",
                              "s.started_at", "s.finished_at")
    calls = subs.select("session_id", "task_id", "agent", F.posexplode("s.tool_calls").alias("call_no", "c")).select(
        "session_id", "task_id", "agent", "call_no", "c.*")
    evidence = subs.select("session_id", "task_id", "agent", F.explode("s.evidence").alias("e")).select(
        "session_id", "task_id", "agent", "e.*")
    return turns, sub_results, calls, evidence


SPANS = ("name string, trace_id string, span_id string, parent_id string, start_time bigint, end_time bigint, "
         "duration_ms double, attributes map<string,string>, status string")


def read_spans(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """Spans from a JSON array, a single object or JSON lines; bad lines are skipped.
    ``lines`` None looks at the first text line to tell them apart."""
    if lines is None:
        first = spark.read.text(path).where("trim(value) <> ''").head()
        start = first["value"].strip() if first else ""
        lines = start.startswith("{") and start.endswith("}")
    reader = spark.read.schema(SPANS)
    if lines:
        return reader.option("mode", "DROPMALFORMED").json(path)
    return reader.option("multiLine", True).json(path)


LOG_FIELDS = ("agent", "question", "agents", "score", "status", "elapsed", "token_usage", "audit", "error", "chunks",
              "entities", "relations", "source", "attempt", "kind", "mode")


def read_app_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON log lines with the request columns and the optional fields as text."""
    schema = ", ".join(f"{c} string" for c in ("ts", "level", "logger", "msg", "req", "session", *LOG_FIELDS))
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("ts", F.try_to_timestamp("ts"))


def repair_json_rows(df: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(good, quarantine). Text that parses stays as it is; otherwise raw CR, LF and TAB inside
    string literals are escaped and counted in ``repairs``; what still fails is quarantined."""
    parses = F.try_parse_json(column).isNotNull()
    fixed = df.withColumn("_fix", F.when(parses, F.struct(F.col(column).alias("text"), F.lit(0).alias("repairs")))
                          .otherwise(escape_controls(column)))
    fixed = fixed.withColumn("repairs", F.col("_fix.repairs")).withColumn("_text", F.col("_fix.text")).drop("_fix")
    ok = F.try_parse_json("_text").isNotNull()
    good = fixed.where(ok).withColumn(column, F.col("_text")).drop("_text")
    return good, fixed.where(~ok).drop("_text")
