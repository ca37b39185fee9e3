"""Tables of one folder that change together: written aside, then published by one new manifest.

``{path}/data/{table}/{commit}`` holds what a commit adds to a table, ``{path}/manifests/{version}.json`` names the commits
that count. A version is published by renaming a finished file to a name that doesn't exist yet, so a job that dies before
leaves files that nobody reads, and of two writers that started from the same version one fails and has to begin again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has published this version."""


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return hadoop, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> tuple[int, dict[str, dict]]:
    """The newest version (0: none) and per table its schema and commits."""
    hadoop, where, fs = _files(spark, f"{path}/manifests")
    if not fs.exists(where):
        return 0, {}
    names = [status.getPath().getName() for status in fs.listStatus(where)]
    versions = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())
    if not versions:
        return 0, {}
    stream = fs.open(hadoop.Path(f"{path}/manifests/{versions[-1]:012d}.json"))
    try:
        return versions[-1], json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def commits(spark: SparkSession, path: str, table: str) -> list[str]:
    """The commits that the newest manifest counts as the table."""
    return current(spark, path)[1].get(table, {}).get("commits", [])


def read(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """What the newest manifest counts as the table; without any commit, no rows of ``schema``."""
    known = current(spark, path)[1].get(table)
    if not known:
        return spark.createDataFrame([], schema)
    root = f"{path}/data/{table}"
    return (spark.read.schema(StructType.fromJson(known["schema"])).option("basePath", root)
            .parquet(*[f"{root}/commit={c}" for c in known["commits"]]).drop("commit"))


def stage(rows: DataFrame, path: str, table: str, partition_by: str | None = None) -> dict:
    """Write rows aside; returns what ``publish`` needs to make them count."""
    commit = uuid.uuid4().hex
    writer = rows.write
    if partition_by:
        writer = writer.partitionBy(partition_by).option("compression", "zstd")
    writer.parquet(f"{path}/data/{table}/commit={commit}")
    return {"commit": commit, "schema": rows.schema.jsonValue()}


def publish(spark: SparkSession, path: str, base: int, added: dict[str, dict]) -> int:
    """Make staged commits count, all at once, on top of version ``base``; raises ``Conflict`` if that isn't the newest."""
    version, tables = current(spark, path)
    if version != base:
        raise Conflict(f"{path} is at version {version}, not {base}")
    for table, new in added.items():
        known = tables.setdefault(table, {"schema": {"type": "struct", "fields": []}, "commits": []})
        names = {f["name"] for f in known["schema"]["fields"]}
        known["schema"]["fields"] += [f for f in new["schema"]["fields"] if f["name"] not in names]
        known["commits"].append(new["commit"])
    hadoop, where, fs = _files(spark, f"{path}/manifests")
    fs.mkdirs(where)
    aside = hadoop.Path(f"{path}/manifests/_{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(json.dumps(tables).encode()))
    finally:
        stream.close()
    gateway = spark.sparkContext._gateway
    options = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").NONE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(aside, hadoop.Path(f"{path}/manifests/{base + 1:012d}.json"), options)
    except Exception as error:
        fs.delete(aside, False)
        if "AlreadyExists" in str(error):
            raise Conflict(f"{path} got version {base + 1} from another writer") from error
        raise
    return base + 1
