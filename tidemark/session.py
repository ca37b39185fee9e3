"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g",
                  app: str = "tidemark") -> SparkSession:
    """A session for tests and the bench; on a cluster, pass in the one that is there."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # 4.1's partition-aware union can hand a join sides with unequal partition counts
        .config("spark.sql.unionOutputPartitioning", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: bytes of a stored table for which there is one shuffle partition at least, and bytes of a shuffle that one task reads
BYTES_PER_PARTITION, BYTES_PER_TASK = 1 << 20, 4 << 20
#: bytes of stored files that one task reads: partial aggregates hold what they find there unpacked
BYTES_PER_SCAN = 32 << 20


def partition_for(spark: SparkSession, path: str) -> None:
    """Let shuffles start from as many partitions as the table at ``path`` needs, so that a task's memory doesn't grow with
    the table; adaptive execution puts small ones together, up to ``BYTES_PER_TASK``, a fraction of its default: joins and
    sorts hold rows unpacked and several times over. Nothing is lowered that another table or the session asked for."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    wanted = max(size // BYTES_PER_PARTITION, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set(first, str(max(wanted, int(spark.conf.get(first, None) or 0))))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(BYTES_PER_TASK))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(BYTES_PER_SCAN))


#: folders of local sessions that name none, by application
_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, below the one that ``spark.checkpoint.dir`` names and all
    executors share. Where the session runs in one process and names none, below its warehouse; that folder is removed
    when the process ends."""
    application = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None) or _own.get(application)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        # the setting can't be changed in a running session, so the folder is remembered here
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{uuid.uuid4().hex}"
        _own[application] = shared
        atexit.register(shutil.rmtree, urlparse(shared).path, ignore_errors=True)
    return f"{shared.rstrip('/')}/{application}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application: results that still read them can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in this application's folder."""
    return f"{scratch_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back. Texts take less room with ``compression`` zstd than
    with the session's codec.

    Cuts the lineage, survives lost executors, and later readers get column pruning."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
