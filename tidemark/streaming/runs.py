"""Run a streaming DataFrame over the data that is there and give its result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch_dir


def replay(df: DataFrame, order: Column, slices: int = 4, files: int | None = None) -> DataFrame:
    """A stream of ``df`` that arrives in ``slices`` batches, cut by ranges of ``order``, each of
    ``files`` files; a slice needs at least that many rows to be a batch of its own."""
    spark = df.sparkSession
    folder = f"{scratch_dir(spark)}/tidemark/replay-{uuid.uuid4().hex}"
    low, high = df.agg(F.min(order).cast("double"), F.max(order).cast("double")).head()
    width = max((high - low + 1) / slices, 1.0)
    part = F.least(F.floor((order.cast("double") - low) / width), F.lit(slices - 1))
    # the trigger counts files and takes them in the order they were written
    files = files or spark.sparkContext.defaultParallelism
    for number in range(slices):
        df.where(part == number).repartition(files).write.parquet(f"{folder}/slice={number}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/slice=*")


#: rows that go to a Python worker, and back, in one batch: most are a key's own there, with a frame for each key
RESULT_ROWS = 500


def finish(stream: DataFrame, mode: str) -> DataFrame:
    """Rows of all batches with their ``batch`` number, written batch by batch."""
    spark = stream.sparkSession
    folder = f"{scratch_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"

    def step(batch: DataFrame, number: int) -> None:
        # overwriting the batch's own folder makes a repeated batch harmless
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
    # state is kept per shuffle partition: one per core, whatever the session says for batch work
    settings = {"spark.sql.shuffle.partitions": spark.sparkContext.defaultParallelism,
                "spark.sql.execution.arrow.maxRecordsPerBatch": RESULT_ROWS}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, str(value))
    try:
        query = (stream.writeStream.foreachBatch(step).outputMode(mode)
                 .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.parquet(f"{folder}/rows")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The row of the last batch per key."""
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(key, "_r.*")
