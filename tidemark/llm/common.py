"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = 2_000


def bounded_batches(spark: SparkSession) -> None:
    """Documents can be long: let the session hand Python workers at most ``BATCH_ROWS`` of them at once."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def per_text(rows: DataFrame, id_col: str, text_col: str, fields: str,
             make: Callable[[list], list[pa.Array]]) -> DataFrame:
    """One output row per input row, in Arrow batches and without a shuffle: the id as it came
    (any type, null allowed) and the columns ``fields`` (DDL) that ``make`` returns for the batch's texts."""
    id_field = rows.schema[id_col]
    schema = T.StructType([T.StructField("doc_id", id_field.dataType)] + T.StructType.fromDDL(fields).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = make(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    bounded_batches(rows.sparkSession)
    return rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, limit: int, id_col: str = "doc_id",
                    text_col: str = "text", keep=None) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled ids, chosen by a hash of the id.

    ``keep`` is a condition on ``doc_id``. Null ids and labels are left out; an id labelled twice
    counts with its larger label. The ids (a bounded table) travel to the texts, not the texts to the labels."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    if keep is not None:
        known = known.where(keep)
    chosen = (known.groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
