"""What the operators share: row keys and slices of Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import scratch_path

#: Bytes of text that a task works on at once; batches from Spark are cut to this size.
SLICE_BYTES = 1 << 20
#: Rows that Spark hands to Python at once; its own 10,000 whole texts take memory on both sides of each task.
BATCH_ROWS = 2000


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, text): the columns an operator reads, a null text as an empty one.

    `uid` tells rows of one doc_id with different texts apart. Rows repeated whole share it, and so share what is found.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text"
    )


def with_row_key(docs: DataFrame, into: str) -> DataFrame:
    """`docs` with the string column `into`, equal in rows of equal ids and texts only; a null text counts as an empty one.

    Unlike an id it is never null, so decisions about single rows can be joined back on it.
    """
    doc = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))
    text = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    return docs.withColumn(into, F.concat_ws(":", doc, text))


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, or one made from it that is no column of `docs`; Spark takes large and small letters for the same."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone, else they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands at most BATCH_ROWS rows to Python at once; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written to the shared folder and read back, and the path, for tables that are let go of by `forget`."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of `stored` once what was made from it is stored itself and nothing reads it again."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the `text` column of each piece has about `limit` bytes, one row at least."""
    for batch in batches:
        sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(batch.schema.get_field_index("text"))]
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
