"""Writers. One guard decides whether anything is written at all."""

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.dedup import keep_first
from .readers import read_if_present


# Text is stored as it is: nothing trimmed, quotes doubled, empty text not marked.
CSV_WRITE_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
# Short pages, as a row holds a whole vector, and a Bloom filter of the ids in each row group.
LOOKUP_OPTIONS = {"parquet.page.row.count.limit": "256", "parquet.bloom.filter.enabled#paper_id": "true"}


def path_exists(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def is_folder(spark, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def partitions(spark: SparkSession, path: str, depth: int) -> list[str]:
    """Partition folders below `path`, as paths relative to it; one for each partition value."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not depth:
        return [""]
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/" + "/".join(["*=*"] * depth))
    found = [str(s.getPath().toString()) for s in files.globStatus(pattern) or [] if s.isDirectory()]
    return sorted("/".join(name.rsplit("/", depth)[1:]) for name in found)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    overwrite: bool = False,
    dry_run: bool = False,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    **options,
) -> None:
    """Write `df`, skip if the target exists unless `overwrite`, or only plan it on `dry_run`.

    Overwriting a partitioned table replaces just the partitions that occur in `df`; without it the
    partitions that the table has stay as they are and the others are added.
    """
    if dry_run:
        return
    mode = "overwrite" if overwrite else "ignore"
    if partition_by and not overwrite and path_exists(df.sparkSession, path):
        # Folder names as they are: reading the table would take a partition "01" for the number 1.
        names = partitions(df.sparkSession, path, len(partition_by))
        values = [[unquote(part.split("=", 1)[1]) for part in name.split("/")] for name in names]
        values = [[None if v == NO_VALUE else v for v in row] for row in values]
        stored = df.sparkSession.createDataFrame(values, T.StructType([T.StructField(c, T.StringType()) for c in partition_by]))
        same = [df[c].cast("string").eqNullSafe(stored[c]) for c in partition_by]
        df, mode = df.join(stored, same, "left_anti"), "append"
    if partition_by:
        # Files per partition follow the data: AQE splits a large partition value over several
        # tasks and joins small ones, so one huge year is not one task.
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    defaults = CSV_WRITE_OPTIONS if fmt == "csv" else {}
    writer.options(**{**defaults, **options}).save(path)


def write_metadata(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the publication years that occur in `df` (it needs a `year` column)."""
    write_table(df, path, fmt=fmt, overwrite=True, partition_by=["year"], sort_by=["paper_id"])


def write_vectors(
    df: DataFrame,
    path: str,
    overwrite: bool = False,
    allow_truncate: bool = False,
    limited: bool = False,
    models: Sequence[str] | None = None,
    only_new: bool = False,
) -> None:
    """Store new vectors by (model, year) as zstd parquet; stored vectors win unless `overwrite`.

    Without `overwrite` only the ids of the stored table are read and only vectors it lacks are
    appended; the stored vectors are neither read nor rewritten. With `overwrite` the touched years
    are replaced as a whole, which loses rows when `df` is only a part of them, so a limited input
    needs `allow_truncate`. `models` names the models in `df`, if known, to read only their ids. `only_new` says that `df`
    has no stored id and no id twice, as the inputs of a model that were held against the table before it ran.

    Files are sorted by id and carry Bloom filters of the ids, for `lookup_listed`.
    """
    spark = df.sparkSession
    keys = ["model", "year", "paper_id"]
    fresh = df.withColumn("year", F.col("year").cast("string"))
    if not only_new:
        # A vector is no ordering key: equal times and sources are told apart by its hash.
        fresh = fresh.withColumn("_tie", F.xxhash64("embedding"))
        fresh = keep_first(fresh, keys, ["generated_at", "source", "_tie"]).drop("_tie")
    if overwrite:
        if limited and not allow_truncate:
            raise ValueError("overwriting years with a limited input drops vectors: allow_truncate")
        mode = "overwrite"
    else:
        mode = "append"
        stored = None if only_new else read_if_present(spark, path, schemas.VECTOR_TABLE)
        if stored is not None:
            if models is not None:
                stored = stored.where(F.col("model").isin(list(models)))
            fresh = fresh.join(stored.select(*keys).distinct(), keys, "left_anti")
    columns = schemas.VECTOR_COLUMNS
    (
        fresh.select("model", "year", *columns)
        .hint("rebalance", F.col("model"), F.col("year"))
        .sortWithinPartitions(*keys)
        .write.mode(mode)
        .partitionBy("model", "year")
        .option("partitionOverwriteMode", "dynamic")
        .options(**LOOKUP_OPTIONS)
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", "5")
        .parquet(path)
    )


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> None:
    """Save a table with one row per `key` as a catalog table bucketed and sorted by it.

    Deduplication by the key and joins of tables with the same buckets then need no shuffle, and a
    lookup of a few keys reads only their buckets and pages. Worth it for vector tables, which are
    wide and joined in every run. Pages are kept short, as a row holds a whole vector.
    """
    (
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .options(**{**LOOKUP_OPTIONS, f"parquet.bloom.filter.enabled#{key}": "true"})
        .saveAsTable(table)
    )


def write_run(scored: DataFrame, recommended: DataFrame, root: str, run_id: str) -> None:
    """The two outputs of a ranking run below its run id."""
    write_table(scored, f"{root}/run_id={run_id}/predictions.parquet", overwrite=True)
    write_table(recommended, f"{root}/run_id={run_id}/recommended.parquet", overwrite=True)


def append_summaries(df: DataFrame, path: str) -> None:
    """Append summary records as JSON lines below their month."""
    df.write.mode("append").partitionBy("month").json(path)
