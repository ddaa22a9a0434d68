"""One row per key.

All of these rank rows within their key and keep the first. Spark prunes such a ranking to one row
per key inside each map task (WindowGroupLimit), so a key that holds a third of the table sends one
row per task to the shuffle, not a third of the table.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank


def _keep_one(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def _names(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def keep_first(df: DataFrame, key, order: Sequence[str]) -> DataFrame:
    """The row that comes first by `order` for each key."""
    return _keep_one(df, _names(key), [F.col(c).asc_nulls_first() for c in order])


def keep_last(df: DataFrame, key, order: Sequence[str]) -> DataFrame:
    """The row that comes last by `order` for each key."""
    return _keep_one(df, _names(key), [F.col(c).desc_nulls_last() for c in order])


def keep_latest_any(df: DataFrame, key, order: Sequence[str] = ()) -> DataFrame:
    """Keep-any deduplication with a fixed choice: the greatest by `order`, then by a hash of the other columns.

    A free choice would differ between runs and after a retry. The hash has 128 bits, so neither texts nor vectors are
    ordering keys; rows that are equal in it are equal.
    """
    keys = _names(key)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys and c not in order]
    ties = {f"_tie_{i}": F.xxhash64(F.lit(i), *rest) for i in range(2)}
    return keep_last(df.withColumns(ties), keys, [*order, *ties]).drop(*ties)


def upsert_latest(
    df: DataFrame,
    scope: str = "year",
    key: str = "paper_id",
    version: str = "updated_at",
    tie: Sequence[str] = (),
    year: str = "year",
) -> DataFrame:
    """Latest version per id: within a publication year, or over all of them (`global`).

    `tie` decides between equal versions, such as the batch a row came with.
    """
    if scope not in ("year", "global"):
        raise ValueError("scope is 'year' or 'global'")
    keys = [year, key] if scope == "year" else [key]
    return keep_last(df, keys, [version, *tie])


def latest_snapshot(df: DataFrame, key: str = "paper_id", year: str = "year") -> DataFrame:
    """One row per id over all years; the last year loaded wins."""
    return keep_last(df, key, [year, "updated_at", "title"])


def order_metadata(df: DataFrame) -> DataFrame:
    """Newest publication first, then by id; a missing date sorts as the empty text."""
    return df.orderBy(blank(F.col("published_at")).desc(), F.col("paper_id").asc())


def duplicate_report(df: DataFrame, key: str = "paper_id", year: str = "year") -> DataFrame:
    """Rows, distinct ids and surplus rows per year, and over all years (`total`).

    Ids are counted per (year, id) first, so a large year is spread over many tasks.
    """
    per_id = df.groupBy(year, key).agg(F.count("*").alias("n"))
    per_year = per_id.groupBy(F.col(year).cast("string").alias("year")).agg(
        F.sum("n").alias("rows"), F.count("*").alias("unique_ids")
    )
    return with_total(per_year, ["year"], ["rows", "unique_ids"]).withColumn(
        "removed", F.col("rows") - F.col("unique_ids")
    )


def with_total(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add a row of sums over the last key, labelled `total`. `df` is already aggregated."""
    *outer, last = keys
    totals = df.groupBy(*outer).agg(*[F.sum(c).alias(c) for c in sums])
    return df.select(*keys, *sums).unionByName(
        totals.select(*outer, F.lit("total").alias(last), *sums)
    )
