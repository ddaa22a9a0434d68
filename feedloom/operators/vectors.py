"""Upkeep of vector tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import keep_first


def length_histogram(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows by vector length."""
    return df.groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("rows"))


def dominant_dim(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The most frequent vector length, as one row; the longer one on a tie."""
    return length_histogram(df, vector).orderBy(F.desc("rows"), F.desc("dim")).limit(1)


def clean_vectors(df: DataFrame, dim: int | None = None, vector: str = "embedding") -> DataFrame:
    """Only the vectors of one length: the given one, else the most frequent.

    The length is one number, so the histogram is worked out first and the filter is a constant.
    """
    if dim is None:
        top = dominant_dim(df, vector).collect()
        if not top:
            return df
        dim = top[0]["dim"]
    return df.where(F.size(vector) == dim)


def vector_manifest(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows and vector length per (model, year), and per model in total."""
    per_year = df.groupBy("model", F.col("year").cast("string").alias("year")).agg(
        F.count("*").alias("rows"), F.max(F.size(vector)).alias("dimension")
    )
    totals = per_year.groupBy("model").agg(
        F.sum("rows").alias("rows"), F.max("dimension").alias("dimension")
    )
    return per_year.unionByName(totals.select("model", F.lit("total").alias("year"), "rows", "dimension"))


def merge_vectors(existing: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """Stored and new vectors, one per (year, id).

    Stored ones win. With `overwrite`, every year that has new vectors keeps only those.
    """
    order = ["generated_at", "source", "embedding"]
    fresh = keep_first(new, ["year", "paper_id"], order)
    if overwrite:
        years = new.select("year").distinct()
        return existing.join(years, "year", "left_anti").unionByName(fresh)
    both = existing.withColumn("_origin", F.lit(0)).unionByName(fresh.withColumn("_origin", F.lit(1)))
    return keep_first(both, ["year", "paper_id"], ["_origin", *order]).drop("_origin")

