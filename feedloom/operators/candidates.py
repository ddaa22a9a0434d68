"""Candidate selection: joins, set membership and filters."""

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import iso_year
from ..functions.vectors import has_any, is_valid_vector
from .dedup import keep_first, keep_latest_any


def drop_blank_ids(df: DataFrame, key: str = "paper_id") -> DataFrame:
    return df.where(F.length(key) > 0)


def filter_categories(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Rows with any of the wanted categories; no wanted categories means no filter."""
    return df.where(has_any(F.col("categories"), categories)) if categories else df


def filter_valid_vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose vector columns are all present and finite."""
    return reduce(lambda rows, c: rows.where(is_valid_vector(F.col(c))), columns, df)


def filter_year(df: DataFrame, start_year: int | None) -> DataFrame:
    """Rows updated in or after a year; undated rows go."""
    return df if start_year is None else df.where(iso_year(F.col("updated")) >= start_year)


def filter_date_window(
    df: DataFrame,
    start: str | None,
    end: str | None,
    last_n_days: int,
    now: datetime,
) -> DataFrame:
    """Rows between two dates, or of the last days before `now` unless both dates are given.

    Dates are compared as text: '2025-01-31T10:00' lies after '2025-01-31'.
    """
    updated = F.col("updated")
    if start and end:
        return df.where((updated >= start) & (updated <= end))
    return df.where(updated >= (now - timedelta(days=last_n_days)).strftime("%Y-%m-%d"))


def join_vectors(
    meta: DataFrame, vectors: Mapping[str, DataFrame], unique_meta: bool = False
) -> DataFrame:
    """Metadata with the vector of every model, for the ids that have them all.

    Every input is reduced to one row per id before it is joined, so equal ids cannot multiply, and
    the rows kept that way are already partitioned by id: each input is shuffled once for its
    deduplication and join together, and not at all if it is a table bucketed by id. Put filters on
    metadata before this join; `unique_meta` says that it has one row per id already.
    """
    rows = meta.where(F.col("id").isNotNull())
    if not unique_meta:
        rows = keep_latest_any(rows, "id", ["updated"])
    for alias, table in vectors.items():
        rows = rows.join(keep_latest_any(table, "id"), "id")
    return rows


def label_candidates(candidates: DataFrame, preferences: DataFrame) -> DataFrame:
    """Candidates with their preference ('unrated' without one) and a `rated` flag.

    One left join serves both sides of the split, so the wide rows are joined once, not twice.
    """
    rated = keep_latest_any(
        preferences.select("id", "preference", "recorded_at"), "id", ["recorded_at", "preference"]
    ).select("id", "preference", F.lit(True).alias("rated"))
    return (
        candidates.where(F.col("id").isNotNull())
        .join(rated, "id", "left")
        .withColumn("rated", F.coalesce("rated", F.lit(False)))
        .withColumn(
            "preference", F.when(F.col("rated"), F.col("preference")).otherwise(F.lit("unrated"))
        )
    )


def split_candidates(candidates: DataFrame, preferences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(preferred, background): the candidates with and without a preference."""
    labelled = label_candidates(candidates, preferences)
    return labelled.where("rated").drop("rated"), labelled.where("NOT rated").drop("rated")


def drop_known(df: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id does not occur in `known`; rows without an id go."""
    return df.where(F.col(key).isNotNull()).join(id_set(known, key), key, "left_anti")


def id_set(df: DataFrame, *keys: str) -> DataFrame:
    """The distinct ids of a table, for a membership join.

    Spark cannot split a skewed key on this side of such a join; distinct ids have none. Copies are
    dropped in the map tasks.
    """
    return df.select(*keys).distinct()


def embedding_backlog(inputs: DataFrame, existing: DataFrame) -> DataFrame:
    """Inputs that have no stored vector for their (year, id), one per id: of the first year, with the first text.

    What is missing is found on ids and years alone, each pair once, so a much copied id is one row of that join. Texts are
    shuffled once, for the ids that are missing.
    """
    rows = drop_blank_ids(inputs)
    missing = id_set(rows, "paper_id", "year").join(id_set(existing, "year", "paper_id"), ["year", "paper_id"], "left_anti")
    first = missing.groupBy("paper_id").agg(F.min("year").alias("_first"))
    # Joined on the id alone, which is also what the rows are ranked by: one shuffle of the texts serves both.
    wanted = rows.join(first, "paper_id").where(F.col("year") == F.col("_first")).drop("_first")
    return keep_first(wanted, "paper_id", ["text"])


def lookup_by_id(vectors: DataFrame, ids: DataFrame, key: str = "paper_id") -> DataFrame:
    """The rows of `vectors` whose id is in the table `ids`, by one semi-join whatever the number of ids."""
    return vectors.join(id_set(ids, key), key, "left_semi")


def lookup_listed(vectors: DataFrame, ids: Sequence[str], key: str = "paper_id") -> DataFrame:
    """The rows of `vectors` whose id is in a list that the caller holds.

    The ids become a filter of the scan. In files sorted by id with Bloom filters, as `write_vectors` and `save_bucketed` leave
    them, Spark then opens only row groups and pages that may hold one, and of a bucketed table only their buckets.
    """
    return vectors.where(F.col(key).isin(sorted({value for value in ids if value is not None})))


def limit_ordered(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first `n` rows by `keys`."""
    return df.orderBy(*keys).limit(n)
