"""Schema alignment, unions and wide/long reshaping."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.ids import iso_year, label_year, month_start, year_from_id, year_from_path
from ..functions.text import embedding_text, first_item, join_list, strip


def normalise_schema(df: DataFrame, columns: Sequence[str] = schemas.METADATA_COLUMNS) -> DataFrame:
    """The given columns as text in the given order; a column `df` lacks becomes ''."""
    have = set(df.columns)
    return df.select(
        *[(F.col(c).cast("string") if c in have else F.lit("")).alias(c) for c in columns]
    )


def union_all(*frames: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """All rows of all frames, each first cast to `schema` (the first frame's by default)."""
    target = schema or frames[0].schema
    cast = [
        f.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in target.fields])
        for f in frames
    ]
    return reduce(DataFrame.unionByName, cast)


def align_union(
    existing: DataFrame, new: DataFrame, defaults: Mapping[str, Column]
) -> DataFrame:
    """Union of frames with different columns; a whole missing column takes its default, else null.

    Nulls in a column that a frame does have are left alone.
    """
    names = list(dict.fromkeys([*existing.columns, *new.columns]))

    def aligned(df: DataFrame) -> DataFrame:
        gaps = {n: defaults[n] for n in names if n not in df.columns and n in defaults}
        return df.withColumns(gaps) if gaps else df

    return aligned(existing).unionByName(aligned(new), allowMissingColumns=True).select(*names)


def embedding_inputs(meta: DataFrame, path: Column | None = None, strict: bool = True) -> DataFrame:
    """(paper_id, text, year) to embed; the year comes from the id, else from the file path.

    Rows whose year cannot be told fail the query, naming the id, or have a null year if not `strict`.
    """
    year = year_from_id(F.col("paper_id"))
    if path is not None:
        year = F.coalesce(year, year_from_path(path))
    if strict:
        message = F.concat(F.lit("no publication year for paper_id "), F.col("paper_id"))
        year = F.coalesce(year, F.raise_error(message).cast("string"))
    return meta.where(F.length("paper_id") > 0).select(
        "paper_id", embedding_text(F.col("title"), F.col("abstract")).alias("text"), year.alias("year")
    )


def split_by_year(df: DataFrame, date: str = "published_at") -> tuple[DataFrame, DataFrame]:
    """(accepted with `year`, rejected): rows with and without a readable publication year."""
    dated = df.withColumn("year", iso_year(F.col(date)))
    return dated.where(F.col("year").isNotNull()), dated.where(F.col("year").isNull()).drop("year")


def reshape_metadata(df: DataFrame, source: str = "legacy_migration") -> DataFrame:
    """A wide record as canonical metadata."""
    have = set(df.columns)

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in have else F.lit("")

    def listed(name: str, render) -> Column:
        return render(F.col(name)) if name in have else F.lit("")

    return df.select(
        F.col("id").cast("string").alias("paper_id"),
        text("title").alias("title"),
        text("abstract").alias("abstract"),
        listed("categories", join_list).alias("categories"),
        listed("categories", first_item).alias("primary_category"),
        listed("authors", join_list).alias("authors"),
        text("created").alias("published_at"),
        text("updated").alias("updated_at"),
        text("doi").alias("doi"),
        text("comment").alias("comment"),
        text("journal_ref").alias("journal_ref"),
        text("license").alias("license"),
        F.lit(source).alias("source"),
        *(["year"] if "year" in have else []),
    )


def missing_wide_columns(df: DataFrame) -> list[str]:
    """Columns a wide record should have and does not."""
    return sorted(set(schemas.WIDE_REQUIRED) - set(df.columns))


def detect_vector_columns(df: DataFrame) -> list[str]:
    """Names of all columns that are lists of numbers."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType)
    ]


def unpivot_vectors(
    df: DataFrame, models: Sequence[str] | None = None, source: str = "hf:unknown"
) -> DataFrame:
    """One row per (model, id) from one vector column per model.

    Models without such a column are left out; see `missing_models`.
    """
    found = detect_vector_columns(df)
    wanted = [m for m in dict.fromkeys(models or found) if m in found]
    pairs = [
        F.struct(F.lit(m).alias("model"), F.col(m).cast("array<float>").alias("embedding"))
        for m in wanted
    ]
    each = F.array(*pairs).cast("array<struct<model:string,embedding:array<float>>>")
    return df.select(
        F.col("id").cast("string").alias("paper_id"),
        F.col("updated").alias("generated_at"),
        *(["year"] if "year" in df.columns else []),
        F.inline(each),
    ).select(
        "model",
        *(["year"] if "year" in df.columns else []),
        "paper_id",
        "embedding",
        "generated_at",
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("model_dim"),
        F.lit(source).alias("source"),
    )


def missing_models(df: DataFrame, models: Sequence[str]) -> list[str]:
    """Requested models that have no vector column."""
    found = detect_vector_columns(df)
    return [m for m in dict.fromkeys(models) if m not in found]


def preference_events(df: DataFrame, generated_at: str) -> DataFrame:
    """Events from monthly preference rows: stripped, blank ones left out, dated by their month."""
    return (
        df.withColumn("paper_id", strip(F.col("paper_id")))
        .withColumn("preference", strip(F.col("preference")))
        .where((F.length("paper_id") > 0) & (F.length("preference") > 0))
        .select(
            "paper_id",
            "preference",
            month_start(F.col("month"), F.lit(generated_at)).alias("recorded_at"),
            F.col("month").alias("source_month"),
            label_year(F.col("month")).alias("year"),
        )
    )

