"""Table layouts and fixed field lists shared by the jobs."""

from pyspark.sql import types as T

# The column and key lists the stored tables must carry, in stored order.
METADATA_COLUMNS = [
    "paper_id", "title", "abstract", "categories", "primary_category", "authors", "published_at",
    "updated_at", "doi", "comment", "journal_ref", "license", "source",
]
METADATA_REQUIRED = [
    "paper_id", "title", "abstract", "categories", "primary_category", "authors", "published_at",
    "updated_at", "source",
]
VECTOR_COLUMNS = ["paper_id", "embedding", "generated_at", "model_dim", "source"]
PREFERENCE_COLUMNS = ["paper_id", "preference", "recorded_at"]
SUMMARY_REQUIRED = ["id", "summary", "summary_time", "migrated_at", "source", "source_file"]
SUMMARY_FIELD_ORDER = [
    "id", "title", "slug", "one_sentence_summary", "problem_background", "method", "experiment",
    "further_thoughts", "reasoning_step", "summary", "abstract", "authors", "institution",
    "categories", "keywords", "preference", "score", "created", "updated", "summary_time",
    "migrated_at", "source", "source_file", "lang", "model", "temperature", "top_p", "year", "date",
    "license", "show",
]
WIDE_REQUIRED = ["id", "title", "abstract", "categories", "authors", "created", "updated"]
RUN_OUTPUT_FILES = ["recommended.parquet", "recommended.jsonl", "predictions.parquet"]


def _strings(names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Ids are always strings: "2301.00001" read as a number would lose its trailing digits.
METADATA = _strings(METADATA_COLUMNS)
PREFERENCES = _strings(PREFERENCE_COLUMNS)
VECTORS = T.StructType(
    [
        T.StructField("paper_id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("generated_at", T.StringType()),
        T.StructField("model_dim", T.IntegerType()),
        T.StructField("source", T.StringType()),
    ]
)

# The stored tables, partition columns included.
METADATA_TABLE = T.StructType([*METADATA.fields, T.StructField("year", T.IntegerType())])
METADATA_RUNS = T.StructType([*METADATA_TABLE.fields, T.StructField("bucket", T.IntegerType())])
VECTOR_TABLE = T.StructType(
    [
        *VECTORS.fields,
        T.StructField("model", T.StringType()),
        T.StructField("year", T.StringType()),
    ]
)

# One harvested record; the XML row tag is `record` and namespaces are ignored.
HARVEST_DDL = (
    "header struct<_status:string, identifier:string>, "
    "metadata struct<arXiv:struct<id:string, title:string, abstract:string, categories:string, "
    "authors:struct<author:array<struct<keyname:string, forenames:string>>>, "
    "created:string, updated:string, doi:string, comments:string, `journal-ref`:string, "
    "license:struct<_VALUE:string, _uri:string>>>"
)

# Reply of a discussion query: threads with their reactions.
THREADS_DDL = (
    "data struct<repository:struct<discussions:struct<nodes:array<struct<id:string, title:string, "
    "updatedAt:string, url:string, number:int, reactions:struct<nodes:array<struct<content:string, "
    "user:struct<login:string>>>>>>>>>"
)
