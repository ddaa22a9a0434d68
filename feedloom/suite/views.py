"""The given tables in the shape the feed jobs expect, once for Spark and once as SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE

FIRST_DAY = "2024-01-01"
NOW_TEXT = "2025-12-31T00:00:00+00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def strip_sql(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def day(c, first: str = FIRST_DAY, span: int = 730):
    """A date text that depends on a number."""
    return F.date_add(F.lit(first).cast("date"), (c % span).cast("int")).cast("string")


def day_sql(c: str, first: str = FIRST_DAY, span: int = 730) -> str:
    return f"CAST(CAST(DATE '{first}' + CAST({c} % {span} AS INTEGER) AS DATE) AS VARCHAR)"


def coded_id(c):
    """An id that carries a year and month: doc/yymm followed by the number."""
    date = day(c)
    return F.concat(F.lit("doc/"), F.substring(date, 3, 2), F.substring(date, 6, 2), c.cast("string"))


def coded_id_sql(c: str) -> str:
    date = day_sql(c)
    return f"'doc/' || substr({date}, 3, 2) || substr({date}, 6, 2) || CAST({c} AS VARCHAR)"


def name_parts(spark: SparkSession, folder: str, target: str, suffix: str) -> None:
    """The part files of a folder, in their order, as files of `target` with another suffix."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = jvm.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(jvm.Path(target))
    for status in files.globStatus(jvm.Path(f"{folder}/part-*")) or []:
        path = status.getPath()
        files.rename(path, jvm.Path(f"{target}/{path.getName().split('.')[0]}{suffix}"))


def name_part(spark: SparkSession, folder: str, path: str) -> None:
    """The only part file of a folder under a name of its own."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = jvm.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(jvm.Path(path).getParent())
    files.rename(files.globStatus(jvm.Path(f"{folder}/part-*"))[0].getPath(), jvm.Path(path))


VIEWS = {}


def view(sql: str):
    def register(fn):
        VIEWS[fn.__name__] = f"{fn.__name__} AS ({sql})"
        return fn

    return register


def with_views(names: str, body: str) -> str:
    """`body` behind the WITH list of the named views; it may go on with ", more AS (..)"."""
    return "WITH " + ",\n".join(VIEWS[n] for n in names.split()) + "\n" + body.lstrip("\n")


@view(f"""
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, split_part(text, chr(10), 1) AS title,
    text AS abstract, source || '; ' || lang AS categories, source AS primary_category,
    '' AS authors, {day_sql('doc_id', '2020-01-01', 1500)} AS published_at,
    {day_sql('doc_id')} AS updated_at FROM documents""")
def papers(spark, folder):
    c = F.col("doc_id")
    return table(spark, folder, "documents").select(
        c.cast("string").alias("paper_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.concat_ws("; ", "source", "lang").alias("categories"),
        F.col("source").alias("primary_category"),
        F.lit("").alias("authors"),
        day(c, "2020-01-01", 1500).alias("published_at"),
        day(c).alias("updated_at"),
    )


@view("SELECT CAST(vec_id AS VARCHAR) AS id, embedding AS vec_a FROM embeddings")
def vec_a(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec_a")
    )


@view("SELECT CAST(vec_id AS VARCHAR) AS id, embedding[1:16] AS vec_b FROM embeddings")
def vec_b(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.slice("embedding", 1, 16).alias("vec_b")
    )


@view("""
  SELECT CAST(vec_id AS VARCHAR) AS id, CASE label
    WHEN 3 THEN list_concat([CAST('nan' AS FLOAT)], embedding[2:])
    WHEN 4 THEN list_concat(embedding[2:], [CAST('-inf' AS FLOAT)])
    WHEN 5 THEN NULL
    WHEN 7 THEN CAST([] AS FLOAT[])
    WHEN 8 THEN list_concat([CAST(NULL AS FLOAT)], embedding[2:])
    WHEN 9 THEN embedding[1:16]
    ELSE embedding END AS vector FROM embeddings""")
def damaged(spark, folder):
    """Vectors with the faults stored data has: non-finite, missing, empty, short."""
    v = F.col("embedding")
    rest = F.slice(v, 2, 63)

    def value(x):
        return F.array(F.lit(x).cast("float"))

    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.when(F.col("label") == 3, F.concat(value(float("nan")), rest))
        .when(F.col("label") == 4, F.concat(rest, value(float("-inf"))))
        .when(F.col("label") == 5, F.lit(None))
        .when(F.col("label") == 7, F.array().cast("array<float>"))
        .when(F.col("label") == 8, F.concat(value(None), rest))
        .when(F.col("label") == 9, F.slice(v, 1, 16))
        .otherwise(v)
        .alias("vector"),
    )


PREFERENCE_SQL = "CASE WHEN toxic = 1 THEN 'dislike' WHEN quality = 1 THEN 'like' ELSE 'neutral' END"


def preference_of(toxic="toxic", quality="quality"):
    return (
        F.when(F.col(toxic) == 1, "dislike").when(F.col(quality) == 1, "like").otherwise("neutral")
    )


@view(f"""
  SELECT CAST(doc_id AS VARCHAR) AS id, {PREFERENCE_SQL} AS preference,
    {day_sql('doc_id', '2024-06-01', 100)} AS recorded_at FROM labels""")
def prefs(spark, folder):
    return table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("id"),
        preference_of().alias("preference"),
        day(F.col("doc_id"), "2024-06-01", 100).alias("recorded_at"),
    )


@view("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id FROM conversations")
def done(spark, folder):
    """Ids that already have a summary."""
    return (
        table(spark, folder, "conversations").select(F.col("conv_id").cast("string").alias("id"))
    ).distinct()


@view("""
  SELECT CAST(o_custkey AS VARCHAR) AS paper_id, o_orderpriority AS title,
    o_orderstatus AS abstract, strftime(o_orderdate, '%Y') || '-01-01' AS published_at,
    strftime(o_orderdate, '%Y-%m-%d') AS updated_at, o_orderkey AS seq,
    CAST(strftime(o_orderdate, '%Y') AS INTEGER) AS year FROM orders""")
def versions(spark, folder):
    """Many versions per id: the orders of a customer."""
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("paper_id"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("abstract"),
        F.concat(F.substring(date, 1, 4), F.lit("-01-01")).alias("published_at"),
        date.alias("updated_at"),
        F.col("o_orderkey").alias("seq"),
        F.substring(date, 1, 4).cast("int").alias("year"),
    )


@view("""
  SELECT user_id AS thread, event_id AS seq, ts AS updated_at, CASE event_type
    WHEN 'click' THEN 'THUMBS_UP' WHEN 'error' THEN 'THUMBS_DOWN' ELSE 'EYES' END AS content
  FROM events""")
def reactions(spark, folder):
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("thread"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("updated_at"),
        F.when(kind == "click", "THUMBS_UP")
        .when(kind == "error", "THUMBS_DOWN")
        .otherwise("EYES")
        .alias("content"),
    )


@view("""
  SELECT event_type AS job,
    CASE event_id % 10 WHEN 0 THEN 'failure' WHEN 1 THEN 'dry_run' ELSE 'success' END AS status,
    CASE event_id % 10 WHEN 0 THEN 'event ' || CAST(event_id AS VARCHAR) END AS error,
    ts AS start_time, ts AS end_time, value AS duration, event_id AS seq FROM events""")
def job_runs(spark, folder):
    part = F.col("event_id") % 10
    return table(spark, folder, "events").select(
        F.col("event_type").alias("job"),
        F.when(part == 0, "failure").when(part == 1, "dry_run").otherwise("success").alias("status"),
        F.when(part == 0, F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("error"),
        F.col("ts").alias("start_time"),
        F.col("ts").alias("end_time"),
        F.col("value").alias("duration"),
        F.col("event_id").alias("seq"),
    )


@view("""
  SELECT CASE WHEN o_orderkey % 89 = 0 THEN '  ' ELSE ' ' || CAST(o_custkey AS VARCHAR) END AS paper_id,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'like' WHEN '5' THEN ' dislike ' ELSE 'neutral' END
      AS preference,
    CASE o_orderkey % 97 WHEN 0 THEN 'init' WHEN 1 THEN 'latest' ELSE strftime(o_orderdate, '%Y-%m') END
      AS month FROM orders""")
def preference_months(spark, folder):
    """Monthly preference rows, some blank, some under a label that is not a month."""
    key, level = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    return table(spark, folder, "orders").select(
        F.when(key % 89 == 0, F.lit("  "))
        .otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
        .alias("paper_id"),
        F.when(level == "1", "like").when(level == "5", " dislike ").otherwise("neutral").alias(
            "preference"
        ),
        F.when(key % 97 == 0, "init")
        .when(key % 97 == 1, "latest")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM"))
        .alias("month"),
    )


@view("""
  SELECT o_orderkey, CASE o_orderkey % 4
    WHEN 0 THEN strftime(o_orderdate, '%y%m') || '.' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0')
    WHEN 1 THEN ' ' || strftime(o_orderdate, '%y%m') || '.' ||
      lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || 'v2 '
    WHEN 2 THEN 'hep-th/' || strftime(o_orderdate, '%y%m') || '012'
    ELSE 'order-' || CAST(o_orderkey AS VARCHAR) END AS paper_id FROM orders""")
def paper_ids(spark, folder):
    """Ids of both formats, and some of neither."""
    key, month = F.col("o_orderkey"), F.date_format("o_orderdate", "yyMM")

    def padded(width: int):
        return F.lpad((key % 10**width).cast("string"), width, "0")

    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(key % 4 == 0, F.concat_ws(".", month, padded(5)))
        .when(key % 4 == 1, F.concat(F.lit(" "), month, F.lit("."), padded(4), F.lit("v2 ")))
        .when(key % 4 == 2, F.concat(F.lit("hep-th/"), month, F.lit("012")))
        .otherwise(F.concat(F.lit("order-"), key.cast("string")))
        .alias("paper_id"),
    )


def json_escape(c):
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


JSON_TEXT_SQL = (
    "replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), "
    "chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r')"
)


@view(f"""
  SELECT conv_id, turn, role, text, CASE turn % 4
    WHEN 0 THEN '{{"highlights": [" first point ", "", "second point"], "summary": "' || {JSON_TEXT_SQL} || '"}}'
    WHEN 1 THEN '{{"highlights": "one\\n\\n two ", "content": "' || {JSON_TEXT_SQL} || '"}}'
    WHEN 2 THEN text
    ELSE '{{"summary": "", "detailed_summary": "' || {JSON_TEXT_SQL} || '"}}' END AS output
  FROM conversations""")
def model_outputs(spark, folder):
    """Model output of every shape: list, text, none, and text that is not JSON."""
    text = json_escape(F.col("text"))

    def wrapped(before: str):
        return F.concat(F.lit(before), text, F.lit('"}'))

    kind = F.col("turn") % 4
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(kind == 0, wrapped('{"highlights": [" first point ", "", "second point"], "summary": "'))
        .when(kind == 1, wrapped('{"highlights": "one\\n\\n two ", "content": "'))
        .when(kind == 2, F.col("text"))
        .otherwise(wrapped('{"summary": "", "detailed_summary": "'))
        .alias("output"),
    )
