"""Column functions over whole tables."""

from pyspark.sql import functions as F

from ..functions.ids import (
    category_setspec, extract_id, iso_year, month_bucket, month_order, year_from_id, year_from_path,
)
from ..functions.text import first_item, first_sentences, join_list, split_list
from ..operators.reshape import embedding_inputs, split_by_year
from .registry import query
from .views import (
    coded_id, coded_id_sql, paper_ids, papers, preference_months, strip_sql, table, with_views,
)


@query(f"""
SELECT doc_id, len(parts) AS n_parts, parts[1] AS first_part, array_to_string(parts, '|') AS parts
FROM (SELECT doc_id, list_transform(string_split(text, ';'), lambda x: {strip_sql('x')}) AS parts
  FROM (SELECT doc_id, source || ' ; ' || lang || chr(9) || ';' || text AS text FROM documents))""")
def split_categories(spark, folder):
    text = F.concat(F.col("source"), F.lit(" ; "), F.col("lang"), F.lit("\t;"), F.col("text"))
    parts = split_list(text)
    return table(spark, folder, "documents").select(
        "doc_id",
        F.size(parts).cast("long").alias("n_parts"),
        F.get(parts, F.lit(0)).alias("first_part"),
        F.array_join(parts, "|").alias("parts"),
    )


@query("""
SELECT doc_id, coalesce(array_to_string(list_filter(items, lambda x: x IS NOT NULL), ';'), '') AS joined,
  CASE WHEN items IS NULL THEN '' ELSE items[1] END AS first_entry
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST([] AS VARCHAR[])
  WHEN 2 THEN [source, NULL, lang] ELSE [lang, source] END AS items FROM documents)""")
def flatten_lists(spark, folder):
    c = F.col("doc_id") % 4
    items = (
        F.when(c == 0, F.lit(None).cast("array<string>"))
        .when(c == 1, F.array().cast("array<string>"))
        .when(c == 2, F.array("source", F.lit(None).cast("string"), "lang"))
        .otherwise(F.array("lang", "source"))
    )
    return table(spark, folder, "documents").select("doc_id", items.alias("items")).select(
        "doc_id", join_list(F.col("items")).alias("joined"), first_item(F.col("items")).alias("first_entry")
    )


DATES = """CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(o_orderdate, '%d.%m.%Y')
  WHEN 3 THEN '' ELSE strftime(o_orderdate, '%Y') END"""


def _dates():
    part = F.col("o_orderkey") % 5

    def text(pattern):
        return F.date_format("o_orderdate", pattern)

    return (
        F.when(part == 0, text("yyyy-MM-dd"))
        .when(part == 1, text("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(part == 2, text("dd.MM.yyyy"))
        .when(part == 3, "")
        .otherwise(text("yyyy"))
    )


@query(f"""
SELECT o_orderkey, value, CASE WHEN regexp_matches(value, '^\\d{{4}}')
  THEN CAST(substr(value, 1, 4) AS INTEGER) END AS year
FROM (SELECT o_orderkey, {DATES} AS value FROM orders)""")
def extract_year(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", _dates().alias("value"), iso_year(_dates()).alias("year")
    )


@query(f"""
SELECT CAST(count_if(ok) AS BIGINT) AS accepted, CAST(count_if(NOT ok) AS BIGINT) AS rejected
FROM (SELECT regexp_matches({DATES}, '^\\d{{4}}') AS ok FROM orders)""")
def accept_or_reject_by_year(spark, folder):
    rows = table(spark, folder, "orders").select(_dates().alias("published_at"))
    accepted, rejected = split_by_year(rows)
    flagged = accepted.select(F.lit(1).alias("ok")).unionByName(rejected.select(F.lit(0).alias("ok")))
    return flagged.agg(
        F.count_if(F.col("ok") == 1).alias("accepted"), F.count_if(F.col("ok") == 0).alias("rejected")
    )


@query(with_views("paper_ids", r"""
SELECT o_orderkey, paper_id, CASE
  WHEN regexp_matches(trim(paper_id), '^\d{4}\.\d{4,5}(v\d+)?$') THEN '20' || substr(trim(paper_id), 1, 2)
  WHEN regexp_matches(trim(paper_id), '^[A-Za-z\-]+/\d{4}\d+(v\d+)?$') THEN
    CASE WHEN CAST(substr(split_part(paper_id, '/', 2), 1, 2) AS INTEGER) >= 91 THEN '19' ELSE '20' END
      || substr(split_part(paper_id, '/', 2), 1, 2) END AS year FROM paper_ids"""), name="year_from_id")
def year_of_paper_id(spark, folder):
    return paper_ids(spark, folder).withColumn("year", year_from_id(F.col("paper_id")))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL
  ELSE CAST(o_custkey AS VARCHAR) || '.' || CAST(o_orderkey AS VARCHAR) END AS arxiv_id FROM orders""")
def extract_ids(spark, folder):
    number = F.concat_ws(".", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    title = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("No id "), number)).otherwise(
        F.concat(F.lit("Discussion on arXiv:"), number, F.lit(" and arXiv:1.2"))
    )
    return table(spark, folder, "orders").select("o_orderkey", extract_id(title).alias("arxiv_id"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (3, 5) THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m') END
  AS month FROM orders""", name="month_bucket")
def bucket_by_month(spark, folder):
    """Time texts with offset, in three columns of falling priority; some are no dates."""
    part = F.col("o_orderkey") % 6
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:30:00-05:00"))
    first = F.when(part.isin(0, 1), stamp).when(part == 3, F.lit("soon")).otherwise(F.lit(""))
    second = F.when(part == 2, F.date_format("o_orderdate", "yyyyMMdd")).when(part == 5, "2024-13-01")
    third = F.when(part == 4, F.date_format("o_orderdate", "yyyy-MM"))
    return table(spark, folder, "orders").select(
        "o_orderkey", month_bucket(first, second, third).alias("month")
    )


@query(with_views("preference_months", r"""
SELECT month, CASE WHEN month = 'init' THEN -1 WHEN month = 'latest' THEN 9999
    ELSE CAST(substr(month, 1, 4) AS INTEGER) END AS order_year,
  CASE WHEN month = 'init' THEN -1 WHEN month = 'latest' THEN 12
    ELSE CAST(substr(month, 6, 2) AS INTEGER) END AS order_month, count(*) AS rows
FROM preference_months GROUP BY month"""), name="month_order")
def order_of_months(spark, folder):
    place = month_order(F.col("month"))
    return (
        preference_months(spark, folder)
        .groupBy("month")
        .agg(F.count("*").alias("rows"))
        .select(
            "month", place["year"].alias("order_year"), place["month"].alias("order_month"), "rows"
        )
    )


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'cs:cs:' || p_brand
  WHEN 1 THEN 'x:a-' || p_type ELSE p_name END AS setspec
FROM (SELECT p_partkey, p_size, replace(p_brand, '#', '') AS p_brand, p_type, p_name FROM part)""", name="category_setspec")
def category_setspecs(spark, folder):
    part = F.col("p_size") % 3
    label = (
        F.when(part == 0, F.concat(F.lit("cs."), F.replace("p_brand", F.lit("#"), F.lit(""))))
        .when(part == 1, F.concat(F.lit("x.a-"), F.col("p_type")))
        .otherwise(F.col("p_name"))
    )
    return table(spark, folder, "part").select("p_partkey", category_setspec(label).alias("setspec"))


@query(f"""
SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(
  string_split(replace(text, chr(10), ' '), '.'), lambda x: {strip_sql('x')}),
  lambda x: x <> '')[1:3], lambda x: x || '.'), '|') AS sentences FROM documents""", name="first_sentences")
def first_three_sentences(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(first_sentences(F.col("text"), 3), "|").alias("sentences")
    )


@query(f"""
SELECT paper_id, md5({strip_sql("title || chr(10) || chr(10) || abstract")}) AS text_md5,
  '20' || substr(paper_id, 5, 2) AS year
FROM (SELECT {coded_id_sql('doc_id')} AS paper_id, split_part(text, chr(10), 1) AS title,
  text AS abstract FROM documents)""", name="embedding_inputs")
def embedding_texts(spark, folder):
    meta = papers(spark, folder).withColumn("paper_id", coded_id(F.col("paper_id").cast("long")))
    return embedding_inputs(meta).select(
        "paper_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "year"
    )


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE strftime(o_orderdate, '%Y') END AS year FROM orders""")
def year_from_file_path(spark, folder):
    """Paths with the year in the file name, in its folder, in both, or nowhere."""
    key, year = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy")
    path = (
        F.when(key % 5 == 0, F.concat(F.lit("feed/metadata/metadata-"), year, F.lit(".csv")))
        .when(key % 5 == 1, F.concat(F.lit("feed/"), year, F.lit("/part-00001.parquet")))
        .when(key % 5 == 2, F.concat(F.lit("feed/of_"), year, F.lit("/1999.parquet")))
        .when(key % 5 == 3, F.concat(F.lit("a/b-c/"), year, F.lit("_v2.tar.gz")))
        .otherwise(F.concat(F.lit("feed/x"), year, F.lit("/12345.csv")))
    )
    return table(spark, folder, "orders").select("o_orderkey", year_from_path(path).alias("year"))
