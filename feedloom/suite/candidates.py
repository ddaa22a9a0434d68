"""Candidate joins, filters and lookups."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.text import join_list
from ..functions.vectors import is_valid_vector
from ..operators.candidates import (
    embedding_backlog, filter_categories, filter_date_window, filter_valid_vectors, filter_year,
    join_vectors, limit_ordered, lookup_by_id, lookup_listed, split_candidates,
)
from ..operators.reshape import embedding_inputs
from ..session import scratch_path
from ..sources.readers import metadata_view
from ..sources.writers import write_vectors
from .registry import query
from .views import (
    coded_id, coded_id_sql, damaged, done, papers, prefs, table, vec_a, vec_b, with_views,
)

WANTED = ["src3", "src11", "fr"]
NOW = datetime(2025, 12, 31)


def meta(spark, folder):
    return metadata_view(papers(spark, folder))


@query(with_views("papers", """
SELECT paper_id AS id, replace(categories, '; ', '|') AS categories FROM papers
WHERE primary_category IN ('src3', 'src11') OR split_part(categories, '; ', 2) = 'fr'"""), name="filter_categories")
def keep_categories(spark, folder):
    rows = filter_categories(meta(spark, folder), WANTED)
    return rows.select("id", join_list(F.col("categories"), "|").alias("categories"))


@query(with_views("damaged", """
SELECT id, len(vector) AS dim FROM damaged
WHERE vector IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""), name="filter_valid_vectors")
def keep_valid_vectors(spark, folder):
    rows = filter_valid_vectors(damaged(spark, folder), ["vector"])
    return rows.select("id", F.size("vector").cast("long").alias("dim"))


@query(with_views("damaged", """
SELECT ok, count(*) AS rows FROM (SELECT coalesce(vector IS NOT NULL AND
  len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0, false) AS ok FROM damaged)
GROUP BY ok"""))
def vector_validity(spark, folder):
    ok = is_valid_vector(F.col("vector"))
    return damaged(spark, folder).groupBy(ok.alias("ok")).agg(F.count("*").alias("rows"))


@query(with_views("papers", """
SELECT paper_id AS id, updated_at AS updated FROM papers WHERE CAST(substr(updated_at, 1, 4) AS INTEGER) >= 2025"""), name="filter_year")
def keep_from_year(spark, folder):
    return filter_year(meta(spark, folder), 2025).select("id", "updated")


@query(with_views("papers", """
SELECT paper_id AS id, updated_at AS updated, 'window' AS kind FROM papers
WHERE updated_at >= '2024-03-05' AND updated_at <= '2025-02-10'
UNION ALL SELECT paper_id, updated_at, 'recent' FROM papers WHERE updated_at >= '2025-10-02'"""), name="filter_date_window")
def keep_date_window(spark, folder):
    rows = meta(spark, folder).select("id", "updated")
    window = filter_date_window(rows, "2024-03-05", "2025-02-10", 7, NOW)
    recent = filter_date_window(rows, None, "2025-02-10", 90, NOW)
    return window.withColumn("kind", F.lit("window")).unionByName(
        recent.withColumn("kind", F.lit("recent"))
    )


def joined(spark, folder):
    vectors = {"vec_a": vec_a(spark, folder), "vec_b": vec_b(spark, folder)}
    return join_vectors(meta(spark, folder), vectors)


@query(with_views("papers vec_a vec_b", """
SELECT id, title, updated_at AS updated, len(vec_a) AS dim_a, len(vec_b) AS dim_b,
  CAST(vec_a[1] AS DOUBLE) AS head_a, CAST(vec_b[16] AS DOUBLE) AS tail_b,
  round(list_sum(list_transform(range(1, 65), lambda i: i * CAST(vec_a[i] AS DOUBLE))), 4) AS mark_a,
  round(list_sum(list_transform(range(1, 17), lambda i: i * CAST(vec_b[i] AS DOUBLE))), 4) AS mark_b
FROM papers JOIN vec_a ON paper_id = vec_a.id JOIN vec_b USING (id)"""), name="join_vectors")
def join_all_vectors(spark, folder):
    return joined(spark, folder).select(
        "id", "title", "updated",
        F.size("vec_a").cast("long").alias("dim_a"), F.size("vec_b").cast("long").alias("dim_b"),
        F.get("vec_a", F.lit(0)).cast("double").alias("head_a"),
        F.get("vec_b", F.lit(15)).cast("double").alias("tail_b"),
        _mark("vec_a").alias("mark_a"), _mark("vec_b").alias("mark_b"),
    )


def _mark(vector):
    """A number that depends on every element and its place."""
    placed = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(placed, F.lit(0.0), lambda a, x: a + x), 4)


@query(with_views("papers vec_a prefs", """
SELECT id, title, preference FROM papers JOIN vec_a ON paper_id = vec_a.id JOIN prefs USING (id)"""))
def split_preferred(spark, folder):
    preferred, _ = split_candidates(joined(spark, folder), prefs(spark, folder))
    return preferred.select("id", "title", "preference")


@query(with_views("papers vec_a prefs", """
SELECT vec_a.id, title, 'unrated' AS preference FROM papers JOIN vec_a ON paper_id = vec_a.id
WHERE vec_a.id NOT IN (SELECT id FROM prefs)"""))
def split_background(spark, folder):
    _, background = split_candidates(joined(spark, folder), prefs(spark, folder))
    return background.select("id", "title", "preference")


@query(f"""
WITH inputs AS (SELECT {coded_id_sql('doc_id')} AS paper_id, text FROM documents),
stored AS (SELECT {coded_id_sql('vec_id')} AS paper_id FROM embeddings)
SELECT paper_id, '20' || substr(paper_id, 5, 2) AS year, md5(text) AS source_md5 FROM inputs
WHERE paper_id NOT IN (SELECT paper_id FROM stored)""", name="embedding_backlog")
def missing_vectors_backlog(spark, folder):
    """Documents without a stored vector. Every input comes twice; one row per id is left."""
    rows = papers(spark, folder).withColumn("paper_id", coded_id(F.col("paper_id").cast("long")))
    copies = rows.unionByName(rows.withColumn("title", F.lit("zz copy")))
    stored = table(spark, folder, "embeddings").select(coded_id(F.col("vec_id")).alias("paper_id"))
    stored = stored.withColumn("year", F.concat(F.lit("20"), F.substring("paper_id", 5, 2)))
    todo = embedding_backlog(embedding_inputs(copies), stored).select("paper_id", "year")
    return todo.join(rows.select("paper_id", "abstract"), "paper_id").select(
        "paper_id", "year", F.md5(F.col("abstract").cast("binary")).alias("source_md5")
    )


@query(with_views("vec_a done", """
SELECT id, CAST(vec_a[1] AS DOUBLE) AS head, len(vec_a) AS dim FROM vec_a WHERE id IN (SELECT id FROM done)"""))
def lookup_vectors_by_id(spark, folder):
    found = lookup_by_id(vec_a(spark, folder), done(spark, folder), "id")
    return found.select(
        "id", F.get("vec_a", F.lit(0)).cast("double").alias("head"),
        F.size("vec_a").cast("long").alias("dim"),
    )


@query(with_views("vec_a", """
SELECT id, CAST(vec_a[1] AS DOUBLE) AS head, len(vec_a) AS dim FROM vec_a
WHERE id IN (SELECT CAST(l_suppkey * 3 AS VARCHAR) FROM lineitem WHERE l_orderkey < 100)"""), name="lookup_listed_vectors")
def look_up_listed_ids(spark, folder):
    """A bounded list of ids, looked up in stored files that are sorted by id and have Bloom filters."""
    path = scratch_path(spark, "vectors")
    c = F.col("vec_id").cast("string")
    write_vectors(table(spark, folder, "embeddings").select(
        F.lit("m").alias("model"), F.lit("2024").alias("year"), c.alias("paper_id"), "embedding", F.lit("t").alias("generated_at"),
        F.size("embedding").alias("model_dim"), F.lit("s").alias("source"),
    ), path)
    wanted = table(spark, folder, "lineitem").where("l_orderkey < 100").select((F.col("l_suppkey") * 3).cast("string"))
    found = lookup_listed(spark.read.parquet(path), [row[0] for row in wanted.distinct().collect()])
    return found.select(
        F.col("paper_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("head"),
        F.size("embedding").cast("long").alias("dim"),
    )


@query(with_views("papers", "SELECT paper_id, updated_at, title FROM papers ORDER BY updated_at, paper_id LIMIT 300"))
def first_papers(spark, folder):
    """A limit takes the first rows by its keys, whatever the order of the table."""
    return limit_ordered(papers(spark, folder), ["updated_at", "paper_id"], 300).select("paper_id", "updated_at", "title")
