"""Reactions, labels and publication flags."""

from pyspark.sql import functions as F

from ..operators.feedback import (
    apply_feedback, feedback_labels, label_paged_threads, publish_flags, recent_threads,
)
from ..session import scratch_path
from ..sources.readers import read_threads
from .registry import query
from .views import done, papers, prefs, reactions, with_views

PAGE = 1000
LABEL_SQL = """CASE WHEN count_if(content = 'THUMBS_UP') > count_if(content = 'THUMBS_DOWN') THEN 'like'
  WHEN count_if(content = 'THUMBS_DOWN') > 0 THEN 'dislike' ELSE 'neutral' END"""


@query(with_views("reactions", f"""
SELECT thread, CAST(count_if(content = 'THUMBS_UP') AS BIGINT) AS likes, CAST(count_if(content = 'THUMBS_DOWN') AS BIGINT) AS dislikes,
  {LABEL_SQL} AS preference FROM reactions GROUP BY thread"""), name="feedback_labels")
def label_feedback(spark, folder):
    return feedback_labels(reactions(spark, folder))


@query(with_views("reactions", f"""
SELECT CAST(thread AS VARCHAR) || '.' || CAST(thread AS VARCHAR) AS arxiv_id, CAST(thread AS INTEGER) AS discussion_id,
  {LABEL_SQL} AS preference FROM reactions WHERE thread % 4 <> 0 GROUP BY thread"""))
def label_nested_threads(spark, folder):
    """All threads with all their reactions nested, in pages as a discussion query returns them."""
    number = F.col("thread").cast("string")
    title = F.when(F.col("thread") % 4 == 0, F.lit("no id")).otherwise(
        F.concat(F.lit("On arXiv:"), number, F.lit("."), number)
    )
    pages = (
        reactions(spark, folder)
        .groupBy("thread", F.floor(F.col("seq") / PAGE).alias("page"))
        .agg(
            F.collect_list(F.struct("content")).alias("reactions"),
            F.max("updated_at").cast("string").alias("updated_at"),
        )
        .select(
            title.alias("title"), F.col("thread").cast("int").alias("number"), "reactions",
            "updated_at", F.lit("http://example.org").alias("url"),
        )
    )
    return label_paged_threads(pages).select("arxiv_id", "discussion_id", "preference")


@query(with_views("reactions", """
, latest AS (SELECT thread FROM reactions GROUP BY thread ORDER BY max(updated_at) DESC, thread LIMIT 100)
SELECT thread, seq, content FROM reactions WHERE thread IN (SELECT thread FROM latest)
QUALIFY row_number() OVER (PARTITION BY thread ORDER BY updated_at, seq) <= 100"""), name="recent_threads")
def recent_thread_reactions(spark, folder):
    return recent_threads(reactions(spark, folder)).select("thread", "seq", "content")


def _daily(spark, folder):
    """Several threads per id: one for each day."""
    day = F.date_format("updated_at", "yyyy-MM-dd")
    rows = reactions(spark, folder).withColumn(
        "thread", F.concat_ws("/", F.col("thread").cast("string"), day)
    )
    return feedback_labels(rows).select(
        F.split_part("thread", F.lit("/"), F.lit(1)).alias("arxiv_id"),
        F.split_part("thread", F.lit("/"), F.lit(2)).alias("updated_at"),
        "preference",
    )


DAILY_SQL = f"""
, daily AS (SELECT CAST(thread AS VARCHAR) AS arxiv_id, strftime(updated_at, '%Y-%m-%d') AS day,
  {LABEL_SQL} AS preference FROM reactions GROUP BY 1, 2),
newest AS (SELECT arxiv_id, arg_max(preference, day) AS preference FROM daily GROUP BY arxiv_id)"""


@query(with_views("prefs reactions", DAILY_SQL + """
SELECT p.id AS arxiv_id, coalesce(n.preference, p.preference) AS preference, recorded_at
FROM prefs p LEFT JOIN newest n ON n.arxiv_id = p.id"""), name="apply_feedback")
def apply_feedback_to_preferences(spark, folder):
    existing = prefs(spark, folder).withColumnRenamed("id", "arxiv_id")
    return apply_feedback(existing, _daily(spark, folder))


@query(with_views("prefs reactions", DAILY_SQL + """
SELECT coalesce(p.id, n.arxiv_id) AS arxiv_id, coalesce(n.preference, p.preference) AS preference, recorded_at
FROM prefs p FULL JOIN newest n ON n.arxiv_id = p.id"""))
def upsert_feedback(spark, folder):
    existing = prefs(spark, folder).withColumnRenamed("id", "arxiv_id")
    return apply_feedback(existing, _daily(spark, folder), insert_new=True)


@query(with_views("papers prefs done", """
SELECT paper_id AS id, coalesce(preference, 'neutral') AS preference,
  coalesce(preference = 'dislike', false) AS draft
FROM papers LEFT JOIN prefs ON prefs.id = paper_id WHERE paper_id IN (SELECT id FROM done)"""), name="publish_flags")
def flag_published(spark, folder):
    rows = papers(spark, folder).select(F.col("paper_id").alias("id"))
    summaries = rows.join(done(spark, folder), "id", "left_semi")
    return publish_flags(summaries, prefs(spark, folder))


REPLY = 10_000


@query(with_views("reactions", f"""
SELECT CAST(thread AS VARCHAR) || '.' || CAST(thread AS VARCHAR) AS arxiv_id, CAST(thread AS INTEGER) AS discussion_id,
  {LABEL_SQL} AS preference FROM reactions GROUP BY thread"""))
def read_thread_replies(spark, folder):
    """Replies of a discussion query as JSON files, each with some threads and a page of their reactions.

    The threads' pages are dealt out over as many files as the reactions fill: their number and size do not depend on how
    many threads a page has reactions of.
    """
    root, number = scratch_path(spark, "replies"), F.col("thread").cast("string")
    rows = reactions(spark, folder)
    pages = rows.groupBy("thread", F.floor(F.col("seq") / REPLY).alias("page")).agg(
        F.collect_list(F.struct("content", F.struct(F.lit("u").alias("login")).alias("user"))).alias("nodes"),
        F.max("updated_at").cast("string").alias("updatedAt"),
    )
    node = F.struct(
        number.alias("id"), F.concat(F.lit("arXiv:"), number, F.lit("."), number).alias("title"), "updatedAt", F.lit("u").alias("url"),
        F.col("thread").cast("int").alias("number"), F.struct("nodes").alias("reactions"),
    )
    place = F.pmod(F.xxhash64("thread", "page"), F.lit(rows.count() // REPLY + 1))
    reply = pages.groupBy(place.alias("reply")).agg(F.collect_list(node).alias("nodes"))
    discussions = F.struct(F.struct("nodes").alias("discussions"))
    value = F.to_json(F.struct(F.struct(discussions.alias("repository")).alias("data"))).alias("value")
    # One reply per file: a reader takes a whole file as one document.
    reply.select(value).write.option("maxRecordsPerFile", 1).text(root)
    return label_paged_threads(read_threads(spark, root)).select("arxiv_id", "discussion_id", "preference")
