"""Reactions to preference labels, and labels into the preference table."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import extract_id
from .dedup import keep_last

# Reaction names and labels.
UP, DOWN = "THUMBS_UP", "THUMBS_DOWN"
LIKE, DISLIKE, NEUTRAL = "like", "dislike", "neutral"


def reaction_label(likes: Column, dislikes: Column) -> Column:
    """like when likes lead; otherwise dislike if there is any; otherwise neutral."""
    return (
        F.when(likes > dislikes, F.lit(LIKE))
        .when(dislikes > 0, F.lit(DISLIKE))
        .otherwise(F.lit(NEUTRAL))
    )


def label_threads(threads: DataFrame) -> DataFrame:
    """One label per thread whose title quotes an id, from its nested reactions."""
    def votes(content: str) -> Column:
        return F.size(F.filter("reactions", lambda r: r["content"] == content))

    return threads.select(
        extract_id(F.col("title")).alias("arxiv_id"),
        F.col("number").alias("discussion_id"),
        reaction_label(votes(UP), votes(DOWN)).alias("preference"),
        "updated_at",
        "url",
    ).where(F.col("arxiv_id").isNotNull())


def label_paged_threads(pages: DataFrame) -> DataFrame:
    """One label per thread whose reactions come in pages: rows of a thread with a part of its reactions each.

    Votes are counted within each page and added up, so no list grows with the reactions of a thread.
    """
    def votes(content: str) -> Column:
        return F.size(F.filter("reactions", lambda r: r["content"] == content)).cast("long")

    sums = (
        pages.select(
            extract_id(F.col("title")).alias("arxiv_id"), F.col("number").alias("discussion_id"), votes(UP).alias("likes"),
            votes(DOWN).alias("dislikes"), "updated_at", "url",
        )
        .where(F.col("arxiv_id").isNotNull())
        .groupBy("arxiv_id", "discussion_id")
        .agg(F.sum("likes").alias("likes"), F.sum("dislikes").alias("dislikes"), F.max("updated_at").alias("updated_at"), F.max("url").alias("url"))
    )
    label = reaction_label(F.col("likes"), F.col("dislikes")).alias("preference")
    return sums.select("arxiv_id", "discussion_id", label, "updated_at", "url")


def feedback_labels(reactions: DataFrame, thread: str = "thread") -> DataFrame:
    """One label per thread from a long table of reactions (thread, content)."""
    counts = reaction_counts(reactions, thread)
    return counts.withColumn("preference", reaction_label(F.col("likes"), F.col("dislikes")))


def reaction_counts(reactions: DataFrame, thread: str = "thread") -> DataFrame:
    """Likes and dislikes per thread; other reactions make a thread known, with zeros."""
    return reactions.groupBy(thread).agg(
        F.count_if(F.col("content") == UP).alias("likes"),
        F.count_if(F.col("content") == DOWN).alias("dislikes"),
    )


def recent_threads(reactions: DataFrame, n: int = 100, per_thread: int = 100) -> DataFrame:
    """The first `per_thread` reactions of each of the `n` threads updated last."""
    latest = (
        reactions.groupBy("thread")
        .agg(F.max("updated_at").alias("thread_updated"))
        .orderBy(F.desc("thread_updated"), "thread")
        .limit(n)
    )
    order = Window.partitionBy("thread").orderBy("updated_at", "seq")
    return (
        reactions.join(latest.select("thread"), "thread", "left_semi")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= per_thread)
    )


def apply_feedback(
    existing: DataFrame, feedback: DataFrame, insert_new: bool = False, key: str = "arxiv_id"
) -> DataFrame:
    """Preferences with the labels of newly reacted ids; ids without feedback keep theirs.

    Feedback is first reduced to the last updated thread per id, so an id with several threads does
    not multiply rows. `insert_new` also adds ids the table does not have yet.
    """
    order = [c for c in ("updated_at", "discussion_id") if c in feedback.columns]
    latest = keep_last(feedback.where(F.col(key).isNotNull()), key, [*order, "preference"]).select(
        key, F.col("preference").alias("_new")
    )
    merged = (
        existing.join(latest, key, "left")
        .withColumn("preference", F.coalesce("_new", "preference"))
        .select(*existing.columns)
    )
    if not insert_new:
        return merged
    # Not a full join: Spark cannot split a skewed key there, but can in the left join above.
    added = latest.join(existing.select(key).distinct(), key, "left_anti")
    return merged.unionByName(
        added.select(key, F.col("_new").alias("preference")), allowMissingColumns=True
    )


def publish_flags(summaries: DataFrame, preferences: DataFrame, key: str = "id") -> DataFrame:
    """Summaries with their preference (neutral without one); disliked ones become drafts."""
    order = [c for c in ("recorded_at", "preference") if c in preferences.columns]
    rated = keep_last(preferences, key, order).select(key, "preference")
    return (
        summaries.join(rated, key, "left")
        .withColumn("preference", F.coalesce("preference", F.lit(NEUTRAL)))
        .withColumn("draft", F.col("preference") == DISLIKE)
    )
