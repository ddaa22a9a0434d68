"""Corpus preparation in five stages: toxicity, near-duplicates, benchmark passages, secrets, encoding.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; all but the last return the columns of
documents. A document without text is kept until near-dedup, where documents without words are one group. A stage decides
about rows: an id that several rows share, or a null one, says nothing about the others, and only rows repeated with id and
text share a decision.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm import bpe, toxicity
from feedloom.llm.common import free_name, small_batches, with_row_key
from feedloom.llm.decontamination import contaminated
from feedloom.llm.secrets import redact
from feedloom.llm.simhash import one_of_near
from feedloom.session import materialise

MARK = "[SECRET]"
#: The stages score, hash and sign, which SQL cannot express; tests compare them with plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model learns from labelled rows that reached this stage."""
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = free_name(docs, "_toxicity")
    return toxicity.score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The row with the smallest id of each near-duplicate group; of those repeated with id and text, the first by the others.

    Rows of one id are in one group only if their texts are near. Rows with null ids have no place in a group: they stay,
    repeats included, unless a row with an id has their fingerprint.
    """
    small_batches(spark)
    key, nth = free_name(docs, "_row_key"), free_name(docs, "_nth")
    rows = with_row_key(docs, key)
    kept = materialise(one_of_near(rows, key), "kept")
    order = Window.partitionBy(key).orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], "text")
    stay = rows.join(kept, key, "left_semi")
    # Rows without an id need no rank, so however many there are of one text, none of them is sorted.
    one = stay.where("doc_id IS NOT NULL").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return one.unionByName(stay.where("doc_id IS NULL")).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    small_batches(spark)
    key = free_name(docs, "_row_key")
    rows = with_row_key(docs, key)
    keys = rows.select(F.col(key).alias("doc_id"), "text")
    found = contaminated(keys, spark.read.parquet(f"{folder}/benchmark.parquet"), "string")
    found = materialise(found.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return rows.join(found, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with secrets replaced by MARK; n_chars follows the text."""
    return redact(docs, MARK).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token count and digests of the encoded and decoded text of each document."""
    small_batches(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("encoding", encode),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages over documents, each one's rows written before the next reads them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
