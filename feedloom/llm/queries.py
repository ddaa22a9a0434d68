"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import bpe, pipeline, suffixes, toxicity
from feedloom.llm.alignment import aligned
from feedloom.llm.decontamination import contaminated
from feedloom.llm.lexical import ranked
from feedloom.llm.licenses import license_finds
from feedloom.llm.packing import packed
from feedloom.llm.projections import near_vectors
from feedloom.llm.recompression import without_repeats
from feedloom.llm.secrets import scan_secrets
from feedloom.llm.simhash import near_groups
from feedloom.llm.token_counts import token_counts

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector."""
    return near_vectors(table(spark, folder, "embeddings"))


@query
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the words of windows that occur again."""
    return without_repeats(table(spark, folder, "documents"))


@query
def op3_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in every document."""
    return license_finds(table(spark, folder, "documents"))


@query
def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    groups = near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, by a model of the labelled rows outside the held-out fold."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model, "score").select(
        "doc_id",
        F.coalesce(toxicity.fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram token counts of every document."""
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded with the byte-level vocabulary, as counts and digests."""
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, with the longest overlap per item."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op9_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the bytes of strings that occur again."""
    return suffixes.without_repeats(table(spark, folder, "documents"))


@query
def op10_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: counts per kind, digest of the base spans, all spans."""
    found = scan_secrets(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(said, 256).alias("base_sha256"),
        said.alias("spans"),
    )


def _secrets_sql() -> str:
    # RE2 folds more letters than A-Z under (?i), so the letters are written out.
    letters = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    words = "|".join([letters("password"), letters("passwd"), letters("secret"), letters("token"), "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"])
    assign = rf"""({words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(
        [("assign", assign, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    ):
        parts.append(
            f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, "
            f"unnest(string_split_regex(text, '{pattern}')[:-2]) AS before, "
            f"unnest(regexp_extract_all(text, '{pattern}')) AS hit, "
            f"unnest(regexp_extract_all(text, '{pattern}', {group})) AS tested, "
            f"unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i FROM docs"
        )
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
spans AS (
  SELECT doc_id, kind, rank, length(tested) >= least AS counts, length(hit) AS n,
    sum(length(before) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
  FROM hits),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || (stop - n)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop - n, rank) AS spans
  FROM spans WHERE counts GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (doc_id)"""


@query
def op11_ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every document in sequences of 2048 tokens."""
    pieces = packed(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


@query
def op13_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of every document's tokens in two vocabularies, and how common the links are."""
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

    def digest(groups):
        return F.when(groups == "", "").otherwise(F.sha2(groups, 256))

    return aligned(table(spark, folder, "documents"), a, b, digest)[0].withColumnRenamed("groups", "groups_sha256")


SEARCH_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL)
  GROUP BY item_id, term),
counted AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM words)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counted, totals GROUP BY term),
shares AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS worth
  FROM counted JOIN docs USING (r) JOIN weights USING (term), totals),
scored AS (
  SELECT item_id, r, doc_id, sum(times * worth)::BIGINT AS score FROM asked JOIN shares USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20"""

QUERIES["pipeline"] = pipeline.run

SQL["op10_secret_scans"] = _secrets_sql()
SQL["op11_ranked_lexical_search"] = SEARCH_SQL
