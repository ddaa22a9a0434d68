"""Sampling, training, scoring and whole ranking runs."""

from pyspark.sql import functions as F

from ..operators.candidates import filter_valid_vectors, label_candidates, split_candidates
from ..operators.inference import embed_texts
from ..operators.ranking import (
    feature_sizes, fit_ranker, objective_gradient, score, score_with_weights, stack_features,
    training_set,
)
from ..operators.reports import run_manifest
from ..operators.sampling import adaptive_sample, sample_exact, score_tier
from ..plans.recommend import RecommendParams, recommend, recommend_run
from ..session import materialise, scratch_path
from ..sources.readers import metadata_view
from .candidates import NOW, joined
from .registry import query
from .views import damaged, done, papers, prefs, table, vec_a, vec_b, with_views

SEED, RATE, HIGH, BOUNDARY = 42, 0.35, 0.6, 0.5
WEIGHTS = [round(0.8 * ((i * 5) % 11 - 5), 4) for i in range(80)]
BIAS = 0.1
MODELS = ["vec_a", "vec_b"]
CANDIDATES = "papers vec_a vec_b prefs"


def u_sql(seed, key: str) -> str:
    return (
        f"(CAST(CAST('0x' || substr(md5('{seed}:' || {key}), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE))"
        f" / CAST({16**13} AS DOUBLE)"
    )


JOINED_SQL = f"""
, joined AS (SELECT vec_a.id, updated_at, list_concat(CAST(vec_a AS DOUBLE[]), CAST(vec_b AS DOUBLE[])) AS features
  FROM papers JOIN vec_a ON paper_id = vec_a.id JOIN vec_b ON vec_b.id = vec_a.id),
preferred AS (SELECT * FROM joined JOIN prefs USING (id)),
background AS (SELECT * FROM joined WHERE id NOT IN (SELECT id FROM prefs)),
scored AS (SELECT *, 1 / (1 + exp(-(list_dot_product(features, CAST({WEIGHTS} AS DOUBLE[])) + CAST({BIAS} AS DOUBLE)))) AS score
  FROM background)"""

SHOWN_SQL = JOINED_SQL + f"""
, keyed AS (SELECT *, {u_sql(SEED, 'id')} AS u,
  CASE WHEN score >= {HIGH} THEN 1 WHEN score >= {BOUNDARY} THEN 2 ELSE 3 END AS tier FROM scored),
placed AS (SELECT *, row_number() OVER (ORDER BY tier,
  CASE WHEN tier = 2 THEN -ln(u) / (score - {BOUNDARY}) ELSE u END, id) AS place,
  greatest(1, floor(count(*) OVER () * CAST({RATE} AS DOUBLE))) AS target FROM keyed),
shown AS (SELECT *, CASE WHEN place <= target THEN 1 ELSE 0 END AS "show" FROM placed)"""


def background(spark, folder):
    _, rest = split_candidates(joined(spark, folder), prefs(spark, folder))
    return stack_features(rest, MODELS)


def scored(spark, folder):
    """Scores are written once: sampling reads them several times, the vectors only once."""
    rows = score_with_weights(background(spark, folder), WEIGHTS, BIAS).select("id", "updated", "score")
    return materialise(rows, "scores")


@query(with_views(CANDIDATES, JOINED_SQL + f"""
SELECT id FROM background ORDER BY {u_sql(7, 'id')}, id LIMIT 120"""))
def sample_background(spark, folder):
    return sample_exact(background(spark, folder).select("id"), 120, 7)


@query(with_views(CANDIDATES, JOINED_SQL + "SELECT id, round(score, 6) AS score FROM scored"))
def score_candidates(spark, folder):
    rows = score_with_weights(background(spark, folder), WEIGHTS, BIAS)
    return rows.select("id", F.round("score", 6).alias("score"))


@query(with_views(CANDIDATES, SHOWN_SQL + """
SELECT id, round(score, 6) AS score, tier, CAST("show" AS INTEGER) AS "show" FROM shown"""), name="adaptive_sample")
def sample_by_score_tier(spark, folder):
    rows = adaptive_sample(scored(spark, folder), RATE, HIGH, BOUNDARY, SEED)
    return rows.select(
        "id", F.round("score", 6).alias("score"),
        score_tier(F.col("score"), HIGH, BOUNDARY).alias("tier"), F.col("show").cast("int").alias("show"),
    )


@query(f"""
WITH scores AS (SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN label = 3 THEN CAST('nan' AS DOUBLE) ELSE (vec_id % 100) / 100.0 END AS score
  FROM embeddings),
keyed AS (SELECT *, {u_sql(SEED, 'id')} AS u, CASE WHEN isnan(score) THEN 3 WHEN score >= 0.9 THEN 1 WHEN score >= 0.8 THEN 2 ELSE 3 END AS tier
  FROM scores),
placed AS (SELECT *, row_number() OVER (ORDER BY tier, CASE WHEN tier <> 2 THEN u WHEN score > 0.8 THEN 1 - 1 / (1 - ln(u) / (score - 0.8)) ELSE 2 + u END, id)
  AS place, greatest(1, floor(count(*) OVER () * CAST(0.3 AS DOUBLE))) AS target FROM keyed)
SELECT id, tier, CASE WHEN place <= target THEN 1 ELSE 0 END AS "show" FROM placed""")
def sample_scores_without_number(spark, folder):
    """A score that is no number belongs to the last tier, and is drawn like any other of it."""
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.when(F.col("label") == 3, F.lit(float("nan"))).otherwise((F.col("vec_id") % 100) / 100.0).alias("score"),
    )
    shown = adaptive_sample(rows, 0.3, 0.9, 0.8, SEED)
    return shown.select("id", score_tier(F.col("score"), 0.9, 0.8).alias("tier"), F.col("show").cast("int").alias("show"))


@query(with_views(CANDIDATES, JOINED_SQL + 'SELECT id, round(score, 6) AS score, 1 AS "show" FROM scored'))
def recommend_all(spark, folder):
    rows = adaptive_sample(scored(spark, folder), RATE, HIGH, BOUNDARY, SEED, include_all=True)
    return rows.select("id", F.round("score", 6).alias("score"), F.col("show").cast("int").alias("show"))


@query(with_views(CANDIDATES, JOINED_SQL + """
SELECT id, len(features) AS dim, round(features[1], 6) AS first, round(features[80], 6) AS last,
  round(list_sum(features), 6) AS total FROM joined"""), name="stack_features")
def stack_feature_vectors(spark, folder):
    rows = stack_features(joined(spark, folder), MODELS)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "id", F.size("features").cast("long").alias("dim"),
        F.round(F.get("features", F.lit(0)), 6).alias("first"),
        F.round(F.element_at("features", -1), 6).alias("last"), F.round(total, 6).alias("total"),
    )


@query(with_views("damaged", """
SELECT min(len(vector)) AS min_vector, max(len(vector)) AS max_vector FROM damaged
WHERE vector IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""))
def feature_size_check(spark, folder):
    sizes = feature_sizes(filter_valid_vectors(damaged(spark, folder), ["vector"]), ["vector"])
    return sizes.select(*[F.col(c).cast("long").alias(c) for c in sizes.columns])


TRAIN_SQL = JOINED_SQL + f"""
, positives AS (SELECT id, 1 AS label FROM preferred WHERE preference = 'like'),
negatives AS (SELECT id, 0 AS label FROM (SELECT id, row_number() OVER (ORDER BY {u_sql(SEED, 'id')}, id) AS place
  FROM background) WHERE place <= greatest(1, floor((SELECT count(*) FROM positives) * CAST(1.5 AS DOUBLE))))"""


def training(spark, folder):
    """The labelled join is written once: the sample of unrated rows reads it several times."""
    labelled = materialise(label_candidates(joined(spark, folder), prefs(spark, folder)), "labelled")
    preferred, rest = (labelled.where(side).drop("rated") for side in ("rated", "NOT rated"))
    return training_set(preferred, rest, 1.5, SEED)


@query(with_views(CANDIDATES, TRAIN_SQL + """
SELECT id, label FROM positives UNION ALL SELECT id, label FROM negatives"""), name="training_set")
def build_training_set(spark, folder):
    return training(spark, folder).select("id", "label")


def trained(spark, folder):
    train = stack_features(training(spark, folder), MODELS).select("id", "features", "label")
    train = materialise(train, "train")
    return train, fit_ranker(train, C=1.0)


@query(name="train_model")
def train_and_score(spark, folder):
    """Scores of a trained model; training is iterative, so only its optimality has SQL."""
    _, model = trained(spark, folder)
    return score(model, background(spark, folder)).select("id", "score")


@query(with_views(CANDIDATES, TRAIN_SQL + """
SELECT CAST(pos AS INTEGER) AS pos, true AS is_zero, (SELECT count(*) FROM positives) AS positives,
  (SELECT count(*) FROM negatives) AS negatives FROM range(-1, 80) AS positions(pos)"""), name="train_stationarity")
def trained_model_is_optimal(spark, folder):
    """The gradient of the training objective vanishes in every coefficient of the fitted model."""
    train, model = trained(spark, folder)
    counts = {row["label"]: row["count"] for row in train.groupBy("label").count().collect()}
    return objective_gradient(train, model, C=1.0).select(
        "pos", (F.abs("gradient") < 1e-3).alias("is_zero"),
        F.lit(counts[1]).cast("long").alias("positives"), F.lit(counts[0]).cast("long").alias("negatives"),
    )


@query(with_views(CANDIDATES, SHOWN_SQL + """
SELECT 'preferred' AS key, count(*) AS value FROM preferred
UNION ALL SELECT 'background', count(*) FROM background
UNION ALL SELECT 'scored', count(*) FROM shown
UNION ALL SELECT 'recommended', CAST(sum("show") AS BIGINT) FROM shown"""), name="run_manifest")
def count_run(spark, folder):
    preferred, rest = split_candidates(joined(spark, folder), prefs(spark, folder))
    rows = adaptive_sample(scored(spark, folder), RATE, HIGH, BOUNDARY, SEED)
    return run_manifest(preferred, rest, rows, rows.where("show = 1"))


def run(spark, folder):
    params = RecommendParams(
        start_year=2024, sample_rate=0.25, high=0.6, boundary=0.5, last_n_days=800, now=NOW, seed=SEED
    )
    vectors = {"vec_a": vec_a(spark, folder), "vec_b": vec_b(spark, folder)}
    meta = metadata_view(papers(spark, folder))
    return recommend(meta, vectors, prefs(spark, folder), done(spark, folder), params)


@query()
def recommend_end_to_end(spark, folder):
    """Candidates, training, scoring and sampling in one run."""
    return run(spark, folder).recommended.select("id", "title", "updated", "preference", "score", "show")


@query(with_views("papers vec_a vec_b prefs done", """
, joined AS (SELECT vec_a.id, vec_a.id IN (SELECT id FROM prefs) AS rated FROM papers JOIN vec_a ON paper_id = vec_a.id
  JOIN vec_b ON vec_b.id = vec_a.id WHERE vec_a.id NOT IN (SELECT id FROM done)),
counts AS (SELECT CAST(count_if(rated) AS BIGINT) AS preferred, CAST(count_if(NOT rated) AS BIGINT) AS background FROM joined)
SELECT '20251231-000000' AS run_id, preferred, background, background AS scored, background AS recommended, background AS stored
FROM counts"""), name="recommend_run")
def run_ranking_twice(spark, folder):
    """A stored run that shows all it scored, tried again after its end; counts of its manifest and of its tables."""
    params = RecommendParams(start_year=2024, last_n_days=800, now=NOW, seed=SEED, include_all=True)
    vectors = {"vec_a": vec_a(spark, folder), "vec_b": vec_b(spark, folder)}
    meta, root = metadata_view(papers(spark, folder)), scratch_path(spark, "ranking-run")
    for _ in range(2):
        manifest = recommend_run(meta, vectors, prefs(spark, folder), done(spark, folder), params, root, NOW)
    stored = spark.read.parquet(f"{root}/run_id=20251231-000000/recommended.parquet")
    counts = ("run_id", "preferred", "background", "scored", "recommended")
    return manifest.select(*counts).join(stored.agg(F.count("*").alias("stored")))


DIM = 64
EMBEDDED_SQL = f"""
WITH words AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+')) AS word FROM documents),
coded AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS code FROM words WHERE word <> ''),
sums AS (SELECT doc_id, (code >> 1) % {DIM} AS pos, sum(CASE WHEN code & 1 = 1 THEN 1 ELSE -1 END) AS n
  FROM coded GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM sums GROUP BY doc_id)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(CAST(n AS DOUBLE) / norm AS FLOAT) AS DOUBLE), 6) AS value
FROM sums JOIN norms USING (doc_id) WHERE n <> 0"""


@query(EMBEDDED_SQL, name="embed_texts")
def embed_documents(spark, folder):
    """Every document embedded as a whole; one row per non-zero element."""
    rows = embed_texts(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.posexplode("embedding").alias("pos", "value")).where("value <> 0").select(
        "doc_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value")
    )
