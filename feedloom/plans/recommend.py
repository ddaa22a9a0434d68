"""The ranking run: candidates, training, scores and the sample to show."""

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.candidates import (
    drop_known, filter_categories, filter_date_window, filter_valid_vectors, filter_year,
    join_vectors, label_candidates,
)
from ..operators.dedup import keep_latest_any
from ..operators.ranking import fit_ranker, score, stack_features, training_set
from ..operators.sampling import adaptive_sample
from ..session import materialise
from ..sources.staged import Staged, publish, stage
from ..sources.writers import path_exists


@dataclass(frozen=True)
class RecommendParams:
    """Settings of a run."""

    categories: Sequence[str] = ()
    start_year: int | None = None
    background_rate: float = 1.0
    C: float = 1.0
    max_iter: int = 1000
    seed: int = 42
    sample_rate: float = 0.001
    high: float = 0.8
    boundary: float = 0.6
    start_date: str | None = None
    end_date: str | None = None
    last_n_days: int = 7
    include_all: bool = False
    set_aside_unequal: bool = False
    now: datetime = field(default_factory=datetime.now)


@dataclass(frozen=True)
class RecommendRun:
    """Tables of a finished run and its model."""

    preferred: DataFrame
    background: DataFrame
    scored: DataFrame
    recommended: DataFrame
    rejected: DataFrame
    model: LogisticRegressionModel


def candidates(
    meta: DataFrame,
    vectors: Mapping[str, DataFrame],
    known: DataFrame | None,
    params: RecommendParams,
) -> DataFrame:
    """Candidate rows with all vectors.

    All filters work on narrow rows before any join: metadata is cut down by category, year and
    known ids first, broken vectors go before their table is shuffled.
    """
    rows = keep_latest_any(meta, "id", ["updated"])
    rows = filter_year(filter_categories(rows, params.categories), params.start_year)
    if known is not None:
        rows = drop_known(rows, known)
    usable = {alias: filter_valid_vectors(df, [alias]) for alias, df in vectors.items()}
    return join_vectors(rows, usable, unique_meta=True)


def recommend(
    meta: DataFrame,
    vectors: Mapping[str, DataFrame],
    preferences: DataFrame,
    known: DataFrame | None,
    params: RecommendParams,
) -> RecommendRun:
    """One run. The labelled candidates and the scores are each written once to the shared folder.

    Later passes (counts, sample, training, scoring) read them back column by column instead of
    repeating the joins, and survive the loss of executors.
    """
    aliases = list(vectors)
    lengths = F.concat_ws(",", *[F.size(alias).cast("string") for alias in aliases])
    labelled = materialise(
        label_candidates(candidates(meta, vectors, known, params), preferences).withColumn(
            "lengths", lengths
        ),
        "candidates",
    )
    # Vectors of unequal length have no common model: an error, or all but the most frequent are set aside.
    common = labelled.groupBy("lengths").count().orderBy(F.desc("count"), "lengths").first()
    if common is None:
        raise ValueError("a run needs candidates")
    rejected = labelled.where(F.col("lengths") != common["lengths"])
    if not params.set_aside_unequal and not rejected.isEmpty():
        raise ValueError(f"vectors of unequal lengths; {common['count']} candidates have {common['lengths']}")
    labelled = labelled.where(F.col("lengths") == common["lengths"]).drop("lengths")
    preferred = labelled.where("rated").drop("rated")
    background = labelled.where("NOT rated").drop("rated")
    if preferred.isEmpty() or background.isEmpty():
        raise ValueError("a run needs both rated and unrated candidates")
    train = training_set(preferred, background, params.background_rate, params.seed)
    train = materialise(stack_features(train, aliases).select("id", "features", "label"), "train")
    model = fit_ranker(train, params.C, params.max_iter)

    window = filter_date_window(
        background, params.start_date, params.end_date, params.last_n_days, params.now
    )
    # Only ids and scores are stored again; texts and vectors join them where they are wanted.
    scores = materialise(score(model, stack_features(window, aliases)).select("id", "score"), "scores")
    shown = adaptive_sample(
        scores, params.sample_rate, params.high, params.boundary, params.seed, params.include_all
    )
    scored = window.join(shown, "id")
    return RecommendRun(
        preferred, background, scored, scored.where(F.col("show") == 1).drop(*aliases), rejected,
        model,
    )


def recommend_run(
    meta: DataFrame,
    vectors: Mapping[str, DataFrame],
    preferences: DataFrame,
    known: DataFrame | None,
    params: RecommendParams,
    root: str,
    run_at: datetime,
    data_sources: Mapping[str, str] | None = None,
) -> DataFrame:
    """A run with its predictions, recommendations and manifest stored below `root` under its id; returns the manifest.

    The three appear together, by one rename: a run is there whole or not at all, and one that is there is not run again.
    """
    spark, run_id = meta.sparkSession, run_at.strftime("%Y%m%d-%H%M%S")
    final = f"{root}/run_id={run_id}"
    if not path_exists(spark, final):
        run = recommend(meta, vectors, preferences, known, params)
        aside = f"{root}/_aside/{uuid.uuid4().hex}"
        scored = stage(run.scored, "predictions.parquet", aside, final)
        shown = stage(run.recommended, "recommended.parquet", aside, final)
        counts = {
            "preferred": run.preferred.count(), "background": run.background.count(), "scored": scored.rows,
            "recommended": shown.rows,
        }
        settings = {
            "high": params.high, "boundary": params.boundary, "sample_rate": params.sample_rate, "last_n_days": params.last_n_days,
            "start_date": params.start_date, "end_date": params.end_date,
        }
        row = (
            run_id, run_at.isoformat(), params.include_all, *counts.values(), json.dumps(settings),
            json.dumps({"categories": list(params.categories), "vectors": list(vectors), **(data_sources or {})}),
        )
        columns = "run_id string, generated_at string, include_all boolean, " + ", ".join(f"{c} long" for c in counts)
        manifest = spark.createDataFrame([row], columns + ", thresholds string, data_sources string")
        stage(manifest.coalesce(1), "manifest.parquet", aside, final)
        publish(spark, Staged("run", aside, final, "parquet", (), scored.rows, {}, ()))
    return spark.read.parquet(f"{final}/manifest.parquet")
