"""Training set, class-balanced logistic regression and scoring."""

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import concat_vectors, linear_probability
from .sampling import sample_exact, sample_target

LIKE = "like"
VALUES_PER_TASK = 1 << 23  # feature values; every solver step is a job: smaller tasks are mostly overhead


def training_set(
    preferred: DataFrame, background: DataFrame, rate: float, seed, key: str = "id"
) -> DataFrame:
    """Liked rows (label 1) and a background sample of `rate` times their number (label 0).

    Disliked rows are in neither part.
    """
    liked = preferred.where(F.col("preference") == LIKE)
    positives = liked.count()
    if positives == 0:
        raise ValueError("no liked rows to train on")
    negatives = sample_exact(background, sample_target(positives, rate), seed, key)
    return liked.withColumn("label", F.lit(1)).unionByName(
        negatives.withColumn("label", F.lit(0)), allowMissingColumns=True
    )


def stack_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add `features`: the vector columns end to end, in the given order."""
    return df.withColumn("features", concat_vectors(columns))


def feature_sizes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shortest and longest vector of each column; unequal ones cannot be stacked into a matrix."""
    sizes = [
        extreme(F.size(c)).alias(f"{name}_{c}")
        for c in columns
        for name, extreme in (("min", F.min), ("max", F.max))
    ]
    return df.agg(*sizes)


def balanced_weight(train: DataFrame) -> tuple[int, Column]:
    """Row count, and the row weight under which both classes weigh n / 2."""
    counts = {row["label"]: row["count"] for row in train.groupBy("label").count().collect()}
    if set(counts) != {0, 1}:
        raise ValueError("training needs rows of both classes")
    n = sum(counts.values())
    weight = F.when(F.col("label") == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))
    return n, weight


def fit_ranker(
    train: DataFrame, C: float = 1.0, max_iter: int = 1000, tol: float = 1e-7
) -> LogisticRegressionModel:
    """L2 logistic regression with balanced classes on `features` and `label`.

    Minimises |b|^2 / 2 + C * sum(w * loss) with w = n / (2 * rows of the class). Spark divides the
    loss by the weight sum, which is n, hence the regularisation 1 / (C * n).
    """
    n, weight = balanced_weight(train)
    width = train.select(F.size("features")).first()[0]
    rows = train.select(
        array_to_vector("features").alias("features"),
        F.col("label").cast("double").alias("label"),
        weight.alias("weight"),
    ).coalesce(1 + n * max(width, 1) // VALUES_PER_TASK)
    model = LogisticRegression(
        weightCol="weight",
        regParam=1.0 / (C * n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    ).fit(rows)
    return without_summary(model)


def without_summary(model: LogisticRegressionModel) -> LogisticRegressionModel:
    """The model without its training summary.

    The summary holds the session, which cannot travel with the model to the tasks once it has observed a metric.
    """
    model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def score(model: LogisticRegressionModel, df: DataFrame) -> DataFrame:
    """Add `score`, the probability of being liked, from `features`."""
    slim = model.copy()
    slim.setFeaturesCol("_vector").setProbabilityCol("_probability")
    slim.setRawPredictionCol("").setPredictionCol("")
    return (
        slim.transform(df.withColumn("_vector", array_to_vector("features")))
        .withColumn("score", F.get(vector_to_array("_probability"), F.lit(1)))
        .drop("_vector", "_probability")
    )


def score_with_weights(df: DataFrame, weights: Sequence[float], bias: float) -> DataFrame:
    """Add `score` from exported model weights."""
    return df.withColumn("score", linear_probability(weights, bias)("features"))


def objective_gradient(train: DataFrame, model: LogisticRegressionModel, C: float) -> DataFrame:
    """Gradient of the training objective at the fitted model, one row per coefficient.

    The intercept has position -1. All entries are close to zero at the optimum.
    """
    _, weight = balanced_weight(train)
    residual = C * weight * (F.col("score") - F.col("label"))
    with_bias = F.concat(F.col("features"), F.array(F.lit(1.0)))
    parts = score(model, train).select(F.posexplode(F.transform(with_bias, lambda x: x * residual)))
    b = [float(x) for x in model.coefficients] + [0.0]
    width = len(b) - 1
    own = F.get(F.array(*[F.lit(x) for x in b]), F.col("pos"))
    return (
        parts.groupBy("pos")
        .agg(F.sum("col").alias("loss_part"))
        .select(
            F.when(F.col("pos") == width, -1).otherwise(F.col("pos")).alias("pos"),
            (F.col("loss_part") + own).alias("gradient"),
        )
    )
