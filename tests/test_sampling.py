"""Exact-size samples against a plain sort of all rows."""

import hashlib
import math

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.functions.rand import uniform
from feedloom.operators import sampling
from feedloom.operators.sampling import adaptive_sample, random_id_batches, sample_exact


def scored(spark, n, fn):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), fn(F.col("id")).alias("score"))


def brute_force(df, rate, high, boundary, seed):
    got = df.select("id", "score", uniform(seed, F.col("id")).alias("u")).collect()

    def key(r):
        if r.score >= high:
            return (1, r.u, r.id)
        if r.score >= boundary:
            w = r.score - boundary
            return (2, -math.log(r.u) / w if w > 0 else math.inf, r.u, r.id)
        return (3, r.u, r.id)

    return {r.id for r in sorted(got, key=key)[: max(1, int(len(got) * rate))]}


@pytest.mark.parametrize("rate", [0.0001, 0.05, 0.1, 0.35, 0.6, 0.9, 1.0])
@pytest.mark.parametrize("limit", [200_000, 5])
def test_adaptive_sample_equals_a_full_sort(spark, monkeypatch, rate, limit):
    """`limit` 5 makes the search for the cut refine its histogram several times."""
    monkeypatch.setattr(sampling, "SORT_LIMIT", limit)
    monkeypatch.setattr(sampling, "BUCKETS", 16 if limit == 5 else 4096)
    df = scored(spark, 3000, lambda c: (c * 37 % 1000) / 1000.0)
    shown = adaptive_sample(df, rate, 0.9, 0.7, 11).where("show = 1")
    ids = {r.id for r in shown.select("id").collect()}
    assert ids == brute_force(df, rate, 0.9, 0.7, 11)


def test_tiers_fill_in_order(spark):
    df = scored(spark, 100, lambda c: c / 100.0)
    shown = adaptive_sample(df, 0.35, 0.9, 0.7, 3).where("show = 1").select("score").collect()
    values = [r.score for r in shown]
    assert len(values) == 35
    assert sum(v >= 0.9 for v in values) == 10 and sum(0.7 <= v < 0.9 for v in values) == 20


def test_boundary_rows_without_weight_come_last(spark):
    df = spark.createDataFrame([("a", 0.7), ("b", 0.7), ("c", 0.71)], "id string, score double")
    shown = adaptive_sample(df, 0.34, 0.9, 0.7, 5).where("show = 1")
    assert rows(shown, "id") == [("c",)]


def test_include_all_and_empty(spark):
    df = scored(spark, 5, lambda c: c / 10.0)
    assert adaptive_sample(df, 0.1, 0.9, 0.7, 1, include_all=True).where("show = 1").count() == 5
    assert adaptive_sample(df.where("score > 5"), 0.5, 0.9, 0.7, 1).count() == 0


def test_weighted_draw_follows_the_weights(spark):
    """Two of three rows per draw; inclusion matches sequential draws in proportion to weight."""
    weights = {"a": 0.1, "b": 0.2, "c": 0.3}
    runs = spark.range(20000).select(F.col("id").alias("run"))
    rows_ = runs.select("run", F.explode(F.map_from_arrays(
        F.array(*[F.lit(k) for k in weights]), F.array(*[F.lit(w) for w in weights.values()])
    )).alias("id", "w"))
    u = uniform("t", F.concat_ws("/", "run", "id"))
    order = -F.ln(u) / F.col("w")
    best = rows_.groupBy("run").agg(F.max_by("id", order).alias("left_out"))
    share = {r["left_out"]: r["count"] / 20000 for r in best.groupBy("left_out").count().collect()}

    def left_out(x):
        y, z = [k for k in weights if k != x]
        total = sum(weights.values())
        first = {k: weights[k] / total for k in weights}
        return sum(first[p] * weights[q] / (total - weights[p]) for p, q in ((y, z), (z, y)))

    for k in weights:
        assert share[k] == pytest.approx(left_out(k), abs=0.015)


@settings(max_examples=12, deadline=None)
@given(n=st.integers(0, 300), k=st.integers(0, 320), seed=st.integers(0, 5))
def test_sample_exact_size(spark, n, k, seed):
    df = spark.range(n).select(F.col("id").cast("string").alias("id"))
    got = [r.id for r in sample_exact(df, k, seed).collect()]
    want = sorted((r.u, r.id) for r in df.select("id", uniform(seed, F.col("id")).alias("u")).collect())
    assert sorted(got) == sorted(i for _, i in want[:k])


def test_random_id_batches(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("paper_id"))
    small = rows(random_id_batches(df, 3, 40, 9))
    assert rows(random_id_batches(df.union(df), 3, 40, 9)) == small
    per_batch = [{i for b, i in small if b == n} for n in range(3)]
    assert [len(s) for s in per_batch] == [40, 40, 40] and len(set.union(*per_batch)) > 80


def test_batches_of_any_number_are_the_smallest_ranks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SORT_LIMIT", 20)
    monkeypatch.setattr(sampling, "CELLS", 300)
    df = spark.range(500).select(F.col("id").cast("string").alias("paper_id"))
    ids = [str(i) for i in range(500)]
    got = {}
    for r in random_id_batches(df.union(df), 7, 33, 5).collect():
        got.setdefault(r["batch"], []).append(r["paper_id"])
    for n in range(7):
        want = sorted(ids, key=lambda i: (hashlib.md5(f"5:{n}:{i}".encode()).hexdigest()[:13], i))[:33]
        assert sorted(got[n]) == sorted(want)
    assert random_id_batches(df, 3, 900, 5).count() == 1500 and random_id_batches(df, 0, 9, 5).count() == 0
    plan = random_id_batches(df, 100, 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


def test_a_repeated_key_is_one_row_of_the_order(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SORT_LIMIT", 5)
    df = spark.range(40).select(F.when(F.col("id") < 30, "same").otherwise(F.col("id").cast("string")).alias("id"))
    ranks = {r.id: r.u for r in df.select("id", uniform(3, F.col("id")).alias("u")).distinct().collect()}
    for k in (1, 7, 31, 40):
        got, taken = sample_exact(df, k, 3), 0
        want = []
        for key in sorted(ranks, key=lambda i: (ranks[i], i)):
            if taken < k:
                want.append(key)
                taken += 30 if key == "same" else 1
        assert sorted({r.id for r in got.collect()}) == sorted(want)
