"""Exact-size sampling without gathering the sample anywhere.

A sample of k rows is "the k smallest rows by a seeded random key". Sorting for it would pull k rows
into one task. Instead the position of the k-th row is found from histograms of the key (bounded
counts, the only thing the driver sees), and membership is then a plain row filter against that
position: no sort, no shuffle of the rows, no join back.
"""

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import uniform, uniform_bits
from ..session import materialise

BUCKETS = 4096
SORT_LIMIT = 200_000  # narrow rows that one task may order without effort


@dataclass(frozen=True)
class Cut:
    """The last row to take: rows up to and including (tier, rank, id) are in."""

    tier: int
    rank: float
    id: str

    def includes(self, tier: Column, rank: Column, key: Column) -> Column:
        same = tier == self.tier
        return (
            (tier < self.tier)
            | (same & (rank < self.rank))
            | (same & (rank == self.rank) & (key <= self.id))
        )


def find_cut(df: DataFrame, k, tier: Column, rank: Column, key: Column) -> Cut | None:
    """Position of the k-th row by (tier, rank, key); None when `df` has no more than k rows.

    `k` is a number or a function of the row count. `rank` lies in [0, 1]. `key` should be unique:
    equal keys are taken together.
    """
    rows = df.select(
        tier.cast("int").alias("tier"), rank.alias("rank"), key.cast("string").alias("key")
    )
    low, high, left = 0.0, 1.0, k
    while True:
        width = (high - low) / BUCKETS
        position = F.floor((F.col("rank") - low) / width)
        bucket = F.greatest(F.least(position, F.lit(BUCKETS - 1)), F.lit(0)).cast("int")
        counts = rows.groupBy("tier", bucket.alias("bucket")).count().collect()
        if callable(left):
            left = left(sum(row["count"] for row in counts))
        for row in sorted(counts, key=lambda r: (r["tier"], r["bucket"])):
            if left <= row["count"]:
                break
            left -= row["count"]
        else:
            return None
        rows = rows.where((F.col("tier") == row["tier"]) & (bucket == row["bucket"]))
        low, high = low + row["bucket"] * width, low + (row["bucket"] + 1) * width
        # Stop when the bucket is small enough to order, or cannot be split any further.
        if row["count"] <= SORT_LIMIT or (high - low) / BUCKETS <= math.ulp(high):
            # Rows of one key are one row of this order, however many there are.
            each = rows.groupBy("tier", "rank", "key").agg(F.count("*").alias("n"))
            upto = F.sum("n").over(Window.orderBy("rank", "key"))
            last = each.withColumn("upto", upto).where(F.col("upto") >= left).orderBy("upto").first()
            return Cut(last["tier"], last["rank"], last["key"])


def sample_exact(df: DataFrame, k: int, seed, key: str = "id") -> DataFrame:
    """Exactly min(k, rows) rows, uniformly without replacement; the same ones on every run."""
    if k <= 0:
        return df.where(F.lit(False))
    rank, one = uniform(seed, F.col(key)), F.lit(0)
    cut = find_cut(df, k, one, rank, F.col(key))
    return df if cut is None else df.where(cut.includes(one, rank, F.col(key).cast("string")))


def sample_target(n: int, rate: float) -> int:
    """Size of a sample of `n` rows at a rate: at least one row."""
    return max(1, int(n * rate))


def score_tier(score: Column, high: float, boundary: float) -> Column:
    """1 for scores at or above `high`, 2 from `boundary` up, 3 below and for those that are no number."""
    return F.when(F.isnan(score), 3).when(score >= high, 1).when(score >= boundary, 2).otherwise(3)


def tier_rank(score: Column, u: Column, boundary: float) -> Column:
    """Order within a tier, in [0, 1]: `u` itself, but weighted by score - boundary in tier 2.

    Ranking by -ln(u)/w and taking the smallest draws without replacement in proportion to w
    (Efraimidis and Spirakis 2006). x/(1+x) keeps the order and maps it into [0, 1); rows without
    weight come last, in random order among themselves.
    """
    weight = score - F.lit(boundary)
    x = -F.ln(u) / weight
    return F.when(weight > 0, x / (1.0 + x) * 0.999999).otherwise(0.999999 + u * 0.000001)


def sampling_keys(high: float, boundary: float, seed, key: str, score: str):
    """(tier, rank) columns of the tiered sample."""
    u = uniform(seed, F.col(key))
    tier = score_tier(F.col(score), high, boundary)
    rank = F.when(tier == 2, tier_rank(F.col(score), u, boundary)).otherwise(u)
    return tier, rank


def adaptive_sample(
    df: DataFrame,
    rate: float,
    high: float,
    boundary: float,
    seed,
    include_all: bool = False,
    key: str = "id",
    score: str = "score",
) -> DataFrame:
    """Add `show` (1/0): exactly max(1, int(n * rate)) rows, best score tier first.

    Rows at or above `high` come first, then rows from `boundary` up drawn in proportion to their
    distance from it, then any other rows.
    """
    if include_all:
        return df.withColumn("show", F.lit(1).cast("byte"))
    tier, rank = sampling_keys(high, boundary, seed, key, score)
    cut = find_cut(df, lambda n: sample_target(n, rate), tier, rank, F.col(key))
    shown = F.lit(True) if cut is None else cut.includes(tier, rank, F.col(key).cast("string"))
    return df.withColumn("show", shown.cast("byte"))


#: Histogram cells that the driver holds for all batches together.
CELLS = 1 << 19


def find_cuts(ids: DataFrame, sizes: Sequence[int], seed, key: str) -> list[tuple[int, str] | None]:
    """For each size, the (rank, key) of the last id of a sample drawn with its own seed; None if it takes all ids.

    Ranks are whole numbers of 52 bits. Each level counts, in one job over all batches, the ids by the next bits of their
    rank behind the bits that are settled for the batch, until the ids with equal bits are few enough to order.
    """
    step = max(4, min(12, (CELLS // max(len(sizes), 1)).bit_length() - 1))
    #: By batch: settled bits, their number, and how many ids behind them are still to take.
    spans = {n: (0, 0, k) for n, k in enumerate(sizes)}
    cuts: dict[int, tuple[int, str] | None] = {}
    while spans:
        more = min(step, 52 - max(bits for _, bits, _ in spans.values()))
        rows = _behind(ids, spans, seed, key)
        cell = F.shiftright("rank", 52 - more - next(iter(spans.values()))[1])
        counts: dict[int, dict[int, int]] = {}
        for row in rows.groupBy("batch", cell.alias("cell")).count().collect():
            counts.setdefault(row["batch"], {})[row["cell"]] = row["count"]
        open_, ready = {}, {}
        for n, (_, bits, left) in spans.items():
            cuts[n] = None
            for at, count in sorted(counts.get(n, {}).items()):
                if left <= count:
                    few = count * len(sizes) <= SORT_LIMIT or bits + more == 52
                    (ready if few else open_)[n] = (at, bits + more, left)
                    break
                left -= count
        if ready:
            rows = _behind(ids, ready, seed, key).withColumn(
                "place", F.row_number().over(Window.partitionBy("batch").orderBy("rank", key))
            )
            for row in rows.where("place = left").select("batch", "rank", key).collect():
                cuts[row["batch"]] = (row["rank"], row[key])
        spans = open_
    return [cuts[n] for n in range(len(sizes))]


def _behind(ids: DataFrame, spans: Mapping[int, tuple[int, int, int]], seed, key: str) -> DataFrame:
    """(batch, rank, key, left): the ids in each batch whose rank begins with the settled bits."""
    fields = "array<struct<batch:int,settled:bigint,bits:int,left:bigint>>"
    batches = F.from_json(F.lit(json.dumps([dict(zip(("batch", "settled", "bits", "left"), (n, *span))) for n, span in spans.items()])), fields)
    rows = ids.select(key, F.inline(batches))
    rows = rows.withColumn("rank", uniform_bits(_batch_seed(seed), F.col(key)))
    return rows.where(F.expr("shiftright(rank, 52 - bits) = settled")).select("batch", "rank", key, "left")


def _batch_seed(seed) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), F.col("batch").cast("string"))


def random_id_batches(
    df: DataFrame, batches: int, size: int, seed, key: str = "paper_id"
) -> DataFrame:
    """`batches` random batches of `size` distinct ids, without repeats inside a batch.

    The table is read once for its ids. These are stored, and all batches are drawn from them in the same passes.
    """
    if batches <= 0 or size <= 0:
        return df.select(F.lit(0).alias("batch"), key).limit(0)
    ids = materialise(df.select(key).distinct(), "ids")
    cuts = find_cuts(ids, [size] * batches, seed, key)
    limits = [{"batch": n, "_to": None if cut is None else cut[0], "_last": None if cut is None else str(cut[1])} for n, cut in enumerate(cuts)]
    rows = ids.select(key, F.inline(F.from_json(F.lit(json.dumps(limits)), "array<struct<batch:int,_to:bigint,_last:string>>")))
    rank, last = uniform_bits(_batch_seed(seed), F.col(key)), F.col("_last").cast(df.schema[key].dataType)
    within = F.col("_to").isNull() | (rank < F.col("_to")) | ((rank == F.col("_to")) & (F.col(key) <= last))
    return rows.where(within).select("batch", key)
