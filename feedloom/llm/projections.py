"""Embedding near-dedup (1): collision-counting projections.

Unit vectors are projected on the directions of a random rotation. Sorted and cut at a random offset into cells of
WIDTH / sqrt(length), ROUTED of these one-dimensional projections make one table; TABLES tables deal the vectors to lists, so that a pair of
cosine LEAST misses all of them with a probability of about 4e-5 and closer pairs less often. Within a list, collisions are
counted in windows centred on each vector: over all COUNTED projections, how many differ by WINDOW at most. As the rotation
keeps distances, a pair of cosine LEAST or more can exceed the window in at most (2 - 2 LEAST) / WINDOW^2 of them, which
fixes the count that pairs must reach; the remaining ones are verified by their cosine in double precision.

A list of more than TILE vectors is cut into blocks, and each pair of blocks is a task's group of its own, so no list is
gathered whole. A pair that meets in several tables counts in the first. Links leave a group as one edge per vector and
the number of its partners, never as pairs.

Equal vectors of one label are compared as one, their first, which counts as many times as there are; so copies cost no
comparisons, whatever their number.

Labels must be equal and not null. Null vectors, zero vectors, vectors with null or non-finite components, and vectors of
different lengths link with nothing. Rows repeated under one id count once, with the smallest label and vector that can
link; null ids keep one row without links. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.graph import components
from feedloom.session import materialise

LEAST = 0.93
TABLES, ROUTED, WIDTH = 14, 6, 2.9
COUNTED, WINDOW, TILE, SEED = 32, 0.14, 1024, 1
#: Pairs looked at together.
PAIRS = 1 << 17


#: Rotations and routes by length of the vectors, kept by each process.
_KEPT: dict[tuple[str, int], object] = {}


def rotation(size: int) -> np.ndarray:
    if ("rotation", size) not in _KEPT:
        _KEPT["rotation", size] = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))[0]
    return _KEPT["rotation", size]


def _routes(size: int) -> tuple[np.ndarray, np.ndarray]:
    if ("routes", size) not in _KEPT:
        _KEPT["routes", size] = _drawn_routes(size)
    return _KEPT["routes", size]


def _drawn_routes(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per table: directions of its projections, and the offsets of its cuts."""
    draw = np.random.default_rng(SEED + 1)
    directions = np.concatenate([np.linalg.qr(draw.standard_normal((size, size)))[0] for _ in range(-(-TABLES * ROUTED // size))], axis=1)
    return directions[:, : TABLES * ROUTED], draw.random(TABLES * ROUTED)


def cells(unit: np.ndarray) -> np.ndarray:
    """The cell of each unit vector in each table."""
    directions, offset = _routes(unit.shape[1])
    cut = np.floor(unit @ directions * (np.sqrt(unit.shape[1]) / WIDTH) + offset).astype(np.int64).reshape(len(unit), TABLES, ROUTED)
    return (cut + 64) @ (128 ** np.arange(ROUTED, dtype=np.int64))


def _units(vectors) -> np.ndarray:
    matrix = np.array(vectors, np.float64)
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)  # else squares may overflow or vanish
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def usable() -> Column:
    """Whether a row (vec_id, label, embedding) can link."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    return F.coalesce(there & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))


def _route(batches):
    for batch in batches:
        vectors = batch.column(1).to_pylist()
        out = np.zeros((len(vectors), TABLES), np.int64)
        sizes = np.array([len(v) for v in vectors])
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            out[rows] = cells(_units([vectors[i] for i in rows]))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * TABLES), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["vec_id", "cells"])


def _pairs(start: np.ndarray, end: np.ndarray):
    """Index pairs (i, j), i in a run, j from i + 1 to the run's end, in portions; start and end per index of i."""
    i = np.arange(len(end))
    count = end - i - 1
    while len(i):
        total = np.cumsum(count)
        take = max(1, int(np.searchsorted(total, PAIRS, side="right")))
        a = np.repeat(i[:take], count[:take])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[:take] - count[:take], count[:take])
        yield a, b
        i, count = i[take:], count[take:]


def _links(unit, own, side, keys, table, run):
    """Pairs of rows in the same run that link, pairs of two blocks only across, each in its first table only."""
    size = unit.shape[1]
    spread = unit @ rotation(size)[:, : min(COUNTED, size)]
    needed = spread.shape[1] - int((2 - 2 * LEAST) / WINDOW**2)
    found = []
    for a, b in _pairs(run[0], run[1]):
        keep = (side[a] != side[b]) | (side[a] == 2)
        a, b = a[keep], b[keep]
        hits = (np.abs(spread[a] - spread[b]) <= WINDOW).sum(axis=1)
        a, b = a[hits >= needed], b[hits >= needed]
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= LEAST
        a, b = a[near], b[near]
        earlier = (keys[a] == keys[b]) & (np.arange(TABLES) < table[a][:, None])
        first = ~earlier.any(axis=1)
        found.append((a[first], b[first]))
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
    return a, b


def _smallest(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row the row with the smallest id that the pairs (a, b) connect it to."""
    order = np.argsort(own, kind="stable")
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own))
    label, a, b = np.arange(len(own)), rank[a], rank[b]
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return order[label[rank]]
        label = new


def _count(batches):
    """(vec_id, to_id, links): per row and group the number of its partners, and the smallest id they connect it to."""
    rest = []
    for batch in batches:
        whole = pa.Table.from_batches([*rest, batch])
        group = np.array(whole.column("group_id"))
        last = int(np.argmax(group == group[-1])) if len(group) else 0
        rest = whole.slice(last).combine_chunks().to_batches()
        yield from _group(whole.slice(0, last))
    if rest:
        yield from _group(pa.Table.from_batches(rest))


def _group(rows: pa.Table):
    vectors = rows.column("embedding").to_pylist()
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        group, own, side, table = (np.array(rows.column(c))[at] for c in ("group_id", "vec_id", "side", "table"))
        new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        end = np.r_[new[1:], len(group)]
        runs = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
        unit = _units([vectors[i] for i in at])
        a, b = _links(unit, own, side, cells(unit), table, (new[runs], end[runs]))
        # Each partner counts as often as its vector occurs.
        copies = np.array(rows.column("copies"))[at]
        links = np.zeros(len(own), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        to = own[_smallest(own, a, b)]
        shown = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own[shown]), pa.array(to[shown]), pa.array(links[shown])], names=["vec_id", "to_id", "links"]
        )


def linked(good: DataFrame) -> DataFrame:
    """(vec_id, to_id, links): per vector and group of a list, the links counted there and the smallest id connected.

    `good`: usable (vec_id, label, embedding, copies), each id once.
    """
    routed = good.select("vec_id", "embedding").mapInArrow(_route, "vec_id long, cells array<long>")
    posts = materialise(good.select("vec_id", "label").join(routed, "vec_id").select("vec_id", "label", F.posexplode("cells").alias("table", "cell")), "posts")
    lists = posts.groupBy("table", "label", "cell").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / TILE).cast("int")
    dealt = posts.join(lists, ["table", "label", "cell"]).withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    # Block pairs (low, high); side 2 marks the pairs of a block with itself.
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(
            F.least(o, F.col("own")).alias("low"),
            F.greatest(o, F.col("own")).alias("high"),
            F.when(o == F.col("own"), 2).when(o > F.col("own"), 0).otherwise(1).alias("side"),
        ),
    )
    tiled = dealt.withColumn("own", own).select("vec_id", "table", "label", "cell", F.explode(tiles).alias("t"))
    named = tiled.select("vec_id", "table", F.xxhash64("table", "label", "cell", "t.low", "t.high").alias("group_id"), "label", "cell", "t.side")
    full = named.join(good.select("vec_id", "embedding", "copies"), "vec_id").select("group_id", "table", "vec_id", "side", "embedding", "copies")
    return full.repartition("group_id").sortWithinPartitions("group_id", "table").mapInArrow(_count, "vec_id long, to_id long, links long")


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every distinct vec_id of `vectors` (vec_id, embedding, label)."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("string").alias("label"),
    )
    rows = rows.withColumn("bad", ~usable()).groupBy("vec_id").agg(F.min(F.struct("bad", "label", "embedding")).alias("v")).select("vec_id", "v.*")
    # 128 bits of hash stand for a label and vector.
    same = {f"same_{i}": F.xxhash64(F.lit(i), "label", "embedding") for i in range(2)}
    rows = materialise(rows.withColumns(same), "vectors")
    one = rows.where("NOT bad").groupBy(*same).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    one = materialise(one, "distinct-vectors")
    good = rows.join(one.select("vec_id", "copies"), "vec_id").select("vec_id", "label", "embedding", "copies")
    found = materialise(linked(materialise(good, "representatives")), "vector-links")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("to_id").alias("b")))
    one = one.join(counts, "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
        *same, (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component"), F.lit(False).alias("bad")
    )
    out = rows.select("vec_id", "bad", *same).join(one, ["bad", *same], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
