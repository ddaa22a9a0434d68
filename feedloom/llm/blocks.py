"""Repeated windows across documents: the Spark side of both substring deduplications.

A window is a stretch of fixed length. Every window has an anchor that depends on its content alone; consecutive windows of
one document with equal anchors are a block. Equal windows have equal anchors, so only blocks whose anchor occurs again
can hold repeated windows (a block that repeats itself is marked by an empty block of its anchor), and equal blocks are told once, with their number of copies. What remains is to compare the
different blocks of one anchor. All keys are hashes of content: 64 bits of anchor, and another 64 of a block or of a window of that anchor.

Joins are on anchors, blocks or documents; a hot anchor's blocks are narrow rows, which Spark can split, and are compared
by window fingerprints, which are counted before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import forget, stored
from feedloom.session import materialise

BLOCK = "uid long, start int, size int, anchor long, content long"
KEY = ["anchor", "content", "size"]


def repeated_blocks(rows: DataFrame, cut: Callable, store: bool = False) -> DataFrame:
    """Blocks (BLOCK) whose anchor occurs more than once, from keyed documents; `cut` maps Arrow batches of (uid, text).

    `store` writes all blocks and reads them twice, instead of cutting the texts once to count anchors and once to join.
    """
    spark = rows.sparkSession
    found = rows.select("uid", "text").mapInArrow(cut, BLOCK)
    found, path = stored(found, "all-blocks") if store else (found, None)
    often = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    out = materialise(found.join(often, "anchor").select("uid", "start", "size", "anchor", "content"), "blocks")
    if store:
        forget(spark, path)
    return out


def kinds(blocks: DataFrame) -> DataFrame:
    """Different blocks: KEY, one place (uid, start), copies, number of kinds and of windows that share the anchor."""
    each = blocks.groupBy(*KEY).agg(F.count("*").alias("copies"), F.min(F.struct("uid", "start")).alias("place"))
    each = each.select(*KEY, "copies", "place.uid", "place.start")
    shared = each.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("size").alias("windows"))
    return materialise(each.join(shared, "anchor").select(F.monotonically_increasing_id().alias("kind"), "*"), "kinds")


def wanted(rows: DataFrame, chosen: DataFrame, *more: str) -> DataFrame:
    """(uid, text, places): the documents that hold the place of a chosen kind; `more` names further columns of a place.

    A row that is repeated whole comes once: its copies are dropped in the map tasks.
    """
    places = chosen.groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "size", "copies", "anchor", *more)).alias("places"))
    once = rows.groupBy("uid").agg(F.first("text").alias("text"))
    return once.join(places, "uid").select("uid", "text", "places")


def by_fingerprint(rows: DataFrame, chosen: DataFrame, prints: Callable) -> DataFrame:
    """(kind, from, to): runs of windows of the chosen kinds that occur again, by counting fingerprints of single windows.

    `prints` maps Arrow batches of (uid, text, places) to (kind, at, f, g, copies).
    """
    each = wanted(rows, chosen).mapInArrow(prints, "kind long, at int, f long, g long, copies long").dropDuplicates(["kind", "at", "f", "g"])
    return repeated_runs(each)


def repeated_runs(each: DataFrame) -> DataFrame:
    """(kind, from, to): runs of the windows (kind, at, f, g, copies) whose fingerprints f and g occur again."""
    often = each.groupBy("f", "g").agg(F.sum("copies").alias("n")).where("n > 1").select("f", "g")
    # Windows that follow one another form a run: their distance to their rank in the block is the same.
    rank = F.expr("at - row_number() OVER (PARTITION BY kind ORDER BY at)")
    windows = each.join(often, ["f", "g"]).select("kind", "at").withColumn("run", rank)
    return windows.groupBy("kind", "run").agg(F.min("at").alias("from"), F.max("at").alias("to")).select("kind", "from", "to")


def runs(kind: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """(kind, from, to) of windows given in order."""
    first = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, int)
    last = np.r_[first[1:], len(at)][: len(first)] - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(kind[first]), pa.array(at[first].astype(np.int32)), pa.array(at[last].astype(np.int32))], names=["kind", "from", "to"]
    )


def shards(search: Callable, weight: Callable, limit: int) -> Callable:
    """A function over Arrow batches sorted by anchor: `search` gets lists of (anchor, kind, copies, value) holding all
    rows of their anchors, cut behind an anchor once their weight passes `limit`; it returns (kind, from, to)."""

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for anchor, kind, copies, value in zip(*(c.to_pylist() for c in batch.columns)):
                if size > limit and anchor != last:
                    yield search(held)
                    held, size = [], 0
                held.append((anchor, kind, copies, value))
                size += weight(value)
                last = anchor
        if held:
            yield search(held)

    return run


RUNS = "kind long, `from` int, `to` int"


def spans(blocks: DataFrame, all_kinds: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(uid, spans): what is to be removed per document, as (start, end) of repeated windows.

    `found` (kind, from, to) are runs of repeated windows in kinds with one copy; all windows of other kinds are repeated.
    """
    single = all_kinds.where("copies = 1").select("kind", *KEY).join(found, "kind").select(*KEY, "from", "to")
    whole = all_kinds.where("copies > 1").select(*KEY, F.lit(0).alias("from"), (F.col("size") - 1).alias("to"))
    placed = blocks.where("size > 0").join(single.unionByName(whole), KEY).select(
        "uid", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to") + length).alias("end")
    )
    return placed.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[list[int]] = []
    for span in spans or ():
        if out and span["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], span["end"])
        else:
            out.append([span["start"], span["end"]])
    return [(a, b) for a, b in out]
