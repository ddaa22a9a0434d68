"""SimHash near-dedup (4): a byte-position inverted index with count filtering.

Two fingerprints of 64 bits that differ in at most two bits differ in at most two of their eight bytes, so they share at
least six positional bytes. A posting list per single byte would hold 1/256 of all fingerprints and a tally over it all
pairs of them, so the index lists the 28 sets of six positions: a pair's tally reaches six exactly if it meets in one of
these lists. A list has 16 free bits, hence at most 65,536 distinct fingerprints, whatever the input. Within a list,
fingerprints meet at the values one bit away from both, which chains them in linear space; each chained pair's tally and
distance are then verified.

Null texts are empty; texts without words have fingerprint zero and link like any other. Copies share one fingerprint and
enter the index once. A null doc_id keeps its row, and its component is that of its fingerprint. Repeated rows keep their
rows. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from feedloom.llm.common import slices
from feedloom.llm.graph import components
from feedloom.session import materialise

#: Words of a shingle, seed of its hash, differing bits that still link.
SHINGLE, SEED, BITS = 3, 42, 2
#: For each list, the two byte positions that are left free.
FREE = list(combinations(range(8), BITS))
MASKS = [(1 << 64) - 1 - sum(0xFF << (8 * i) for i in pair) for pair in FREE]
NEEDED = 8 - BITS


def fingerprint(text: str) -> int:
    """Bit b is set if more than half the hashes of the shingles (repeats included) have it set."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # for bytes, A-Z and ASCII white space only
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(words, words[1:], words[2:]))
    count = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count)
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(count, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fingerprint as a signed long) for every row, and after them the columns `more`, which are strings."""

    def run(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            columns = [batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", *more])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long"), text, *more)
    return rows.mapInArrow(run, ", ".join(["doc_id long, fp long", *[f"`{c}` string" for c in more]]))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _chain(place: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that chain all fingerprints of each list (place, key) lying at most two bits apart; rows sorted by list."""
    new = np.r_[True, (place[1:] != place[:-1]) | (key[1:] != key[:-1])]
    group = np.cumsum(new) - 1
    shared = np.bincount(group)[group] > 1
    group, fp, place = group[shared], fp[shared], place[shared]
    if not len(fp):
        return fp, fp
    shifts = np.array([[8 * p + b for p in pair for b in range(8)] for pair in FREE], np.uint64)[place]
    met = np.concatenate([fp[:, None], fp[:, None] ^ (np.uint64(1) << shifts)], axis=1)
    owner = np.repeat(np.arange(len(fp)), met.shape[1])
    met = met.ravel()
    order = np.lexsort((met, group[owner]))
    owner, met, at = owner[order], met[order], group[owner][order]
    next_same = (met[1:] == met[:-1]) & (at[1:] == at[:-1])
    return fp[owner[:-1][next_same]], fp[owner[1:][next_same]]


def _verified(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    differ = (a ^ b).view(np.uint8).reshape(-1, 8)
    tally = (differ == 0).sum(axis=1)
    near = (tally >= NEEDED) & (np.bitwise_count(differ).sum(axis=1) <= BITS)
    pairs = np.unique(np.stack([a[near], b[near]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _link_lists(batches):
    """Verified pairs of each posting list; a list that a batch cuts off is carried over."""
    rest = None
    for batch in batches:
        place, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if rest is not None:
            place, key, fp = (np.concatenate(x) for x in zip(rest, (place, key, fp)))
        if not len(fp):
            continue
        last = int(np.argmax((place == place[-1]) & (key == key[-1])))
        rest = place[last:], key[last:], fp[last:]
        yield from _links(place[:last], key[:last], fp[:last])
    if rest is not None:
        yield from _links(*rest)


def _links(place, key, fp):
    if len(fp):
        a, b = _verified(*_chain(place, key, fp.view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["fa", "fb"])


def near_links(prints: DataFrame) -> DataFrame:
    """(fa, fb): links that connect all distinct fingerprints of `prints` (fp) at most two bits apart."""
    masked = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in MASKS])
    posts = prints.select("fp", F.posexplode(masked).alias("place", "key")).select("place", "key", "fp")
    parted = posts.repartition("place", "key").sortWithinPartitions("place", "key")
    return parted.mapInArrow(_link_lists, "fa long, fb long").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable over links."""
    prints = materialise(fingerprints(docs), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = near_links(first.where("first IS NOT NULL").select("fp"))
    named = links.join(first.select(F.col("fp").alias("fa"), F.col("first").alias("a")), "fa").join(
        first.select(F.col("fp").alias("fb"), F.col("first").alias("b")), "fb"
    )
    joined = first.join(components(named.select("a", "b")), F.col("first") == F.col("node"), "left")
    groups = joined.select("fp", F.coalesce("component", "first").alias("component_id"))
    return prints.join(groups, "fp", "left").select("doc_id", "fp", "component_id")


def one_of_near(docs: DataFrame, key: str) -> DataFrame:
    """(key): the key of one row of each near-duplicate group, the smallest by (doc_id, key), where rows have a string `key`.

    Groups are made of fingerprints, so rows of one id with texts that are not near are in groups of their own. Rows with
    null ids do not link: they keep their keys unless a row with an id has their fingerprint.
    """
    prints = materialise(fingerprints(docs, key), "fingerprints")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", key))
    first = materialise(prints.groupBy("fp").agg(F.min(named).alias("first")), "first")
    links = near_links(first.where("first IS NOT NULL").select("fp"))
    groups = components(links.select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    joined = first.where("first IS NOT NULL").join(groups, F.col("fp") == F.col("node"), "left")
    least = joined.groupBy(F.coalesce("component", "fp").alias("group")).agg(F.min("first").alias("first"))
    alone = prints.where("doc_id IS NULL").select("fp", key).distinct().join(first.where("first IS NULL"), "fp", "left_semi")
    return least.select(F.col("first")[key].alias(key)).unionByName(alone.select(key))
