"""Ranked lexical search (11): the best documents for each item, found by a search of two trees.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A score is the sum
over an item's terms of a weight by the term's rarity times the term's saturated share of the document, in whole numbers.

Documents are read once per block of items: each task keeps the terms that the block knows, in bundles of many documents.
Document counts and lengths are then summed over all bundles. The search takes the bundles again. Over the documents of a
bundle, ordered by their rarest term, stands a tree whose nodes hold the highest share of each term; over the items stands
another whose nodes hold the highest weight of each term. The product of two nodes is an upper bound on all scores between
them; the pair with the highest bound is opened first, and a pair below the weakest of the k-th scores that its items have
so far is dropped whole, which loses nothing. K-th scores are carried along the bundles of a task, and start from those that
the items reach in SAMPLE of the bundles, so a task hands on few documents that are not among the best.

Items with equal texts are searched once. A block has about BLOCK_BYTES of item text, which bounds what is sent to each task.

Null and empty texts have no terms and so no rows. Repeated rows of either table are documents and items of their own. Of
equal scores, the smaller doc_id is first, and a null one is last. Empty tables give an empty result, other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import slices
from feedloom.session import materialise

K = 20
#: Bytes of item text that are searched for at once; documents of a bundle; documents of a leaf and children of a node.
BLOCK_BYTES, BUNDLE, LEAF, FAN = 1 << 19, 4096, 16, 8
#: Cells of the table of shares over which one tree is built, which bounds its documents. One of so many bundles is searched first.
CELLS, SAMPLE = 1 << 23, 16
#: Bytes that are no part of a term become blanks, A-Z become a-z.
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
LETTERS = bytes(c if c >= 128 or c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
BUNDLES = (
    "bundle long, n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, "
    "bounds array<int>, terms array<int>, counts array<int>"
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def bundles(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Documents that hold a term of the vocabulary, many to a row: term numbers and counts by document.

    n_docs and n_terms are about all documents.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        number = TaskContext.get().partitionId() << 33
        ids, lengths, bounds, found, counts, n_docs, n_terms = [], [], [0], [], [], 0, 0
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = terms(text)
                n_docs += bool(words)
                n_terms += len(words)
                known = Counter(map(vocabulary.get, words))
                known.pop(None, None)
                if known:
                    ids.append(doc)
                    lengths.append(len(words))
                    found.extend(known)
                    counts.extend(known.values())
                    bounds.append(len(found))
            if len(ids) >= BUNDLE or len(found) >= BUNDLE << 8:
                yield _bundle(number, n_docs, n_terms, ids, lengths, bounds, found, counts)
                number += 1
                ids, lengths, bounds, found, counts, n_docs, n_terms = [], [], [0], [], [], 0, 0
        if n_docs:
            yield _bundle(number, n_docs, n_terms, ids, lengths, bounds, found, counts)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, BUNDLES)


def _bundle(number, n_docs, n_terms, *lists) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    names = [field.split()[0] for field in BUNDLES.split(", ")]
    values = [pa.array([x], pa.int64()) for x in (number, n_docs, n_terms)]
    return pa.RecordBatch.from_arrays(values + [pa.array([x], pa.list_(k)) for x, k in zip(lists, kinds)], names=names)


class Items:
    """A tree over items: each node has the terms of its items and their highest weights."""

    def __init__(self, vectors: list[dict[int, int]]):
        #: Items by rarest term, so that neighbours share terms; nodes are (first, end, terms, weights, children).
        self.order = sorted(range(len(vectors)), key=lambda i: max((v, t) for t, v in vectors[i].items())[::-1])
        level = []
        for at, i in enumerate(self.order):
            names = np.array(sorted(vectors[i]), np.int64)
            level.append((at, at + 1, names, np.array([vectors[i][t] for t in names], np.int64), ()))
        while len(level) > 1:
            level = [_parent(level[a : a + FAN]) for a in range(0, len(level), FAN)]
        self.root = level[0]


def _parent(nodes: list[tuple]) -> tuple:
    names, at = np.unique(np.concatenate([n[2] for n in nodes]), return_inverse=True)
    most = np.zeros(len(names), np.int64)
    np.maximum.at(most, at, np.concatenate([n[3] for n in nodes]))
    return nodes[0][0], nodes[-1][1], names, most, tuple(nodes)


class Best:
    """The k best documents of each item so far, and the score that a document needs at least."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.held = [None] * len(least)

    def add(self, item: int, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        new = (scores, nulls, ids)
        if self.held[item] is not None:
            new = tuple(np.concatenate(pair) for pair in zip(self.held[item], new))
        first = np.lexsort((new[2], new[1], -new[0]))[: self.k]
        self.held[item] = new = tuple(x[first] for x in new)
        if len(first) == self.k:
            self.least[item] = max(self.least[item], new[0][-1])


class Documents:
    """A tree over some documents: `levels[0]` has the shares of each document, `levels[1]` the maxima of LEAF documents,
    and each later level those of FAN nodes of the level before."""

    def __init__(self, shares: np.ndarray, nulls: np.ndarray, ids: np.ndarray):
        self.nulls, self.ids = nulls, ids
        self.levels = [shares, np.maximum.reduceat(shares, np.arange(0, len(shares), LEAF))]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN)))

    def children(self, level: int, node: int) -> slice:
        fan = LEAF if level == 1 else FAN
        return slice(fan * node, min(fan * node + fan, len(self.levels[level - 1])))


def search(items: Items, docs: Documents, best: Best) -> None:
    """Add to `best` all documents that are among the k best of an item."""

    def bounds(item: tuple, level: int, nodes: slice) -> np.ndarray:
        # Shares are whole numbers below 2^24; the factor covers what a long sum of doubles may lose.
        return docs.levels[level][nodes][:, item[2]].astype(float) @ item[3] * (1 + 1e-9)

    top = len(docs.levels) - 1
    heap = [(-bounds(items.root, top, slice(0, 1))[0], 0, items.root, top, 0)]
    pushed = 0
    while heap:
        bound, _, item, level, node = heapq.heappop(heap)
        if -bound < best.least[item[0] : item[1]].min():
            continue
        below = docs.children(level, node)
        if level == 1 and not item[4]:
            scores = docs.levels[0][below][:, item[2]].astype(np.int64) @ item[3]
            good = np.flatnonzero(scores >= best.least[item[0]])
            if len(good):
                best.add(item[0], scores[good], docs.nulls[below][good], docs.ids[below][good])
            continue
        if level == 1:
            below, deeper = slice(node, node + 1), 1
        else:
            deeper = level - 1
        for part in item[4] or (item,):
            value, least = bounds(part, deeper, below), best.least[part[0] : part[1]].min()
            for at in np.flatnonzero(value >= least):
                pushed += 1
                heapq.heappush(heap, (-value[at], pushed, part, deeper, below.start + int(at)))


def _trees(row: pa.RecordBatch, width: int, weights: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Documents]:
    """Trees over the documents of one bundle, each within CELLS cells."""
    ids, lengths, bounds, names, tf = (column.flatten() for column in row.columns)
    nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    bounds, names = bounds.to_numpy(), names.to_numpy()
    lengths, tf = lengths.to_numpy().astype(np.int64), tf.to_numpy().astype(np.int64)
    if not len(ids):
        return
    length = 100 - 25 + 25 * lengths * n_docs // n_terms
    owner = np.repeat(np.arange(len(lengths)), np.diff(bounds))
    shares = 1_000_000_000 * tf // (1000 * tf + 12 * length[owner])
    # Documents in the order of the term that is worth most in them.
    worth = np.lexsort((weights[names] * shares, owner))
    rarest = names[worth[bounds[1:] - 1]]
    order = np.lexsort((length, rarest))
    step = max(LEAF, CELLS // max(width, 1))
    for at in range(0, len(order), step):
        some = order[at : at + step]
        table = np.zeros((len(some), width), np.float32)
        for k, doc in enumerate(some):
            mine = slice(bounds[doc], bounds[doc + 1])
            table[k, names[mine]] = shares[mine]
        yield Documents(table, nulls[some], ids[some])


def _best(stored: DataFrame, vectors: list[dict[int, int]], weights: list[int], totals: tuple[int, int], k: int, least: list[int]) -> DataFrame:
    """(item, rank, doc_id, score): the k best documents of each item that reach its least score."""

    def run(batches: Iterator[pa.RecordBatch]):
        items = Items(vectors)
        worth = np.array(weights, np.int64)
        best = Best(k, np.array(least, np.int64)[items.order])
        for batch in batches:
            for at in range(batch.num_rows):
                for tree in _trees(batch.slice(at, 1), len(weights), worth, *totals):
                    search(items, tree, best)
        for at, held in enumerate(best.held):
            if held is not None:
                ids = pa.array(held[2], pa.int64(), mask=held[1])
                item = pa.array([items.order[at]] * len(ids), pa.int32())
                yield pa.RecordBatch.from_arrays([item, ids, pa.array(held[0], pa.int64())], names=["item", "doc_id", "score"])

    found = stored.select("doc_ids", "lengths", "bounds", "terms", "counts").mapInArrow(run, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, keys: list[str], texts: list[str], k: int) -> DataFrame:
    """(key, rank, doc_id, score) for the items of one block."""
    counts = [Counter(terms(text.encode())) for text in texts]
    vocabulary = {term: i for i, term in enumerate(sorted(set().union(*counts)))}
    stored = materialise(bundles(docs, vocabulary), "bundles")
    n_docs, n_terms = stored.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    holding = dict(stored.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weights = [weight(n_docs or 0, holding.get(i, 0)) for i in range(len(vocabulary))]
    vectors = [{vocabulary[t]: weights[vocabulary[t]] * n for t, n in c.items()} for c in counts]
    totals = (n_docs or 0, n_terms or 1)
    sample = stored.where(F.pmod(F.xxhash64("bundle"), F.lit(SAMPLE)) == 0)
    first = _best(sample, vectors, weights, totals, k, [1] * len(texts)).where(F.col("rank") == k)
    reached = dict(first.select("item", "score").collect())
    found = _best(stored, vectors, weights, totals, k, [reached.get(i, 1) for i in range(len(texts))])
    names = docs.sparkSession.createDataFrame(list(enumerate(keys)), "item int, key string")
    return found.join(names, "item").select("key", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) with the highest scores above 0 for each item (item_id, text)."""
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = rows.withColumn("key", F.sha2("text", 256))
    texts = materialise(rows.groupBy("key").agg(F.first("text").alias("text")), "items")
    blocks = math.ceil((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes)
    found = []
    for block in range(blocks):
        mine = texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).collect()
        mine = [(key, text) for key, text in mine if terms(text.encode())]
        if mine:
            found.append(_block(docs, *map(list, zip(*mine)), k))
    if not found:
        return rows.selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score").limit(0)
    return rows.join(reduce(DataFrame.unionByName, found), "key").select("item_id", "rank", "doc_id", "score")
