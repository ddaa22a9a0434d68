"""Packing (12): documents dealt to training sequences of equal length and balanced attention cost.

A document is its ids and one end id. Whole stretches of `capacity` ids are sequences of their own; what is left of each
document goes, longest first, to the sequence of lowest cost that has room for it. The cost of a piece of n ids is estimated
as n + n^2 / (6 * width), the linear work of a layer and the quadratic work of attention inside the piece. A piece that fits
nowhere is cut: the sequence of lowest cost with any room takes its head, and the rest is placed like a piece of its own.

Each task packs pools of POOL ids or one document more, so nothing is shuffled and memory is that of a pool and of the
longest text. A pool of T ids has T div capacity sequences of `capacity` and one for each power of two in the remainder; as
these hold T ids together, every sequence ends up full or at a power of two, and none needs padding. Ids of sequences are the
task's number times 2^33 and a running number: a task that runs again gives the same ones, but they are not consecutive.

Null and empty texts are one end id. Repeated rows and null ids are documents of their own, in the order of the table; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.bpe import UNSURE, Codec
from feedloom.llm.common import slices

CAPACITY, END, POOL = 2048, 1, 1 << 20
#: Width of the model whose costs are balanced.
WIDTH = 1024
# Fixed value: the pre-token pattern of the vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUN = re.compile(r"(?<!\s)\s{10000}")
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Encoder:
    """Ids of whole texts, as little-endian unsigned numbers of 32 bits; `special` strings are special ids or plain text.

    The vocabulary's ids are also the ranks of its merges, so a library of ranks gives the same ids in a quarter of the time.
    Texts with code points on whose class libraries differ go to the vocabulary's own, as do runs of white space beyond RUN.
    """

    def __init__(self, path: str, special: bool = True):
        self.codec, self.special = Codec(path), special
        self.codec.tokenizer.encode_special_tokens = not special
        names = self.codec.special
        ranks = {raw: i for i, raw in self.codec.bytes.items() if i not in names.values()}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=names)

    def ids(self, text: str) -> bytes:
        if UNSURE.search(text) or RUN.search(text):
            return _raw(self.codec._library(text))
        found = self.fast.encode_to_numpy(text, allowed_special="all" if self.special else set(), disallowed_special=())
        return found.astype("<u4").tobytes()


def _raw(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def spread(lengths: list[int], capacity: int = CAPACITY, width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of documents of these lengths, without a gap."""
    total = sum(lengths)
    room = [capacity] * (total // capacity)
    room += [1 << b for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]
    room, pieces, rests, full = np.array(room, np.int64), [], [], 0
    cost, size = np.zeros(len(room)), room.copy()
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((doc, start, capacity, full, 0))
            room[full] = 0
            full += 1
        if n % capacity:
            rests.append((doc, n - n % capacity, n % capacity))
    rests.sort(key=lambda rest: -rest[2])
    for doc, start, n in rests:
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
            to = int(np.where(fits, cost, np.inf).argmin())
            part = min(n, int(room[to]))
            pieces.append((doc, start, part, to, int(size[to] - room[to])))
            cost[to] += part + part * part / (6 * width)
            room[to] -= part
            start, n = start + part, n - part
    return pieces


def packed(docs: DataFrame, path: str, end: int = END, capacity: int = CAPACITY, width: int = WIDTH, pool: int = POOL) -> DataFrame:
    """The pieces of all documents (doc_id, text): where each lies in its document and in its sequence, and its ids."""

    def pools(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
        encoder, names, held, tokens = Encoder(path), [], [], 0
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.ids(text) + _raw([end])
                names.append(doc)
                held.append(ids)
                tokens += len(ids) // 4
                if tokens >= pool:
                    yield names, held
                    names, held, tokens = [], [], 0
        if names:
            yield names, held

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        for names, held in pools(batches):
            pieces = spread([len(ids) // 4 for ids in held], capacity, width)
            for at in range(0, len(pieces), 2000):
                some = pieces[at : at + 2000]
                doc, start, length, sequence, offset = zip(*some)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[d] for d in doc], pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array([len(held[d]) // 4 for d in doc], pa.int64()),
                        pa.array([first + s for s in sequence], pa.int64()),
                        pa.array(offset, pa.int64()),
                        pa.array([held[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc, start, length)], pa.binary()),
                    ],
                    names=[field.split()[0] for field in SCHEMA.split(", ")],
                )
            first += 1 + max(piece[3] for piece in pieces)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, SCHEMA)
