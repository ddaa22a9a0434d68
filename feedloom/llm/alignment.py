"""Cross-tokenizer alignment (13): tokens of two vocabularies that end together, and how often each pair does so corpus-wide.

The byte-level vocabulary (A) encodes a blank and the text, the piece vocabulary (B) the text, before which it puts a blank
itself. Where tokens of both end, the text is cut into groups, and the two tokens are linked; a token has one byte at least,
so one of each ends there. Many texts are aligned at once, on arrays of their bytes. Both vocabularies begin a new token at a
blank between two characters that are no white space, so long texts are encoded in parts that are cut there.

Counting is an external sort that spills. A task makes a chunk of some megabytes of text into records of (B id, A id,
document, links), deals them to RADICES by the B id, and writes each radix of a chunk as two zstd runs, one with the sorted
pairs and their counts and one with the documents. Runs of one radix are merged by a heap, FAN_IN at a time and in as many
rounds as that takes, so no task meets more than FAN_IN runs and a pair of all documents is a handful of counts. The last
round reads one B id after the other and marks the pairs with its highest count. Of two linked tokens one ends with the other,
so there are at most as many pairs as the bytes of both vocabularies: the marked pairs are bounded whatever the corpus, and
travel to the document runs, which stay where they are. Each run gives its documents' shares, added up by document.

Null and empty texts, and texts that one of the vocabularies does not reproduce byte by byte, have no tokens: zeros and empty
groups. Repeated rows and null ids keep their rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import slices
from feedloom.llm.packing import Encoder
from feedloom.session import materialise

#: Parts of the pairs by B id; runs that one task merges; characters of a chunk, and of a part of a text.
RADICES, FAN_IN, CHUNK, PART = 32, 64, 1 << 22, 1 << 16
#: A blank between characters that are no white space: both vocabularies begin a token there.
CUT = re.compile(r"(?<=\S) (?=\S)")
SPILLED = (
    "chunk long, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "radix int, pairs binary, records binary"
)


class Aligned(NamedTuple):
    """Texts that were aligned together; `links` are B id x 2^32 + A id, in the order of the texts."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    links: np.ndarray


class Side:
    """The tokens of one vocabulary, as bytes in one array and as decimal ids with the two separators that may follow."""

    def __init__(self, tokens: list[bytes], end: str):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        #: Row 2 i is id i and a comma, row 2 i + 1 the id and `end`, which closes its part of a group.
        self.names = [f"{i}{mark}".encode() for i in range(len(tokens)) for mark in (",", end)]

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - sizes), sizes)]


class Aligner:
    """Both vocabularies; made once per task."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.encoder = Encoder(a_path, special=False)
        self.b = SentencePieceProcessor(model_file=b_path)
        known = self.encoder.codec.bytes
        self.sides = (
            Side([known.get(i, b"") for i in range(max(known) + 1)], "|"),
            Side([self._piece(i) for i in range(self.b.vocab_size())], ";"),
        )
        names = self.sides[0].names + self.sides[1].names
        width = max(map(len, names))
        self.letters = np.frombuffer(b"".join(n.ljust(width, b"\0") for n in names), np.uint8).reshape(-1, width)
        self.widths = np.array([len(n) for n in names], np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def align(self, texts: list[str]) -> Aligned:
        """A text that either vocabulary does not reproduce has no tokens, as an empty one."""
        raw = [(" " + text).encode() if text else b"" for text in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        tokens = [self._encoded(texts, side) for side in (0, 1)]
        good = sizes > 0
        for side, ids in zip(self.sides, tokens):
            for k, own in enumerate(ids):
                good[k] &= bool(len(own)) and int(side.lengths[own].sum()) == sizes[k]
        whole = np.frombuffer(b"".join(r for r, ok in zip(raw, good) if ok), np.uint8)
        kept, ends = np.flatnonzero(good), np.cumsum(sizes[good])
        for side, ids in zip(self.sides, tokens):
            wrong = np.flatnonzero(side.spelled(_joined([ids[k] for k in kept])) != whole)
            good[kept[np.unique(np.searchsorted(ends, wrong, "right"))]] = False
        return self._aligned(len(texts), np.flatnonzero(good), sizes[good], [[ids[k] for k in np.flatnonzero(good)] for ids in tokens])

    def _encoded(self, texts: list[str], side: int) -> list[np.ndarray]:
        parts, owner = [], []
        for k, text in enumerate(texts):
            mine = _parts(text) if text else []
            parts += mine
            owner += [k] * len(mine)
        if side == 0:
            found = [np.frombuffer(self.encoder.ids(" " + part), "<u4") for part in parts]
        else:
            found = [np.array(ids, np.uint32) for ids in self.b.encode(parts, num_threads=1)]
        held: list[list[np.ndarray]] = [[] for _ in texts]
        for k, ids in zip(owner, found):
            held[k].append(ids)
        return [_joined(ids) for ids in held]

    def _aligned(self, n: int, kept: np.ndarray, sizes: np.ndarray, tokens: list[list[np.ndarray]]) -> Aligned:
        ids = [_joined(side) for side in tokens]
        counts = [np.array([len(x) for x in side], np.int64) for side in tokens]
        ends = [np.cumsum(side.lengths[own]) for side, own in zip(self.sides, ids)]
        total = int(sizes.sum())
        meet = np.zeros(total + 1, np.int8)
        for side in ends:
            meet[side] += 1
        last = [meet[side] == 2 for side in ends]
        a_last, b_last = (np.flatnonzero(x) for x in last)
        links = ids[1][b_last].astype(np.int64) << 32 | ids[0][a_last]
        # Written order: a group's A tokens stand behind all B tokens of earlier groups, its B tokens behind its A tokens.
        a_group, b_group = (np.cumsum(x) - x for x in last)
        before = np.concatenate([[0], b_last[:-1] + 1]) if len(b_last) else np.zeros(0, np.int64)
        order = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        order[np.arange(len(ids[0])) + before[a_group]] = 2 * ids[0].astype(np.int64) + last[0]
        order[np.arange(len(ids[1])) + a_last[b_group] + 1] = len(self.sides[0].names) + 2 * ids[1].astype(np.int64) + last[1]
        said = self._written(order)
        stops = np.cumsum(np.add.reduceat(self.widths[order], np.cumsum(sum(counts)) - sum(counts))) if len(kept) else []
        out = Aligned(*[np.zeros(n, np.int64) for _ in range(3)], [""] * n, links)
        out.n_a[kept], out.n_b[kept] = counts
        out.n_links[kept] = np.diff(np.searchsorted(ends[0][a_last], np.cumsum(sizes), "right"), prepend=0)
        for k, start, stop in zip(kept, [0, *stops], stops):
            out.groups[k] = said[start : stop - 1].decode()
        return out

    def _written(self, order: np.ndarray) -> bytes:
        """The decimal ids and separators, in pieces that keep the padded letters small."""
        out = []
        for at in range(0, len(order), 1 << 18):
            letters = self.letters[order[at : at + (1 << 18)]].reshape(-1)
            out.append(letters[letters != 0].tobytes())
        return b"".join(out)


def _joined(ids: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(ids) if ids else np.zeros(0, np.uint32)


def _parts(text: str) -> list[str]:
    """The text in parts of about PART characters, cut at blanks between characters that are no white space."""
    parts, at = [], 0
    while len(text) - at > PART:
        cut = CUT.search(text, at + PART)
        if cut is None:
            break
        parts.append(text[at : cut.start()])
        at = cut.end()
    return [*parts, text[at:]]


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _unpack(run: bytes, *kinds: str) -> list[np.ndarray]:
    """Columns of equal length of a run."""
    raw = zstandard.ZstdDecompressor().decompress(run)
    n, out, at = len(raw) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _runs(links: np.ndarray, doc: np.ndarray, radices: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(radix, pairs, records) of the links of a chunk; `doc` has the document of each and rises."""
    order = np.argsort(links, kind="stable")
    links, doc = links[order], doc[order]
    first = np.flatnonzero(np.diff(links, prepend=-1).astype(bool) | np.diff(doc, prepend=-1).astype(bool))
    times = np.diff(first, append=len(links))
    links, doc = links[first], doc[first]
    radix = (links >> 32) % radices
    for r in range(radices):
        mine = np.flatnonzero(radix == r)
        if len(mine):
            names, at = np.unique(links[mine], return_index=True)
            held = np.diff(at, append=len(mine))
            yield r, _pack(names, np.add.reduceat(times[mine], at)), _pack(
                np.repeat(np.arange(len(names)), held).astype(np.uint32), doc[mine].astype(np.uint32), times[mine].astype(np.uint32)
            )


def spilled(docs: DataFrame, a_path: str, b_path: str, chunk_size: int = CHUNK, radices: int = RADICES) -> DataFrame:
    """Two kinds of rows: documents with their groups (`doc` is not null), and the runs of a chunk's records by radix."""
    names = [field.split()[0] for field in SPILLED.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    kinds = [kinds[field.split()[1]] for field in SPILLED.split(", ")]

    def runs(chunk: int, links: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for run in _runs(np.concatenate(links), np.concatenate(owners), radices):
            row = (chunk, *[None] * 7, *run)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    def run(batches):
        aligner, chunk = Aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        links, owners, n_docs, size = [], [], 0, 0
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            found = aligner.align(texts)
            numbers = range(n_docs, n_docs + len(texts))
            columns = [[chunk] * len(texts), numbers, batch.column(0), found.n_a, found.n_b, found.n_links, found.n_links, found.groups]
            columns += [[None] * len(texts)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            links.append(found.links)
            owners.append(np.repeat(np.arange(n_docs, n_docs + len(texts)), found.n_links))
            n_docs += len(texts)
            size += sum(map(len, texts))
            if size >= chunk_size:
                yield from runs(chunk, links, owners)
                links, owners, n_docs, size, chunk = [], [], 0, 0, chunk + 1
        if n_docs:
            yield from runs(chunk, links, owners)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, SPILLED)


def _merged(runs: list[bytes]) -> Iterator[tuple[int, int]]:
    """(pair, count) of sorted runs in order."""
    streams = [zip(*(c.tolist() for c in _unpack(run, "<i8", "<i8"))) for run in runs]
    last, total = -1, 0
    for pair, count in chain(heapq.merge(*streams), [(-2, 0)]):
        if pair != last:
            if last >= 0:
                yield last, total
            last, total = pair, 0
        total += count


def _merge(table: pa.Table) -> pa.Table:
    made = np.array(list(_merged(table["pairs"].to_pylist())), np.int64).reshape(-1, 2)
    return pa.table({"radix": table["radix"].slice(0, 1), "part": table["part"].slice(0, 1), "pairs": pa.array([_pack(*made.T)])})


def pair_counts(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(radix, b_id, a_id, n, best): how often each pair is linked, and whether no other A id is linked to the B id more often."""
    schema = "radix int, part long, pairs binary"
    parts = runs.select("chunk").distinct().count()
    level = runs.select("radix", F.col("chunk").alias("part"), "pairs")
    while parts > 1:
        parts = -(-parts // fan_in)
        dealt = level.withColumn("part", F.pmod(F.xxhash64("part", F.lit(parts)), F.lit(parts)))
        level = materialise(dealt.groupBy("radix", "part").applyInArrow(_merge, schema), "merged")

    def best(batches):
        for batch in batches:
            for radix, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs, counts = _unpack(run, "<i8", "<i8")
                b = pairs >> 32
                first = np.flatnonzero(np.diff(b, prepend=-1))
                highest = np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(b)))
                columns = [pa.array(np.full(len(b), radix), pa.int32()), pa.array(b), pa.array(pairs & 0xFFFFFFFF), pa.array(counts)]
                columns.append(pa.array(counts == highest))
                yield pa.RecordBatch.from_arrays(columns, names=["radix", "b_id", "a_id", "n", "best"])

    return level.select("radix", "pairs").mapInArrow(best, "radix int, b_id long, a_id long, n long, best boolean")


def aligned(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    keep: Callable[[Column], Column] = lambda groups: groups,
    chunk_size: int = CHUNK,
    radices: int = RADICES,
    fan_in: int = FAN_IN,
) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) and the pairs of `pair_counts`.

    `keep` is what to store of a document's groups, such as a digest of them.
    """
    made = spilled(docs, a_path, b_path, chunk_size, radices)
    stored = materialise(made.withColumn("groups", keep(F.col("groups"))), "spilled")
    runs = stored.where("doc IS NULL").select("chunk", "radix", "pairs", "records")
    counts = materialise(pair_counts(runs, fan_in), "pairs")
    known = counts.select((F.shiftleft("b_id", 32) + F.col("a_id")).alias("pair"), "n", "best").orderBy("pair").toArrow()
    names, n, top = (known.column(c).to_numpy() for c in ("pair", "n", "best"))

    def shares(batches):
        """Adds up what the records of a chunk, which mostly stand together, give to its documents."""
        chunk, best, total = None, {}, {}

        def flush():
            columns = [[chunk] * len(total), list(total), list(best.values()), list(total.values())]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "doc", "n_best", "count_sum"])

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                now, pairs, records = (row.column(c)[0].as_py() for c in ("chunk", "pairs", "records"))
                if now != chunk and total:
                    yield flush()
                    best, total = {}, {}
                chunk = now
                which, doc, times = _unpack(records, "<u4", "<u4", "<u4")
                at_pair = np.searchsorted(names, _unpack(pairs, "<i8", "<i8")[0])[which]
                times = times.astype(np.int64)
                docs_here, where = np.unique(doc, return_inverse=True)
                for values, sums in ((times * top[at_pair], best), (times * n[at_pair], total)):
                    added = np.zeros(len(docs_here), np.int64)
                    np.add.at(added, where, values)
                    for d, v in zip(docs_here.tolist(), added.tolist()):
                        sums[d] = sums.get(d, 0) + v
        if total:
            yield flush()

    back = runs.mapInArrow(shares, "chunk long, doc int, n_best long, count_sum long")
    back = back.groupBy("chunk", "doc").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = stored.where("doc IS NOT NULL").select("chunk", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    rows = rows.join(back, ["chunk", "doc"], "left").drop("chunk", "doc")
    return rows.fillna(0, ["n_best", "count_sum"]), counts
