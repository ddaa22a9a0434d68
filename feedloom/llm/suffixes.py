"""Suffix-array dedup over bytes (9): induced sorting of shards.

The anchor of a 200-byte window is the smallest hash of the strings of GRAM bytes in it, so equal windows of all documents
meet in one shard. A shard is the text of different blocks of some anchors, a separator behind each. Its suffixes are
classified, the leftmost smaller ones are sorted by their substrings (by recursion on their names) and the others are
induced from them, bucket by bucket. Permuted common prefixes with the preceding suffix are computed at irreducible
positions and continued from there; a window is repeated if they reach its length on either side. Names from a large
alphabet leave no buckets worth an array operation, so that level is sorted by doubling instead.

Anchors whose blocks exceed SHARD_BYTES / 4 are split further, down to single windows, which are counted by 128-bit
fingerprints. Texts of fewer than LENGTH bytes have no window and stay whole. Null texts are empty. Rows repeated whole are
separate occurrences, each with its row in the result; null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.blocks import RUNS, by_fingerprint, kinds, merged, repeated_blocks, runs, shards, spans, wanted
from feedloom.llm.common import keyed, release, slices
from feedloom.llm.wordhash import Rolling, byte_values, mixed
from feedloom.session import materialise

LENGTH, GRAM = 200, 32
GRAMS = LENGTH - GRAM + 1
#: Bytes of a shard, windows of a block, bytes hashed at once; alphabets up to BUCKETS are sorted by buckets.
SHARD_BYTES, LONGEST, CHUNK, BUCKETS = 1 << 20, 1 << 15, 1 << 20, 1024
_BYTES = byte_values(31)


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """least() of every `width` consecutive values."""
    done = 1
    while 2 * done <= width:
        values = least(values[:-done], values[done:])
        done *= 2
    return least(values[: len(values) - width + done], values[width - done :]) if width > done else values


def _cut(raw: np.ndarray, stop: np.ndarray, rolling: Rolling):
    """(start, size, anchor, content) of the blocks of joined texts that end at `stop`."""
    prefix = rolling.prefix(_BYTES[raw])
    at = np.arange(len(raw) - GRAM + 1)
    gram = rolling.stretch(prefix, at, at + GRAM)
    least = _sliding(gram, GRAMS, np.minimum)
    text = np.repeat(np.arange(len(stop)), np.diff(np.r_[0, stop]))
    valid = (np.arange(len(least)) + LENGTH) <= stop[text[: len(least)]]
    first = np.r_[0, stop[:-1]]
    begins = valid & np.r_[True, least[1:] != least[:-1]]
    begins[first[first < len(least)]] |= valid[first[first < len(least)]]
    run = np.flatnonzero(begins)
    if not len(run):
        return [np.zeros(0, np.int64)] * 4
    begins[valid] |= ((np.arange(len(least)) - run[np.maximum(np.cumsum(begins) - 1, 0)]) % LONGEST == 0)[valid]
    start = np.flatnonzero(begins)
    end = np.minimum(np.r_[start[1:], len(least)], stop[text[start]] - LENGTH + 1)
    anchor, content = least[start], rolling.stretch(prefix, start, end + LENGTH - 1)
    # A block that holds its anchor twice may repeat itself: it is named once more by an empty block.
    top = np.r_[np.zeros(GRAMS - 1, np.uint64), np.where(valid, least, 0), np.zeros(GRAMS - 1, np.uint64)]
    chosen = np.flatnonzero(gram == _sliding(top, GRAMS, np.maximum))
    low, high = np.searchsorted(chosen, start), np.searchsorted(chosen, end + GRAMS - 1)
    seen, active = np.zeros(len(start), np.int64), np.flatnonzero(low < high)
    while len(active):
        seen[active] += gram[chosen[low[active]]] == anchor[active]
        low[active] += 1
        active = active[(low[active] < high[active]) & (seen[active] < 2)]
    own = seen > 1
    size = np.r_[end - start, np.zeros(own.sum(), np.int64)]
    return np.r_[start, start[own]], size, np.r_[anchor, anchor[own]], np.r_[content, content[own]]


def _pieces(texts: list[bytes]):
    """Groups of (document, offset, bytes), each with all windows that start in it, long texts in pieces."""
    group, held = [], 0
    for d, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, CHUNK):
            part = text[at : at + CHUNK + LENGTH - 1]
            if group and held + len(part) > CHUNK:
                yield group
                group, held = [], 0
            group.append((d, at, part))
            held += len(part)
    if group:
        yield group


def _cut_batches(batches):
    rolling = Rolling(0xD6E8FEB86659FD93)
    for batch in slices(batches):
        for group in _pieces([t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]):
            stop = np.cumsum([len(p) for *_, p in group])
            start, size, anchor, content = _cut(np.frombuffer(b"".join(p for *_, p in group), np.uint8), stop, rolling)
            part = np.searchsorted(stop, start, side="right")
            document, offset = (np.array([g[i] for g in group]) for i in (0, 1))
            place = start - np.r_[0, stop][part] + offset[part]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(document[part])),
                    pa.array(place.astype(np.int32)),
                    pa.array(size.astype(np.int32)),
                    pa.array(anchor.astype(np.uint64).view(np.int64)),
                    pa.array(content.astype(np.uint64).view(np.int64)),
                ],
                names=["uid", "start", "size", "anchor", "content"],
            )


def _classify(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last symbol is unique and smallest."""
    step = np.sign(np.diff(text.astype(np.int64)))
    where = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(where[::-1])[::-1]
    return np.r_[np.r_[step, 1][following] > 0, True]


def _place(order: np.ndarray, text: np.ndarray, rows: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Put suffixes, in their order, at the edges of their buckets and move these."""
    symbols = text[rows]
    by = np.argsort(symbols, kind="stable")
    symbols = symbols[by]
    new = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
    count = np.diff(np.r_[new, len(symbols)])
    rank = np.arange(len(symbols)) - np.repeat(new, count)
    order[edge[symbols] + step * rank] = rows[by]
    edge[symbols[new]] += step * count


def _induce(text: np.ndarray, small: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost smaller ones in theirs."""
    begin = np.r_[0, np.cumsum(sizes)]
    order = np.full(len(text), -1)
    tail = begin[1:] - 1
    _place(order, text, first[::-1], tail, -1)
    used = np.flatnonzero(sizes)
    head = begin[:-1].copy()

    def before(rows):
        return rows[rows > 0] - 1

    for c in used:
        at = begin[c]
        while at < head[c]:
            at, rows = head[c], before(order[at : head[c]])
            rows = rows[~small[rows]]
            if len(rows):
                _place(order, text, rows, head, 1)
        rows = before(order[tail[c] + 1 : begin[c + 1]])
        rows = rows[~small[rows]]
        if len(rows):
            _place(order, text, rows, head, 1)
    tail = begin[1:] - 1
    tail[text[-1]] -= 1  # the last suffix is behind no other
    order[begin[text[-1]]] = len(text) - 1
    for c in used[::-1]:
        at = begin[c + 1] - 1
        while at > tail[c]:
            at, rows = tail[c], before(order[tail[c] + 1 : at + 1][::-1])
            rows = rows[small[rows]]
            if len(rows):
                _place(order, text, rows, tail, -1)
        rows = before(order[begin[c] : head[c]][::-1])
        rows = rows[small[rows]]
        if len(rows):
            _place(order, text, rows, tail, -1)
    return order


def _doubling(text: np.ndarray) -> np.ndarray:
    """Suffix order of names: ranks of twice the length each round, until all differ."""
    rank, width, n = text.astype(np.int64), 1, len(text)
    while True:
        key = rank * (rank.max() + 2) + np.r_[rank[width:] + 1, np.zeros(min(width, n), np.int64)][:n]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.r_[0, np.cumsum(sorted_key[1:] != sorted_key[:-1])]
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """The order of all suffixes of `text`, whose last symbol is 0 and occurs nowhere else."""
    if len(text) == 1:
        return np.zeros(1, np.int64)
    if symbols > BUCKETS:
        return _doubling(text)
    small = _classify(text)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(text, minlength=symbols)
    rough = _induce(text, small, left, sizes)
    slot = np.full(len(text), -1)
    slot[left] = np.arange(len(left))
    sorted_left = slot[rough]
    sorted_left = sorted_left[sorted_left >= 0]
    # Name the substrings from each of them to the next: equal neighbours share a name.
    end = np.r_[left[1:], left[-1]]
    a, b = left[sorted_left[:-1]], left[sorted_left[1:]]
    size_a, size_b = end[sorted_left[:-1]] - a, end[sorted_left[1:]] - b
    differ = size_a != size_b
    open_rows, k = np.flatnonzero(~differ), 0
    while len(open_rows):
        same = text[a[open_rows] + k] == text[b[open_rows] + k]
        differ[open_rows[~same]] = True
        open_rows = open_rows[same & (size_a[open_rows] > k)]
        k += 1
    names = np.empty(len(left), np.int64)
    names[sorted_left] = np.r_[0, np.cumsum(differ)]
    if names[sorted_left[-1]] + 1 == len(left):
        return _induce(text, small, left[sorted_left], sizes)
    return _induce(text, small, left[suffix_array(names, int(names.max()) + 1)], sizes)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position the preceding suffix in order, and the length of their common prefix."""
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n - 1  # the last symbol itself: no common prefix, its own place apart
    back = np.where((np.arange(n) > 0) & (before > 0), text[before - 1] != text[np.arange(n) - 1], True)
    here = np.flatnonzero(back)
    padded = np.r_[text, np.zeros(8, text.dtype)].astype(np.uint8 if text.max() < 256 else np.uint16)
    eight = np.zeros(n + 1, np.uint64)
    for i in range(4 if padded.dtype == np.uint16 else 8):
        width = 16 if padded.dtype == np.uint16 else 8
        eight[:n] |= padded[i : n + i].astype(np.uint64) << np.uint64(width * i)
    step = 4 if padded.dtype == np.uint16 else 8
    length = np.zeros(len(here), np.int64)
    active = np.flatnonzero(before[here] != here)
    while len(active):
        a, b = here[active] + length[active], before[here[active]] + length[active]
        x = eight[np.minimum(a, n)] ^ eight[np.minimum(b, n)]
        whole = x == 0
        low = x & (~x + np.uint64(1))
        bits = np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64)
        length[active] += np.where(whole, step, bits // (64 // step))
        active = active[whole]
    last = np.maximum.accumulate(np.where(back, np.arange(n), 0))
    reach = np.zeros(n, np.int64)
    reach[here] = here + length
    return before, reach[last] - np.arange(n)


def repeated_in_shard(blocks: list[bytes], copies: np.ndarray) -> np.ndarray:
    """Positions, in the blocks joined with one separator behind each, of windows that occur again."""
    raw = np.frombuffer(b"\0".join(blocks) + b"\0\0", np.uint8).astype(np.uint16) + 2
    ends = np.cumsum([len(b) + 1 for b in blocks]) - 1
    raw[ends] = 1
    raw[-1] = 0
    order = suffix_array(raw, 258)
    before, length = common_prefixes(raw, order)
    long = np.flatnonzero(length >= LENGTH)
    again = np.zeros(len(raw), bool)
    again[long] = again[before[long]] = True
    for n in np.flatnonzero(copies > 1):
        again[ends[n] - len(blocks[n]) : ends[n] - LENGTH + 1] = True
    for n in range(len(blocks)):  # what reaches over a block's end is no window
        again[ends[n] - LENGTH + 1 : ends[n] + 1] = False
    return np.flatnonzero(again)


def _texts(batches):
    """(anchor, kind, copies, block) of the places in each document."""
    for batch in slices(batches):
        rows = []
        for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            for p in places:
                if p["size"]:
                    rows.append((p["anchor"], p["kind"], p["copies"], raw[p["start"] : p["start"] + p["size"] + LENGTH - 1]))
        columns = list(zip(*rows)) or [[]] * 4
        kinds_of = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_of)], names=["anchor", "kind", "copies", "block"])


def _search(held: list[tuple]) -> pa.RecordBatch:
    _, kinds_of, copies, blocks = (list(c) for c in zip(*held))
    at = repeated_in_shard(blocks, np.array(copies))
    first = np.cumsum([0, *(len(b) + 1 for b in blocks)])
    block = np.searchsorted(first, at, side="right") - 1
    return runs(np.array(kinds_of, np.int64)[block], at - first[block])


def _prints(batches):
    values = _BYTES, byte_values(32)
    rolling = Rolling(0xE7037ED1A0B428DB), Rolling(0x8EBC6AF09C88C6E3)
    for batch in slices(batches):
        out = [[np.zeros(0, np.int64)] for _ in range(5)]
        for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            for p in places:
                part = np.frombuffer(raw[p["start"] : p["start"] + p["size"] + LENGTH - 1], np.uint8)
                at = np.arange(p["size"])
                both = [r.stretch(r.prefix(v[part]), at, at + LENGTH).view(np.int64) for r, v in zip(rolling, values)] if p["size"] else [at, at]
                for column, value in zip(out, (np.full(len(at), p["kind"]), at, *both, np.full(len(at), p["copies"]))):
                    column.append(value)
        columns = [np.concatenate(c) for c in out]
        columns[1] = columns[1].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "at", "f", "g", "copies"])


def _kept(batches):
    for batch in slices(batches):
        out = []
        for doc, text, found in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode("utf-8", "surrogatepass")
            gone, at, kept = merged(found), 0, hashlib.sha256()
            for start, end in gone:
                kept.update(raw[at:start])
                at = end
            kept.update(raw[at:])
            out.append((doc, len(raw), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
        columns = list(zip(*out))
        kinds_of = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds_of)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def repeated_bytes(rows: DataFrame) -> DataFrame:
    """(uid, spans) of keyed documents: stretches of bytes under a window that starts anywhere else too."""
    blocks = repeated_blocks(rows, _cut_batches)
    release(rows.sparkSession)
    every = kinds(blocks)
    release(rows.sparkSession)
    mixed_kinds = every.where("kinds > 1")
    hot = (F.col("windows") + F.col("kinds") * LENGTH) > SHARD_BYTES // 4
    texts = wanted(rows, mixed_kinds.where(~hot)).mapInArrow(_texts, "anchor long, kind long, copies long, block binary")
    sharded = texts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(shards(_search, len, SHARD_BYTES), RUNS)
    found = materialise(sharded.unionByName(by_fingerprint(rows, mixed_kinds.where(hot), _prints)), "runs")
    del texts, sharded
    release(rows.sparkSession)  # the texts shuffled above, before the caller shuffles them again
    return spans(blocks, every, found, LENGTH)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of `docs` (doc_id, text)."""
    rows = keyed(docs)
    found = rows.join(repeated_bytes(rows), "uid", "left").select("doc_id", "text", "spans")
    return found.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
