"""Substring dedup over words (2): recompression.

Rounds of recompression name runs of one symbol and pairs of a left and a right symbol. A name is a hash of what it stands
for, and which side a symbol takes is a bit of its name, so all tasks give equal texts equal names without exchanging a
dictionary. With each symbol goes the stretch of words that forces it to appear: any text with that stretch has the symbol
in the same place. The anchor of a window is the highest symbol that the window alone forces, levels from HIGH on counting
alike (of these the smallest name; single words are level 0, so there always is one). Windows that are equal thus share a high-level symbol, and windows
that share one are verified by fingerprints of their words: 64 bits besides the anchor's in shards of whole anchors, and 128
bits, counted window by window, for anchors with more than SHARD / 8 windows.

Null texts have no words. Texts of fewer than WINDOW words have no window and stay whole. Rows repeated whole are separate
occurrences, each with its row in the result; null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.blocks import RUNS, kinds, merged, repeated_blocks, repeated_runs, runs, shards, spans, wanted
from feedloom.llm.common import forget, keyed, release, slices, stored
from feedloom.llm.wordhash import Rolling, byte_values, mixed, word_borders
from feedloom.session import materialise

WINDOW, ROUNDS, HIGH = 35, 6, 2
#: Words that one pass of the rounds takes; bytes whose words are hashed at once.
PASS, CHUNK = 1 << 18, 1 << 20
#: Windows of a shard.
SHARD = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TURNS = np.arange(ROUNDS + 1, dtype=np.uint64) * _ODD
_TOP = np.uint64(2**64 - 1)
_FAR = np.int64(1) << 40
_BYTES = (byte_values(21), byte_values(22))


def hashes(raw: bytes, values: int = 0) -> np.ndarray:
    """The hash of every word, by chunks that end at white space."""
    out, at = [], 0
    rolling = Rolling(0xD6E8FEB86659FD93 + 8 * values)
    while at < len(raw):
        end = at + CHUNK
        if end < len(raw):
            end = max((raw.rfind(b, at, end) for b in b" \n\t\r\x0b\x0c"), default=-1)
            if end <= at:  # one word of more than a chunk
                end = min((e for e in (raw.find(b, at + CHUNK) for b in b" \n\t\r\x0b\x0c") if e >= 0), default=len(raw))
        part = np.frombuffer(raw[at:end], np.uint8)
        start, stop = word_borders(part)
        out.append(rolling.stretch(rolling.prefix(_BYTES[values][part]), start, stop))
        at = end if end > at else at + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class _Symbols:
    """A sequence of symbols: name, and the stretch [left, right) of words that forces it. Borders are forced by nothing."""

    def __init__(self, name, left, right, border):
        self.name, self.left, self.right, self.border = name, left, right, border

    def before(self, values):
        return np.r_[-_FAR, values[:-1]]

    def after(self, values):
        return np.r_[values[1:], _FAR]


def _runs(x: _Symbols):
    """Runs of one symbol become one; each run and single depends on both neighbours being others."""
    new = np.r_[True, (x.name[1:] != x.name[:-1]) | x.border[1:] | x.border[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(new)] - 1
    count = last - first + 1
    name = np.where(count > 1, mixed(x.name[first] * _ODD + count.astype(np.uint64)), x.name[first])
    left = np.minimum(x.left[first], x.before(x.left)[first])
    right = np.maximum(x.right[last], x.after(x.right)[last])
    return _Symbols(name, left, right, x.border[first]), count > 1


def _pairs(x: _Symbols, turn: int):
    """A left symbol and a right one behind it become a pair; others depend on the neighbour they did not pair with."""
    side = (mixed(x.name + _TURNS[turn]) >> np.uint64(40)) & np.uint64(1) == 1
    opens = np.r_[side[:-1] & ~side[1:] & ~x.border[:-1] & ~x.border[1:], False]
    closes = np.r_[False, opens[:-1]]
    right = np.where(opens, x.after(x.right), np.where(side, np.maximum(x.right, x.after(x.right)), x.right))
    left = np.where(~opens & ~side, np.minimum(x.left, x.before(x.left)), x.left)
    follower = np.r_[x.name[1:], np.uint64(0)]
    name = np.where(opens, mixed(mixed(x.name * _ODD) + follower), x.name)
    keep = ~closes
    return _Symbols(name[keep], left[keep], right[keep], x.border[keep]), opens[keep]


def anchors(words: np.ndarray, border: np.ndarray) -> np.ndarray:
    """The anchor of the window that starts at each word; a border (between documents) ends what is before it."""
    n, steps = len(words), (WINDOW - 1).bit_length()
    least = [np.full(n, _TOP) for _ in range(steps)]

    def offer(x: _Symbols, made: np.ndarray, level: int) -> None:
        made = made & ~x.border
        low, high = np.maximum(x.right[made] - WINDOW, 0), x.left[made]
        key = (np.uint64(HIGH - min(level, HIGH)) << np.uint64(60)) | (mixed(x.name[made]) >> np.uint64(4))
        fits = high >= low
        low, high, key = low[fits], high[fits], key[fits]
        level_of = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        for k in range(steps):
            at = level_of == k
            np.minimum.at(least[k], low[at], key[at])
            np.minimum.at(least[k], high[at] - (1 << k) + 1, key[at])

    place = np.arange(n, dtype=np.int64)
    x = _Symbols(words, np.where(border, -_FAR, place), np.where(border, _FAR, place + 1), border)
    offer(x, np.ones(n, bool), 0)
    for turn in range(1, ROUNDS + 1):
        x, runs = _runs(x)
        offer(x, runs, turn)
        x, pairs = _pairs(x, turn)
        offer(x, pairs, turn)
    for k in range(steps - 1, 0, -1):
        half = 1 << (k - 1)
        np.minimum(least[k - 1], least[k], out=least[k - 1])
        np.minimum(least[k - 1][half:], least[k][:-half], out=least[k - 1][half:])
    return least[0]


def _blocks(texts: list[bytes]):
    """(document, start, size, anchor, content) of all blocks, as arrays."""
    out = []
    own = [hashes(t) for t in texts]
    rolling = Rolling(0xA0761D6478BD642F)
    parts = [(d, at, w[at : at + PASS + WINDOW - 1]) for d, w in enumerate(own) for at in range(0, len(w) - WINDOW + 1, PASS)]
    group, held = [], 0
    for part in [*parts, None]:
        if group and (part is None or held + len(part[2]) > PASS):
            out.append(_cut(group, rolling))
            group, held = [], 0
        if part is not None:
            group.append(part)
            held += len(part[2]) + 1
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def _cut(parts, rolling):
    sizes = np.array([len(w) + 1 for *_, w in parts])
    words = np.concatenate([x for *_, w in parts for x in (w, np.zeros(1, np.uint64))])
    stop = np.cumsum(sizes) - 1
    first = stop - sizes + 1
    border = np.zeros(len(words), bool)
    border[stop] = True
    anchor = anchors(words, border)
    part = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(len(words)) - first[part]
    valid = place <= (sizes - 1 - WINDOW)[part]
    begins = valid & np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]
    run = np.flatnonzero(begins)
    begins[valid] |= ((np.arange(len(words)) - run[np.cumsum(begins) - 1]) % (WINDOW - 1) == 0)[valid]
    start = np.flatnonzero(begins)
    end = np.minimum(np.r_[start[1:], len(words)], (stop - WINDOW + 1)[part[start]])
    prefix = rolling.prefix(words)
    content = rolling.stretch(prefix, start, end + WINDOW - 1)
    # A block that holds equal windows itself is named once more, by an empty block, so that its anchor counts as repeated.
    at = np.flatnonzero(valid)
    window, block = rolling.stretch(prefix, at, at + WINDOW), (np.cumsum(begins) - 1)[at]
    own = np.zeros(len(start), bool)
    for step in range(1, WINDOW - 1):
        own[block[step:][(window[step:] == window[:-step]) & (block[step:] == block[:-step])]] = True
    start, size = np.r_[start, start[own]], np.r_[end - start, np.zeros(own.sum(), np.int64)]
    document, offset = (np.array([p[i] for p in parts]) for i in (0, 1))
    return document[part[start]], place[start] + offset[part[start]], size, anchor[start], np.r_[content, content[own]]


def _cut_batches(batches):
    for batch in slices(batches):
        document, start, size, anchor, content = _blocks([t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(document)),
                pa.array(start.astype(np.int32)),
                pa.array(size.astype(np.int32)),
                pa.array(anchor.astype(np.uint64).view(np.int64)),
                pa.array(content.astype(np.uint64).view(np.int64)),
            ],
            names=["uid", "start", "size", "anchor", "content"],
        )


_ROLLING = Rolling(0xE7037ED1A0B428DB), Rolling(0x8EBC6AF09C88C6E3)
PRINTS = "anchor long, kind long, copies long, f array<long>, g array<long>"


def _prints(batches):
    """(anchor, kind, copies, f, g), a row per block with the fingerprints of its windows; g only for hot anchors."""
    for batch in slices(batches):
        kind, start, size, copies, anchor, hot = (c.to_numpy(zero_copy_only=False) for c in batch.column(2).flatten().flatten())
        count = batch.column(2).value_lengths().to_numpy()
        end, found = np.cumsum(count), ([np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)])
        for text, a, b in zip(batch.column(1).to_pylist(), end - count, end):
            raw = text.encode("utf-8", "surrogatepass")
            for k, chosen in enumerate((np.ones(b - a, bool), hot[a:b].astype(bool))):
                if chosen.any():
                    rolling, n = _ROLLING[k], size[a:b][chosen].astype(np.int64)
                    at = np.arange(n.sum()) + np.repeat(start[a:b][chosen] - np.cumsum(n) + n, n)
                    found[k].append(rolling.stretch(rolling.prefix(hashes(raw, k)), at, at + WINDOW))
        lists = [
            pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(f).view(np.int64)))
            for n, f in zip((size, size * hot), found)
        ]
        yield pa.RecordBatch.from_arrays([*map(pa.array, (anchor, kind, copies)), *lists], names=["anchor", "kind", "copies", "f", "g"])


def _search(held: list[tuple]) -> pa.RecordBatch:
    """Windows of a shard whose fingerprints occur again there."""
    rows = {kind: (anchor, copies, prints) for anchor, kind, copies, prints in held}
    sizes = [len(x) for *_, x in rows.values()]
    kind, anchor, copies = (
        np.repeat(np.array(x, np.int64), sizes) for x in (list(rows), [a for a, *_ in rows.values()], [c for _, c, _ in rows.values()])
    )
    at = np.concatenate([np.arange(n) for n in sizes])
    prints = np.concatenate([np.array(x, np.int64) for *_, x in rows.values()])
    order = np.lexsort((prints, anchor))
    same = (prints[order][1:] == prints[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])
    again = copies > 1
    again[order[1:][same]] = again[order[:-1][same]] = True
    return runs(kind[again], at[again])


def _kept(batches):
    for batch in slices(batches):
        out = []
        for doc, text, found in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.encode("utf-8", "surrogatepass").split()
            rest, at = [], 0
            for start, end in merged(found):
                rest += words[at:start]
                at = end
            rest += words[at:]
            out.append((doc, len(words), len(words) - len(rest), hashlib.sha256(b" ".join(rest)).hexdigest()))
        doc, words, removed, digest = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def repeated_words(rows: DataFrame) -> DataFrame:
    """(uid, spans) of keyed documents: stretches of words under a window that starts anywhere else too."""
    blocks = repeated_blocks(rows, _cut_batches, store=True)
    release(rows.sparkSession)
    every = kinds(blocks)
    release(rows.sparkSession)
    hot = (F.col("windows") > SHARD // 8).alias("hot")
    mixed_kinds = every.where("kinds > 1 AND size > 0").select("*", hot)
    prints, path = stored(wanted(rows, mixed_kinds, "hot").mapInArrow(_prints, PRINTS), "prints")
    release(rows.sparkSession)  # the texts shuffled above, before the caller shuffles them again
    lists = prints.where("size(g) = 0").select("anchor", "kind", "copies", "f")
    sharded = lists.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(shards(_search, len, 2 * SHARD), RUNS)
    # A row repeated whole has its blocks in several rows of `prints`.
    single = prints.where("size(g) > 0").dropDuplicates(["kind"]).select("kind", "copies", F.posexplode(F.arrays_zip("f", "g")).alias("at", "p"))
    counted = repeated_runs(single.select("kind", "at", "p.f", "p.g", "copies"))
    found = materialise(sharded.unionByName(counted), "runs")
    del prints, lists, sharded, single, counted
    forget(rows.sparkSession, path)
    release(rows.sparkSession)
    return spans(blocks, every, found, WINDOW)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of `docs` (doc_id, text)."""
    rows = keyed(docs)
    found = rows.join(repeated_words(rows), "uid", "left").select("doc_id", "text", "spans")
    return found.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")
