"""Benchmark decontamination (8): spaced seeds.

Words are lower-cased, ASCII punctuation counts as white space. Each mask in MASKS is laid on every word position of the
benchmark items and of the documents; the words under its marks are hashed, those under its gaps are ignored, so a seed
survives a substituted word. Test and training seeds are joined on the hash. Around each hit both sides are compared word
by word on the hit's diagonal: an overlap is a stretch of at least WORDS words (or the whole item, if that is shorter) of
which SIMILAR are equal, beginning and ending with equal words. By enumeration the masks find every such overlap of 13 to 20
words. Items of SHORTEST to WORDS - 1 words are sought as a whole, word for word, by a seed over all their words (those of
SPAN or more also by the masks, which miss some of their substitutions); items of fewer words are everyday language and not
sought.

Before the join, training seeds pass a bitmap of the test seeds, whose size is BITMAP_BITS whatever the benchmark; false
positives cost time only. Null or empty texts have no hits. Items repeated under one id merge; repeated documents give the
same rows once. Null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import slices
from feedloom.llm.wordhash import Rolling, byte_values, mixed, word_borders
from feedloom.session import materialise

#: Marks and gaps of the seeds.
MASKS = ("11101011", "110011011", "1101001011", "1101000101")
SPAN, SHORTEST = max(map(len, MASKS)), 4
#: An overlap's least words and share of equal words; words compared on either side of a hit.
WORDS, SIMILAR, AROUND = 13, 0.8, 40
BITMAP_BITS = 1 << 23
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 0x20 for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_ARROW = {"long": pa.int64(), "string": pa.string()}


def text_words(text: str) -> bytes:
    """Lower-cased bytes with ASCII punctuation as blanks."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the place of each text's first word (one more at the end)."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    start, end = word_borders(raw)
    rolling = Rolling(_BASE)
    hashes = rolling.stretch(rolling.prefix(byte_values(8)[raw]), start, end)
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(start, borders)


def whole(words: int) -> str:
    """The mask of a short item: all its words."""
    return "1" * words


def seeds(hashes: np.ndarray, first: np.ndarray, masks: Sequence[str] = MASKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per mask: positions inside one text, and the hash of the words under the marks there."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for mask in masks:
        last = len(hashes) - len(mask) + 1
        if last <= 0:
            continue
        value = np.full(last, int(mask, 2), np.uint64)
        for i, mark in enumerate(mask):
            if mark == "1":
                value = mixed(value + hashes[i : i + last])
        at = np.flatnonzero(text[:last] == text[len(mask) - 1 :])
        yield at, value[at]


def _bits(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.uint64(BITMAP_BITS)
    return value % size, (value >> np.uint64(32)) % size


def item_seeds(items: DataFrame) -> DataFrame:
    """(item, at, seed) of (item, words array<long>)."""

    def run(batches):
        for batch in batches:
            words = [np.array(w, np.int64) for w in batch.column(1).to_pylist()]
            first = np.cumsum([0, *map(len, words)])
            hashes = np.concatenate([*words, np.zeros(0, np.int64)]).view(np.uint64)
            owner = np.repeat(np.arange(len(words)), np.diff(first))
            size = np.diff(first)[owner]
            found = [(at[size[at] >= SPAN], value[size[at] >= SPAN]) for at, value in seeds(hashes, first)]
            for n in range(SHORTEST, WORDS):
                found += [(at[size[at] == n], value[size[at] == n]) for at, value in seeds(hashes, first, [whole(n)])]
            for at, value in found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner[at])), pa.array((at - first[owner[at]]).astype(np.int32)), pa.array(value.view(np.int64))],
                    names=["item", "at", "seed"],
                )

    return items.mapInArrow(run, "item long, at int, seed long")


def item_words(benchmark: DataFrame) -> DataFrame:
    """(key, item, words): a number and the word hashes of each different text; `key` is a hash of the text."""

    def run(batches):
        for batch in slices(batches):
            hashes, first = word_hashes([text_words(t) for t in batch.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "words"])

    found = benchmark.groupBy("key").agg(F.first("text").alias("text")).mapInArrow(run, "key string, words array<long>")
    return found.select("key", F.monotonically_increasing_id().alias("item"), "words")


def bitmap(known: DataFrame) -> np.ndarray:
    """BITMAP_BITS bits, set at two places for each seed; at most BITMAP_BITS / 32 numbers reach the driver."""
    size = F.lit(BITMAP_BITS)
    low = F.pmod("seed", size)  # as of unsigned numbers, since the size is a power of two
    high = F.shiftrightunsigned("seed", 32) % size
    places = known.select(F.explode(F.array(low, high)).alias("p"))
    word, bit = F.floor(F.col("p") / 32).cast("int"), (F.col("p") % 32).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    rows = places.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 32, "<u4")
    for row in rows:
        out[row.word] = row.bits
    return out.view(np.uint8)


def regions(docs: DataFrame, marks: np.ndarray, kind: str = "long", masks: Sequence[str] = MASKS) -> DataFrame:
    """(doc_id, start, words, hits): stretches of each text around its seeds that the bitmap holds; `kind` is the id's type."""
    shared = docs.sparkSession.sparkContext.broadcast(marks.tobytes())  # BITMAP_BITS / 8 bytes

    def run(batches):
        table = np.frombuffer(shared.value, np.uint8)
        for batch in slices(batches):
            hashes, first = word_hashes([text_words(t) for t in batch.column(1).to_pylist()])
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            at, value = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for place, seed in seeds(hashes, first, masks):
                p, q = _bits(seed)
                held = (table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & (table[q >> np.uint64(3)] >> (q & np.uint64(7)).astype(np.uint8)) & 1
                at.append(place[held == 1])
                value.append(seed[held == 1])
            at, value = np.concatenate(at), np.concatenate(value)
            order = np.argsort(at, kind="stable")
            at, value = at[order], value[order]
            out = []
            cut = np.flatnonzero((np.diff(at) > 2 * AROUND) | (np.diff(text[at]) > 0)) + 1 if len(at) else []
            for group in np.split(np.arange(len(at)), cut) if len(at) else []:
                n = text[at[group[0]]]
                start = max(first[n], at[group[0]] - AROUND)
                end = min(first[n + 1], at[group[-1]] + SPAN + AROUND)
                hits = [{"at": int(a - start), "seed": int(s)} for a, s in zip(at[group], value[group].view(np.int64))]
                out.append((batch.column(0)[int(n)].as_py(), int(start - first[n]), hashes[start:end].view(np.int64), hits))
            columns = list(zip(*out)) or [[]] * 4
            kinds = [_ARROW[kind], pa.int32(), pa.list_(pa.int64()), pa.list_(pa.struct([("at", pa.int32()), ("seed", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "words", "hits"])

    rows = docs.select(F.col("doc_id").cast(kind), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, start int, words array<long>, hits array<struct<at:int, seed:long>>")


def overlap(ours: np.ndarray, theirs: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """The longest overlap on a diagonal as (first word of ours, words, equal words); ours[i] faces theirs[i - shift]."""
    low, high = max(0, shift), min(len(ours), len(theirs) + shift)
    if high <= low:
        return None
    same = ours[low:high] == theirs[low - shift : high - shift]
    least = min(WORDS, len(theirs))
    at = np.flatnonzero(same)
    # With S(i) = equal words before i minus SIMILAR times the words, a stretch i..j holds if S(j) >= S(i).
    balance = np.r_[0, np.cumsum(same)] - SIMILAR * np.arange(len(same) + 1)
    best = None
    if len(at):
        begin, end = balance[at], balance[at + 1]
        top = np.maximum.accumulate(end[::-1])[::-1]  # the best end from here on
        for i in range(len(at)):
            if top[i] < begin[i] - 1e-9:
                continue
            j = int(np.flatnonzero(end[i:] >= begin[i] - 1e-9)[-1]) + i
            words = int(at[j] - at[i] + 1)
            if words >= least and (best is None or words > best[1]):
                best = (low + int(at[i]), words, j - i + 1)
            if best and len(same) - at[i] <= best[1]:
                break
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, kind: str = "long") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): the longest overlap of each document and item that overlap.

    `kind`, long or string, is the type of doc_id.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = rows.select("item_id", F.sha2("text", 256).alias("key"), "text")
    items = materialise(item_words(rows), "items")
    names = rows.select("item_id", "key").distinct().join(items.select("key", "item"), "key").select("item_id", "item")
    known = materialise(item_seeds(items.select("item", "words")), "seeds")
    size = F.size("words")
    short = [row.n for row in items.where((size >= SHORTEST) & (size < WORDS)).select(size.alias("n")).distinct().collect()]
    masks = [*MASKS, *map(whole, sorted(short))]
    found = materialise(regions(docs, bitmap(known), kind, masks).select(F.monotonically_increasing_id().alias("region"), "*"), "regions")
    hits = found.select("region", F.explode("hits").alias("h")).select("region", F.col("h.at").alias("place"), "h.seed")
    pairs = hits.join(known, "seed").select("region", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    facing = pairs.join(found.select("region", "doc_id", "start", "words"), "region").join(
        items.select("item", F.col("words").alias("theirs")), "item"
    )

    def run(batches):
        for batch in batches:
            doc, item, start, shift, ours, theirs = (c.to_pylist() for c in batch.columns)
            out = []
            for row in zip(doc, item, start, shift, ours, theirs):
                best = overlap(np.array(row[4], np.int64), np.array(row[5], np.int64), row[3])
                if best:
                    out.append((row[0], row[1], row[2] + best[0], best[1], best[2] / best[1]))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [_ARROW[kind], pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item", "first_word", "n_words", "similarity"])

    checked = facing.select("doc_id", "item", "start", "shift", "words", "theirs").mapInArrow(
        run, f"doc_id {kind}, item long, first_word int, n_words int, similarity double"
    )
    best = F.max(F.struct("n_words", "similarity", (-F.col("first_word")).alias("before"))).alias("b")
    # Ids of equal items, or of one that is repeated, share what is found; an id with several texts has the longest.
    found = checked.groupBy("doc_id", "item").agg(best).join(names, "item")
    return found.groupBy("doc_id", "item_id").agg(F.max("b").alias("b")).select(
        "doc_id", "item_id", (-F.col("b.before")).alias("first_word"), "b.n_words", "b.similarity"
    )
