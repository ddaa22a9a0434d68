"""Toxicity (5): classification by compressed length under zstandard dictionaries.

A window is one lower-cased word, written several times so that block overhead weighs the same for every window. It is
compressed under a dictionary of ordinary text and under those of toxic text, which together hold all telling words: the
words with the highest log-odds are in the first, and a dictionary ends where the log-odds have fallen by BAND or its bytes
are full. A window has a cell for each toxic dictionary: the dictionary, the word's length, the bytes saved. Thresholds are
calibrated on labelled texts that the dictionaries were not made from: a cell that saves bytes counts as toxic if almost only
toxic texts show it. Scoring asks only dictionaries that have toxic cells of the word's length. A document's score is the
share of toxic texts among those of about its length with as many toxic windows; where few are known, that share among texts
of any length counts as well.

Fitting reads at most SAMPLE labelled rows per label and fold, in the order of a hash, whole and each distinct text once;
scoring reads every whole text. Without labelled rows of both kinds every score is the share of label 1, or 0.
Null and empty texts have no windows. Several labels of one document count as toxic if any does. A null doc_id is scored
and never held out. Repeated rows keep their rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from feedloom.llm.common import slices
from feedloom.session import materialise

#: Labelled rows per label and fold that a model is fitted on at most.
SAMPLE = 4000
#: Bytes of the dictionaries (of the first toxic one: each is twice as large as the one before, up to ORDINARY_BYTES);
#: documents a word must occur in; how much likelier it must be in toxic text.
ORDINARY_BYTES, TOXIC_BYTES, ORDINARY_DOCS, TOXIC_DOCS, LIKELIER = 100_000, 3_000, 2, 3, 4.0
#: How far log-odds fall within one toxic dictionary.
BAND = 2.0
#: A toxic cell: seen in so many toxic documents at least, and in so few ordinary ones for each of these at most.
CELL_DOCS, CELL_ORDINARY = 2, 0.05
#: Copies of a word in its window; longest word length told apart; toxic windows told apart one by one, and by doublings
#: from there on; windows a task remembers.
ECHO, LENGTHS, COUNTS, TABLE = 4, 12, 3, 200_000
#: Windows of the shortest length class, each further class doubling them; as how many texts the share of any length counts.
SHORT, PRIOR = 1024, 4
FOLDS = 5
_WORD = re.compile(r"[^\W\d_]+")


def windows(text: str | None) -> list[bytes]:
    return [w.encode() for w in _WORD.findall((text or "").lower())]


@dataclass
class Model:
    """What scoring needs: dictionary contents, toxic cells, score by toxic windows, also for each length class known."""

    ordinary: bytes
    toxic: tuple[bytes, ...]
    cells: frozenset = frozenset()
    scores: tuple[float, ...] = (0.0,)
    by_length: dict = field(default_factory=dict)
    _table: dict = field(default_factory=dict)
    _tools: tuple = ()
    _asked: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_table": {}, "_tools": (), "_asked": {}}

    def cells_of(self, word: bytes, asked=None) -> list[tuple[int, int, int]]:
        """(toxic dictionary, length class, bytes it saves), for the dictionaries asked or all."""
        if not self._tools:
            self._tools = tuple(map(_compressor, (self.ordinary, *self.toxic)))
        echo = (b" " + word) * ECHO + b" "
        length, plain = min(len(word), LENGTHS), len(self._tools[0].compress(echo))
        asked = range(len(self.toxic)) if asked is None else asked
        return [(k, length, plain - len(self._tools[k + 1].compress(echo))) for k in asked]

    def is_toxic(self, word: bytes) -> bool:
        found = self._table.get(word)
        if found is None:
            if not self._asked:
                self._asked = {n: sorted({k for k, m, _ in self.cells if m == n}) for n in range(LENGTHS + 1)}
            if len(self._table) >= TABLE:
                self._table.clear()
            asked = self._asked[min(len(word), LENGTHS)]
            found = self._table[word] = bool(asked) and not self.cells.isdisjoint(self.cells_of(word, asked))
        return found

    def standing(self, text: str | None) -> tuple[int, int]:
        """(length class of the text, level of its number of toxic windows)."""
        words = windows(text)
        n = sum(map(self.is_toxic, words)) if self.cells else 0
        return (len(words) // SHORT).bit_length(), n if n < COUNTS else COUNTS - 1 + (n // COUNTS).bit_length()

    def score(self, text: str | None) -> float:
        length, level = self.standing(text)
        scores = self.by_length.get(length, self.scores)
        return scores[min(level, len(scores) - 1)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        3, min_match=3, window_log=18, write_content_size=False, write_dict_id=False, write_checksum=False
    )
    learned = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    learned.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=learned, compression_params=params)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS: 0 is held out, 1 calibrates, the others make the dictionaries."""
    return F.crc32(doc_id.cast("string")) % FOLDS


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, fits) of the sample a model is fitted on, each distinct text of a label once."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .withColumn("fits", fold_of(F.col("doc_id")) > 1)
        .where(fold_of(F.col("doc_id")) != 0)
    )
    parts = [
        known.where((F.col("toxic") == toxic) & (F.col("fits") == fits)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        for toxic in (0, 1)
        for fits in (True, False)
    ]
    sample = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (
        text.where(F.length("text") > 0)
        .join(F.broadcast(sample), "doc_id")  # at most 4 x SAMPLE ids
        .groupBy("text", "toxic")
        .agg(F.max("fits").alias("fits"))
    )


def _shown(rows: DataFrame, units, kind: str) -> DataFrame:
    """(toxic, unit, docs): in how many texts of each label each distinct unit occurs."""

    def run(batches):
        for batch in slices(batches):
            counts = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((toxic, unit) for unit in set(units(text)))
            keys = list(counts)
            yield pa.RecordBatch.from_pydict(
                {"toxic": [k[0] for k in keys], "unit": [k[1] for k in keys], "docs": list(counts.values())},
                schema=pa.schema([("toxic", pa.int32()), ("unit", pa.string()), ("docs", pa.int64())]),
            )

    found = rows.select("text", "toxic").mapInArrow(run, f"toxic int, unit {kind}, docs long")
    return found.groupBy("unit").agg(
        *[F.sum(F.when(F.col("toxic") == k, F.col("docs")).otherwise(0)).alias(n) for k, n in ((0, "plain"), (1, "bad"))]
    )


def _content(words: list[str]) -> bytes:
    """A dictionary of the words, the first at the end, where a match costs least."""
    return b" " + b"  ".join(w.encode() for w in reversed(words)) + b" " * 8


def _ordinary(words: DataFrame) -> bytes:
    """The words that most texts show, up to ORDINARY_BYTES."""
    kept, size = [], 0
    for row in words.orderBy(F.desc("plain"), "unit").limit(ORDINARY_BYTES // 2).select("unit").collect():
        size += len(row.unit.encode()) + 2
        if size > ORDINARY_BYTES:
            break
        kept.append(row.unit)
    return _content(kept)


def _toxic(words: DataFrame, plain: int, bad: int) -> tuple[bytes, ...]:
    """Dictionaries of all the words; at most the vocabulary of the sample's toxic texts reaches the driver."""
    odds = lambda n, of: F.log((F.col(n) + 0.5) / (F.lit(of) - F.col(n) + 0.5))
    rows = words.select("unit", (odds("bad", bad) - odds("plain", plain)).alias("odds")).orderBy(F.desc("odds"), "unit").collect()
    parts, size, limit, top = [[]], 0, TOXIC_BYTES, rows[0].odds if rows else 0.0
    for row in rows:
        more = len(row.unit.encode()) + 2
        full = parts[-1] and size + more > limit
        if full or row.odds < top - BAND:
            parts.append([])
            size, limit, top = 0, min(2 * limit, ORDINARY_BYTES) if full else limit, row.odds
        parts[-1].append(row.unit)
        size += more
    return tuple(map(_content, parts))


def _shares(seen: dict[int, tuple[int, int]], prior, weight: float) -> tuple[float, ...]:
    """Share of toxic texts by level, never falling, of level -> (toxic, ordinary) texts; `prior` of a level has `weight`."""
    out, least = [], 0.0
    for n in range(max(COUNTS, *seen, 0) + 1):
        bad, plain = seen.get(n, (0, 0))
        least = max(least, (bad + weight * prior(n)) / (bad + plain + weight))
        out.append(least)
    return tuple(out)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows outside the held-out fold."""
    sample = materialise(labelled(docs, labels), "labelled")
    sizes = {(r.fits, r.toxic): r["count"] for r in sample.groupBy("fits", "toxic").count().collect()}
    plain, bad = sizes.get((True, 0), 0), sizes.get((True, 1), 0)
    total = sum(sizes.values())
    share = sum(v for (_, toxic), v in sizes.items() if toxic) / total if total else 0.0
    if not plain or not bad:
        return Model(_content([]), (_content([]),), scores=(share,))
    words = materialise(_shown(sample.where("fits"), lambda t: [w.decode() for w in windows(t)], "string"), "words")
    telling = words.where(F.col("bad") >= TOXIC_DOCS).where((F.col("bad") / bad) >= LIKELIER * (F.col("plain") + 0.5) / plain)
    model = Model(_ordinary(words.where(F.col("plain") >= ORDINARY_DOCS)), _toxic(telling, plain, bad))
    rest = sample.where("NOT fits")
    shown = lambda t: {"%d:%d:%d" % c for w in set(windows(t)) for c in model.cells_of(w) if c[2] > 0}
    cells = _shown(rest, shown, "string").where(F.col("bad") >= CELL_DOCS)
    toxic_cells = cells.where(F.col("plain") <= CELL_ORDINARY * F.col("bad")).select("unit").collect()  # at most LENGTHS x 100 a dictionary
    model.cells = frozenset(tuple(map(int, r.unit.split(":"))) for r in toxic_cells)
    seen, every = {}, {}
    for r in _shown(rest, lambda t: ["%d:%d" % model.standing(t)], "string").collect():  # a few levels of each length class
        length, level = map(int, r.unit.split(":"))
        seen.setdefault(length, {})[level] = (r.bad, r.plain)
        bad, plain = every.get(level, (0, 0))
        every[level] = (bad + r.bad, plain + r.plain)
    model.scores = _shares(every, lambda n: 0.5 if n else share, 1)
    any_length = lambda n: model.scores[min(n, len(model.scores) - 1)]
    model.by_length = {length: _shares(levels, any_length, PRIOR) for length, levels in seen.items()}
    return model


def score(docs: DataFrame, model: Model, into: str = "toxicity") -> DataFrame:
    """`docs` with the score of `text` as the double column `into`; a column of that name is replaced."""
    names = [c for c in docs.columns if c != into]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = StructType([*rows.schema.fields, StructField(into, DoubleType())])

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = pa.array([model.score(t) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, into])

    return rows.mapInArrow(run, schema)
