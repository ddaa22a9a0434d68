"""BPE encoding and decoding (7): pre-tokens by table, long unsplit text by tree concatenation.

Short pre-tokens are encoded once per task and looked up afterwards. A pre-token of more than LEAF characters is halved
until the halves are short; neighbours are joined bottom-up by encoding a window around the join again, which grows until
its first token is the left side's and its last token the right side's. All neighbouring tokens of the joined list are
then neighbours in some valid encoding, which makes the list the encoding of the whole. A document of more than PIECE
characters is cut at its special strings, which begin and end a text of their own for the vocabulary, and the stretches
between them every PIECE characters; these pieces are encoded in parallel tasks and joined in the same way by stretch.

Null texts are empty texts: no ids, empty decoded text. The end-of-text string in a text becomes its special id, as the
library does. Repeated rows and null ids keep their rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import groupby

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import slices

#: Characters: above LEAF a pre-token is halved; above PIECE a document is dealt to several tasks. Entries of a task's table.
LEAF, PIECE, TABLE = 256, 1 << 16, 300_000
# The pre-token pattern of the vocabulary, \s being the Unicode property White_Space.
_SPACE = r"\p{White_Space}"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
    rf"|{_SPACE}+(?=\Z|{_SPACE})|{_SPACE}+"
)
#: Code points on whose class Unicode versions differ: texts that hold any are split by the library itself.
UNSURE = re.compile("[՘֋֌࢏౜೜₏-\U0010ffff]")


class Codec:
    """One tokenizer file with a table of encoded pre-tokens; made once per task."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.leaf, self.table = leaf, {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.reach = max(map(len, self.special), default=0)
        self.marks = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self.pattern = regex.compile(PATTERN)
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        letters = _byte_letters()
        names = {i: s for s, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.bytes = {i: bytes(letters[c] for c in s) for i, s in names.items()}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}

    def pre_tokens(self, text: str) -> list[str]:
        if UNSURE.search(text):
            return [text[a:b] for _, (a, b) in self.split(text)]
        return self.pattern.findall(text)

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def unsplit(self, text: str) -> list[int]:
        """Ids of text without special strings, halved while it is long."""
        if len(text) <= self.leaf:
            return self._library(text)
        half = len(text) // 2
        return self.join(self.unsplit(text[:half]), self.unsplit(text[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours as one text."""
        if not left or not right:
            return left + right
        i, j = 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            raw = b"".join(map(self.bytes.get, left[-i:] + right[:j]))
            try:
                text = raw.decode("utf-8")
                window = self._library(text)
            except UnicodeDecodeError:  # it begins or ends inside a character
                window = None
            # The text's own ends need no agreement. Else one token must come out as it was, a special string's length away.
            first = i == len(left) or i > 1 and window and window[0] == left[-i] and self._far(left[-i:])
            # White space at the window's end would be split as at a text's end, so it ends with another character.
            last = j == len(right) or window and window[-1] == right[j - 1] and self._far(right[:j]) and not text[-1].isspace()
            if window is not None and first and last:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if first else 2 * i), (j if last else 2 * j)
            if window is None and first and last:
                i, j = 2 * i, 2 * j

    def _far(self, ids: list[int]) -> bool:
        return sum(len(self.bytes[i]) for i in ids) >= self.reach

    def encode(self, text: str) -> tuple[list[tuple], int]:
        """Entries (ids as text, count, bytes) of the pre-tokens of `text` in order."""
        out, at = [], 0
        for mark in self.marks.finditer(text):
            out += self._entries(text[at : mark.start()])
            name = mark.group()
            out.append((str(self.special[name]), 1, name.encode()))
            at = mark.end()
        return out + self._entries(text[at:] if at else text)

    def _entries(self, text: str) -> list[tuple]:
        parts = self.pre_tokens(text)
        table = self.table
        if len(table) > TABLE:
            table.clear()
        for word in set(parts).difference(table):
            ids = self.unsplit(word)
            table[word] = (",".join(map(str, ids)), len(ids), b"".join(map(self.bytes.get, ids)))
        return [table[word] for word in parts]

    def ids(self, text: str) -> list[int]:
        return [int(i) for entry in self.encode(text) if entry[1] for i in entry[0].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.get, ids)).decode("utf-8", "replace")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, by rule: printable bytes stand for
    themselves, the others for the code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    return letters


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def digests(docs: DataFrame, path: str, leaf: int = LEAF, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of `docs` (doc_id, text)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def whole(batches):
        codec = Codec(path, leaf)
        for batch in slices(batches):
            out = []
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entries = codec.encode(words)
                names, counts, raw = zip(*entries) if entries else ((), (), ())
                shown = b"".join(raw).decode("utf-8", "replace").encode()
                out.append((doc, sum(counts), _sha(",".join(names).encode()), _sha(shown)))
            yield _batch(out, schema)

    short = rows.where(F.length("text") <= piece).mapInArrow(whole, schema)
    return short.unionByName(encode_long(rows.where(F.length("text") > piece), path, leaf, piece).mapInArrow(_digest(path), schema))


def _digest(path: str):
    def run(batches):
        codec = Codec(path)
        for batch in batches:
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.append((doc, len(ids), _sha(",".join(map(str, ids)).encode()), _sha(codec.decode(ids).encode())))
            yield _batch(out, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields]
    )


def special_strings(path: str) -> list[str]:
    """The special strings of a vocabulary file."""
    with open(path, encoding="utf-8") as file:
        return [token["content"] for token in json.load(file)["added_tokens"]]


def _pieces(text: str, marks: re.Pattern, piece: int):
    """(stretch, text): the special strings, and the stretches between them in pieces of `piece` characters."""
    at, n = 0, 0
    for start, end in [*(m.span() for m in marks.finditer(text)), (len(text), len(text))]:
        for k in range(at, start, piece):
            yield n, text[k : min(k + piece, start)]
        if start < end:
            yield n + 1, text[start:end]
        at, n = end, n + 2


def encode_long(rows: DataFrame, path: str, leaf: int = LEAF, piece: int = PIECE) -> DataFrame:
    """(doc_id, ids): pieces of each text encoded in parallel tasks, then joined pairwise by document.

    Rows of one id and text are told apart by a number of their own.
    """
    tagged = rows.withColumn("row", F.monotonically_increasing_id())
    marks = re.compile("|".join(map(re.escape, special_strings(path))) or "(?!)")

    def cut(batches):
        for batch in batches:
            for doc, text, row in zip(*(column.to_pylist() for column in batch.columns)):
                parts = list(_pieces(text, marks, piece))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(parts), pa.int64()), pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()),
                     pa.array([n for n, _ in parts], pa.int32()), pa.array([t for _, t in parts], pa.string())],
                    names=["doc_id", "row", "k", "stretch", "text"],
                )

    kinds = "doc_id long, row long, k int, stretch int, text string"
    pieces = tagged.select("doc_id", "text", "row").mapInArrow(cut, kinds).repartition("row", "k")

    def leaves(batches):
        codec = Codec(path, leaf)
        for batch in batches:
            ids = [codec.ids(t) for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "row", "k", "stretch", "ids"])

    encoded = pieces.mapInArrow(leaves, "doc_id long, row long, k int, stretch int, ids array<int>")
    gathered = encoded.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "stretch", "ids"))).alias("nodes")
    )

    def roots(batches):
        codec = Codec(path, leaf)
        for batch in batches:
            out = []
            for nodes in batch.column(1).to_pylist():
                ids = []
                for _, stretch in groupby(nodes, key=lambda n: n["stretch"]):
                    level = [n["ids"] for n in stretch]
                    while len(level) > 1:
                        joined = [codec.join(a, b) for a, b in zip(level[::2], level[1::2])]
                        level = joined + level[len(joined) * 2 :]
                    ids += level[0]
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return gathered.select("doc_id", "nodes").mapInArrow(roots, "doc_id long, ids array<int>")
