"""Token counts (6): unigram segmentation by dynamic programming over a trie of pre-tokens.

A pre-token is a word `[^\\x20\\x09-\\x0D]+` behind the vocabulary's word mark. Each task takes the distinct pre-tokens of its
rows in sorted order, which walks their trie depth first: the forward scores of a shared prefix are computed once and kept
on the path, and each pre-token's count is stored at its end. The best segmentation has the highest sum of piece scores,
and of equal ones the fewest tokens. A character that no piece covers costs UNKNOWN below the lowest score and counts as
one token per byte of UTF-8.

Counting needs no shuffle: a task's table of counts is emptied when it exceeds TABLE words, which changes no result.
Null texts are empty and have no tokens. Repeated rows and null ids keep their rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import slices

MARK, UNKNOWN, TABLE = "▁", 10.0, 300_000


class Vocabulary:
    """Pieces with scores of a sentencepiece file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.load({model.id_to_piece(i): model.get_score(i) for i in plain})

    def load(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        # Lengths of the pieces that end with a given character, so that few cuts are tried.
        ends: dict[str, set[int]] = {}
        for piece in scores:
            ends.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: sorted(n) for c, n in ends.items()}

    @classmethod
    def of(cls, scores: dict[str, float]) -> Vocabulary:
        made = cls.__new__(cls)
        made.load(scores)
        return made

    def counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of each of the distinct words."""
        scores, lengths, out = self.scores, self.lengths, {}
        best, count, last = [0.0], [0], ""
        for word in sorted(words):
            shared, top = 0, min(len(last), len(word))
            while shared < top and last[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                char = word[end - 1]
                value, tokens = best[end - 1] + self.unknown, count[end - 1] + len(char.encode("utf-8", "surrogatepass"))
                for n in lengths.get(char, ()):
                    if n > end:
                        break
                    found = scores.get(word[end - n : end])
                    if found is not None:
                        found += best[end - n]
                        if found > value or found == value and count[end - n] < tokens:
                            value, tokens = found, count[end - n] + 1
                best.append(value)
                count.append(tokens)
            out[word] = count[-1]
            last = word
        return out


def _words(text: str) -> list[str]:
    return [w.decode() for w in text.encode("utf-8", "surrogatepass").split()]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pre_tokens, n_tokens) of every row of `docs` (doc_id, text)."""

    def run(batches):
        vocabulary, table = Vocabulary(path), {}
        for batch in slices(batches):
            texts = [_words(t) for t in batch.column(1).to_pylist()]
            if len(table) > TABLE:
                table.clear()
            new = set().union(*texts).difference(table)
            table |= {word[1:]: n for word, n in vocabulary.counts([MARK + w for w in new]).items()}
            totals = [sum(map(table.__getitem__, words)) for words in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in texts], pa.int64()), pa.array(totals, pa.int64())],
                names=["doc_id", "n_pre_tokens", "n_tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pre_tokens long, n_tokens long")
