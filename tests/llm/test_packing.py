import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from feedloom.llm.packing import packed, spread

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, sequence_id string, ids int, start double"


def plain(lengths, capacity, width):
    """Longest first into the cheapest sequence with room, one id list at a time."""
    total = sum(lengths)
    sizes = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        sizes.append(1 << rest.bit_length() - 1)
        rest -= sizes[-1]
    bins = [[] for _ in sizes]
    cost = [0.0] * len(sizes)
    used = [0] * len(sizes)
    pieces = sorted(
        ((doc, at, min(capacity, n - at)) for doc, n in enumerate(lengths) for at in range(0, n, capacity)),
        key=lambda piece: -piece[2],
    )
    for doc, start, n in pieces:
        while n:
            open_ = [s for s in range(len(sizes)) if sizes[s] - used[s] >= n] or [s for s in range(len(sizes)) if sizes[s] > used[s]]
            to = min(open_, key=lambda s: (cost[s], s))
            part = min(n, sizes[to] - used[to])
            bins[to].append((doc, start, part, used[to]))
            used[to] += part
            cost[to] += part + part * part / (6 * width) if part < capacity else float("inf")
            start, n = start + part, n - part
    return sorted((d, s, n, to, o) for to, held in enumerate(bins) for d, s, n, o in held)


def test_spread_equals_a_plain_version_and_needs_no_padding():
    draw = random.Random(1)
    for _ in range(150):
        capacity = draw.choice([4, 7, 16, 32])
        lengths = [draw.choice([1, 2, 3, capacity, draw.randrange(1, 5 * capacity)]) for _ in range(draw.randrange(1, 40))]
        pieces = spread(lengths, capacity, 2)
        assert sorted(pieces) == plain(lengths, capacity, 2)
        for sequence in {p[3] for p in pieces}:
            held = sorted((p[4], p[2]) for p in pieces if p[3] == sequence)
            assert [o for o, _ in held] == list(np.cumsum([0] + [n for _, n in held])[:-1])
            size = sum(n for _, n in held)
            assert size == capacity or size & (size - 1) == 0 and size < capacity


def test_costs_are_balanced():
    draw = random.Random(2)
    lengths = [draw.randrange(1, 600) for _ in range(4000)]
    cost = {}
    for _, _, n, sequence, _ in spread(lengths, 2048, 64):
        cost[sequence] = cost.get(sequence, 0) + n + n * n / 384
    full = sorted(cost.values())[10:]
    assert max(full) / min(full) < 1.15


def test_pieces_are_the_ids_of_the_library(spark):
    words = "the of and <|endoftext|> élan  \n日本 x1".split(" ")
    draw = random.Random(3)
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(0, 400))) for _ in range(60)]
    texts += ["", None, "a" * 9000, "the " * 8000, texts[0], texts[0]]
    ids = [*range(len(texts) - 3), None, 7, 7]
    docs = spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in zip(ids, texts)], SCHEMA).repartition(3)
    rows = packed(docs, PATH, capacity=256, pool=3000).collect()
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    want = sorted((i is None, i or 0, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in zip(ids, texts))
    raw, starts = {}, {}
    for row in sorted(rows, key=lambda r: r["start"]):
        assert len(row["ids"]) == 4 * row["length"]
        if row["doc_id"] is not None and row["doc_id"] != 7:
            assert row["start"] == starts.get(row["doc_id"], 0)
            starts[row["doc_id"]] = row["start"] + row["length"]
            raw[row["doc_id"]] = raw.get(row["doc_id"], b"") + bytes(row["ids"])
    for null, doc, tokens in want:
        if not null and doc != 7:
            assert np.frombuffer(raw[doc], "<u4").tolist() == tokens
            assert {r["doc_tokens"] for r in rows if r["doc_id"] == doc} == {len(tokens)}
    assert sum(r["length"] for r in rows) == sum(len(tokens) for _, _, tokens in want)
    sequences = {}
    for row in rows:
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for held in sequences.values():
        size = 0
        for offset, n in sorted(held):
            assert offset == size
            size += n
        assert size == 256 or size < 256 and size & (size - 1) == 0
    assert zlib.crc32(b"") == 0 and packed(docs.limit(0), PATH).count() == 0
