import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import recompression
from feedloom.llm.recompression import WINDOW, anchors, hashes, without_repeats


def brute_words(texts, width=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        rest = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(rest)).hexdigest()))
    return out


def made_texts(seed, alphabet=2000):
    draw = random.Random(seed)
    filler = lambda n: [f"w{draw.randrange(alphabet)}" for _ in range(n)]
    passages = [filler(draw.randrange(30, 60)) for _ in range(8)]
    texts = []
    for _ in range(60):
        words = filler(draw.randrange(0, 50))
        for _ in range(draw.randrange(0, 3)):
            p = list(draw.choice(passages))
            if draw.random() < 0.3:
                p[draw.randrange(len(p))] = "changed"
            words += p + filler(draw.randrange(0, 30))
        texts.append(draw.choice([" ", "\n", "  ", "\t\x0b"]).join(words))
    texts += [texts[0], texts[1].replace("\n", " "), None, "", " ", "a " * 200, "a " * 150, "a b " * 120, "x a b " * 90, "a b " * 60 + "c"]
    return texts


@pytest.mark.parametrize("alphabet", [3, 2000])
def test_equal_windows_have_equal_anchors(alphabet):
    draw = random.Random(alphabet)
    base = [f"w{draw.randrange(alphabet)}" for _ in range(300)]
    for _ in range(30):
        at = draw.randrange(0, 300 - WINDOW)
        other = [f"w{draw.randrange(alphabet)}" for _ in range(draw.randrange(40))] + base[at : at + WINDOW]
        place = len(other) - WINDOW
        other += [f"w{draw.randrange(alphabet)}" for _ in range(draw.randrange(40))]
        found = []
        for words, i in ((base, at), (other, place)):
            h = np.r_[hashes(" ".join(words).encode()), np.uint64(0)]
            border = np.zeros(len(h), bool)
            border[-1] = True
            found.append(anchors(h, border)[i])
        assert found[0] == found[1]


@pytest.mark.parametrize("shard", [8, 1 << 18])
def test_without_repeats(spark, monkeypatch, shard):
    monkeypatch.setattr(recompression, "SHARD", shard)
    texts = made_texts(1)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[2], "y"), (4, texts[4], "x"), (4, texts[5], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(3)
    got = [tuple(r) for r in without_repeats(docs).collect()]
    want = [(r[0], *b) for r, b in zip(rows, brute_words([r[1] for r in rows]))]
    assert [x for x in sorted(got, key=str) if x not in want] == [x for x in sorted(want, key=str) if x not in got] == []
    assert sorted(got, key=str) == sorted(want, key=str)
    assert without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [8, 1 << 18])
def test_a_row_repeated_many_times(spark, monkeypatch, shard):
    """Repeated whole, under one id and under null, next to rows that share a part of it."""
    monkeypatch.setattr(recompression, "SHARD", shard)
    draw = random.Random(4)
    filler = lambda n: " ".join(f"w{draw.randrange(5000)}" for _ in range(n))
    passage = filler(50)
    hot = f"{filler(20)} {passage} {filler(40)}"
    rows = [(7, hot)] * 150 + [(None, hot)] * 150 + [(i, f"{filler(30)} {passage} {filler(9)}") for i in range(100, 110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in without_repeats(docs).collect()), key=str)
    assert got == sorted(((r[0], *b) for r, b in zip(rows, brute_words([t for _, t in rows]))), key=str)


def test_small_passes_change_nothing(monkeypatch):
    texts = [" ".join(t.split()).encode() for t in made_texts(3) if t]
    texts.append(b" ".join(texts) * 2)
    whole, words = recompression._blocks(texts), hashes(texts[-1])
    monkeypatch.setattr(recompression, "CHUNK", 37)
    assert (hashes(texts[-1]) == words).all()
    monkeypatch.setattr(recompression, "PASS", 50)
    small = recompression._blocks(texts)

    def each(blocks):
        return {(d, s + i): a for d, s, n, a, _ in zip(*(b.tolist() for b in blocks)) for i in range(n)}

    assert each(whole) == each(small)
