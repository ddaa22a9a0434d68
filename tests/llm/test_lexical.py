import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import lexical
from feedloom.llm.lexical import Best, Documents, Items, ranked, search, terms

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, k):
    """Every item against every document."""
    held = [(i, Counter(words(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t in words(text)
                if c[t]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def texts(draw, n, longest=60):
    vocabulary = [f"w{i}" for i in range(80)] + ["Äpfel", "äpfel", "THE", "the", "a1_b2", "日本"]
    rarity = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(draw.choices(vocabulary, rarity, k=draw.randrange(longest))) + draw.choice(["", ".", "\x7f"]) for _ in range(n)]


def test_terms_are_the_matches_of_the_pattern():
    draw = random.Random(1)
    for _ in range(500):
        text = "".join(draw.choice("aZ09_-[]{}@`/:\x00\x7f\x80é日\n  ") for _ in range(30))
        assert [t.decode() for t in terms(text.encode())] == words(text)


@pytest.mark.parametrize("cells, bundle, block", [(1 << 23, 4096, 1 << 19), (400, 7, 300), (1, 3, 1 << 19)])
def test_ranking_equals_a_plain_version(spark, monkeypatch, cells, bundle, block):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "BUNDLE", bundle)
    monkeypatch.setattr(lexical, "SAMPLE", 3)
    draw = random.Random(cells)
    docs = list(enumerate(texts(draw, 150)))
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(None, docs[5][1]), (3, docs[3][1]), (3, docs[3][1]), (900, None), (901, ""), (902, "?!")]
    items = list(enumerate(texts(draw, 30, 25))) + [(50, docs[5][1]), (50, docs[5][1]), (None, "w1 w1 w2"), (60, None), (61, " "), (62, "unknown")]
    draw.shuffle(docs)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, score int").repartition(5)
    q = spark.createDataFrame([(i, t, 1, "k") for i, t in items], "item_id long, text string, doc_id int, key string")
    got = sorted(map(tuple, ranked(d, q, 6, block).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain(docs, items, 6)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, items in ((d.limit(0), q), (d, q.limit(0)), (d.limit(0), q.limit(0))):
        assert ranked(docs, items).count() == 0
        assert ranked(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_whole_batches_are_pruned():
    """Clustered documents: items of one cluster never open the leaves of another."""
    shares = np.zeros((1600, 100), np.float32)
    for doc in range(1600):
        shares[doc, doc // 16] = 1000 + doc
    opened = []
    docs = Documents(shares, np.zeros(1600, bool), np.arange(1600))
    children = docs.children
    docs.children = lambda level, node: opened.append((level, node)) or children(level, node)
    best = Best(5, np.ones(100, np.int64))
    search(Items([{i: 3} for i in range(100)]), docs, best)
    assert all(sorted(held[2]) == list(range(16 * i + 11, 16 * i + 16)) for i, held in enumerate(best.held))
    assert sum(level == 1 for level, _ in opened) < 1000  # of 100 x 100 pairs of item and leaf
