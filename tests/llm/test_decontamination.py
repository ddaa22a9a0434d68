import random
from itertools import combinations

import numpy as np

from feedloom.llm.decontamination import MASKS, SHORTEST, SIMILAR, SPAN, WORDS, contaminated, overlap


def brute(ours, theirs, shift):
    best = 0
    for i in range(len(ours)):
        for j in range(i, len(ours)):
            faced = [0 <= k - shift < len(theirs) and ours[k] == theirs[k - shift] for k in range(i, j + 1)]
            inside = 0 <= i - shift and j - shift < len(theirs)
            if inside and faced[0] and faced[-1] and sum(faced) >= SIMILAR * len(faced) - 1e-9 and len(faced) >= min(WORDS, len(theirs)):
                best = max(best, len(faced))
    return best


def test_overlap():
    draw = random.Random(1)
    for _ in range(60):
        theirs = [draw.randrange(50) for _ in range(draw.randrange(5, 30))]
        ours = [draw.randrange(50) for _ in range(draw.randrange(0, 6))] + [w if draw.random() < 0.85 else -1 for w in theirs]
        shift = len(ours) - len(theirs)
        found = overlap(np.array(ours), np.array(theirs), shift)
        assert (found[1] if found else 0) == brute(ours, theirs, shift)


def test_contaminated(spark):
    draw = random.Random(3)
    word = lambda: "w%d" % draw.randrange(10**6)
    items = [(i, " ".join(word() for _ in range(30 + 9 * i))) for i in range(4)]
    filler = lambda n: " ".join(word() for _ in range(n))
    changed = items[1][1].split()
    for k in range(5, len(changed), 7):
        changed[k] = word()
    docs = [
        (1, filler(50) + " " + items[0][1].upper() + ". " + filler(70)),
        (2, filler(9) + " " + " ".join(changed)),
        (3, items[2][1].replace(" ", ",\n")),
        (4, filler(300)),
        (5, " ".join(items[3][1].split()[:WORDS])),
        (6, filler(20) + " " + " ".join(items[3][1].split()[: SPAN - 1]) + " " + filler(20)),
        (7, None),
        (8, ""),
        (None, items[0][1]),
        (9, items[0][1] + " " + filler(500) + " " + items[1][1]),
    ]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs] + [(1, docs[0][1], 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, (9, None), (10, ""), (11, "too short"), (0, items[0][1])], "item_id long, text string")
    got = contaminated(frame, bench).collect()
    pairs = sorted(((r.doc_id, r.item_id) for r in got), key=str)
    assert pairs == sorted([(1, 0), (2, 1), (3, 2), (5, 3), (None, 0), (9, 0), (9, 1)], key=str)
    first = {(r.doc_id, r.item_id): (r.first_word, r.n_words) for r in got}
    assert first[1, 0] == (50, 30) and first[9, 1] == (530, 39)
    assert contaminated(frame.limit(0), bench).count() == 0
    assert contaminated(frame, bench.limit(0)).count() == 0


def test_masks_find_every_overlap():
    """All ways to substitute a fifth of the words inside an overlap leave one seed whole."""
    marks = [[i for i, c in enumerate(mask) if c == "1"] for mask in MASKS]
    for words in range(WORDS, 21):
        for changed in combinations(range(1, words - 1), int((1 - SIMILAR) * words + 1e-9)):
            gone = set(changed)
            assert any(
                all(p + i not in gone for i in mark) for mark, mask in zip(marks, MASKS) for p in range(words - len(mask) + 1)
            ), changed


def test_all_documents_against_all_items(spark):
    """Every document and item word by word on every diagonal, short items included."""
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 20, 40])]
    docs = []
    for d in range(80):
        words = draw.choice(items)[1].split()
        cut = draw.randrange(len(words))
        words = words[cut:] if draw.random() < 0.2 else words
        words = [draw.choice(vocabulary) if draw.random() < 0.12 else w for w in words]
        docs.append((d, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(30))) + " " + " ".join(words) + " " + "end. " * draw.randrange(3)))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_words for r in contaminated(*frames).collect()}
    want = {}
    for d, text in docs:
        ours = np.array([hash(w) for w in text.replace(".", " ").split()])
        for i, item in items:
            theirs = np.array([hash(w) for w in item.split()])
            best = max((brute(ours.tolist(), theirs.tolist(), s) for s in range(1 - len(theirs), len(ours))), default=0)
            # Short items are sought word for word, and not below SHORTEST words.
            exact = len(theirs) >= SHORTEST and f" {item} " in f" {text.replace('.', ' ')} "
            if best and (len(theirs) >= WORDS or exact or len(theirs) >= SPAN and (d, i) in got):
                want[d, i] = best
    assert got == want and len(want) > 20


def test_equal_items_share_what_is_found(spark):
    draw = random.Random(2)
    passages = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(20)) for _ in range(2)]
    items = [(i, passages[0]) for i in range(50)] + [(7, passages[1]), (None, passages[0])]
    docs = [(1, "x y " + passages[0]), (2, passages[1] + " z"), (3, "nothing")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.first_word, r.n_words) for r in contaminated(*frames).collect()), key=str)
    assert got == sorted([(1, i, 2, 20) for i in [*range(50), None]] + [(2, 7, 0, 20)], key=str)
