import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import suffixes
from feedloom.llm.suffixes import common_prefixes, suffix_array, without_repeats


@pytest.mark.parametrize("letters", ["a", "ab", "abcd", "abcdefghijklmnopqrstuvwxyz"])
@pytest.mark.parametrize("buckets", [1024, 3])
def test_suffix_array(monkeypatch, letters, buckets):
    draw = random.Random(len(letters))
    for _ in range(40):
        raw = "".join(draw.choice(letters) for _ in range(draw.randrange(1, 300))).encode()
        raw += raw[: draw.randrange(200)]
        text = np.r_[np.frombuffer(raw, np.uint8).astype(np.uint16) + 2, np.uint16(0)]
        order = suffix_array(text, 258)
        values = text.tolist()
        assert order.tolist() == sorted(range(len(text)), key=lambda i: values[i:])
        before, length = common_prefixes(text, order)
        for x, y in zip(order[:-1], order[1:]):
            n = 0
            while x + n < len(values) and y + n < len(values) and values[x + n] == values[y + n]:
                n += 1
            assert before[y] == x and length[y] == n
    monkeypatch.setattr(suffixes, "BUCKETS", buckets)


def brute_bytes(texts, width=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        n_spans = int((gone[1:] > gone[:-1]).sum() + gone[0]) if len(r) else 0
        out.append((len(r), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def made_texts(seed):
    draw = random.Random(seed)
    filler = lambda n: "".join(draw.choice("abcdefgé  \n") for _ in range(n))
    passages = [filler(draw.randrange(150, 500)) for _ in range(6)]
    texts = []
    for _ in range(50):
        text = filler(draw.randrange(0, 400))
        for _ in range(draw.randrange(0, 3)):
            p = draw.choice(passages)
            if draw.random() < 0.4:
                k = draw.randrange(len(p))
                p = p[:k] + "#" + p[k + draw.randrange(2) :]
            text += p + filler(draw.randrange(0, 200))
        texts.append(text)
    texts += [texts[0], None, "", "a" * 199, "b" * 200, "c" * 201, "d" * 900, "ef" * 300, "x" + "ghi" * 150, passages[0][:200], "abc" * 70]
    return texts


@pytest.mark.parametrize("hot", [False, True])
def test_without_repeats(spark, monkeypatch, hot):
    texts = made_texts(2)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 2000 if hot else 1 << 20)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[2], "y"), (4, texts[4], "x"), (4, texts[5], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(3)
    got = [tuple(r) for r in without_repeats(docs).collect()]
    want = [(r[0], *b) for r, b in zip(rows, brute_bytes([r[1] for r in rows]))]
    assert [x for x in sorted(got, key=str) if x not in want] == [x for x in sorted(want, key=str) if x not in got] == []
    assert len(got) == len(want)
    assert without_repeats(docs.limit(0)).count() == 0


def test_small_pieces_change_nothing(monkeypatch):
    texts = [t.encode() for t in made_texts(5) if t]
    texts.append(b"".join(texts) * 2)
    rolling = suffixes.Rolling(77)

    def each():
        out = {}
        for group in suffixes._pieces(texts):
            stop = np.cumsum([len(p) for *_, p in group])
            start, size, anchor, _ = suffixes._cut(np.frombuffer(b"".join(p for *_, p in group), np.uint8), stop, rolling)
            for s, n, a in zip(start.tolist(), size.tolist(), anchor.tolist()):
                k = int(np.searchsorted(stop, s, side="right"))
                d, at, _ = group[k]
                place = s - int(np.r_[0, stop][k]) + at
                out |= {(d, place + i): a for i in range(n)}
        return out

    whole = each()
    assert len(whole) == sum(max(0, len(t) - 199) for t in texts)
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    assert each() == whole
