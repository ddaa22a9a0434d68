import random

from xxhash import xxh64_intdigest

from feedloom.llm.simhash import fingerprint, near_groups, near_links


def plain(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items):
    """items: (id, fingerprint) -> id: smallest id reachable over at most two differing bits."""
    best = {i: i for i, _ in items}
    changed = True
    while changed:
        changed = False
        for i, f in items:
            low = min(best[j] for j, g in items if (f ^ g).bit_count() <= 2)
            changed |= low < best[i]
            best[i] = low
    return best


def test_fingerprint():
    for text in ["", "a", "a B", "a b c", "A b c d a b c", "é x\x0by\xa0z w", " lots of  words " * 50]:
        assert fingerprint(text) == plain(text)


def test_links_connect_like_all_pairs(spark):
    draw = random.Random(1)
    prints = set()
    for _ in range(12):
        f = draw.getrandbits(64)
        for _ in range(25):
            prints.add(f)
            for _ in range(draw.randrange(1, 4)):
                f ^= 1 << draw.randrange(64)
    prints = sorted(prints)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in prints}
    df = spark.createDataFrame([(signed[f],) for f in prints], "fp long")
    links = {tuple(r) for r in near_links(df).collect()}
    back = {v: k for k, v in signed.items()}
    assert all((back[a] ^ back[b]).bit_count() <= 2 for a, b in links)
    want = brute_components(list(enumerate(prints)))
    place = {signed[f]: i for i, f in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(place[a]), find(place[b])))
        root[y] = x
    assert [find(i) for i in range(len(prints))] == [want[i] for i in range(len(prints))]


def test_groups(spark):
    draw = random.Random(2)
    base = " ".join(draw.choice(["red", "blue", "oak", "elm", "sky"]) + str(draw.randrange(40)) for _ in range(400))
    texts = [base, base.upper(), base.replace("oak", "oaks", 1), None, "", " \t", "one two", "One  two", "entirely other words here"]
    rows = [(i + 5, t, 0, "x") for i, t in enumerate(texts)] + [(5, base, 0, "x"), (None, base, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, a string")
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in near_groups(docs).collect()]
    assert sorted((d is None, d or 0, f) for d, f, _ in got) == sorted((d is None, d or 0, plain(t)) for d, t, *_ in rows)
    want = brute_components([(d, plain(t)) for d, t, *_ in rows if d is not None])
    assert {d: c for d, _, c in got if d is not None} == want
    assert {c for d, _, c in got if d is None} == {want[5]}
    assert near_groups(docs.limit(0)).count() == 0
