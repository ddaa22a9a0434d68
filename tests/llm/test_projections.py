import numpy as np

from feedloom.llm import projections
from feedloom.llm.projections import LEAST, near_vectors


def brute(rows):
    good = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (np.array(v, float) / np.linalg.norm(v), label)
    links = {i: set() for i, *_ in rows}
    for i, (a, x) in good.items():
        for j, (b, y) in good.items():
            if i < j and x == y and len(a) == len(b) and a @ b >= LEAST:
                links[i].add(j)
                links[j].add(i)
    best = {i: i for i in links}
    for _ in links:
        new = {i: min([best[i], *(best[j] for j in links[i])]) if i is not None else None for i in links}
        if new == best:
            break
        best = new
    return {i: (len(links[i]), best[i]) for i in links}


def test_near_vectors(spark, monkeypatch):
    draw = np.random.default_rng(2)
    rows, n = [], 0
    for c in range(40):
        centre = draw.standard_normal(64)
        for _ in range(draw.integers(1, 30) if c else 260):
            noise = draw.standard_normal(64) * draw.choice([0.02, 0.2, 0.26])
            rows.append((n, [float(x) for x in centre + noise], int(c % 2)))
            n += 1
    rows += [(n, None, 0), (n + 1, [0.0] * 64, 0), (n + 2, rows[0][1], None), (n + 3, [None, *rows[0][1][1:]], 0), (n + 4, rows[0][1][:9], 0)]
    rows += [(n + 5, [float("nan")] * 64, 0), (None, rows[0][1], 0), (n + 6, [x * 7 for x in rows[0][1]], 0), (n + 7, [], 0)]
    chain = np.random.default_rng(3).permutation(60)
    rows += [(1000 + int(k), [float(np.cos(i / 4)), float(np.sin(i / 4)) + i / 1000, i / 10], 3) for i, k in enumerate(chain)]
    monkeypatch.setattr(projections, "TILE", 100)
    frame = spark.createDataFrame([(*r, "x") for r in [*rows, rows[3]]], "vec_id long, embedding array<double>, label int, cell string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(frame).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert got == want
    assert near_vectors(frame.limit(0)).count() == 0


def test_repeated_ids_and_extreme_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, "a"), (1, v, None), (1, None, "a"), (1, [0.0] * 3, "a"), (2, v, "a"), (3, [x * 1e200 for x in v], "a"), (4, [x * 1e-200 for x in v], "a"), (5, [x * 1e-310 for x in v], "a")]
    rows += [(6, v, "b"), (7, None, "b"), (7, v, "b"), (8, [float("inf"), 1.0, 1.0], "b"), (9, [], None), (None, v, "a")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4, 5)} == {1: (4, 1, True), **{i: (4, 1, False) for i in (2, 3, 4, 5)}}
    assert got[6] == (1, 6, True) and got[7] == (1, 6, False) and got[8] == (0, 8, True) and got[9] == (0, 9, True)
    assert got[None] == (0, None, True) and len(got) == 10


def test_copies_cost_no_comparisons(spark, monkeypatch):
    monkeypatch.setattr(projections, "TILE", 50)
    draw = np.random.default_rng(5)
    centre = draw.standard_normal(16)
    near = centre + 0.02 * draw.standard_normal(16)
    rows = [(i, [float(x) for x in centre], 1) for i in range(30_000)] + [(40_000 + i, [float(x) for x in near], 1) for i in range(2)]
    rows += [(50_000, [float(x) for x in draw.standard_normal(16)], 1)]
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = {(r.n_links, r.component_id): r.n for r in out.groupBy("n_links", "component_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert got == {(30_001, 0): 30_002, (0, 50_000): 1}
