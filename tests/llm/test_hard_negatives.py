import math
import random

import numpy as np

from precis.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>, a string, v int, score int"


def brute(rows, every=100, k=5):
    kept = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        kept.append((i, label, tuple(math.floor(256 * x) for x in v)))

    def order(hits):
        return sorted(hits, key=lambda h: (-h[1], h[0] is None, h[0] or 0))
    out = []
    for i, label, q in {r for r in kept if r[0] is not None and r[0] % every == 0}:
        scored = [(j, sum(a * b for a, b in zip(q, w)), m) for j, m, w in kept if j != i]
        for j, s, _ in order([h for h in scored if h[2] == label])[:k]:
            fit = order([h for h in scored if h[2] != label and 80 * s <= 100 * h[1] <= 100 * s])[:k]
            out += [(i, j, n + 1, m, s, t) for n, (m, t, _) in enumerate(fit)]
    return sorted(out, key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, m, v, "x", 1, 2) for i, m, v in rows], SCHEMA)
    out = hn.mine(df, **how)
    assert out.columns == hn.RESULT
    return sorted([tuple(r) for r in out.collect()], key=repr)


def vectors(n, seed, dims=64, grid=None, labels=5):
    r = random.Random(seed)
    middles = [[r.gauss(0, 0.2) for _ in range(dims)] for _ in range(6)]
    out = []
    for i in range(n):
        v = [m + r.gauss(0, 0.1) for m in r.choice(middles)]
        out.append((i, r.randrange(labels), [round(x * grid) / grid for x in v] if grid else v))
    return out


def test_brute_force(spark):
    rows = vectors(900, 1)
    want = brute(rows)
    assert len(want) > 100 and run(spark, rows) == want


def test_blocks_of_anchors_give_the_same(spark):
    rows = vectors(300, 2)
    assert run(spark, rows, block=2, every=20) == brute(rows, every=20)


def test_ties_repeated_rows_and_equal_vectors(spark):
    """Coarse components and few dimensions make most scores equal."""
    rows = vectors(250, 3, dims=4, grid=4)
    rows += rows[:60] + [(1000 + k, k % 5, rows[100][2]) for k in range(80)] + [(100, 3, rows[5][2]), (100, 3, rows[5][2])]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(210, 4)
    odd = [(300, 1, None), (400, None, [1.0] * 64), (500, 1, [None] * 64), (600, 1, [nan] * 64), (700, 2, [inf] + [0.0] * 63),
           (None, 1, [0.3] * 64), (None, 2, [0.3] * 64), (-100, 3, [0.1] * 64), (800, 2, [0.2] * 10), (900, 1, []),
           (801, 1, [0.5] * 70), (10**15, 4, [-0.2] * 64)]
    assert run(spark, good + odd) == brute(good + odd)


def test_negative_scores_have_no_window(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 2, [-1.0, 0.0]), (2, 2, [-2.0, 0.0]), (3, 3, [-1.0, 0.0]), (100, 5, [0.0, 1.0]),
            (8, 5, [1.0, 0.0]), (9, 6, [0.0, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_no_anchor(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []


def test_scan_drops_candidates_before_the_last_column():
    r = np.random.default_rng(5)
    n, dims = 4000, 64
    x = (r.normal(0, 8, (n, dims)) * (0.9 ** np.arange(dims) * 4)).astype(np.int64)
    chunk = hn.Chunk(np.arange(n), np.ones(n, bool), np.zeros(n, np.int64), np.full(n, dims), x.ravel().astype(np.int32))
    sizes = []

    def keep(low, high):
        sizes.append(len(low))
        return high >= hn._kth(low, 5)
    rows, score = hn._scan(chunk, x[17], np.arange(n), keep)
    full = x @ x[17]
    best = np.lexsort((np.arange(n), -full))[:5]
    assert set(best) <= set(rows.tolist()) and (score == full[rows]).all()
    assert sizes[-1] < n / 10
