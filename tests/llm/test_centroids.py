import hashlib
import random

import numpy as np

from precis.llm import centroids as ct

SCHEMA = "vec_id long, cluster string, embedding array<double>, i int"


def brute(rows, dims=64, k=16, rounds=3):
    """Plain integers, every vector against every centroid."""
    import math
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(cents)]
    got = [(i, *near(v)) for i, v in kept]
    each = {}
    for _, d, c in got:
        each[c] = each.get(c, 0) + d
    total = sum(each.values())
    return sorted([(i, c, d, each[c], total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for i, d, c in got], key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, "x", v, 3) for i, v in rows], SCHEMA)
    out = ct.cluster_digest(df)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted([tuple(r) for r in out.collect()], key=repr)


def vectors(n, seed, spread=1.0, grid=None):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    out = []
    for i in range(n):
        v = [m + r.gauss(0, spread) for m in r.choice(middles)]
        out.append((i, [round(x * grid) / grid for x in v] if grid else v))
    return out


def test_brute_force(spark):
    rows = vectors(300, 1, 0.3)
    assert run(spark, rows) == brute(rows)


def test_ties_and_repeated_rows(spark):
    """Coarse components give equal distances and equal centroids."""
    rows = [(i, [float(int(x)) for x in v]) for i, v in vectors(120, 2, 0.2)]
    rows += rows[:40] + [(7, [0.0] * 64)] * 60 + [(1000 + i, [0.0] * 64) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(30, 3)
    odd = [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [1.0] * 63 + [None]), (505, [nan] + [0.0] * 63),
           (506, [0.0] * 63 + [inf]), (507, [-inf] * 64), (None, None)]
    want = brute(good)
    assert run(spark, good + odd) == want == brute(good + odd)


def test_null_ids_are_kept(spark):
    rows = vectors(20, 4) + [(None, [0.5] * 64), (None, [0.25] * 64)]
    assert run(spark, rows) == brute(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(5, 5)
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_huge_components_stop_at_the_bound(spark):
    rows = [(1, [1e30] * 64), (2, [-1e30] * 64), (3, [0.0] * 64)]
    got = {r[0]: r for r in run(spark, rows)}
    assert len(got) == 3 and all(r[2] == 0 for r in got.values())


def test_walk_is_exact_and_stops_early():
    r = np.random.default_rng(6)
    cents = r.integers(-60, 60, (40, 8))
    x = np.concatenate([cents[r.integers(40, size=200)] + r.integers(-2, 3, (200, 8)), r.integers(-60, 60, (50, 8)), cents])
    steps: list = []
    number, distance = ct.nearest(x, ct.Lists(cents), steps)
    full = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert len(steps) == len(x) and sum(steps) < 0.3 * 40 * len(x)


def test_threshold_is_strict():
    """An unmet centroid exactly as far as the best one, with a smaller number."""
    cents = np.array([[2, 0], [0, 0], [1, 1]])
    x = np.array([[1, 0]])
    assert ct.nearest(x, ct.Lists(cents))[0].tolist() == [0]
    r = np.random.default_rng(7)
    for _ in range(300):
        cents, x = r.integers(-2, 3, (12, 3)), r.integers(-2, 3, (20, 3))
        full = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
        assert (ct.nearest(x, ct.Lists(cents))[0] == full.argmin(axis=1)).all()
