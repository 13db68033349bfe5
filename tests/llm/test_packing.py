import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from precis.llm import packing as pk

SCHEMA = "doc_id long, text string, bucket int, batch string"


def padding(cells, counts, tokens, bounds, granule):
    return sum(next(b for b in bounds if b >= c) * granule * n - t for c, n, t in zip(cells, counts, tokens))


def test_bounds_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        m = int(rng.integers(1, 9))
        cells = np.sort(rng.choice(40, m, replace=False)) + 1
        counts = rng.integers(1, 20, m)
        tokens = cells * 8 * counts - rng.integers(0, 8, m)
        for k in (1, 2, 3, 10):
            got = pk.best_bounds(cells, counts, tokens, k, 8)
            assert len(got) == min(k, m) and got[-1] == cells[-1]
            best = min(padding(cells, counts, tokens, [*x, cells[-1]], 8)
                       for x in itertools.combinations(cells[:-1], min(k, m) - 1))
            assert padding(cells, counts, tokens, got, 8) == best


def brute(rows, max_tokens, granule, buckets, batch_tokens):
    pieces = []
    for i, t in rows:
        n = len(re.findall(r"[^\W_]+|[^ \t\n\x0b\f\r\w]|_", t or ""))
        for p in range(max(-(-n // max_tokens), 1)):
            pieces.append((i, p, p * max_tokens, min(n - p * max_tokens, max_tokens)))
    cell = lambda x: max(-(-x[3] // granule), 1)
    cells = sorted({cell(x) for x in pieces})
    bounds = pk.best_bounds(np.array(cells), np.array([sum(cell(x) == c for x in pieces) for c in cells]),
                            np.array([sum(x[3] for x in pieces if cell(x) == c) for c in cells]), buckets, granule)
    out = []
    for b, top in enumerate(bounds):
        own = sorted((x for x in pieces if (bounds[b - 1] if b else 0) < cell(x) <= top),
                     key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[3]))
        slots = max(batch_tokens // (top * granule), 1)
        out += [(*x, b, top * granule, k // slots, k % slots) for k, x in enumerate(own)]
    return sorted(out, key=repr)


def test_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), "tok, " * int(n)) for i, n in enumerate(rng.integers(0, 90, 150))]
    rows += [(None, "a b"), (None, None), (200, None), (201, ""), (202, "x " * 5000), (3, "a b"), (3, "a b"), (7, "_é-ß 😀 12")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(5)
    got = pk.pack(df, max_tokens=64, granule=4, buckets=4, batch_tokens=256)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows, 64, 4, 4, 256)


def test_budget_and_cover(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pk.pack(df)
    batches = got.groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.max("bucket_tokens").alias("t"),
                                                 F.countDistinct("slot").alias("s"))
    assert batches.where("n * t > 65536 OR s <> n").count() == 0
    assert got.agg(F.countDistinct("doc_id")).first()[0] == 1000


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    assert [tuple(r) for r in pk.pack(df).collect()] == [(None, 0, 0, 0, 0, 8, 0, 0)] * len(rows)


def test_another_token_count(spark):
    df = spark.createDataFrame([(1, "abc", 0, "")], SCHEMA)
    assert pk.pack(df, tokens=F.length("text")).first().n_tokens == 3
