import hashlib
import random

import numpy as np
import pytest

from precis.llm import suffix_dedup as sd
from precis.llm.suffix_groups import suffix_arrays

SCHEMA = "doc_id long, text string, block int, route string"


def brute(rows, size=sd.LENGTH):
    first = {}
    for i, t in rows:
        b, o = (t or "").encode(), sd.NOBODY if i is None else i
        for p in range(len(b) - size + 1):
            first[b[p:p + size]] = min(first.get(b[p:p + size], o), o)
    out = []
    for i, t in rows:
        b, o = (t or "").encode(), sd.NOBODY if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p:p + size]] < o:
                gone[p:p + size] = b"\1" * size
        spans, at = [], 0
        while (at := gone.find(1, at)) >= 0:
            end = gone.find(0, at)
            end = len(b) if end < 0 else end
            spans.append(f"{at}:{end}")
            at = end
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(spans), hashlib.sha256(kept).hexdigest(), ",".join(spans)))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in sd.drop_repeats(df, **more).collect()], key=repr)


def mixed():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé ") for _ in range(400)) for _ in range(5)]
    rows = [(1, None), (2, ""), (3, "short"), (None, base[0]), (None, base[0]), (5, "a" * 300), (6, "a" * 120 + "b" + "a" * 60),
            (7, "ab" * 100), (8, "b" + "ab" * 60), (9, "x" * 49), (10, "x" * 49), (11, "y" * 50), (12, "y" * 50), (12, "y" * 50 + "z")]
    for k in range(60):
        x, y = rng.choice(base), rng.choice(base)
        a, b = rng.randrange(300), rng.randrange(300)
        rows.append((20 + k, x[a:a + rng.randrange(30, 140)] + rng.choice(["", "\n", "qq"]) + y[b:b + rng.randrange(30, 140)]))
    return rows


@pytest.mark.parametrize("hot", [sd.HOT, 3, 1])
def test_brute_force(spark, hot):
    assert run(spark, mixed(), hot=hot) == brute(mixed())


def test_documents_sf001(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == brute([(None, None)])


def test_long_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(60_000))
    rows = [(1, long), (2, long[:30_000] + "#" + long[30_000:]), (3, long[777:40_000]), (4, long), (5, "ab" * 20_000), (6, "ab" * 20_001)]
    assert run(spark, rows) == brute(rows)


def test_suffix_arrays_of_many_texts():
    rng = random.Random(2)
    for _ in range(300):
        texts = [[rng.randint(0, rng.choice([0, 1, 2, 4])) for _ in range(rng.randint(0, 40))] * rng.choice([1, 1, 2, 3])
                 for _ in range(rng.randint(1, 8))]
        symbols = np.array([x for t in texts for x in t], np.int64)
        bounds = np.cumsum([0] + [len(t) for t in texts])
        got = suffix_arrays(symbols, bounds)
        for t, a, b in zip(texts, bounds, bounds[1:]):
            assert (got[a:b] - a).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_window_hashes_agree_with_suffix_arrays():
    rng = random.Random(3)
    base = "".join(rng.choice("ab") for _ in range(300)).encode()
    routes = []
    for _ in range(6):
        r = sd._Route()
        for k in range(8):
            a = rng.randrange(200)
            r.add(base[a:a + rng.randrange(20, 100)], rng.randrange(5), (0, k, a))
        routes.append(r)
    for r in routes:
        assert (sd.covered([r]) == sd.covered([r], direct=True)).all()


def test_anchors_of_equal_windows_agree():
    rng = random.Random(6)
    text = "".join(rng.choice("abc") for _ in range(500)).encode()
    data = np.frombuffer(text, np.uint8)
    places, _ = sd.anchors(data, np.array([0, 200, 200, 240, 500]))
    ends = [200, 240, 500]
    for lo, hi in zip([0, 200, 240], ends):
        for w in range(lo, hi - sd.LENGTH + 1):
            assert any(w <= p <= w + sd.LENGTH - sd.GRAM for p in places)
    assert not any(200 <= p < 240 for p in places)


def test_a_hot_passage_is_spread_over_tasks(spark):
    """One passage in most documents, by way of the window hashes."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh") for _ in range(200))
    rows = [(k, "".join(rng.choice("ijkl ") for _ in range(60)) + (passage if k % 4 else "") + str(k)) for k in range(400)]
    assert run(spark, rows, hot=10) == brute(rows)
