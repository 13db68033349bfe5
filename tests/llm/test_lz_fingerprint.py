import hashlib

import numpy as np
import pytest

from precis.llm import lz_fingerprint as lz

SCHEMA = "doc_id long, text string, bucket int, halo string"


def phrase_set(text):
    data, seen, at = text.encode(), set(), 0
    for end in range(1, len(data) + 1):
        if data[at:end] not in seen:
            seen.add(data[at:end])
            at = end
    return seen


def brute(rows):
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0]), reverse=True)
    order = sorted(order, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        edited = t[:len(t) - m] + u[:m]
        a, b, c = lz.fingerprint(t), lz.fingerprint(edited), lz.fingerprint(u)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), lz.shown(a), lz.shown(b),
                    lz.likeness(a, b), lz.likeness(a, c)))
    return sorted(out, key=repr)


def run(spark, rows, parts=4):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in lz.fingerprints(df).collect()], key=repr)


def test_phrases_match_the_plain_parse():
    rng = np.random.default_rng(3)
    for alphabet in ("a", "ab", "abcdé😀 "):
        for n in (0, 1, 2, 5, 50, 400):
            text = "".join(rng.choice(list(alphabet), n))
            assert set(lz.parse(text.encode(), 0, set())[0]) == phrase_set(text)


def test_signature_holds_the_smallest_hashes():
    text = "the quick brown fox jumps over the lazy dog " * 200
    own = lz.fingerprint(text)
    assert len(own) == lz.K and (own == lz.smallest(list(phrase_set(text)), 10**6)[:lz.K]).all()


def test_likeness_is_near_jaccard():
    rng = np.random.default_rng(5)
    for same in (0, 300, 900):
        common = rng.integers(2**32, size=same, dtype=np.uint32)
        a, b = (np.unique(np.concatenate([common, rng.integers(2**32, size=1000 - same, dtype=np.uint32)])) for _ in "ab")
        assert lz.likeness(a[:128], b[:128]) == pytest.approx(same / (2000 - same), abs=0.13)
    empty = np.zeros(0, np.uint32)
    assert lz.likeness(empty, empty) == 1 and lz.likeness(empty, a) == 0


def test_brute_force(spark):
    words = ["alpha", "béta", "gamma", "😀", "delta", "\n"]
    rows = [(i * 3, " ".join(words[(i * k + k) % 6] for k in range(i * 4))) for i in range(25)]
    rows += [(None, "null id"), (100, None), (101, ""), (102, "x" * 200_000), (6, "again"), (6, "again"), (102, "a")]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone")], [(1, None)], [(2, "same"), (2, "same")], [(None, "a"), (None, "b")]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_documents_sf001(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted([tuple(r) for r in lz.fingerprints(df).collect()], key=repr)
    assert got == brute(rows)
    assert sum(g[5] > g[6] for g in got) > 0.9 * len(got)
