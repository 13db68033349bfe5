"""ROUGE-L / ROUGE-Lsum against plain-Python brute force on small frames."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from precis.operators import rouge

WORDS = ["le", "la", "de", "chat", "noir", "est", "ici", "un", "et"]


def _tok(t):
    return [x for x in re.split(r"\s+", re.sub(r"[^a-z0-9]+", " ", (t or "").lower())) if x]


def _lcs_brute(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t


def _f(p, r):
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def _rouge_l(pred, ref):
    p, r = _tok(pred), _tok(ref)
    if not p or not r:
        return 0.0
    lcs = _lcs_brute(r, p)[len(r)][len(p)]
    return _f(lcs / len(p), lcs / len(r))


def _lcs_ind(ref, can):
    t = _lcs_brute(ref, can)
    i, j, out = len(ref), len(can), []
    while i > 0 and j > 0:
        if ref[i - 1] == can[j - 1]:
            out.insert(0, i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def _rouge_lsum(pred, ref):
    refs = [_tok(s) for s in (ref or "").split("\n") if len(s)]
    cans = [_tok(s) for s in (pred or "").split("\n") if len(s)]
    m, n = sum(map(len, refs)), sum(map(len, cans))
    if not refs or not cans or not m or not n:
        return 0.0
    cr, cc = Counter(t for s in refs for t in s), Counter(t for s in cans for t in s)
    hits = 0
    for r in refs:
        union = set()
        for c in cans:
            union.update(_lcs_ind(r, c))
        for i in sorted(union):
            if cr[r[i]] > 0 and cc[r[i]] > 0:
                hits, cr[r[i]], cc[r[i]] = hits + 1, cr[r[i]] - 1, cc[r[i]] - 1
    return _f(hits / n, hits / m)


def _rouge_n(pred, ref, n):
    def grams(t):
        return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
    gp, gr = grams(_tok(pred)), grams(_tok(ref))
    ov = sum(min(c, gr[g]) for g, c in gp.items())
    p = ov / max(sum(gp.values()), 1)
    r = ov / max(sum(gr.values()), 1)
    return _f(p, r)


sentence = st.lists(st.sampled_from(WORDS + ["É", "l'été", "12"]), min_size=0, max_size=12).map(" ".join)
text = st.lists(sentence, min_size=0, max_size=3).map("\n".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=15), st.lists(st.sampled_from("abcd"), max_size=15))
def test_lcs_length_equals_brute_force(a, b):
    assert rouge.lcs_length(a, b) == _lcs_brute(a, b)[len(a)][len(b)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=10), st.lists(st.sampled_from("abc"), max_size=10))
def test_lcs_indices_equal_brute_force(a, b):
    assert rouge.lcs_places(a, b) == _lcs_ind(a, b)


def test_rouge_metrics_equal_python(spark):
    import random
    rng = random.Random(3)
    pairs = []
    for i in range(60):
        def one():
            return "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9)))
                             for _ in range(rng.randint(1, 3)))
        pairs.append((i, one(), one()))
    pairs.append((100, "", "le chat"))
    pairs.append((101, "L'Été à Paris-12", "l t paris 12"))
    df = spark.createDataFrame(pairs, "pair_id long, prediction string, reference string")
    got = {(r["pair_id"], r["metric"]): r["fmeasure"] for r in rouge.rouge_all(df).collect()}
    for i, p, r in pairs:
        assert got[(i, "rouge1")] == pytest.approx(_rouge_n(p, r, 1))
        assert got[(i, "rouge2")] == pytest.approx(_rouge_n(p, r, 2))
        assert got[(i, "rougeL")] == pytest.approx(_rouge_l(p, r))
        assert got[(i, "rougeLsum")] == pytest.approx(_rouge_lsum(p, r))


def test_corpus_mean_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "a b"), (2, "c", "d")], "pair_id long, prediction string, reference string")
    out = {r["metric"]: r["score"] for r in rouge.rouge_corpus(rouge.rouge_n(df)).collect()}
    assert out["rouge1"] == pytest.approx(0.5)
    empty = df.limit(0)
    assert rouge.rouge_corpus(rouge.rouge_n(empty)).count() == 0
    zeros = {r["metric"]: r["score"] for r in rouge.rouge_corpus(rouge.rouge_n(empty), rouge.ALL_METRICS).collect()}
    assert zeros == {m: 0.0 for m in rouge.ALL_METRICS}


def test_long_pair_stays_small():
    import tracemalloc
    import random
    rng = random.Random(3)
    a, b = ([rng.randrange(400) for _ in range(20_000)] for _ in "ab")
    tracemalloc.start()
    places = rouge.lcs_places(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(places) == rouge.lcs_length(a, b)
    rest = iter(b)
    assert all(any(x == a[k] for x in rest) for k in places)


def test_lsum_of_one_line_is_l_and_of_equal_texts_is_one():
    import random
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice(WORDS) for _ in range(rng.randrange(1, 12))] for _ in "ab")
        one = rouge.pair_scores([a], [b], a, b, ("rougeL", "rougeLsum"))
        # hits are the LCS tokens, each at most as often as either side has it
        assert one[0][1:] == one[1][1:]
        cut = rng.randrange(len(a) + 1)
        lines = [x for x in (a[:cut], a[cut:]) if x]
        assert rouge.pair_scores(lines, lines, a, a, ("rougeLsum",))[0][1:] == (1.0, 1.0, 1.0)


def _bootstrap_by_hand(rows, resamples, seed):
    import hashlib

    import numpy as np
    means = {}
    for metric in {m for _, m, _ in rows}:
        own = [(k, round(f * 10**8)) for k, m, f in rows if m == metric]
        for r in range(resamples):
            weights = []
            for k, _ in own:
                h = hashlib.md5(f"{seed},{r // 8},{k}".encode()).hexdigest()
                weights.append(sum(h[4 * (r % 8):4 * (r % 8) + 4] >= s for s in rouge.POISSON_STEPS))
            if sum(weights):
                means.setdefault(metric, []).append(sum(w * f for w, (_, f) in zip(weights, own)) / sum(weights) / 10**8)
    return {m: np.percentile(x, [2.5, 50, 97.5]) for m, x in means.items()}


def test_bootstrap_by_hand(spark):
    import random
    rng = random.Random(1)
    rows = [(k, m, rng.random()) for k in range(40) for m in ("rouge1", "rouge2")] + [(0, "rougeL", 0.25)]
    df = spark.createDataFrame([(k, m, 0.0, 0.0, f) for k, m, f in rows],
                               "pair_id long, metric string, precision double, recall double, fmeasure double").repartition(3)
    want = _bootstrap_by_hand(rows, 100, 3)
    got = {r["metric"]: r for r in rouge.rouge_bootstrap(df, resamples=100, seed=3, metrics=("rouge1", "rouge2", "rougeL", "rougeLsum")).collect()}
    for m, q in want.items():
        assert max(abs(got[m][c] - x) for c, x in zip(("low", "mid", "high"), q)) < 1e-9
    assert got["rouge1"]["n_pairs"] == 40 and got["rougeL"]["low"] == got["rougeL"]["high"] == 0.25
    assert tuple(got["rougeLsum"])[1:] == (0.0, 0.0, 0.0, 0)


def test_bootstrap_covers_the_mean_and_narrows_with_the_pairs(spark):
    df = spark.range(4000).select(F.col("id").alias("pair_id"), F.lit("rouge1").alias("metric"),
                                  (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("fmeasure"))
    wide, narrow = (rouge.rouge_bootstrap(df.where(F.col("pair_id") < n), 400).first() for n in (100, 4000))
    mean = df.agg(F.avg("fmeasure")).first()[0]
    assert narrow["low"] < mean < narrow["high"] and wide["high"] - wide["low"] > 3 * (narrow["high"] - narrow["low"])
    # about 1.96 standard deviations on either side
    assert 0.7 < (narrow["high"] - narrow["low"]) / (2 * 1.96 * 0.2887 / 4000 ** 0.5) < 1.3


def test_ngram_tables_are_made_in_small_batches(spark, monkeypatch):
    from collections import Counter

    from precis.operators import rouge
    monkeypatch.setattr(rouge, "GRAM_PAIRS", 2)
    monkeypatch.setattr(rouge, "GRAM_ROWS", 5)
    texts = [(k, " ".join(f"w{j % 3}" for j in range(k)), "w0 w1 w0" if k % 2 else "") for k in range(9)]
    pairs = spark.createDataFrame([*texts, (None, "a b", "b a")], "pair_id long, prediction string, reference string")
    table = rouge.ngram_overlap(rouge.tokenized(pairs.coalesce(1)))
    assert "ArrowEvalPython" not in table._jdf.queryExecution().executedPlan().toString()  # a list of rows for each pair of a batch
    want = []
    for k, p, r in [*texts, (None, "a b", "b a")]:
        for n in (1, 2):
            x, y = (Counter(" ".join(t) for t in zip(*(s.split()[j:] for j in range(n)))) for s in (p, r))
            want += [(k, n, g, x[g], y[g], min(x[g], y[g])) for g in x | y]
    assert sorted(map(tuple, table.collect()), key=repr) == sorted(want, key=repr)
