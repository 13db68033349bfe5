import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from precis.llm import quality as q

DOCS = "doc_id long, text string, _score2 double, quality int"


def corpus(n):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = []
    for i in range(n):
        own = [words[(i * 7 + k * k) % 6] for k in range(20)]
        bad = i % 4 == 0
        rows.append((i, " ".join(f"{w.upper()}!!" if bad else w for w in own), int(not bad)))
    return rows


def test_held_out_accuracy(spark):
    spark_docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = q.train(spark_docs, labels)
    own = (q.score(spark_docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id"), model)
           .where(q.held_out("doc_id")).select("_score", "quality").toPandas())
    assert len(own) > 500
    assert ((own._score >= 0.5) == (own.quality == 1)).mean() > 0.98
    rank = own._score.rank().to_numpy()
    good = own.quality.to_numpy() == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.99


def test_nulls_empty_repeats_and_other_columns(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([(i, t, 0.5, 9) for i, t, _ in rows] + [(100, None, 0.1, 9), (101, "", 0.1, 9), (None, "alpha", 0.1, 9),
                                  (1, rows[1][1], 0.5, 9), (102, "word " * 100_000, 0.1, 9)], DOCS)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (2, None, 0), (3, 7, 0), (3, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    model = q.train(docs, labels)
    out = q.score(docs, model).collect()
    assert len(out) == 65 and all(0 <= r._score <= 1 for r in out)
    by_id = {r.doc_id: r._score for r in out}
    assert by_id[100] == by_id[101]
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((by_id[i] >= 0.5) == bool(rows[i][2]) for i in held)
    assert out[0]._score2 == 0.5 and out[0].quality == 9


def test_held_out_labels_are_never_read(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    a = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    b = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows], "doc_id long, quality int")
    x, y = q.train(docs, a), q.train(docs, b)
    assert (x.weights == y.weights).all() and x.bias == y.bias


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)]])
def test_without_two_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    model = q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert all(r._score >= 0.5 for r in q.score(docs, model).collect())
    assert q.score(docs.limit(0), model).collect() == []


def test_features_do_not_depend_on_the_batch():
    texts = ["One two TWO!!", "", "x x x x", "é ß — z", None]
    o, f = q.features(pa.array(texts))
    for k, t in enumerate(texts):
        assert np.array_equal(f[o == k], q.features(pa.array([t], pa.string()))[1])


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(40)]
    y = np.where([0 in r or 3 in r for r in rows], 1.0, -1.0)
    ratios = rng.normal(size=12)
    w, b = q.descend(rows, y, ratios, 1.0, 500)
    x = np.zeros((40, 13))
    for k, r in enumerate(rows):
        x[k, r] = ratios[r] / np.linalg.norm(ratios[r])
    x[:, 12] = 1
    full = np.append(w, b)
    value = lambda v: v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()
    best = value(full)
    assert all(value(full + rng.normal(scale=s, size=13)) >= best - 1e-2 for s in (0.01, 0.1, 1) for _ in range(200))


def test_a_column_that_has_the_name_of_the_score(spark):
    rows = corpus(30)
    docs = spark.createDataFrame([(i, t, 7.0, 8.0) for i, t, _ in rows], "doc_id long, text string, _score double, __SCORE double")
    model = q.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    out = q.score(docs, model)
    assert out.columns == ["doc_id", "text", "_score", "__SCORE", "___score"]
    assert all(r._score == 7.0 and r["__SCORE"] == 8.0 and 0 <= r["___score"] <= 1 for r in out.collect())


def test_scores_equal_a_plain_scorer(spark):
    """Score by score: n-gram indicators times ratios, scaled to length 1, times weights, plus the bias."""
    rows = corpus(80)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "unseen words only")], "doc_id long, text string")
    model = q.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    got = {r.doc_id: r._score for r in q.score(docs, model).collect()}
    for r in docs.collect():
        found = set(q.features(pa.array([r.text or ""]))[1].tolist())
        total = length = 0.0
        for f in found:  # the model's weights hold the ratio already
            total += float(model.weights[f])
            length += float(model.ratios[f]) ** 2
        margin = total / (length ** 0.5 or 1.0) + float(model.bias)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-2 * margin))) < 1e-6


def test_ratios_equal_plain_counts():
    texts, labels = ["a b a", "b c", "c d", "a d d d"], np.array([1, 0, 0, 1])
    rows = [np.unique(q.features(pa.array([t]))[1]) for t in texts]
    model = q.fit_rows(rows, labels, 1 << q.BITS)
    size = 1 << q.BITS
    for f in {int(x) for r in rows for x in r}:
        n = [sum(f in set(r.tolist()) for r, y in zip(rows, labels) if y == q_) + 1.0 for q_ in (1, 0)]
        whole = [sum(len(r) for r, y in zip(rows, labels) if y == q_) + 1.0 * size for q_ in (1, 0)]
        assert abs(model.ratios[f] - np.log((n[0] / whole[0]) / (n[1] / whole[1]))) < 1e-5
