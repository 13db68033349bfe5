"""Quality classifier: linear support vectors on Naive Bayes scaled n-grams.

Features are indicators of hashed n-grams (``2 ** bits`` of them): words and
word pairs as written, word shapes (letters, capitals, digits and each sign,
runs folded) and shape pairs, and immediate repetitions of a word.  Each
indicator is scaled by the log ratio of its smoothed class counts, rows are
brought to length 1, and a linear model with hinge loss is fitted by dual
coordinate descent; the score is the logistic of the margin.

Fitting uses at most ``max_train`` labelled rows, those of the smallest hash of
the id (a documented bound; their ids are broadcast, at most ``max_train``
pairs, and one task fits).  The model, ``2 ** bits`` floats, is broadcast;
scoring reads every whole text once, in Arrow batches, and shuffles nothing.

Labels are learnt only from rows whose crc32(id as text) mod 3 is not 1.
Defined results: null text counts as empty and is scored like any text by the
bias alone; a null id hashes as the empty text; labels that are null or not 0
or 1 are ignored; a document with several labels counts once for each; without
two classes the score is the smoothed share of label 1.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm import words as wd
from precis.llm.common import free_name, pairs, table

BITS = 18
MAX_TRAIN = 20_000
RESULT = "doc_id long, held_out boolean, score double, predicted int"

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 57


class Model(NamedTuple):
    weights: np.ndarray   # ratio times weight, by feature
    ratios: np.ndarray    # log count ratio, by feature
    bias: float


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) of each distinct feature of each text, sorted."""
    data, off = wd.buffer(texts)
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    if len(shape):
        keep[1:] = shape[1:] != shape[:-1]
        keep[off[:-1][off[:-1] < len(shape)]] = True
    folded = wd.split(shape[keep], np.concatenate([[0], np.cumsum(keep)])[off], wd.SOLID)
    plain = wd.split(data, off, wd.SOLID)
    found, owners = [], []
    for space, w in enumerate((plain, folded)):
        owner, h = w.owner, w.hashes
        same = owner[1:] == owner[:-1]
        pair = wd.mix(h[:-1] * np.uint64(3) + h[1:] + np.uint64(space + 1))[same]
        found += [wd.mix(h + np.uint64(space * 2 + 7)), pair]
        owners += [owner, owner[:-1][same]]
    owner, h = plain.owner, plain.hashes
    again = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    times = np.bincount(owner[1:][again], minlength=len(texts))
    for least in (1, 3, 8):
        at = np.flatnonzero(times >= least)
        found.append(np.full(len(at), wd.mix(np.array([least + 1001], np.uint64))[0]))
        owners.append(at)
    key = (np.concatenate(owners).astype(np.int64) << bits) | (
        np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key >> bits, key & ((1 << bits) - 1)


def descend(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss on rows of length 1 plus a
    constant; rows in a seeded order, fresh each round, until nothing moves."""
    weights, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    order, rng = np.arange(len(rows)), np.random.default_rng(7)
    scaled = []
    for x in rows:
        v = ratios[x]
        scaled.append(v / (np.sqrt(v @ v) or 1.0))
    for _ in range(rounds):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            x, v = rows[i], scaled[i]
            gradient = y[i] * (weights[x] @ v + bias) - 1
            step = min(max(alpha[i] - gradient / (v @ v + 1.0), 0.0), cost) - alpha[i]
            if abs(step) > 1e-9:
                alpha[i] += step
                weights[x] += step * y[i] * v
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, bias


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, size: int, smooth: float = 1.0, cost: float = 4.0,
             rounds: int = 12) -> Model:
    n1, n = int(labels.sum()), len(labels)
    if not 0 < n1 < n:
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32),
                     float(np.log((n1 + 1) / (n - n1 + 1))) / 2)
    counts = []
    for label in (1, 0):
        own = [x for x, q in zip(rows, labels) if q == label]
        c = np.bincount(np.concatenate(own), minlength=size) + smooth
        counts.append(c / c.sum())
    ratios = np.log(counts[0] / counts[1])
    weights, bias = descend(rows, np.where(labels == 1, 1.0, -1.0), ratios, cost, rounds)
    return Model((weights * ratios).astype(np.float32), ratios.astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_train: int = MAX_TRAIN, bits: int = BITS) -> Model:
    """The model of at most ``max_train`` labelled rows that are not held out."""
    spark = docs.sparkSession
    marked = (labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("q"))
              .where(F.col("q").isin(0, 1) & F.col("i").isNotNull() & ~held_out("i"))
              .orderBy(F.xxhash64("i"), "i", "q").limit(max_train))
    chosen = pairs(spark, [tuple(r) for r in marked.collect()], "i long, q int")  # bounded by max_train
    texts = (docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
             .join(F.broadcast(chosen), "i").select("q", "t"))

    def extract(batches):
        for batch in batches:
            for part in wd.pieces(batch, 1):
                owner, feature = features(part.column(1), bits)
                cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
                packed = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["q", "x"])

    def fit(batches):
        rows, marks = [], []
        for batch in batches:
            marks += batch.column(0).to_pylist()
            rows += [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
        m = fit_rows(rows, np.array(marks, int), 1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), pa.array([m.ratios.tobytes()]),
                                          pa.array([float(m.bias)])], names=["w", "r", "b"])

    got = (texts.mapInArrow(extract, "q int, x binary").repartition(1)
           .mapInArrow(fit, "w binary, r binary, b double").first())  # 2 ** bits floats, twice
    if got is None:
        return fit_rows([], np.zeros(0, int), 1 << bits)
    return Model(np.frombuffer(got.w, np.float32), np.frombuffer(got.r, np.float32), got.b)


def margins(texts: pa.Array, model: Model) -> np.ndarray:
    owner, feature = features(texts, int(len(model.weights)).bit_length() - 1)
    n = len(texts)
    total = np.bincount(owner, model.weights[feature], n)
    length = np.sqrt(np.bincount(owner, model.ratios[feature].astype(float) ** 2, n))
    return total / np.where(length > 0, length, 1.0) + model.bias


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_score``, by another name (``common.free_name``) where
    that one is taken; the other columns go through as they are."""
    own = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    added = free_name("_score", names)
    schema = docs.select(*[F.col(f"`{c}`") for c in names], F.lit(0.0).alias(added)).schema

    def run(batches):
        for batch in batches:
            for part in wd.pieces(batch, names.index(text_col)):
                s = 1 / (1 + np.exp(-2 * margins(part.column(names.index(text_col)), own.value)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], names=[*names, added])

    return docs.mapInArrow(run, schema)


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"))
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"))
