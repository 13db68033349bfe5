"""ROUGE scoring: J1 pair_predictions, J3 ngram_overlap, A8 rouge_n,
A9 rouge_l, A10 rouge_lsum, A11 rouge_corpus.

Plan shape: prediction and reference sit in one row, so scoring moves nothing:
the JVM makes the token arrays, one Arrow-batched pandas UDF codes the tokens
of a pair as integers and computes every metric asked for, and the metrics of a
row become rows.  One scan, no exchange, and no need for a unique key.  Longest
common subsequences are bit-parallel: a row of the table is one integer with a
bit per token.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rouge_tokens, split_lines

KEY = "pair_id"


SCORES = "array<struct<metric: string, precision: double, recall: double, fmeasure: double>>"
GRAMS = "n int, ngram string, n_pred long, n_ref long, overlap long"
#: pairs that are taken from a batch at once, and n-grams of an output batch
GRAM_PAIRS, GRAM_ROWS = 64, 20_000


# --- scores of one pair ------------------------------------------------------

def gram_counts(tokens: Sequence, n: int) -> Counter:
    return Counter(zip(*(tokens[k:] for k in range(n)))) if n > 1 else Counter(tokens)


def score(hits: int, n_pred: int, n_ref: int) -> tuple[float, float, float]:
    """Precision, recall and F; 0 where a side has nothing."""
    p, r = (hits / n_pred if n_pred else 0.0), (hits / n_ref if n_ref else 0.0)
    return p, r, (2.0 * p * r / (p + r) if p + r > 0 else 0.0)


def _places(tokens: Sequence) -> dict:
    """Token -> integer with a bit for each place of the token."""
    out: dict = {}
    for k, t in enumerate(tokens):
        out[t] = out.get(t, 0) | (1 << k)
    return out


def _rows(tokens: Sequence, over: Sequence):
    """Rows of the common-subsequence table of ``tokens`` against ``over``:
    bit j is 0 where the length grows from column j to j + 1."""
    mask = (1 << len(over)) - 1
    places, row = _places(over), mask
    for t in tokens:
        hit = row & places.get(t, 0)
        row = ((row + hit) | (row - hit)) & mask
        yield row


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence."""
    if not len(a) or not len(b):
        return 0
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    return len(b) - row.bit_count()


def lcs_places(ref: Sequence, can: Sequence) -> list[int]:
    """Places of ``ref`` on one longest common subsequence with ``can``: from
    the end, equal tokens are taken, else the side whose loss keeps more is
    shortened, ``ref`` if both keep the same.  Holds a bit per cell."""
    if not len(ref) or not len(can):
        return []
    rows = [(1 << len(can)) - 1, *_rows(ref, can)]
    i, j, out = len(ref), len(can), []
    while i and j:
        if ref[i - 1] == can[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
            continue
        left = (1 << (j - 1)) - 1
        without_can = j - 1 - (rows[i] & left).bit_count()
        without_ref = j - (rows[i - 1] & (2 * left + 1)).bit_count()
        if without_can > without_ref:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def summary_lcs_hits(ref_sents: Sequence, can_sents: Sequence) -> tuple[int, int, int]:
    """ROUGE-Lsum counts (hits, reference tokens, candidate tokens): the union
    of the places that a reference sentence shares with any candidate sentence,
    each token counted at most as often as either side has it."""
    left_r = Counter(t for s in ref_sents for t in s)
    left_c = Counter(t for s in can_sents for t in s)
    m, n, hits = left_r.total(), left_c.total(), 0
    for r in ref_sents:
        for k in sorted({k for c in can_sents for k in lcs_places(r, c)}):
            if left_c[r[k]] > 0 and left_r[r[k]] > 0:
                hits += 1
                left_c[r[k]] -= 1
                left_r[r[k]] -= 1
    return hits, m, n


def _coded(texts: list[list], codes: dict) -> list[list[int]]:
    return [[codes.setdefault(t, len(codes)) for t in x] for x in texts]


def pair_scores(pred_lines: list[list], ref_lines: list[list], pred: list, ref: list,
                metrics: Sequence[str]) -> list[tuple]:
    """(metric, precision, recall, F) of one pair of tokenised texts."""
    codes: dict = {}
    (p, r), out = _coded([pred, ref], codes), []
    for m in metrics:
        if m == "rougeL":
            got = score(lcs_length(p, r), len(p), len(r))
        elif m == "rougeLsum":
            hits, n_ref, n_pred = summary_lcs_hits(_coded(ref_lines, codes), _coded(pred_lines, codes))
            got = score(hits, n_pred, n_ref)
        else:
            n = int(m.removeprefix("rouge"))
            a, b = gram_counts(p, n), gram_counts(r, n)
            got = score((a & b).total(), a.total(), b.total())
        out.append((m, *got))
    return out


# --- tables ------------------------------------------------------------------

def rouge_scores(pairs: DataFrame, metrics: Sequence[str], pred: str = "prediction", ref: str = "reference",
                 unicode: bool = False, key: str = KEY) -> DataFrame:
    """``key, metric, precision, recall, fmeasure``, a row per pair and metric."""
    def lines(c: str) -> Column:
        if "rougeLsum" not in metrics:
            return F.array().cast("array<array<string>>")
        return F.transform(split_lines(F.col(c)), lambda s: rouge_tokens(s, unicode))

    @F.pandas_udf(SCORES)
    def scored(pl: pd.Series, rl: pd.Series, p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("metric", "precision", "recall", "fmeasure"), s))
                           for s in pair_scores(a, b, list(c), list(d), metrics)]
                          for a, b, c, d in zip(pl, rl, p, r)])

    return pairs.select(key, F.inline(scored(lines(pred), lines(ref), rouge_tokens(F.col(pred), unicode),
                                             rouge_tokens(F.col(ref), unicode))))


def tokenized(pairs: DataFrame, pred: str = "prediction", ref: str = "reference",
              unicode: bool = False, key: str = KEY) -> DataFrame:
    """X17 on both sides."""
    return pairs.select(key, rouge_tokens(F.col(pred), unicode).alias("_pt"),
                        rouge_tokens(F.col(ref), unicode).alias("_rt"))


def ngram_overlap(toks: DataFrame, orders: Sequence[int] = (1, 2), key: str = KEY) -> DataFrame:
    """Per (pair, n, ngram) the prediction count, the reference count and
    the clipped overlap (the match of the two count tables).  A task holds about
    ``GRAM_ROWS`` output rows at a time, however many pairs a batch has."""
    def batch(keys: list, kind: pa.DataType, rows: list) -> pa.RecordBatch:
        n, gram, n_pred, n_ref = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, kind), pa.array(n, pa.int32()), pa.array(gram, pa.string()), pa.array(n_pred, pa.int64()),
             pa.array(n_ref, pa.int64()), pa.array([min(x) for x in zip(n_pred, n_ref)], pa.int64())],
            names=[key, "n", "ngram", "n_pred", "n_ref", "overlap"])

    def grams(batches):
        for whole in batches:
            kind, keys, rows = whole.schema.field(0).type, [], []
            for at in range(0, whole.num_rows, GRAM_PAIRS):
                some = whole.slice(at, GRAM_PAIRS)
                for k, a, b in zip(*(some.column(c).to_pylist() for c in range(3))):
                    for n in orders:
                        x, y = gram_counts(a, n), gram_counts(b, n)
                        rows += [(n, g if n == 1 else " ".join(g), x[g], y[g]) for g in x | y]
                    keys += [k] * (len(rows) - len(keys))
                    if len(rows) >= GRAM_ROWS:
                        yield batch(keys, kind, rows)
                        keys, rows = [], []
            yield batch(keys, kind, rows)

    return toks.select(key, "_pt", "_rt").mapInArrow(grams, f"`{key}` {toks.schema[key].dataType.simpleString()}, {GRAMS}")


def rouge_n(pairs: DataFrame, orders: Sequence[int] = (1, 2), pred: str = "prediction", ref: str = "reference",
            unicode: bool = False, key: str = KEY) -> DataFrame:
    """precision = overlap / prediction n-grams, recall = overlap /
    reference n-grams (each 0 when its side has none), F = 2PR/(P+R)."""
    return rouge_scores(pairs, [f"rouge{n}" for n in orders], pred, ref, unicode, key)


def rouge_l(pairs: DataFrame, pred: str = "prediction", ref: str = "reference",
            unicode: bool = False, key: str = KEY) -> DataFrame:
    """The same with the length of the longest common subsequence."""
    return rouge_scores(pairs, ["rougeL"], pred, ref, unicode, key)


def rouge_lsum(pairs: DataFrame, pred: str = "prediction", ref: str = "reference",
               unicode: bool = False, key: str = KEY) -> DataFrame:
    """A10: summary-level; texts are split on newlines, empty lines dropped."""
    return rouge_scores(pairs, ["rougeLsum"], pred, ref, unicode, key)


def rouge_all(pairs: DataFrame, pred: str = "prediction", ref: str = "reference",
              unicode: bool = False, key: str = KEY) -> DataFrame:
    """All four metrics per pair, in one pass."""
    return rouge_scores(pairs, ALL_METRICS, pred, ref, unicode, key)


def rouge_corpus(scores: DataFrame, metrics: tuple[str, ...] | None = None) -> DataFrame:
    """Corpus score per metric = mean of per-pair F.  With ``metrics``
    every named metric gets a row, 0.0 when no pair is scored."""
    agg = scores.groupBy("metric").agg(
        F.coalesce(F.avg("fmeasure"), F.lit(0.0)).alias("score"),
        F.count(F.lit(1)).alias("n_pairs"))
    if metrics is None:
        return agg
    names = scores.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    return names.join(agg, "metric", "left").select(
        "metric", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"))


#: P(X <= k) of a Poisson variable of mean 1 for k = 0, 1, ... in 65,536ths, as four hexadecimal digits.
POISSON_STEPS = ("5e2d", "bc5a", "eb71", "fb23", "ff10", "ffd9", "fffa", "ffff")
_PER_HASH = 8      # resamples whose weights one digest holds
_F_UNITS = 10**8   # F is summed in whole units, so that the order of the rows does not matter


def rouge_bootstrap(scores: DataFrame, resamples: int = 1000, seed: int = 0, confidence: float = 0.95,
                    metrics: tuple[str, ...] | None = None, key: str = KEY) -> DataFrame:
    """A11 with an interval: ``metric, low, mid, high, n_pairs``, the quantiles
    of the mean F over ``resamples`` resamplings of the pairs.

    Every pair gets a weight in every resample, a Poisson number of mean 1 from
    a digest of the seed, the resample and the pair's key.  So a resample is a
    weighted mean, all of them are one aggregation with partial sums (a few
    numbers per metric and resample move), and the same seed gives the same
    interval on any cluster.  All metrics of a pair share its weights.
    Resamples in which every weight is 0 do not count; with ``metrics`` every
    named metric gets a row, 0.0 when no pair is scored."""
    blocks = -(-resamples // _PER_HASH)
    rows = (scores.select("metric", F.round(F.col("fmeasure") * _F_UNITS).cast("long").alias("f"),
                          F.col(key).cast("string").alias("key"),
                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
            .withColumn("h", F.md5(F.concat_ws(",", F.lit(str(seed)), F.col("block").cast("string"), "key"))))
    weights = [reduce(lambda a, b: a + b, [(F.substring("h", 4 * j + 1, 4) >= s).cast("long") for s in POISSON_STEPS])
               for j in range(_PER_HASH)]
    sums = (rows.select("metric", "block", "f", *[w.alias(f"w{j}") for j, w in enumerate(weights)])
            .groupBy("metric", "block").agg(
                F.count(F.lit(1)).alias("n"),
                F.array(*[F.struct((F.col("block") * _PER_HASH + j).alias("r"), F.sum(F.col(f"w{j}") * F.col("f")).alias("f"),
                                   F.sum(f"w{j}").alias("w")) for j in range(_PER_HASH)]).alias("s")))
    means = (sums.select("metric", "n", F.inline("s")).where((F.col("w") > 0) & (F.col("r") < resamples))
             .withColumn("mean", F.col("f").cast("double") / F.col("w").cast("double") / _F_UNITS))
    tail = (1 - confidence) / 2
    agg = means.groupBy("metric").agg(F.percentile("mean", [tail, 0.5, 1 - tail]).alias("q"), F.max("n").alias("n_pairs")).select(
        "metric", F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"), "n_pairs")
    if metrics is None:
        return agg
    names = scores.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    return names.join(agg, "metric", "left").select(
        "metric", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("low", "mid", "high")],
        F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"))


ALL_METRICS = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def pair_predictions(predictions: DataFrame, references: DataFrame, key: str = KEY,
                     pred: str = "prediction", ref: str = "summary") -> DataFrame:
    """Prediction i <-> reference i, as an equi-join on the pair key."""
    return predictions.select(key, pred).join(
        references.select(key, F.col(ref).alias("reference")), key, "inner")
