"""Count-based next-token scorer (G8), token cross entropy (A6) and epoch
loss from batches (A7).

The reference trains a network on teacher-forced pairs (decoder input token
i -> target token i, pads ignored).  Here the same pairs are counted: the
table (prev, next, n) gives p(next | prev) with add-alpha smoothing over the
vocabulary.  It is the "model" handed to generation; its size is bounded by
the number of distinct bigrams of the training data (and by V x V).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import PAD

ALPHA = 0.1


def teacher_forced_pairs(batches: DataFrame, pad: int = PAD) -> DataFrame:
    """(batch_id, prev, next) for every target position whose target is not
    the pad id."""
    z = F.arrays_zip(F.col("tgt_in").alias("prev"), F.col("tgt_out").alias("next"))
    return batches.select("batch_id", F.inline(z)).where(F.col("next") != pad)


def next_token_table(batches: DataFrame, vocab_size: int, alpha: float = ALPHA,
                     pad: int = PAD) -> DataFrame:
    """(prev, next, n, total, logp) with
    logp = ln((n + alpha) / (total(prev) + alpha * V)).  The window holds one
    ``prev`` token's successors (at most V rows)."""
    counts = teacher_forced_pairs(batches, pad).groupBy("prev", "next").agg(
        F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("prev"))
    return counts.withColumn("total", total).withColumn(
        "logp", F.log((F.col("n") + alpha) / (F.col("total") + alpha * vocab_size)))


def _met(batches: DataFrame, table: DataFrame, pad: int) -> DataFrame:
    """``batch_id, n, total`` of every non-pad target; 0 for pairs never seen."""
    pos = teacher_forced_pairs(batches, pad)
    pairs = table.select("prev", "next", "n")
    totals = table.select("prev", "total").distinct()
    # AQE broadcasts the table when its measured bytes allow; else a shuffle
    # join, whose partitions of hot bigrams it splits
    joined = pos.join(pairs, ["prev", "next"], "left").join(totals, "prev", "left")
    return joined.select("batch_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))


def _loss(epoch: int, vocab_size: int, alpha: float):
    """-ln p after ``epoch`` passes over the training pairs."""
    return -F.log((epoch * F.col("n") + alpha) / (epoch * F.col("total") + alpha * vocab_size))


def token_cross_entropy(batches: DataFrame, table: DataFrame, vocab_size: int,
                        alpha: float = ALPHA, pad: int = PAD) -> DataFrame:
    """Per batch, mean of -ln p(next | prev) over the non-pad targets;
    pairs never seen get the smoothed probability alpha / (total + alpha V)."""
    return _met(batches, table, pad).groupBy("batch_id").agg(
        F.avg(_loss(1, vocab_size, alpha)).alias("batch_loss"), F.count(F.lit(1)).alias("n_tokens"))


def epoch_losses(batches: DataFrame, table: DataFrame, vocab_size: int, epochs: int,
                 alpha: float = ALPHA, pad: int = PAD) -> DataFrame:
    """A6 + A7 after each of ``epochs`` passes: ``epoch, loss, n_batches``, the
    mean of the batch means.  A pass counts the training pairs once more, so
    after e passes p = (e n + alpha) / (e total + alpha V): less and less is left
    for pairs never seen, which is how this scorer overfits.  All epochs come
    from one join and one aggregation per batch."""
    per_batch = _met(batches, table, pad).groupBy("batch_id").agg(
        *[F.avg(_loss(e, vocab_size, alpha)).alias(f"e{e}") for e in range(1, epochs + 1)])
    rows = F.inline(F.array(*[F.struct(F.lit(e).alias("epoch"), F.col(f"e{e}").alias("batch_loss")) for e in range(1, epochs + 1)]))
    return per_batch.select(rows).groupBy("epoch").agg(F.avg("batch_loss").alias("loss"), F.count(F.lit(1)).alias("n_batches"))


def table_after(table: DataFrame, epoch: int, vocab_size: int, alpha: float = ALPHA) -> DataFrame:
    """G8 after ``epoch`` passes."""
    n, total = F.col("n") * epoch, F.col("total") * epoch
    return table.select("prev", "next", n.alias("n"), total.alias("total"),
                        F.log((n + alpha) / (total + alpha * vocab_size)).alias("logp"))
