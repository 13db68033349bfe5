"""Run-log analytics: W2 running_best, W3 early_stop, W4 best_epoch, A7.

The reference's epoch loop is sequential; here it is a window partitioned by
run (one run's epochs per group, never the whole log) ordered by epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import cosine_lr, round4, round6

PATIENCE = 3


def running_best(log: DataFrame, run: str = "run_id", epoch: str = "epoch",
                 loss: str = "val_loss") -> DataFrame:
    """``best_before`` = lowest loss of the earlier epochs (null before
    the first); ``improved`` iff strictly lower than it (+inf at start).  NaN
    never improves and never becomes the best."""
    earlier = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    clean = F.when(F.isnan(F.col(loss)), F.lit(None)).otherwise(F.col(loss))
    best_before = F.min(clean).over(earlier)
    improved = (~F.isnan(F.col(loss))) & (F.col(loss) < F.coalesce(best_before, F.lit(float("inf"))))
    return log.withColumn("best_before", best_before).withColumn("improved", F.coalesce(improved, F.lit(False)))


def early_stop(log: DataFrame, run: str = "run_id", epoch: str = "epoch",
               loss: str = "val_loss", patience: int = PATIENCE) -> DataFrame:
    """W3 per epoch: patience counter (0 on improvement, else +1) and
    ``stopped`` = first epoch whose counter reaches ``patience``."""
    rb = running_best(log, run, epoch, loss)
    upto = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    last_improved = F.coalesce(F.max(F.when(F.col("improved"), F.col(epoch))).over(upto), F.lit(0))
    return rb.withColumn("patience_counter", (F.col(epoch) - last_improved).cast("int"))


def run_summary(log: DataFrame, run: str = "run_id", epoch: str = "epoch",
                loss: str = "val_loss", patience: int = PATIENCE) -> DataFrame:
    """W3 + W4 per run: ``stop_epoch`` (first epoch with counter >= patience,
    else the last epoch), ``best_epoch`` (last improvement at or before the
    stop: the checkpoint kept) and its loss."""
    per_epoch = early_stop(log, run, epoch, loss, patience)
    agg = per_epoch.groupBy(run).agg(
        F.min(F.when(F.col("patience_counter") >= patience, F.col(epoch))).alias("_stop"),
        F.max(epoch).alias("last_epoch"),
        F.collect_list(F.when(F.col("improved"), F.struct(F.col(epoch).alias("e"),
                                                         F.col(loss).alias("l")))).alias("_imp"))
    stop = F.coalesce(F.col("_stop"), F.col("last_epoch"))
    kept = F.filter("_imp", lambda s: s["e"] <= stop)
    best = F.array_max(kept)
    return agg.select(run, stop.alias("stop_epoch"), (F.col("_stop").isNotNull()).alias("stopped_early"),
                      best["e"].alias("best_epoch"), best["l"].alias("best_val_loss"))


def lr_log(log: DataFrame, run: str = "run_id", epoch: str = "epoch", lr: float = 1e-4,
           enabled: bool = True) -> DataFrame:
    """X15 + X16 on a run log: T_max = the run's number of epochs."""
    t = F.max(epoch).over(Window.partitionBy(run))
    return log.withColumn("lr", cosine_lr(F.col(epoch), t, lr, enabled=enabled)) \
              .withColumn("lr_shown", round6(F.col("lr")))


def epoch_loss(batch_losses: DataFrame, run: str = "run_id", loss: str = "batch_loss") -> DataFrame:
    """Unweighted mean of the batch means (a short last batch weighs the
    same); no batch -> 0.0."""
    return batch_losses.groupBy(run).agg(
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("epoch_loss"),
        F.count(F.lit(1)).alias("n_batches")).withColumn("epoch_loss_shown", round4("epoch_loss"))
