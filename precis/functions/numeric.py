"""Numeric column functions: X15 cosine_lr, X16 round4 / round6."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_lr(epoch, t_max, lr: float = 1e-4, eta_min_ratio: float = 0.01,
              enabled: bool = True) -> Column:
    """Learning rate logged for ``epoch`` (from 1), i.e. after the
    scheduler step: ``eta + (lr - eta) * (1 + cos(pi * e / T)) / 2`` with
    ``eta = 0.01 * lr``; constant ``lr`` when the schedule is off."""
    e = F.col(epoch) if isinstance(epoch, str) else epoch
    t = F.col(t_max) if isinstance(t_max, str) else (t_max if isinstance(t_max, Column) else F.lit(t_max))
    if not enabled:
        return F.lit(float(lr))
    eta = lr * eta_min_ratio
    return F.lit(eta) + F.lit(lr - eta) * (F.lit(1.0) + F.cos(F.lit(math.pi) * e / t)) / F.lit(2.0)


def round4(x) -> Column:
    """Scores and losses are shown with 4 decimals."""
    return F.round(F.col(x) if isinstance(x, str) else x, 4)


def round6(x) -> Column:
    """The learning rate is shown with 6 decimals."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6)
