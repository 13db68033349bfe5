"""Token-id array functions: X5 truncate_ids, X6 frame_target, X7 pad_ids,
X8 shift_target, X9 pad_mask.  All built-in array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: special ids (order of the special tokens) -----------------
SOS, PAD, EOS, UNK, MASK = 0, 1, 2, 3, 4
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truncate_ids(ids, n: int) -> Column:
    """The first ``n`` ids (``max_len`` for sources, ``max_len - 2`` for
    targets)."""
    if n < 0:
        raise ValueError("max_len must be >= 2 (the target keeps max_len - 2 ids)")
    return F.slice(_c(ids), 1, n) if n > 0 else F.array().cast("array<int>")


def frame_target(ids, sos: int = SOS, eos: int = EOS) -> Column:
    """``[sos] + ids + [eos]``."""
    return F.concat(F.array(F.lit(sos)), _c(ids), F.array(F.lit(eos)))


def pad_ids(ids, length, pad: int = PAD) -> Column:
    """Right-pad with ``pad`` up to ``length``."""
    n = _c(length) if not isinstance(length, int) else F.lit(length)
    return F.concat(_c(ids), F.array_repeat(F.lit(pad), F.greatest(n - F.size(_c(ids)), F.lit(0))))


def shift_input(ids) -> Column:
    """Decoder input = all but the last position."""
    return F.slice(_c(ids), 1, F.size(_c(ids)) - 1)


def shift_output(ids) -> Column:
    """Decoder target = all but the first position."""
    return F.slice(_c(ids), 2, F.size(_c(ids)) - 1)


def pad_mask(ids, pad: int = PAD) -> Column:
    """True where the id is the pad id."""
    return F.transform(_c(ids), lambda x: x == F.lit(pad))
