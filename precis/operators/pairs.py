"""Canonical pair table: F1-F9, L3, L5, L7, A1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, preview_always

KEY = "pair_id"


def rename_canonical(df: DataFrame, text_column: str = "text",
                     summary_column: str = "summary") -> DataFrame:
    """mapped columns become ``text`` and ``summary`` (no-op if so named)."""
    mapping = {}
    if text_column != "text":
        mapping[text_column] = "text"
    if summary_column != "summary":
        mapping[summary_column] = "summary"
    return df.withColumnsRenamed(mapping) if mapping else df


def keep_pair_columns(df: DataFrame, keep: tuple[str, ...] = (KEY,)) -> DataFrame:
    """drop everything but the keys, ``text`` and ``summary``."""
    return df.select(*[c for c in keep if c in df.columns], "text", "summary")


def drop_empty_pairs(df: DataFrame) -> DataFrame:
    """keep rows whose text and summary are both non-null and non-empty.
    Whitespace-only strings are kept (F6 deals with them).  The predicate is
    pushed to the Parquet scan."""
    return df.where((F.col("text") != "") & (F.col("summary") != ""))


def normalise(df: DataFrame, text_column: str = "text", summary_column: str = "summary",
              keep: tuple[str, ...] = (KEY,)) -> DataFrame:
    """F1 + F2 + F3."""
    return drop_empty_pairs(keep_pair_columns(rename_canonical(df, text_column, summary_column), keep))


def null_to_empty(df: DataFrame, cols: tuple[str, ...] = ("text", "summary")) -> DataFrame:
    """null -> ''."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in cols})


def blank_guard(df: DataFrame, text_col: str = "text", out_col: str = "needs_generation") -> DataFrame:
    """flag rows whose text is null, empty or blank (no generation; the
    summary is '')."""
    return df.withColumn(out_col, ~is_blank(F.col(text_col)))


def drop_blank_scored(df: DataFrame, pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """the spot check skips pairs whose stripped prediction or reference
    is empty."""
    return df.where(~is_blank(F.col(pred)) & ~is_blank(F.col(ref)))


def require_nonempty(df: DataFrame, what: str = "evaluation table") -> DataFrame:
    """F8: zero rows -> ValueError (one cheap ``isEmpty`` job)."""
    if df.isEmpty():
        raise ValueError(f"no rows: the {what} is empty")
    return df


def require_split(splits: set[str] | list[str], split: str = "test", where: str = "") -> None:
    """missing split -> ValueError."""
    if split not in set(splits):
        raise ValueError(f"no {split} split at {where}; found: {', '.join(sorted(splits)) or 'none'}")


def validation_cap(max_samples: int | None) -> int:
    """L3: validation rows = min(2000, max_samples or 2000)."""
    return min(2000, max_samples if max_samples else 2000)


def head_preview(df: DataFrame, width: int = 500) -> DataFrame:
    """Every row numbered from 1 in key order, text cut to ``width``
    characters plus '...' (positions computed without a single-task window)."""
    from .ordering import with_positions
    pos = with_positions(df, [KEY], "pos")
    return pos.select((F.col("pos") + 1).alias("row_no"), KEY,
                      preview_always(F.col("text"), width).alias("text_preview"), "summary")


def spot_check_rows(rows: DataFrame, limit: int = 20, batch_size: int = 32) -> DataFrame:
    """First ``min(limit, rows)`` rows of the first batch (L1: numbering
    every row to take twenty is not needed)."""
    from .ordering import first_n
    return first_n(rows, min(limit, batch_size), (KEY,))


def row_counts(df: DataFrame, source_col: str = "source") -> DataFrame:
    """A1: rows per source plus the total (``source`` null) via ROLLUP."""
    return df.rollup(source_col).agg(F.count(F.lit(1)).alias("n_rows"))
