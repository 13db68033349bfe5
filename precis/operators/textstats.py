"""Text statistics of the UI (X11-X14) as columns of a pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def text_stats(df: DataFrame, text: str = "text", summary: str = "summary",
               key: str = "pair_id") -> DataFrame:
    """Per row: word and character counts of both sides, compression
    percentage, word delta and the two preview forms."""
    return df.select(
        key,
        tx.word_count(text).alias("words_text"),
        tx.word_count(summary).alias("words_summary"),
        tx.char_count(text).alias("chars_text"),
        tx.char_count(summary).alias("chars_summary"),
        tx.compression_pct(summary, text).alias("compression_pct"),
        tx.word_delta(summary, text).alias("word_delta"),
        tx.preview_always(text, 500).alias("preview_500"),
        tx.preview_if_longer(text, 1000).alias("preview_1000"),
    )
