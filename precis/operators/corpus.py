"""Tokenizer corpus: U3 unpivot_corpus, F5, A2 pretoken_counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pretokenize


def unpivot_corpus(df: DataFrame, keys: tuple[str, ...] = ("source", "pair_id")) -> DataFrame:
    """U3 + F5: texts and summaries as one ``value`` column with its ``kind``;
    empty or null strings are dropped (each side on its own)."""
    keep = [k for k in keys if k in df.columns]
    long = df.select(*keep, F.expr("stack(2, 'text', text, 'summary', summary) AS (kind, value)"))
    return long.where(F.col("value") != "")


def pretoken_counts(corpus: DataFrame, value: str = "value") -> DataFrame:
    """A2: frequency of every pre-token over the corpus.  The explode stays
    inside the scan stage; partial aggregation combines hot pre-tokens
    (' de', ' la') map-side before the shuffle, so a key that holds a third of
    all rows costs one row per task, not a third of the data."""
    return corpus.select(F.explode(pretokenize(F.col(value))).alias("pretoken")) \
        .groupBy("pretoken").agg(F.count(F.lit(1)).alias("n"))
