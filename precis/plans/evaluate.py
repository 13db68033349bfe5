"""Evaluation jobs: the flagship ROUGE query and P2 evaluate_model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rouge
from ..sources import scan


def flagship_rouge(spark: SparkSession, sf_dir: str, source: str = "conv",
                   split: str = "test") -> DataFrame:
    """Pairs of one source and split (S2, F1-F3) scored against themselves
    as prediction=text, reference=summary: mean ROUGE-1 / ROUGE-2 F."""
    pairs = scan.load_source(spark, source, split, None, sf_dir)
    scored = rouge.rouge_n(pairs.select("pair_id", F.col("text").alias("prediction"),
                                        F.col("summary").alias("reference")))
    return rouge.rouge_corpus(scored)
