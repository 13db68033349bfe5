"""The corpus pipeline: quality classifier, line dedup, near-dedup, benchmark
decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a runner writes
it as Parquet and hands the reread table to the next stage.  All but the last
return the columns of ``documents``; the last returns the packing plan, one row
per piece of a document that is left.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm import decontaminate, line_dedup, order_minhash, packing, quality
from precis.llm.common import stored, table
from precis.session import scoped, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.5 or more).
    It learns from the labelled documents of its own input.  A null text scores
    as an empty one and stays null; a row with a null id is scored like any
    other; no row is added or repeated."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(COLUMNS), model).where("_score >= 0.5").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that line dedup drops; ``n_chars``
    counts what is left, which may be nothing.  A null text becomes empty; each
    row counts as a document, and a null id is smaller than every id."""
    kept = line_dedup.line_dedup(docs.select(COLUMNS))
    return kept.withColumn("text", F.col("_kept")).withColumn(
        "n_chars", F.length("_kept").cast("long")).select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one document: that with the smallest
    id, null last.  Rows that repeat an id, or have none, are documents like
    all others; of rows equal in id and text one stays.  Texts without a word
    (null and empty ones count as equal) are near-duplicates of equal texts
    only."""
    return order_minhash.one_of_each_class(docs.select(COLUMNS)).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.  Null and empty texts contain
    none and stay as they are, as do repeated rows and rows without an id."""
    return decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan of what is left; a null or empty text is one piece."""
    return packing.pack(docs)


def _stage(fn):
    """A stage that may be started from any folder and leaves no table behind
    that its result does not read."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return scoped(fn)(spark, docs, sf_dir)
    return run_stage


STAGES = [
    ("quality_classifier", _stage(keep_quality)),
    ("line_dedup", _stage(drop_repeated_lines)),
    ("minhash_near_dedup", _stage(keep_one_of_near_copies)),
    ("benchmark_decontamination", _stage(drop_contaminated)),
    ("packing", _stage(pack)),
]

#: The classifier, the near-dedup sketches and the embedding have no SQL form.
ORACLE_SQL = None


@scoped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
