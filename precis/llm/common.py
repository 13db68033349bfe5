"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from precis.session import materialize, ship_package, shared_path, shuffle_partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder."""
    return shared_path(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and
    fixes the rows, so that two later passes see the same ones."""
    return materialize(df, name)


def free_name(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores in front until no column has it (Spark does
    not tell names apart by case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def key128(col: Column) -> list[Column]:
    """128 bits of hash of a string column as two longs (two seeds)."""
    return [F.xxhash64(col), F.xxhash64(F.lit(31), col)]


def pairs(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small local table of proven size."""
    return spark.createDataFrame(rows, schema)


def positions(df: DataFrame, group: str, by: str, order: list[str], name: str = "_pos") -> DataFrame:
    """``df`` with the position (from 0) of each row in its group, ordered by
    the long column ``by`` (null first), then ``order``.  The quantiles of
    ``by`` cut each group into ranges, so that a group of any size is numbered
    by many tasks; a range's offset is the sum of the counts before it.  ``df``
    is read three times: store it first if it is costly."""
    n = shuffle_partitions(df.sparkSession)
    quantiles = F.percentile_approx(by, [k / n for k in range(1, n)] or [0.5], 10_000)
    cuts = sorted(set(df.agg(quantiles).first()[0] or []))  # at most one per shuffle partition
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    cell = F.coalesce(F.size(F.filter(bounds, lambda c: c <= F.col(by))), F.lit(0))
    cut = df.withColumn("__range", F.when(F.col(by).isNull(), -1).otherwise(cell))
    counts = (cut.groupBy(F.col(group).alias("__group"), F.col("__range").alias("__at"))
              .agg(F.count(F.lit(1)).alias("__n")))
    before = W.partitionBy("__group").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    rank = F.row_number().over(W.partitionBy(group, "__range").orderBy(F.col(by).asc_nulls_first(),
                                                                       *[F.col(c).asc_nulls_first() for c in order]))
    joined = cut.withColumn("__rank", rank).join(
        offsets, cut[group].eqNullSafe(offsets["__group"]) & (cut["__range"] == offsets["__at"]))
    return (joined.withColumn(name, F.col("__rank") - 1 + F.col("__offset"))
            .drop("__range", "__rank", "__offset", "__group", "__at"))
