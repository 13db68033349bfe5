"""Inventory of Parquet files, and keys of their rows.

Table order is the order of the listed paths, inside a path that of the file
names (sub-folders included), inside a file that of its rows.  ``pair_id`` is
the number of rows in all files before a row's own, plus its index there: unique
and in table order whatever the files are called.

The inventory is a table with a row per file.  Spark lists the files; a scan
without a column, which reads footers alone, counts their rows in tasks; a file
that gives no row has its footer read once more, which tells an empty file from
a broken one.  The driver makes the same few calls whatever the number of files.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pairs import KEY
from ..session import materialize
from .shared import open_folder

#: an inventory of at most so many files (about 200 bytes each) may be broadcast
BROADCAST_FILES = 200_000
INVENTORY = "file string, plain string, place int, n long, error string"


class BrokenFiles(ValueError):
    """Some files of a source cannot be read; ``files`` names the first ones."""

    def __init__(self, files: list[tuple[str, str]], n: int):
        self.files, self.n = files, n
        super().__init__(f"{n} unreadable file(s): " + "; ".join(f"{os.path.basename(f)} ({e})" for f, e in files))


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _plain(path: str, folder: str) -> str:
    """A path as given, absolute and without scheme."""
    plain = urlparse(path).path if "://" in path or path.startswith("file:") else path
    return os.path.normpath(plain if plain.startswith("/") else f"{folder}/{plain}")


def _footer_rows(batches):
    """Row count, or what is wrong, of files that gave no row."""
    import pyarrow.parquet as pq
    for batch in batches:
        out = []
        for file, plain in zip(batch["file"], batch["plain"]):
            try:
                scheme = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/]+", file)  # a store other than the local disk
                fs, path = open_folder((scheme[0] if scheme else "") + plain)
                with fs.open_input_file(path) as f:
                    out.append((file, pq.ParquetFile(f).metadata.num_rows, None))
            except Exception as exc:  # noqa: BLE001 - the reason is the result
                out.append((file, None, f"{type(exc).__name__}: {str(exc)[:200]}"))
        yield pd.DataFrame(out, columns=["file", "n", "error"])


def inventory(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows as in ``INVENTORY`` of the Parquet files below ``paths``: ``file``
    as Spark names it, its ``plain`` path, the ``place`` of the given path it
    lies below, rows ``n``, or the ``error`` that reading its footer gives."""
    name = F.col("_metadata.file_path")
    raw = F.regexp_replace(F.regexp_replace(name, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), r"\+", "%2B")
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
              .select(name.alias("file"), F.url_decode(raw).alias("plain")))
    if len(paths) == 1:
        placed = listed.withColumn("place", F.lit(0))
    else:
        folder = file_system(spark, ".")[0].getWorkingDirectory().toUri().getPath()
        given = spark.createDataFrame([(_plain(p, folder), k) for k, p in enumerate(paths)], "above string, place int")
        parts = F.split("plain", "/")
        above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
        placed = (listed.select("file", "plain", F.explode(above).alias("above")).join(given, "above")
                  .groupBy("file", "plain").agg(F.min("place").alias("place")))
    counts = (_parquet(spark, paths, tolerant=True).select(name.alias("file")).groupBy("file")
              .agg(F.count(F.lit(1)).alias("n")))
    counted = materialize(placed.join(counts, "file", "left"), "inventory")
    checked = counted.where("n IS NULL").select("file", "plain").mapInPandas(_footer_rows, "file string, n long, error string")
    found = (counted.where("n IS NOT NULL").withColumn("error", F.lit(None).cast("string"))
             .unionByName(counted.where("n IS NULL").drop("n").join(checked, "file")))
    return materialize(found.select("file", "plain", "place", "n", "error"), "inventory")


def _parquet(spark: SparkSession, paths: Sequence[str], tolerant: bool = False) -> DataFrame:
    return (spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", str(tolerant).lower())
            .parquet(*paths))


def broken_files(files: DataFrame, shown: int = 5) -> BrokenFiles | None:
    """The files of an inventory that cannot be read."""
    bad = files.where("error IS NOT NULL")
    first = bad.orderBy("place", "plain").limit(shown).collect()
    return BrokenFiles([(r["file"], r["error"]) for r in first], bad.count()) if first else None


def keyed_rows(spark: SparkSession, paths: Sequence[str], files: DataFrame, first: int = 0, tolerant: bool = False) -> DataFrame:
    """The rows of ``paths`` with ``pair_id``, which starts at ``first``; rows
    of files without an entry in the inventory are left out."""
    before = Window.orderBy("place", "plain").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    offsets = files.where("error IS NULL").select(
        F.col("file").alias("_file"), (F.coalesce(F.sum("n").over(before), F.lit(0)) + first).alias("_off"))
    if files.count() <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    located = _parquet(spark, paths, tolerant).withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    return (located.drop(KEY).join(offsets, "_file")
            .withColumn(KEY, F.col("_off") + F.col("_row")).drop("_file", "_row", "_off"))


def read_in_order(spark: SparkSession, paths: Sequence[str], first: int = 0) -> DataFrame:
    """The rows of ``paths`` with ``pair_id``, which starts at ``first``;
    :class:`BrokenFiles` if a file's footer cannot be read."""
    files = inventory(spark, paths)
    bad = broken_files(files)
    if bad:
        raise bad
    return keyed_rows(spark, paths, files, first)


def read_what_is_whole(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame, Callable[[], int]]:
    """``(rows, files, missing)``: the rows of all files that can be read, the
    inventory, and a function that, once an action has read ``rows`` whole,
    tells how many rows are missing that the footers promise: a file that breaks
    off inside is read up to there and the job goes on."""
    files = inventory(spark, paths)
    promised = files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seen = Observation()
    rows = keyed_rows(spark, paths, files, tolerant=True).observe(seen, F.count(F.lit(1)).alias("n"))
    return rows, files, lambda: promised - seen.get["n"]
