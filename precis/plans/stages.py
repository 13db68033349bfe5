"""Stages of a job under one folder, each committed by a manifest.

A stage writes its data to ``<folder>/<name>`` and then, last, a manifest
``<folder>/_done/<name>.json`` with a fingerprint: a digest of the stage's
name, its parameters and the fingerprints of what it reads.  A later run that
asks for the same fingerprint finds the manifest and reads the data instead of
making it.  A stage that broke off has no manifest (an old one is removed before
its data is touched), so it is made again, and so is every stage behind it
whose fingerprint changes with it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import file_system


def fingerprint_of_files(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of all files below ``path``, as
    Spark lists them (one aggregate, no content read)."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    each = F.xxhash64("path", "length", F.unix_micros("modificationTime")).cast("decimal(38,0)")
    row = listed.agg(F.count(F.lit(1)).alias("n"), F.sum(each).alias("h"), F.sum("length").alias("bytes")).first()
    return _digest([row["n"], str(row["h"]), row["bytes"]])


def _digest(what) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()


class Stages:
    """Runs stages; ``made`` lists those that were not found committed."""

    def __init__(self, spark: SparkSession, folder: str, source: str):
        self.spark, self.root, self.source = spark, folder.rstrip("/"), source
        self.names: list[str] = []
        self.made: list[str] = []
        self._prints: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _manifest(self, name: str) -> str:
        return f"{self.root}/_done/{name}.json"

    def committed(self, name: str) -> str | None:
        """The fingerprint in the manifest of a stage, if there is one."""
        fs, p = file_system(self.spark, self._manifest(name))
        if not fs.exists(p):
            return None
        # read by name: files below a folder that starts with "_" are hidden from a scan
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["fingerprint"]
        except (ValueError, KeyError):
            return None
        finally:
            stream.close()

    def folder(self, name: str, build: Callable[[str], None], params: dict, after: Sequence[str] = ()) -> None:
        """A stage whose ``build(path)`` writes its own files below ``path``."""
        own = _digest([name, params, [self._prints[a] for a in after] or self.source])
        self.names.append(name)
        self._prints[name] = own
        if self.committed(name) == own:
            return
        self.made.append(name)
        fs, p = file_system(self.spark, self._manifest(name))
        fs.delete(p, False)
        build(self.path(name))
        out = fs.create(p, True)
        try:
            out.write(json.dumps({"stage": name, "params": params, "fingerprint": own}, sort_keys=True).encode())
        finally:
            out.close()

    def table(self, name: str, build: Callable[[], DataFrame], params: dict, after: Sequence[str] = ()) -> DataFrame:
        """A stage of one table; ``build`` is called only if it is not committed."""
        self.folder(name, lambda path: build().write.mode("overwrite").parquet(path), params, after)
        return self.spark.read.parquet(self.path(name))
