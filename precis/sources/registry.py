"""S1 source registry and S3 validation.

A source is either a list of Parquet files per split (the usual case: the
split is chosen by path, so only those files are read) or a builder that
returns a DataFrame with a ``bucket`` column, from which the split is derived
(used by the stand-in sources built from the given tables).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SPLITS = ("train", "test", "validation")
ALL = "all"


@dataclass(frozen=True)
class SourceSpec:
    name: str
    text_column: str = "text"
    summary_column: str = "summary"
    #: split -> Parquet files, relative to the base folder given at scan time
    parquet_files: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: (spark, base_dir) -> DataFrame with ``pair_id`` and ``bucket``
    builder: Callable[[SparkSession, str], DataFrame] | None = None

    def splits(self) -> tuple[str, ...]:
        return tuple(self.parquet_files) if self.parquet_files else SPLITS


@dataclass(frozen=True)
class Registry:
    sources: tuple[SourceSpec, ...]

    def names(self) -> list[str]:
        return [s.name for s in self.sources]

    def rank(self, name: str) -> int:
        return self.names().index(name)

    def get(self, name: str) -> SourceSpec:
        for s in self.sources:
            if s.name == name:
                return s
        raise KeyError(name)

    def validate(self, name: str, split: str) -> SourceSpec:
        """S3: the entry of ``name``; ValueError with the choices when the
        registry lacks the source or the source lacks the split."""
        by_name = {s.name: s for s in self.sources}
        for what, wanted, known in (("source", name, [*by_name, ALL]),
                                    ("split", split, by_name[name].splits() if name in by_name else ())):
            if wanted not in known or wanted == ALL:
                raise ValueError(f"No {what} {wanted!r}; choose from: {', '.join(known)}")
        return by_name[name]

    def as_frame(self, spark: SparkSession) -> DataFrame:
        """S1 as a table: one row per (source, split, file)."""
        rows = []
        for rank, s in enumerate(self.sources):
            if s.parquet_files:
                for split, files in s.parquet_files.items():
                    for f in files:
                        rows.append((s.name, rank, split, f, s.text_column, s.summary_column))
            else:
                for split in SPLITS:
                    rows.append((s.name, rank, split, None, s.text_column, s.summary_column))
        schema = ("source string, source_rank int, split string, path string, "
                  "text_col string, summary_col string")
        return spark.createDataFrame(rows, schema)
