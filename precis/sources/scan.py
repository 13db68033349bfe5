"""S2 scan_source, L1/L2 limits and U1/U2 unions of pair sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import first_n
from ..operators.pairs import KEY, normalise
from .files import BrokenFiles, read_in_order
from .registry import ALL, Registry, SourceSpec


def split_of_bucket(bucket) -> F.Column:
    """bucket -> split: 0 = test, 1 = validation, others = train."""
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    return F.when(b == 0, "test").when(b == 1, "validation").otherwise("train")


def scan_source(spark: SparkSession, spec: SourceSpec, split: str, base_dir: str) -> DataFrame:
    """The raw rows of one source and split, with a ``pair_id`` key.
    Parquet sources read only the files of the split, in table order (see
    ``files``); builder sources filter their ``bucket``-derived split."""
    if spec.parquet_files:
        return read_in_order(spark, [f"{base_dir.rstrip('/')}/{f}" for f in spec.parquet_files[split]])
    return spec.builder(spark, base_dir).where(split_of_bucket("bucket") == split)


def load_source(spark: SparkSession, name: str, split: str = "train",
                max_samples: int | None = None, base_dir: str = "",
                registry: Registry | None = None) -> DataFrame:
    """One source: S3 check, S2 scan, F1-F3, then L1 on the filtered rows
    (``max_samples=None`` keeps all; 0 keeps none)."""
    reg = registry or default_registry()
    spec = reg.validate(name, split)
    raw = scan_source(spark, spec, split, base_dir)
    pairs = normalise(raw, spec.text_column, spec.summary_column)
    return first_n(pairs, max_samples, (KEY,))


@dataclass
class LoadReport:
    source: str
    status: str
    error: str | None = None
    broken_files: int = 0


def source_quota(max_samples: int | None, n_sources: int) -> int | None:
    """L2: an equal share for every source, rounded down and never passed on;
    no limit (None or 0) is no quota."""
    return max_samples // n_sources if max_samples else None


def load_pairs(spark: SparkSession, name: str = "conv", split: str = "train",
               max_samples: int | None = None, base_dir: str = "",
               registry: Registry | None = None,
               report: list[LoadReport] | None = None) -> DataFrame:
    """Pairs of one source, or of ``all``: every source up to its quota (L2),
    concatenated in registry order (U1) with ``source`` and ``source_rank``.
    A source that fails is left out and noted in ``report`` (U2), be it that its
    path or schema is wrong or that the footer of one of its files cannot be
    read; if none is left, ValueError."""
    reg = registry or default_registry()

    def tagged(own: str, limit: int | None) -> DataFrame:
        return load_source(spark, own, split, limit, base_dir, reg).withColumns(
            {"source": F.lit(own), "source_rank": F.lit(reg.rank(own))})

    if name != ALL:
        return tagged(name, max_samples)
    quota, notes = source_quota(max_samples, len(reg.sources)), []
    parts = [p for p in (_attempt(own, lambda own=own: tagged(own, quota), notes) for own in reg.names())
             if p is not None]
    if report is not None:
        report += notes
    if not parts:
        raise ValueError("every source failed: " + "; ".join(f"{n.source} ({n.error})" for n in notes))
    return union_sources(parts)


def _attempt(own: str, build, notes: list[LoadReport]) -> DataFrame | None:
    try:
        part = build()
    except Exception as exc:  # noqa: BLE001 - one source must not take the others with it
        notes.append(LoadReport(own, "failed", f"{type(exc).__name__}: {exc}", exc.n if isinstance(exc, BrokenFiles) else 0))
        return None
    notes.append(LoadReport(own, "loaded"))
    return part


_DEFAULT: list[Callable[[], Registry]] = []


def set_default_registry(build: Callable[[], Registry]) -> None:
    """The registry used where none is given."""
    _DEFAULT[:] = [build]


def default_registry() -> Registry:
    if not _DEFAULT:
        raise ValueError("no registry given and no default set")
    return _DEFAULT[0]()


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Concatenation, duplicates kept; order = (source_rank, pair_id)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def report_frame(spark: SparkSession, report: list[LoadReport]) -> DataFrame:
    """U2 report as a table: source, status, error, files that cannot be read."""
    return spark.createDataFrame([(r.source, r.status, r.error, r.broken_files) for r in report],
                                 "source string, status string, error string, broken_files int")
