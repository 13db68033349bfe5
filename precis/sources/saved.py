"""S4 scan_saved and S5 scan_saved_dir: tables saved as Parquet folders.

A folder is classified once, from its listing: ``splits`` (a split dictionary:
a marker file or sub-folders named like splits), ``table`` (anything else) or
``missing``.  Listing uses the Hadoop FileSystem of the path, so the same code
lists local folders, HDFS or object stores.  Rows get ``pair_id`` in file order
(see ``files``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import KEY, normalise, require_split
from .files import file_system, read_in_order
from .scan import union_sources

#: Folders that hold no data set, split names, marker file.
SKIP_DIRS = frozenset({"temp_cache", "abstract_tmp", "model_cache"})
SPLIT_NAMES = ("train", "test", "validation")
MARKER = "dataset_dict.json"


@dataclass(frozen=True)
class Saved:
    path: str
    kind: str                       # "missing", "table" or "splits"
    splits: tuple[str, ...] = ()

    def folder(self, split: str) -> str:
        return f"{self.path}/{split}"


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return bool(fs.exists(p))


def list_children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is_directory) of the entries of ``path``."""
    fs, p = file_system(spark, path)
    return sorted((st.getPath().getName(), bool(st.isDirectory())) for st in fs.listStatus(p))


def classify(spark: SparkSession, path: str) -> Saved:
    path = path.rstrip("/")
    if not path_exists(spark, path):
        return Saved(path, "missing")
    children = dict(list_children(spark, path))
    splits = tuple(s for s in SPLIT_NAMES if children.get(s))
    return Saved(path, "splits" if splits or MARKER in children else "table", splits)


def scan_saved(spark: SparkSession, path: str, messages: list[str] | None = None):
    """The table at ``path``, or a dict split -> table for a split
    dictionary; None, with a message, if there is nothing."""
    saved = classify(spark, path)
    if saved.kind == "missing":
        if messages is not None:
            messages.append(f"nothing is saved at {path}: path not found")
        return None
    if saved.kind == "splits":
        return {s: read_in_order(spark, [saved.folder(s)]) for s in saved.splits}
    return read_in_order(spark, [saved.path])


def scan_saved_split(spark: SparkSession, path: str, split: str = "test") -> DataFrame | None:
    """One split of a saved dictionary (F9: ValueError if it has none of that
    name), rows as they are: no rename, no filter (T16).  None if nothing is
    saved there."""
    saved = classify(spark, path)
    if saved.kind == "missing":
        return None
    require_split(saved.splits, split, path)
    return read_in_order(spark, [saved.folder(split)])


def training_folders(spark: SparkSession, base_dir: str) -> list[tuple[str, str]]:
    """(child, folder to read) of every child that is a split dictionary with
    a training split."""
    found = ((name, classify(spark, f"{base_dir.rstrip('/')}/{name}"))
             for name, is_dir in list_children(spark, base_dir) if is_dir and name not in SKIP_DIRS)
    return [(name, s.folder("train")) for name, s in found if "train" in s.splits]


def scan_saved_dir(spark: SparkSession, base_dir: str = "data",
                   messages: list[str] | None = None) -> DataFrame | None:
    """The training splits of the children of ``base_dir``, through F1-F3
    with the default names.  ``pair_id`` runs on from child to child, in the
    order of their names; ``source`` holds the name.  A child that cannot be
    read is noted and left out; None if no table is left."""
    notes = messages if messages is not None else []
    if not path_exists(spark, base_dir):
        notes.append(f"nothing is saved at {base_dir}: path not found")
        return None
    parts, first = [], 0
    for name, folder in training_folders(spark, base_dir):
        try:
            rows = read_in_order(spark, [folder], first)
            parts.append(normalise(rows).withColumn("source", F.lit(name)))
            last = rows.agg(F.max(KEY)).first()[0]  # None: no row
            first = first if last is None else last + 1
        except Exception as exc:  # noqa: BLE001 - one child must not take the others with it
            notes.append(f"{name} was left out: {type(exc).__name__}: {str(exc)[:200]}")
    if not parts:
        notes.append(f"no training split below {base_dir}")
        return None
    return union_sources(parts)
