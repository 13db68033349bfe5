"""S6 scan_text_files: ``.txt`` / ``.md`` files as documents, strict UTF-8; and
documents written as text files of their own."""

from __future__ import annotations

import functools
import uuid

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scoped, ship_package, shuffle_partitions
from .files import file_system
from .shared import open_folder, open_store

#: files of a folder, so that tasks list many folders of bounded size in parallel
FOLDER_FILES = 1000
#: files, and bytes of them, that a reading task gets at most on average
TASK_FILES, TASK_BYTES = 10_000, 1 << 27
#: names in a batch of a listing; files and bytes in a batch of contents (one file may be more)
BATCH_NAMES, BATCH_FILES, BATCH_BYTES = 10_000, 1000, 1 << 24


def write_text_files(docs: DataFrame, path: str, key: str, value: str = "value", folder_files: int = FOLDER_FILES) -> None:
    """A file ``<key>=<its value>.txt`` for each key of a partition of ``docs``,
    its rows a line each (rows that repeat a key inside a partition share a
    file; null is a key).  Tasks write the files themselves: Spark's writer makes
    a folder, a checksum and a move of each file, some 20 ms a file.  A folder
    of files is hidden until it is whole, then renamed; what a broken attempt
    leaves stays hidden."""
    ship_package(docs.sparkSession)
    made, root = file_system(docs.sparkSession, path)
    made.mkdirs(root)  # also where there is no row

    def write(batches):
        from pyspark import TaskContext
        fs, root = open_folder(path)
        part, made, files, folder, out, last = TaskContext.get().partitionId(), 0, 0, None, None, None

        def show():
            nonlocal made
            shown = f"{root}/part-{part:05d}-{made:05d}"
            if fs.get_file_info(shown).type == FileType.NotFound:  # else another attempt was first
                fs.move(folder, shown)
            made += 1

        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None or k != last:
                    if out is not None:
                        out.close()
                    if files == folder_files:
                        show()
                        files, folder = 0, None
                    if folder is None:
                        folder = f"{root}/_part-{part:05d}-{made:05d}-{uuid.uuid4().hex}"
                        fs.create_dir(folder, recursive=True)
                    out, last, files = fs.open_output_stream(f"{folder}/{key}={'null' if k is None else k}.txt"), k, files + 1
                out.write(text.encode() + b"\n")
            yield batch.slice(0, 0).select([0])
        if out is not None:
            out.close()
            show()

    kind = docs.schema[key].dataType.simpleString()
    docs.select(key, value).sortWithinPartitions(key).mapInArrow(write, f"{key} {kind}").count()


def scan_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``.txt`` or ``.md`` file under ``path`` (a folder, a file or a
    pattern of them): ``text`` when the bytes are valid UTF-8, else ``text`` null
    and an ``error``.  Other files, hidden and empty ones are ignored, as by
    Spark's ``binaryFile`` reader.  That reader lists every file on the driver and
    makes a task of a few files, whatever their size; here tasks list and read.
    It is left the stores that tasks cannot open."""
    ship_package(spark)
    fs, given = file_system(spark, path)
    try:
        open_store(fs.makeQualified(given).toString())
        roots = [s.getPath().toString() for s in fs.globStatus(given) or []]
    except (ValueError, OSError, NotImplementedError):  # of pyarrow: not such a store, or no way to it from here
        roots = []
    if roots:
        raw = _listed_and_read(spark, roots)
    else:  # it also says what is wrong with a path that does not exist
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md}") \
            .option("recursiveFileLookup", "true").load(path).select("path", "content")
    ok = F.is_valid_utf8(F.col("content"))
    return raw.select(
        "path",
        F.when(ok, F.col("content").cast("string")).alias("text"),
        F.when(~ok, F.lit("invalid UTF-8")).alias("error"),
        F.length("content").cast("long").alias("n_bytes"))


@scoped
def _listed_and_read(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``path`` and ``content`` of the text files at or below ``roots``.  A level
    of the folders is a table, listed by tasks; the driver knows its counts."""
    level = spark.createDataFrame([(r,) for r in roots], "path string")
    folders, tables, files, n_bytes = len(roots), [], 0, 0
    while folders:
        found = materialize(level.repartition(min(folders, shuffle_partitions(spark)), "path")
                            .mapInArrow(_entries, "path string, n_bytes long"), "listing")
        n, here, size = found.agg(F.count("*"), F.count("n_bytes"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
        if here:
            tables.append(found.where("n_bytes IS NOT NULL").select("path"))
        level, folders, files, n_bytes = found.where("n_bytes IS NULL").select("path"), n - here, files + here, n_bytes + size
    if not files:
        return spark.createDataFrame([], "path string, content binary")
    tasks = max(shuffle_partitions(spark), -(-files // TASK_FILES), -(-n_bytes // TASK_BYTES))
    names = functools.reduce(DataFrame.unionByName, tables)
    return names.repartition(min(files, tasks), "path").mapInArrow(_contents, "path string, content binary")


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name


def _entries(batches):
    """The text files in folders, with their size, and the folders in them (a
    null size); of a file itself.  What is hidden is what Spark's readers hide."""
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())],
                                          ["path", "n_bytes"])
    rows = []
    for path in (p for b in batches for p in b.column(0).to_pylist()):
        fs, inside = open_store(path)
        one = fs.get_file_info(inside)
        for info in [one] if one.type == FileType.File else fs.get_file_info(FileSelector(inside)):
            name, at = info.base_name, path if info is one else f"{path.rstrip('/')}/{info.base_name}"
            if info.type == FileType.File and info.size and name.endswith((".txt", ".md")) and not _hidden(name):
                rows.append((at, info.size))
            elif info.type == FileType.Directory and (
                    name.startswith(("_metadata", "_common_metadata")) or not (_hidden(name) or name.endswith("._COPYING_"))):
                rows.append((at, None))
            if len(rows) == BATCH_NAMES:
                yield batch(rows)
                rows = []
    yield batch(rows)


def _contents(batches):
    """Files read, a bounded batch at a time."""
    def batch(paths, contents):
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
    paths, contents, held = [], [], 0
    for path in (p for b in batches for p in b.column(0).to_pylist()):
        fs, inside = open_store(path)
        with fs.open_input_stream(inside, compression=None) as f:
            contents.append(f.read())
        paths.append(path)
        held += len(contents[-1])
        if held >= BATCH_BYTES or len(paths) == BATCH_FILES:
            yield batch(paths, contents)
            paths, contents, held = [], [], 0
    yield batch(paths, contents)
