"""Session helpers: building a local session for tests and locating the
checkpoint folder of the cluster."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every session of the library should carry.  AQE re-plans joins and
#: shuffle partition counts at run time and splits skewed join partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


#: the application that has the package
_SHIPPED: dict[str, str] = {}


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app_name: str = "precis") -> SparkSession:
    """A local session for tests and the bench (UI off, small shuffles)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.default.parallelism", str(cores))
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in
    ``spark.checkpoint.dir``.  Where it is unset, a single-machine session
    (tests) gets a fresh scratch folder; on a cluster, whose executors would
    not see the driver's folder, that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir()
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError(f"spark.checkpoint.dir is not set; {sc.master} needs a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="precis-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that
    their tasks import it wherever the application was started."""
    sc = spark.sparkContext
    if _SHIPPED.get("application") == sc.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="precis-pkg-"), "precis.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    _SHIPPED["application"] = sc.applicationId


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: tables written by the calls of :func:`scoped` that run now, innermost last
_SCOPES: list[list[str]] = []


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, the
    lineage cut, the same rows for every later pass."""
    ship_package(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scoped(fn):
    """``fn``, which returns a DataFrame, such that the tables it wrote on the
    way (:func:`materialize`) are deleted as soon as it returns, but for those
    that its result reads.  A scope inside another hands those on to it."""
    @functools.wraps(fn)
    def run(*args, **kwargs):
        _SCOPES.append([])
        try:
            result = fn(*args, **kwargs)
            read = {os.path.dirname(_plain(f)) for f in result.inputFiles()}
        except BaseException:
            read = set()
            raise
        finally:
            for path in (made := _SCOPES.pop()):
                if _plain(path) not in read:
                    delete_folder(SparkSession.active(), path)
            if _SCOPES:
                _SCOPES[-1].extend(p for p in made if _plain(p) in read)
        return result
    return run


def _plain(path: str) -> str:
    """Without scheme and authority, which are written in several ways."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
