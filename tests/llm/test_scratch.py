"""Tables written on the way are gone once a query's result does not read them,
and stages run from any folder."""

import os
import subprocess
import sys

import pytest

from precis.llm import queries
from precis.session import materialize, scoped
from tests.conftest import ROOT, SF_SMALL


def folders(spark):
    path = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {f for f in os.listdir(path) if not f.endswith(".crc")}


@pytest.mark.parametrize("name,most", [("op10_order_minhash", 2), ("op11_centroid_clusters", 1), ("op5_length_buckets", 1)])
def test_tables_left_behind(spark, name, most):
    before = folders(spark)
    result = queries.QUERIES[name](spark, SF_SMALL)
    left = folders(spark) - before
    assert len(left) <= most, left
    assert result.count() > 0


def test_scopes_keep_what_the_result_reads(spark):
    before = folders(spark)
    inner = scoped(lambda: materialize(materialize(spark.range(5), "gone").where("id > 1"), "kept"))

    def outer():
        a = inner()
        return a.join(materialize(spark.range(3), "also"), "id")
    got = scoped(outer)()
    assert sorted(f.split("-")[0] for f in folders(spark) - before) == ["also", "kept"]
    assert [r.id for r in got.collect()] == [2]
    with pytest.raises(ZeroDivisionError):
        scoped(lambda: (materialize(spark.range(3), "lost"), 1 / 0))()
    assert not any(f.startswith("lost") for f in folders(spark))


def test_a_stage_runs_from_another_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import corpus_pipeline
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", 2).getOrCreate()
docs = spark.read.parquet("{SF_SMALL}/documents.parquet")
print("rows", dict(corpus_pipeline.STAGES)["quality_classifier"](spark, docs, "{SF_SMALL}").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and "rows" in out.stdout, out.stderr[-2000:]
