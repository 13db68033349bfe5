"""The pipeline on small tables: each stage does what it promises to its own
input, and the run equals its stages."""

import hashlib
import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as cp
from precis.llm import decontaminate, order_minhash, packing, quality
from precis.llm import words as wd
from tests.conftest import SF_SMALL
from tests.llm.test_line_dedup import brute as line_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage, written as a runner would."""
    folder, out = tempfile.mkdtemp(prefix="precis-pipe-", dir="/tmp"), []
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name, stage in cp.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup",
                                         "benchmark_decontamination", "packing"]
    for _, after in stages[:-1]:
        assert after.columns == cp.COLUMNS


def test_quality_keeps_what_the_model_accepts(spark, stages):
    before, after = stages[0]
    model = quality.train(before, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    want = {i: t for i, t in texts(before).items() if 1 / (1 + np.exp(-2 * quality.margins(pa.array([t]), model)[0])) >= 0.5}
    assert texts(after) == want and 0 < len(want) < before.count()


def test_line_dedup_equals_brute_force(stages):
    before, after = stages[1]
    want = {i: digest for i, _, _, digest in line_brute(list(texts(before).items()))}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts(after).items()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_dedup_keeps_the_smallest_of_each_class(stages):
    before, after = stages[2]
    classes = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(before).collect()}
    assert set(texts(after)) == {i for i, c in classes.items() if i == c}
    assert len(set(texts(after).values())) == after.count()


def test_decontamination_against_brute_force(spark, stages):
    before, after = stages[3]
    items = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    hashed = [wd.lower_words(pa.array([t])).hashes for t in items]
    hit = set()
    for i, t in texts(before).items():
        own = wd.lower_words(pa.array([t])).hashes
        if any(decontaminate.best_match(x, own, len(x)) <= int(0.2 * len(x) + 1e-9) for x in hashed if len(x) >= 5):
            hit.add(i)
    assert hit and set(texts(after)) == set(texts(before)) - hit


def test_packing_covers_what_is_left(stages):
    before, after = stages[4]
    got = sorted((r.doc_id, r.piece) for r in after.collect())
    assert {i for i, _ in got} == set(texts(before)) and len(got) == len(set(got))
    want = sorted((r.doc_id, r.piece, r.n_tokens) for r in packing.pieces(before).collect())
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in after.collect()) == want


def test_run_equals_its_stages(spark, stages):
    got = sorted(map(tuple, cp.run(spark, SF_SMALL).collect()))
    assert got == sorted(map(tuple, stages[-1][1].collect()))


def test_empty_and_odd_documents(spark):
    folder = tempfile.mkdtemp(prefix="precis-pipe-", dir="/tmp")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF_SMALL}/{name}.parquet", folder)
    for rows in ([], [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, None, None, "s", None)]):
        path = f"{folder}/documents.parquet"
        spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(path)
        assert os.path.isdir(path)
        # null and empty texts are equal, so of the four rows that with the smallest id stays
        assert [r.doc_id for r in cp.run(spark, folder).collect()] == ([1] if rows else [])
