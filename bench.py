"""Headline timings: runs the main jobs on $BENCH_SF_DIR (default
/root/testdata/sf0.1) on local[$BENCH_CPUS] and prints one JSON line.

Every query is forced to completion with the ``noop`` sink (the whole plan
runs, nothing is collected).  Times are wall seconds per query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from precis.operators import rouge  # noqa: E402
from precis.operators.bpe import train_bpe  # noqa: E402
from precis.operators.corpus import pretoken_counts  # noqa: E402
from precis.operators.encode import bpe_encode  # noqa: E402
from precis.plans import fixtures as fx  # noqa: E402
from precis.plans.flow import Summarizer, evaluate_pairs, fit_scorer  # noqa: E402
from precis.session import local_session  # noqa: E402
from precis.sources import scan  # noqa: E402

VOCAB = int(os.environ.get("BENCH_VOCAB", "1000"))


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus * 2, app_name="precis-bench")
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    docs = fx.table(spark, sf_dir, "documents").select(F.col("text").alias("value"))
    timed("pretoken_counts", lambda: run(pretoken_counts(docs)))
    model = timed("bpe_train", lambda: train_bpe(docs, vocab_size=VOCAB))
    timed("bpe_encode_docs", lambda: run(bpe_encode(fx.table(spark, sf_dir, "documents"), model, "text")))
    rp = fx.rouge_pairs(spark, sf_dir)
    timed("rouge_n", lambda: run(rouge.rouge_n(rp)))
    timed("rouge_l", lambda: run(rouge.rouge_l(rp)))
    timed("rouge_lsum", lambda: run(rouge.rouge_lsum(rp)))

    def evaluation():
        train = scan.load_source(spark, "conv", "train", None, sf_dir)
        summ = Summarizer(model, fit_scorer(train, model))
        test = scan.load_source(spark, "conv", "test", None, sf_dir)
        per_pair, corpus = evaluate_pairs(spark, test, summ)
        run(per_pair)
    timed("evaluate_model", evaluation)

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_wall_time", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
                      "vocab_size": VOCAB, "bpe_rounds": model.rounds,
                      "bpe_merges": len(model.merges)}))
    spark.stop()


if __name__ == "__main__":
    main()
