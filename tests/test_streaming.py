"""The stateless normalisation runs on a file stream."""

import tempfile

from precis.streaming.pairs_stream import read_pair_stream, stats_stream, write_stream


def test_stream_normalises_and_counts(spark):
    base = tempfile.mkdtemp(prefix="precis-stream-", dir="/tmp")
    rows = [(1, "un deux", "un"), (2, "", "x"), (3, "trois", None), (4, "a b c", "a b")]
    spark.createDataFrame(rows, "pair_id long, source string, target string") \
        .write.parquet(f"{base}/in/part1")
    stream = read_pair_stream(spark, f"{base}/in/part1", "pair_id long, source string, target string",
                              "source", "target")
    q = write_stream(stats_stream(stream), f"{base}/out", f"{base}/ckpt")
    q.awaitTermination(120)
    out = {r["pair_id"]: r["words_text"] for r in spark.read.parquet(f"{base}/out").collect()}
    assert out == {1: 2, 4: 3}
