"""Pad / unpad round trip and the shifted decoder views."""

import random

from pyspark.sql import functions as F

from precis.functions.arrays import PAD, frame_target, pad_ids, pad_mask, shift_input, shift_output


def test_pad_unpad_round_trip(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randint(5, 50) for _ in range(rng.randint(0, 12))], rng.randint(12, 20)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, ids array<int>, width int")
    out = df.select("id", "ids", pad_ids("ids", F.col("width")).alias("p"), pad_mask(pad_ids("ids", F.col("width"))).alias("m"),
                    frame_target("ids").alias("f")).collect()
    for r in out:
        assert len(r["p"]) == rows[r["id"]][2]
        assert [x for x in r["p"] if x != PAD] == r["ids"]
        assert r["m"] == [x == PAD for x in r["p"]]
        assert r["f"] == [0] + r["ids"] + [2]
    sh = df.select(frame_target("ids").alias("f")).select("f", shift_input("f").alias("i"),
                                                        shift_output("f").alias("o")).collect()
    for r in sh:
        assert r["i"] == r["f"][:-1] and r["o"] == r["f"][1:]
