"""One query per operator, over its whole table, and the SQL of those that SQL
can express."""

from __future__ import annotations

from precis.llm import (centroids, chat, decontaminate, hard_negatives, licenses, line_dedup, lz_fingerprint, order_minhash, packing,
                        quality, secrets, suffix_dedup, warc)
from precis.llm.common import table
from precis.session import scoped

QUERIES = {
    "op1_warc_normalise": warc.warc_roundtrip,
    "op2_lz_fingerprint": lz_fingerprint.lz_fingerprints,
    "op3_quality_scores": quality.quality_scores,
    "op4_cgk_decontaminate": decontaminate.benchmark_hits,
    "op5_length_buckets": packing.pack_buckets,
    "op6_suffix_dedup": suffix_dedup.drop_repeats_digest,
    "op7_secret_scan": lambda spark, d: secrets.scan_secrets(table(spark, d, "documents")),
    "op8_line_dedup": lambda spark, d: line_dedup.line_dedup_digest(table(spark, d, "documents")),
    "op10_order_minhash": order_minhash.near_duplicate_classes,
    "op9_perspective_chat": chat.rotate_conversations,
    "op11_centroid_clusters": centroids.centroid_clusters,
    "op12_hard_negatives": hard_negatives.hard_negatives,
    "op13_license_scan": licenses.license_scan,
}
QUERIES = {name: scoped(fn) for name, fn in QUERIES.items()}
ORACLE = {
    "op1_warc_normalise": warc.ORACLE,
    "op5_length_buckets": packing.oracle(),
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_perspective_chat": chat.ORACLE,
    "op11_centroid_clusters": centroids.oracle(),
    "op12_hard_negatives": hard_negatives.ORACLE,
}
