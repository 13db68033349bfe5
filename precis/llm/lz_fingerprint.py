"""Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into dictionary phrases: each phrase is the
shortest string that is not yet in the dictionary.  The phrase set is hashed
and the ``k`` smallest hashes are the fingerprint; the likeness of two
fingerprints is the bottom-k estimate of the Jaccard similarity of the phrase
sets, which follows how well one text compresses the other.

The query also fingerprints an edited form of each text, whose last third is
replaced by the head of the next document in descending id order.  Both forms
share the parse of the first two thirds.  Neighbours meet without a global
sort in one task: the ids' quantiles (at most one per shuffle partition) cut
them into ranges, the head of each range is also dealt to the range before it
(cyclic), and each range is sorted and streamed, two documents in memory at a
time.  That is one shuffle of the texts.

Defined results: null text counts as empty (an empty set; two empty sets are
alike, 1.0; an empty and another set 0.0); a null id comes last; repeated ids
are ordered by text; a lone document is its own next document; equal texts
have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm.common import table
from precis.session import shuffle_partitions

K = 128
END = b"\xff"  # fixed value: not a byte of UTF-8
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def parse(data: bytes, at: int, seen: set) -> tuple[list, int]:
    """Parses on from ``at``; adds the new phrases to ``seen``.  Returns them
    and where the unfinished last phrase starts.  The dictionary holds every
    prefix of its phrases, so the search may start at any length: at three
    bytes, then up or down."""
    new, n = [], len(data)
    data += END  # no phrase holds END, so a search that runs into it stops
    keep, put = new.append, seen.add
    while at < n:
        end = at + 3
        phrase = data[at:end]
        if phrase in seen:
            end += 1
            phrase = data[at:end]
            while phrase in seen:
                end += 1
                phrase = data[at:end]
        else:
            shorter = data[at:at + 2]
            if shorter not in seen:
                end = at + 2
                phrase = shorter
                shorter = data[at:at + 1]
                if shorter not in seen:
                    end = at + 1
                    phrase = shorter
        if end > n:
            break
        put(phrase)
        keep(phrase)
        at = end
    return new, at


def smallest(phrases: list, k: int, more: np.ndarray | None = None) -> np.ndarray:
    """The ``k`` smallest hashes of the phrases (and of ``more``), sorted."""
    h = np.fromiter(map(crc32, phrases), np.uint32, len(phrases))
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    if more is not None:
        h = np.concatenate([h, more])
    if len(h) > 4 * k:
        few = np.unique(np.partition(h, 2 * k)[:2 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(h)[:k]


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    union = both[np.concatenate([[True], ~twice])][:k]
    return float(np.count_nonzero(both[1:][twice] <= union[-1]) / len(union))


def fingerprint(text: str, k: int = K) -> np.ndarray:
    return smallest(parse(text.encode(), 0, set())[0], k)


def shown(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype("<u4").tobytes()).decode()


def two_forms(text: str, following: str, k: int = K) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of the text and of its edited form, and that form."""
    cut = len(text) - len(text) // 3
    head, tail, other = text[:cut].encode(), text[cut:].encode(), following[:len(text) - cut]
    seen: set = set()
    phrases, at = parse(head, 0, seen)
    shared, rest = smallest(phrases, k), head[at:]
    own, _ = parse(rest + tail, 0, seen)
    seen.difference_update(own)
    changed, _ = parse(rest + other.encode(), 0, seen)
    return smallest(own, k, shared), smallest(changed, k, shared), text[:cut] + other


def in_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``bucket, halo, i, t`` partitioned by bucket and sorted by id
    descending; each bucket ends with the head of the next one (halo 1).  Rows
    that repeat the id of a head are dealt to both buckets as well."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(text_col, F.lit("")).alias("t"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(-2**63)).alias("o"))
    quantiles = F.percentile_approx("o", [k / n for k in range(1, n)] or [0.5], 10_000)
    cuts = sorted(set(rows.agg(quantiles).first()[0] or []))  # at most one per shuffle partition
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    placed = rows.withColumn("b", F.size(F.filter(bounds, lambda c: c > F.col("o"))))
    heads = sorted((r.b, r.o) for r in placed.groupBy("b").agg(F.max("o").alias("o")).collect())  # one per range
    before = [x for k, (_, o) in enumerate(heads) for x in (F.lit(o).cast("long"), F.lit(heads[k - 1][0]))]
    target = F.create_map(*before)[F.col("o")] if before else F.lit(None).cast("int")
    here = F.struct(F.col("b").alias("bucket"), F.lit(0).alias("halo"))
    there = F.struct(target.alias("bucket"), F.lit(1).alias("halo"))
    return (placed.withColumn("x", F.explode(F.when(target.isNull(), F.array(here)).otherwise(F.array(here, there))))
            .select("x.bucket", "x.halo", "i", "t", "o")
            .repartitionById(len(cuts) + 1, "bucket")
            .sortWithinPartitions("bucket", "halo", F.col("o").desc(), "t")
            .select("bucket", "halo", "i", "t"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Rows as in ``RESULT``, one per row of ``docs``."""
    def stream(batches):
        waiting = None  # id and text of the document whose next one is still to come
        last = None     # the one before it, whose next fingerprint is still to come
        for batch in batches:
            done = []
            for halo, i, t in zip(*(batch.column(c) for c in (1, 2, 3))):
                halo, i, t = halo.as_py(), i.as_py(), t.as_py()
                if waiting is not None:
                    own, changed, edited = two_forms(waiting[1], t, k)
                    if last is not None:
                        done.append((*last, own))
                    last = (*waiting, own, changed, edited)
                    waiting = None
                if not halo:
                    waiting = (i, t)
                elif last is not None:
                    done.append((*last, fingerprint(t, k)))
                    last = None
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in done], pa.int64()), pa.array([len(r[1]) for r in done], pa.int64()),
                pa.array([hashlib.sha256(r[4].encode()).hexdigest() for r in done], pa.string()),
                pa.array([shown(r[2]) for r in done], pa.string()), pa.array([shown(r[3]) for r in done], pa.string()),
                pa.array([likeness(r[2], r[3], k) for r in done], pa.float64()),
                pa.array([likeness(r[2], r[5], k) for r in done], pa.float64())],
                names=[x.split()[0] for x in RESULT.split(", ")])
        if waiting is not None or last is not None:
            raise ValueError("a range ends without the head of the next one")

    return in_ranges(docs, id_col, text_col).mapInArrow(stream, RESULT)


def lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
