"""Tables derived with Spark from the given parquet tables.

They stand in for the reference's remote corpora: three pair sources, a
dirty variant, run logs, logits and prefixes.  Each builder takes
``(spark, sf_dir)`` and reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import pretokenize
from ..sources import scan
from ..sources.registry import Registry, SourceSpec


#: schemas of the given tables by application and path: reading one is a job
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def pairs_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn followed by an assistant turn: (text, summary)."""
    conv = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = conv.agg(F.max("turn") + 1).scalar()  # more than any turn number, so that keys are unique
    nxt = conv.select("conv_id", "turn", "role", "text",
                      F.lead("role").over(w).alias("nr"), F.lead("text").over(w).alias("nt"))
    return nxt.where((F.col("role") == "user") & (F.col("nr") == "assistant")).select(
        (F.col("conv_id") * turns + F.col("turn")).alias("pair_id"),
        (F.col("conv_id") % 10).alias("bucket"),
        "text",
        F.col("nt").alias("summary"),
    )


def docs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; the first line plays the summary."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pair_id"), "text", F.substring_index("text", "\n", 1).alias("summary"))


def pairs_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French documents; the first line plays the summary."""
    docs = table(spark, sf_dir, "documents").where(F.col("lang") == "fr")
    return docs.select(
        F.col("doc_id").alias("pair_id"),
        (F.col("doc_id") % 10).alias("bucket"),
        "text",
        F.substring_index("text", "\n", 1).alias("summary"),
    )


def pairs_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages under source-specific names: ``source`` (html), ``target``
    (title).  Needs F1 to become canonical."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.col("page_id").alias("pair_id"),
        (F.col("page_id") % 10).alias("bucket"),
        "url",
        F.col("html").alias("source"),
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("target"),
    )


def dirty_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs_conv with nulls, empty and blank strings by ``pair_id % 7``."""
    p = pairs_conv(spark, sf_dir)
    m = F.col("pair_id") % 7
    return p.select(
        "pair_id", "bucket",
        F.when(m == 1, F.lit("")).when(m == 2, F.lit("   ")).otherwise(F.col("text")).alias("text"),
        F.when(m == 0, F.lit(None).cast("string")).otherwise(F.col("summary")).alias("summary"),
    )


def rouge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs_conv(spark, sf_dir)
    return p.select("pair_id", F.col("text").alias("prediction"), F.col("summary").alias("reference"))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user, one epoch per event (run logs are short: the
    per-run window holds one run's epochs)."""
    ev = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return ev.select(F.col("user_id").alias("run_id"),
                     F.row_number().over(w).alias("epoch"),
                     F.col("value").alias("val_loss"))


def batch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rm = run_metrics(spark, sf_dir)
    return rm.select("run_id", F.col("epoch").alias("batch_id"), F.col("val_loss").alias("batch_loss"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form candidates: vocabulary of 64, specials 0..4."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("seq_id"), F.posexplode("embedding").alias("token_id", "e")) \
              .select("seq_id", F.col("token_id").cast("long").alias("token_id"),
                      (F.col("e").cast("double") * 10).alias("logit"))


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prefix`` starts with sos (0); then ``3 + vec_id % 12`` tokens from a
    small set so bigrams and recent tokens repeat."""
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq_id"))
    n = F.lit(3) + F.col("seq_id") % 12
    body = F.transform(F.sequence(F.lit(1).cast("long"), n.cast("long")),
                       lambda p: (F.lit(5) + (F.col("seq_id") * 7 + p * p) % 5).cast("int"))
    return emb.select("seq_id", F.concat(F.array(F.lit(0)), body).alias("prefix"))


def conv_pretokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens of pairs_conv texts and summaries, one row each, with
    their kind and position (input of the ``tokens`` fixture)."""
    p = pairs_conv(spark, sf_dir)
    sides = p.select("pair_id", F.explode(F.array(
        F.struct(F.lit("text").alias("kind"), F.col("text").alias("value")),
        F.struct(F.lit("summary").alias("kind"), F.col("summary").alias("value")))).alias("s"))
    return sides.select("pair_id", "s.kind",
                        F.posexplode(pretokenize(F.col("s.value"))).alias("pos", "pretoken"))


def conv_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tokens``: pre-tokens of pairs_conv with ids ``5 + dense rank`` of the
    pre-token (J2 against a vocabulary built without a single-task window)."""
    from ..operators.encode import dense_vocab, token_lookup
    pt = conv_pretokens(spark, sf_dir)
    vocab = dense_vocab(pt, keys=table(spark, sf_dir, "conversations").select(F.explode(pretokenize(F.col("text"))).alias("pretoken")))
    return token_lookup(pt, vocab)


def conv_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair: ``src_ids`` (text) and ``tgt_ids`` (summary) in
    pre-token order.  A group is one pair."""
    t = conv_tokens(spark, sf_dir)
    def ids(kind):
        item = F.when(F.col("kind") == kind, F.struct("pos", "id"))
        return F.transform(F.array_sort(F.collect_list(item)), lambda s: s["id"])
    return t.groupBy("pair_id").agg(ids("text").alias("src_ids"), ids("summary").alias("tgt_ids"))


def conv_vocab_size(spark: SparkSession, sf_dir: str) -> Column:
    """5 specials + distinct pre-tokens of pairs_conv, counted with the query
    that uses the number."""
    return conv_pretokens(spark, sf_dir).agg(F.countDistinct("pretoken") + 5).scalar()


def conv_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the keys of pairs_conv, without looking at roles."""
    conv = table(spark, sf_dir, "conversations")
    turns = conv.agg(F.max("turn") + 1).scalar()
    return conv.select((F.col("conv_id") * turns + F.col("turn")).alias("pair_id"))


def fixture_registry() -> Registry:
    """Three stand-in sources, in rank order.  ``pages`` keeps the
    source-specific column names (``source`` -> text, ``target`` -> summary)."""
    return Registry((
        SourceSpec("conv", builder=pairs_conv),
        SourceSpec("docs", builder=pairs_docs),
        SourceSpec("pages", text_column="source", summary_column="target", builder=pairs_pages),
    ))


scan.set_default_registry(fixture_registry)
