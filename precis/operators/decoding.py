"""Decoding rules as table operators.

Input: candidates ``(seq_id, token_id, logit)`` and prefixes ``(seq_id,
prefix array<int>)`` starting with sos.  Rules apply in this order: block
specials, repetition penalty, minimum length, no repeated trigram, pick.
Every join is keyed on ``seq_id`` (one sequence = one vocabulary of rows, a
bounded group); the only constant table (blocked ids) is four rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import EOS, MASK, PAD, SOS, UNK

NEG_INF = float("-inf")
# --- fixed values of the decoding rules ---------------------------------------
BLOCKED = (SOS, PAD, UNK, MASK)   # eos stays allowed
RECENT_WINDOW = 8                 # repetition penalty looks at the last 8 tokens
PENALTY = 1.5
MIN_PREFIX = 5                    # eos blocked while the prefix (with sos) is shorter
TRIGRAM_MIN_PREFIX = 4
# ------------------------------------------------------------------------------


def block_specials(cands: DataFrame) -> DataFrame:
    """G1: sos, pad, unk, mask -> -inf."""
    return cands.withColumn("logit", F.when(F.col("token_id").isin(*BLOCKED), F.lit(NEG_INF))
                            .otherwise(F.col("logit")))


def drop_blocked(cands: DataFrame) -> DataFrame:
    """The candidates without the blocked ids (left anti join against a
    four-row constant table)."""
    blocked = cands.sparkSession.createDataFrame([(t,) for t in BLOCKED], "token_id long")
    return cands.join(F.broadcast(blocked), "token_id", "left_anti")


def recent_tokens(prefixes: DataFrame, window: int = RECENT_WINDOW) -> DataFrame:
    """The set of the last ``window`` tokens of each prefix."""
    p = F.col("prefix")
    last = F.slice(p, F.greatest(F.size(p) - (window - 1), F.lit(1)), window)
    return prefixes.select("seq_id", F.array_distinct(last).alias("recent"))


def prefix_token_flags(cands: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``in_recent`` marks candidates found among the recent tokens
    (left outer join on (seq_id, token_id))."""
    recent = recent_tokens(prefixes).select(
        "seq_id", F.explode(F.col("recent").cast("array<bigint>")).alias("token_id")) \
        .withColumn("in_recent", F.lit(True))
    return cands.join(recent, ["seq_id", "token_id"], "left") \
                .withColumn("in_recent", F.coalesce("in_recent", F.lit(False)))


def repetition_penalty(cands: DataFrame, prefixes: DataFrame, factor: float = PENALTY) -> DataFrame:
    """Each recent token once: logit > 0 -> / factor, else * factor
    (-inf stays -inf)."""
    flagged = prefix_token_flags(cands, prefixes)
    l = F.col("logit")
    pen = F.when(l > 0, l / factor).otherwise(l * factor)
    return flagged.withColumn("logit", F.when(F.col("in_recent"), pen).otherwise(l)).drop("in_recent")


def min_length(cands: DataFrame, prefixes: DataFrame, min_prefix: int = MIN_PREFIX) -> DataFrame:
    """Eos -> -inf while the prefix (sos included) is shorter than
    ``min_prefix``."""
    short = prefixes.where(F.size("prefix") < min_prefix).select(
        "seq_id", F.lit(EOS).cast("long").alias("token_id"), F.lit(True).alias("_short"))
    j = cands.join(short, ["seq_id", "token_id"], "left")
    return j.withColumn("logit", F.when(F.col("_short"), F.lit(NEG_INF)).otherwise(F.col("logit"))) \
            .drop("_short")


def prefix_bigrams(prefixes: DataFrame) -> DataFrame:
    """Every adjacent pair of a prefix with the token after it (the
    window holds one prefix)."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    toks = prefixes.select("seq_id", F.posexplode("prefix").alias("pos", "t0"))
    return toks.select("seq_id", "pos", "t0", F.lead("t0", 1).over(w).alias("t1"),
                       F.lead("t0", 2).over(w).alias("t2")).where(F.col("t2").isNotNull())


def no_repeat_trigram(cands: DataFrame, prefixes: DataFrame,
                      min_prefix: int = TRIGRAM_MIN_PREFIX) -> DataFrame:
    """When the prefix has at least ``min_prefix`` tokens, every token
    that followed an earlier occurrence of the last bigram -> -inf."""
    p = F.col("prefix")
    last = prefixes.where(F.size(p) >= min_prefix).select(
        "seq_id", F.element_at(p, -2).alias("t0"), F.element_at(p, -1).alias("t1"))
    banned = prefix_bigrams(prefixes).join(last, ["seq_id", "t0", "t1"]) \
        .select("seq_id", F.col("t2").cast("long").alias("token_id")).distinct() \
        .withColumn("_ban", F.lit(True))
    j = cands.join(banned, ["seq_id", "token_id"], "left")
    return j.withColumn("logit", F.when(F.col("_ban"), F.lit(NEG_INF)).otherwise(F.col("logit"))).drop("_ban")


def apply_rules(cands: DataFrame, prefixes: DataFrame) -> DataFrame:
    """G1 -> G2 -> G3 -> G4 on the candidate table."""
    return no_repeat_trigram(min_length(repetition_penalty(block_specials(cands), prefixes), prefixes),
                             prefixes)


def ranked(scored: DataFrame) -> DataFrame:
    """Rank candidates by (logit desc, token_id): ties go to the lower id."""
    w = Window.partitionBy("seq_id").orderBy(F.col("logit").desc(), F.col("token_id"))
    return scored.withColumn("rank", F.row_number().over(w))


def top2_token(scored: DataFrame) -> DataFrame:
    """The second best token of each sequence."""
    return ranked(scored).where(F.col("rank") == 2).select("seq_id", "token_id", "logit")


def pick_token(scored: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Arg max; when the prefix is longer than 2 and the best equals
    both last tokens, the second best.  When every candidate is -inf the
    lowest id still comes out (T12)."""
    top = ranked(scored).where(F.col("rank") <= 2).groupBy("seq_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("token_id"))).alias("best"),
        F.max(F.when(F.col("rank") == 2, F.col("token_id"))).alias("second"))
    p = F.col("prefix")
    j = top.join(prefixes, "seq_id")
    repeat = (F.size(p) > 2) & (F.col("best") == F.element_at(p, -1)) & (F.col("best") == F.element_at(p, -2))
    return j.select("seq_id", F.when(repeat & F.col("second").isNotNull(), F.col("second"))
                    .otherwise(F.col("best")).alias("next_token"), "best", "second")


def decode_step(cands: DataFrame, prefixes: DataFrame) -> DataFrame:
    """One constrained greedy step for every sequence."""
    return pick_token(apply_rules(cands, prefixes), prefixes)


def visible(scored: DataFrame) -> DataFrame:
    """Output form of a rule table: ``logit`` null where the rules set -inf,
    with an explicit ``excluded`` flag."""
    ex = F.col("logit") == F.lit(NEG_INF)
    return scored.select("seq_id", "token_id", F.when(ex, F.lit(None)).otherwise(F.col("logit")).alias("logit"),
                         ex.alias("excluded"))
