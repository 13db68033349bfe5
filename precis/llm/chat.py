"""Chat formatting by perspective rotation.

Each conversation is rendered once for every participant: that speaker's turns
become ``assistant`` turns, the turns of all others ``user`` turns that carry
the speaker's name, and system turns stay system turns.  The mask holds the
code-point spans, end exclusive, of what the assistant writes, end marker
included; a loss is computed there only.

A rendering is cut into chunks of ``max_turns`` turns, so a conversation of any
length never has to fit into one task or row; positions come from quantile
ranges of the turn number (see ``common.positions``).

Defined results: turns are ordered by number (null first), then role and text,
repeated rows are turns of their own; a null role speaks as ``unknown``; names
are written with ``_`` for a space, and ``_``, ``%`` and other white space as
``%`` and their code, so no two speakers share one; null text is empty; control markers inside a text are broken up by a space; a
conversation of system turns alone has no participant and gives no row; a null
``conv_id`` is one conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm.common import positions, table

#: Fixed values of the rendered format.
OPEN, CLOSE, SYSTEM = "<|im_start|>", "<|im_end|>", "system"
MAX_TURNS = 256


def _plain(text: Column) -> Column:
    """Text in which no control marker is left."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


#: How characters of a speaker's name are written, in this order.
NAME_CODES = (("%", "%25"), ("_", "%5F"), (" ", "_"), ("\t", "%09"), ("\n", "%0A"), ("\x0b", "%0B"), ("\f", "%0C"), ("\r", "%0D"))


def speaker_name(role: Column) -> Column:
    """Different for different roles, without white space or control marker."""
    for plain, code in NAME_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", max_turns: int = MAX_TURNS) -> DataFrame:
    """``conv_id, speaker, chunk, n_turns, n_target, rendered, mask``, a row
    for each conversation, participant and chunk."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), _plain(F.col(text_col)).alias("said"))
    placed = (positions(rows, "conv_id", "turn", ["role", "said"])
              .withColumn("chunk", F.expr(f"_pos div {max_turns}")))
    speakers = (rows.where(F.col("role") != SYSTEM).groupBy("conv_id", "role").agg(F.lit(1))
                .select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")))
    seen = placed.join(speakers, placed["conv_id"].eqNullSafe(speakers["of"])).drop("of")
    own = F.col("role") == F.col("speaker")
    head = (F.when(F.col("role") == SYSTEM, F.lit(f"{OPEN}system\n"))
            .when(own, F.lit(f"{OPEN}assistant\n"))
            .otherwise(F.concat(F.lit(f"{OPEN}user name="), speaker_name(F.col("role")), F.lit("\n"))))
    turn = F.struct("_pos", head.alias("head"), F.concat("said", F.lit(CLOSE)).alias("body"), own.alias("own"))
    chunks = (seen.groupBy("conv_id", "speaker", "chunk")
              .agg(F.array_sort(F.collect_list(turn)).alias("turns")))  # at most max_turns
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "")
    spans = F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.lit("").alias("spans")), _advance,
                        lambda acc: F.substring(acc["spans"], 2, 2**31 - 1))
    return chunks.select("conv_id", "speaker", "chunk", F.size("turns").cast("long").alias("n_turns"),
                         F.size(F.filter("turns", lambda t: t["own"])).cast("long").alias("n_target"),
                         text.alias("rendered"), spans.alias("mask"))


def _advance(acc: Column, t: Column) -> Column:
    start = acc["at"] + F.length(t["head"])
    end = start + F.length(t["body"])
    span = F.concat(F.lit(","), start.cast("string"), F.lit(":"), end.cast("string"))
    return F.struct((end + 1).alias("at"), F.concat(acc["spans"], F.when(t["own"], span).otherwise("")).alias("spans"))


def rotate_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


def _name_sql() -> str:
    out = "role"
    for plain, code in NAME_CODES:
        out = f"replace({out}, chr({ord(plain)}), '{code}')"
    return out


ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role,
         replace(coalesce(text, ''), '<|im_', '<| im_') AS said FROM conversations
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) - 1 AS pos FROM t
), s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (
  SELECT p.conv_id, speaker, pos, pos // {MAX_TURNS} AS chunk, role = speaker AS own, said || '{CLOSE}' AS body,
         CASE WHEN role = 'system' THEN '{OPEN}system' || chr(10)
              WHEN role = speaker THEN '{OPEN}assistant' || chr(10)
              ELSE '{OPEN}user name=' || {_name_sql()} || chr(10)
         END AS head
  FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, chunk ORDER BY pos)
            - length(body) - 1 AS place FROM r
)
SELECT conv_id, speaker, chunk, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_target,
       string_agg(head || body || chr(10), '' ORDER BY pos) AS rendered,
       coalesce(string_agg(CAST(place AS BIGINT) || ':' || CAST(place + length(body) AS BIGINT), ',' ORDER BY pos)
                FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, speaker, chunk
"""
