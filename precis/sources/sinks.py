"""Sinks: S7 tokenizer tables and file (see operators.bpe) and S8 summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bpe import read_tokenizer, write_tokenizer  # noqa: F401  (S7)
from ..operators.bpe_file import read_tokenizer_file, write_tokenizer_file  # noqa: F401  (S7)

#: escapes of the text form: a backslash and line ends, so that a summary is one line
_ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"))


def escaped(text) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    for plain, code in _ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescaped(line) -> Column:
    """Inverse of :func:`escaped`.  Two backslashes in a row always begin an
    escape, so the pieces between them hold only escaped line ends."""
    pieces = F.split(F.col(line) if isinstance(line, str) else line, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")),
                                                                F.lit("\\r"), F.lit("\r"))), "\\")


def write_summaries(df: DataFrame, path: str, key: str = "pair_id", as_text: bool = False) -> None:
    """Summaries as Parquet (key, summary), or as plain text, one line per
    summary whatever it holds (backslashes and line ends escaped, null as an
    empty line)."""
    if as_text:
        df.select(F.coalesce(escaped("summary"), F.lit("")).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)
    else:
        df.select(key, "summary").write.mode("overwrite").parquet(path)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The summaries of a text sink, ``summary``, as they were."""
    return spark.read.option("lineSep", "\n").text(path).select(unescaped("value").alias("summary"))
