"""Registered queries: one per operator of the inventory, each a
``(spark, sf_dir) -> DataFrame`` over whole given tables, with the DuckDB
SQL that must give the same rows (absent for operators SQL cannot express;
those are checked by the unit tests against plain Python)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ordering, pairs, rouge
from ..sources import scan
from . import fixtures as fx
from .oracle_sql import (BPE_ENCODE_SQL, BPE_MERGES_SQL, BPE_VOCAB, BPE_VOCAB_SQL, SPLIT_OF_BUCKET, generate_duck,
                         rouge_tokens_duck, with_fixtures, word_count_duck)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --- sources, filters, limits, unions

@register("scan_conv_test", with_fixtures(
    "SELECT pair_id, text, summary FROM pairs_conv "
    "WHERE bucket = 0 AND text <> '' AND summary <> ''", "pairs_conv"))
def q_scan_conv_test(spark, d):
    return scan.load_source(spark, "conv", "test", None, d).select("pair_id", "text", "summary")


@register("rename_pages_canonical", with_fixtures(
    "SELECT pair_id, source AS text, target AS summary FROM pairs_pages "
    "WHERE bucket NOT IN (0, 1) AND source <> '' AND target <> ''", "pairs_pages"))
def q_rename_pages(spark, d):
    return scan.load_source(spark, "pages", "train", None, d).select("pair_id", "text", "summary")


@register("drop_empty_pairs", with_fixtures(
    "SELECT pair_id, text, summary FROM dirty_pairs WHERE text <> '' AND summary <> ''",
    "dirty_pairs"))
def q_drop_empty(spark, d):
    return pairs.normalise(fx.dirty_pairs(spark, d))


@register("null_to_empty", with_fixtures(
    "SELECT pair_id, coalesce(text, '') AS text, coalesce(summary, '') AS summary FROM dirty_pairs",
    "dirty_pairs"))
def q_null_to_empty(spark, d):
    return pairs.null_to_empty(fx.dirty_pairs(spark, d).select("pair_id", "text", "summary"))


@register("blank_guard", with_fixtures(
    "SELECT pair_id, NOT regexp_full_match(coalesce(text, ''), '[\\s\\x1c-\\x1f]*') "
    "AS needs_generation FROM dirty_pairs", "dirty_pairs"))
def q_blank_guard(spark, d):
    return pairs.blank_guard(fx.dirty_pairs(spark, d)).select("pair_id", "needs_generation")


@register("drop_blank_scored", with_fixtures(
    "SELECT pair_id, text AS prediction, summary AS reference FROM dirty_pairs "
    "WHERE NOT regexp_full_match(coalesce(text, ''), '[\\s\\x1c-\\x1f]*') "
    "AND NOT regexp_full_match(coalesce(summary, ''), '[\\s\\x1c-\\x1f]*')", "dirty_pairs"))
def q_drop_blank_scored(spark, d):
    dp = fx.dirty_pairs(spark, d).select("pair_id", F.col("text").alias("prediction"),
                                         F.col("summary").alias("reference"))
    return pairs.drop_blank_scored(dp)


@register("first_n_docs", with_fixtures(
    "SELECT pair_id, text, summary FROM pairs_docs "
    "WHERE bucket NOT IN (0, 1) AND text <> '' AND summary <> '' ORDER BY pair_id LIMIT 50",
    "pairs_docs"))
def q_first_n_docs(spark, d):
    return scan.load_source(spark, "docs", "train", 50, d).select("pair_id", "text", "summary")


_QUOTA_SQL = (
    "SELECT source, pair_id, text, summary FROM ("
    "  SELECT *, row_number() OVER (PARTITION BY source ORDER BY pair_id) AS rn "
    f"  FROM sources_all WHERE {SPLIT_OF_BUCKET} = '{{split}}') WHERE rn <= {{q}}")


@register("source_quota_all", with_fixtures(_QUOTA_SQL.format(split="train", q=100), "sources_all"))
def q_source_quota(spark, d):
    return scan.load_pairs(spark, "all", "train", 300, d).select("source", "pair_id", "text", "summary")


@register("validation_cap_all", with_fixtures(_QUOTA_SQL.format(split="validation", q=666),
                                              "sources_all"))
def q_validation_cap(spark, d):
    cap = pairs.validation_cap(None)
    return scan.load_pairs(spark, "all", "validation", cap, d).select(
        "source", "pair_id", "text", "summary")


@register("validation_cap_small", with_fixtures(_QUOTA_SQL.format(split="validation", q=4), "sources_all"))
def q_validation_cap_small(spark, d):
    """L3 + L2 with a cap below the row counts: 12 rows among three sources."""
    return scan.load_pairs(spark, "all", "validation", pairs.validation_cap(12), d).select(
        "source", "pair_id", "text", "summary")


@register("tolerant_union_counts", with_fixtures(
    f"SELECT source, count(*) AS n_rows FROM sources_all WHERE {SPLIT_OF_BUCKET} = 'train' GROUP BY source",
    "sources_all"))
def q_tolerant_union(spark, d):
    """A registry with a source whose files are missing; the rest loads."""
    from ..sources.registry import Registry, SourceSpec
    broken = SourceSpec("broken", parquet_files={"train": ("no/such/file.parquet",)})
    report: list = []
    reg = Registry((broken, *fx.fixture_registry().sources))
    df = scan.load_pairs(spark, "all", "train", None, d, reg, report)
    told = scan.report_frame(spark, report).where("status = 'loaded'").select("source")
    return df.join(told, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))


@register("scan_files_docs",
          "SELECT pair_id, text, summary FROM (SELECT row_number() OVER () - 1 AS pair_id, text, lang AS summary "
          "FROM documents) WHERE text <> '' AND summary <> ''")
def q_scan_files(spark, d):
    """S2 + F1-F3 on a Parquet-file source: keys are the rows' places."""
    from ..sources.registry import Registry, SourceSpec
    spec = SourceSpec("files", summary_column="lang", parquet_files={"train": ("documents.parquet",)})
    return scan.load_source(spark, "files", "train", None, d, Registry((spec,)))


@register("scan_saved_docs", "SELECT doc_id, text FROM documents WHERE doc_id % 10 = 0")
def q_scan_saved(spark, d):
    """S4 + F9: documents saved as a split dictionary, its test split read back."""
    from ..session import shared_path
    from ..sources.saved import scan_saved_split
    docs, path = fx.table(spark, d, "documents").select("doc_id", "text"), shared_path(spark, "saved")
    docs.where("doc_id % 10 <> 0").write.parquet(f"{path}/train")
    docs.where("doc_id % 10 = 0").write.parquet(f"{path}/test")
    return scan_saved_split(spark, path, "test").select("doc_id", "text")


@register("saved_dir_counts", "SELECT lang AS source, count(*) AS n_rows, count(*) AS n_keys FROM documents "
          "WHERE text <> '' GROUP BY lang")
def q_saved_dir(spark, d):
    """One saved folder per language; keys are unique over all of them."""
    from ..session import shared_path
    from ..sources.saved import scan_saved_dir
    docs, path = fx.table(spark, d, "documents"), shared_path(spark, "saved-dir")
    for (lang,) in sorted(docs.select("lang").distinct().collect()):
        docs.where(F.col("lang") == lang).select("text", F.lit("s").alias("summary")).write.parquet(f"{path}/{lang}/train")
    return scan_saved_dir(spark, path).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("pair_id").alias("n_keys"))


@register("write_summaries_docs", "SELECT split_part(text, chr(10), 1) AS value FROM documents")
def q_write_summaries(spark, d):
    """Summaries written as text files and read back."""
    from ..session import shared_path
    from ..sources.sinks import write_summaries
    path = shared_path(spark, "summaries")
    write_summaries(fx.docs_all(spark, d).select("pair_id", "summary"), path, as_text=True)
    return spark.read.text(path)


@register("unpivot_dirty", with_fixtures(
    "SELECT pair_id, kind, value FROM (SELECT pair_id, 'text' AS kind, text AS value FROM dirty_pairs UNION ALL "
    "SELECT pair_id, 'summary', summary FROM dirty_pairs) WHERE value <> ''", "dirty_pairs"))
def q_unpivot_dirty(spark, d):
    """F5 on rows that it drops."""
    from ..operators.corpus import unpivot_corpus
    return unpivot_corpus(fx.dirty_pairs(spark, d)).select("pair_id", "kind", "value")


@register("union_sources_all", with_fixtures(
    f"SELECT source, source_rank, pair_id, text, summary FROM sources_all WHERE {SPLIT_OF_BUCKET} = 'train'",
    "sources_all"))
def q_union_all(spark, d):
    return scan.load_pairs(spark, "all", "train", None, d).select(
        "source", "source_rank", "pair_id", "text", "summary")


@register("row_counts_all", with_fixtures(
    "SELECT source, count(*) AS n_rows FROM sources_all "
    f"WHERE {SPLIT_OF_BUCKET} = 'train' GROUP BY ROLLUP (source)", "sources_all"))
def q_row_counts(spark, d):
    return pairs.row_counts(scan.load_pairs(spark, "all", "train", None, d))


@register("source_split_counts", with_fixtures(
    f"SELECT source, {SPLIT_OF_BUCKET} AS split, count(*) AS n_rows FROM sources_all GROUP BY ALL",
    "sources_all"))
def q_source_split_counts(spark, d):
    """S1 + S2 + A1: rows per source and split after F1-F3."""
    parts = [scan.load_pairs(spark, "all", split, None, d).withColumn("split", F.lit(split))
             for split in ("train", "test", "validation")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("first_rows_per_source", with_fixtures(
    "SELECT source, pair_id, row_no, left(text, 500) || '...' AS text_preview FROM ("
    " SELECT *, row_number() OVER (PARTITION BY source ORDER BY pair_id) AS row_no FROM sources_all "
    f" WHERE {SPLIT_OF_BUCKET} = 'train') WHERE row_no <= 3", "sources_all"))
def q_first_rows_per_source(spark, d):
    """L5 second form: rows 1..3 of every source (L1 per source)."""
    from pyspark.sql import Window
    rows = []
    for name in ("conv", "docs", "pages"):
        rows.append(scan.load_pairs(spark, name, "train", 3, d))
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    w = Window.partitionBy("source").orderBy("pair_id")  # at most 3 rows per source here
    return out.select("source", "pair_id", F.row_number().over(w).alias("row_no"),
                      tx.preview_always("text", 500).alias("text_preview"))


@register("unpivot_corpus", with_fixtures(
    "SELECT source, pair_id, kind, value FROM ("
    "  SELECT source, pair_id, 'text' AS kind, text AS value FROM sources_all "
    f"  WHERE {SPLIT_OF_BUCKET} = 'train' UNION ALL "
    "  SELECT source, pair_id, 'summary', summary FROM sources_all "
    f"  WHERE {SPLIT_OF_BUCKET} = 'train') WHERE value <> ''", "sources_all"))
def q_unpivot(spark, d):
    from ..operators.corpus import unpivot_corpus
    return unpivot_corpus(scan.load_pairs(spark, "all", "train", None, d)).select(
        "source", "pair_id", "kind", "value")


@register("head_preview_conv", with_fixtures(
    "SELECT row_number() OVER (ORDER BY pair_id) AS row_no, pair_id, "
    "left(text, 500) || '...' AS text_preview, summary FROM pairs_conv", "pairs_conv"))
def q_head_preview(spark, d):
    return pairs.head_preview(fx.pairs_conv(spark, d))


@register("batch_rows_docs",
    "SELECT pair_id, CAST(floor((rn - 1) / 32) AS BIGINT) AS batch_id, "
    "CAST(mod(rn - 1, 32) AS INTEGER) AS pos_in_batch FROM ("
    "  SELECT doc_id AS pair_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)")
def q_batch_rows(spark, d):
    df = fx.table(spark, d, "documents").select(F.col("doc_id").alias("pair_id"))
    return ordering.batch_rows(df, 32).select("pair_id", "batch_id", "pos_in_batch")


@register("spot_check_conv", with_fixtures(
    "SELECT pair_id, text, summary FROM pairs_conv "
    "WHERE bucket = 1 AND text <> '' AND summary <> '' ORDER BY pair_id LIMIT 20", "pairs_conv"))
def q_spot_check(spark, d):
    df = scan.load_source(spark, "conv", "validation", None, d)
    return pairs.spot_check_rows(df, 20).select("pair_id", "text", "summary")


@register("shuffled_batches_conv", with_fixtures(
    "SELECT pair_id, CAST(floor((rn - 1) / 32) AS BIGINT) AS batch_id, "
    "CAST(mod(rn - 1, 32) AS INTEGER) AS pos_in_batch FROM ("
    "  SELECT pair_id, row_number() OVER (ORDER BY md5('13,1,' || CAST(pair_id AS VARCHAR)), pair_id) AS rn "
    "  FROM pairs_conv)", "pairs_conv"))
def q_shuffled(spark, d):
    df = fx.pairs_conv(spark, d)
    return ordering.shuffled_batches(df, 32, seed=13, epoch=1).select(
        "pair_id", "batch_id", "pos_in_batch")


# --- ROUGE

_ROUGE_BASE = (
    "base AS (SELECT pair_id, {p} AS p, {r} AS r FROM rouge_pairs), "
    "grams AS ("
    " SELECT pair_id, 1 AS n, unnest(p) AS g, 1 AS cp, 0 AS cr FROM base UNION ALL"
    " SELECT pair_id, 1, unnest(r), 0, 1 FROM base UNION ALL"
    " SELECT pair_id, 2, unnest(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])), 1, 0 FROM base UNION ALL"
    " SELECT pair_id, 2, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])), 0, 1 FROM base), "
    "ov AS (SELECT pair_id, n, g, sum(cp) AS n_pred, sum(cr) AS n_ref, least(sum(cp), sum(cr)) AS overlap "
    " FROM grams GROUP BY pair_id, n, g), "
    "tot AS (SELECT pair_id, 1 AS n, len(p) AS tp, len(r) AS tr FROM base UNION ALL "
    " SELECT pair_id, 2, greatest(len(p) - 1, 0), greatest(len(r) - 1, 0) FROM base), "
    "per AS (SELECT tot.pair_id, tot.n, coalesce(sum(ov.overlap), 0) AS overlap, tp, tr "
    " FROM tot LEFT JOIN ov ON tot.pair_id = ov.pair_id AND tot.n = ov.n "
    " GROUP BY tot.pair_id, tot.n, tp, tr), "
    "sc AS (SELECT pair_id, 'rouge' || CAST(n AS VARCHAR) AS metric, "
    " overlap / greatest(tp, 1) AS precision, overlap / greatest(tr, 1) AS recall FROM per)"
).format(p=rouge_tokens_duck("prediction"), r=rouge_tokens_duck("reference"))


def _rouge_sql(select: str) -> str:
    body = with_fixtures("SELECT 1", "rouge_pairs")
    head = body[: body.rindex("\nSELECT 1")]
    return f"{head},\n{_ROUGE_BASE}\n{select}"


_F = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END"


@register("rouge_tokens", with_fixtures(
    f"SELECT pair_id, {rouge_tokens_duck('prediction')} AS pred_tokens, "
    f"{rouge_tokens_duck('reference')} AS ref_tokens FROM rouge_pairs", "rouge_pairs"))
def q_rouge_tokens(spark, d):
    rp = fx.rouge_pairs(spark, d)
    return rp.select("pair_id", tx.rouge_tokens("prediction").alias("pred_tokens"),
                     tx.rouge_tokens("reference").alias("ref_tokens"))


@register("ngram_overlap", _rouge_sql(
    "SELECT pair_id, n, g AS ngram, n_pred, n_ref, overlap FROM ov"))
def q_ngram_overlap(spark, d):
    toks = rouge.tokenized(fx.rouge_pairs(spark, d))
    return rouge.ngram_overlap(toks, (1, 2)).select(
        "pair_id", "n", "ngram", "n_pred", "n_ref", "overlap")


@register("rouge_n_pairs", _rouge_sql(
    f"SELECT pair_id, metric, precision, recall, {_F} AS fmeasure FROM sc"))
def q_rouge_n(spark, d):
    return rouge.rouge_n(fx.rouge_pairs(spark, d))


@register("rouge_corpus_n", _rouge_sql(
    f"SELECT metric, coalesce(avg({_F}), 0.0) AS score, count(*) AS n_pairs FROM sc GROUP BY metric"))
def q_rouge_corpus(spark, d):
    return rouge.rouge_corpus(rouge.rouge_n(fx.rouge_pairs(spark, d)))


_LCS_DUCK = (
    "list_reduce(range(1, len(p) + 1), lambda prev, i: list_reduce(range(1, len(r) + 1), "
    "lambda acc, j: list_append(acc, greatest(acc[j], prev[j + 1], "
    "CASE WHEN p[i] = r[j] THEN prev[j] + 1 ELSE 0 END)), [0]), "
    "list_transform(range(0, len(r) + 1), lambda x: 0))[len(r) + 1]")


@register("rouge_l_pairs", with_fixtures(
    "SELECT pair_id, 'rougeL' AS metric, "
    "CASE WHEN np > 0 AND nr > 0 THEN lcs / np ELSE 0.0 END AS precision, "
    "CASE WHEN np > 0 AND nr > 0 THEN lcs / nr ELSE 0.0 END AS recall, "
    "CASE WHEN np > 0 AND nr > 0 AND lcs > 0 THEN 2 * (lcs / np) * (lcs / nr) / (lcs / np + lcs / nr) "
    "ELSE 0.0 END AS fmeasure FROM ("
    f" SELECT pair_id, len(p) AS np, len(r) AS nr, {_LCS_DUCK} AS lcs FROM ("
    f"  SELECT pair_id, {rouge_tokens_duck('prediction')} AS p, {rouge_tokens_duck('reference')} AS r "
    "  FROM rouge_pairs))", "rouge_pairs"))
def q_rouge_l(spark, d):
    return rouge.rouge_l(fx.rouge_pairs(spark, d))


@register("rouge_lsum_pairs")
def q_rouge_lsum(spark, d):
    return rouge.rouge_lsum(fx.rouge_pairs(spark, d))


@register("rouge_lsum_flat_pairs", ORACLE["rouge_l_pairs"].replace("'rougeL'", "'rougeLsum'"))
def q_rouge_lsum_flat(spark, d):
    """A10 on texts of one line, where it equals A9."""
    flat = fx.rouge_pairs(spark, d).withColumns(
        {c: F.translate(c, "\n", " ") for c in ("prediction", "reference")})
    return rouge.rouge_lsum(flat)


@register("pair_predictions", with_fixtures(
    "SELECT p.pair_id, p.text AS prediction, r.summary AS reference "
    "FROM pairs_conv p JOIN pairs_conv r ON p.pair_id = r.pair_id", "pairs_conv"))
def q_pair_predictions(spark, d):
    preds = fx.pairs_conv(spark, d).select("pair_id", F.col("text").alias("prediction"))
    return rouge.pair_predictions(preds, fx.pairs_conv(spark, d))


# --- text statistics

@register("text_stats_docs", with_fixtures(
    f"SELECT pair_id, {word_count_duck('text')} AS words_text, "
    f"{word_count_duck('summary')} AS words_summary, length(text) AS chars_text, "
    "length(summary) AS chars_summary, "
    "CASE WHEN length(text) = 0 THEN 0.0 ELSE (1 - length(summary) / length(text)) * 100 END AS compression_pct, "
    f"{word_count_duck('summary')} - {word_count_duck('text')} AS word_delta, "
    "left(text, 500) || '...' AS preview_500, "
    "CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END AS preview_1000 "
    "FROM docs_all", "docs_all"))
def q_text_stats(spark, d):
    from ..operators.textstats import text_stats
    return text_stats(fx.docs_all(spark, d))


# --- run logs

_PER_EPOCH = (
    "rb AS (SELECT run_id, epoch, val_loss, min(CASE WHEN isnan(val_loss) THEN NULL ELSE val_loss END) "
    " OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before "
    " FROM run_metrics), "
    "imp AS (SELECT *, coalesce(NOT isnan(val_loss) AND val_loss < coalesce(best_before, 'inf'::DOUBLE), false) "
    " AS improved FROM rb), "
    "pe AS (SELECT *, CAST(epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run_id "
    " ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS patience_counter FROM imp)")


def _runs_sql(select: str) -> str:
    body = with_fixtures("SELECT 1", "run_metrics")
    return f"{body[: body.rindex(chr(10) + 'SELECT 1')]},\n{_PER_EPOCH}\n{select}"


@register("early_stop_epochs", _runs_sql(
    "SELECT run_id, epoch, val_loss, best_before, improved, patience_counter FROM pe"))
def q_early_stop_epochs(spark, d):
    from ..operators.runlog import early_stop
    return early_stop(fx.run_metrics(spark, d)).select(
        "run_id", "epoch", "val_loss", "best_before", "improved", "patience_counter")


@register("best_epoch_runs", _runs_sql(
    "SELECT s.run_id, stop_epoch, stopped_early, "
    "max(CASE WHEN improved AND epoch <= stop_epoch THEN epoch END) AS best_epoch, "
    "arg_max(CASE WHEN improved AND epoch <= stop_epoch THEN val_loss END, "
    "CASE WHEN improved AND epoch <= stop_epoch THEN epoch END) AS best_val_loss "
    "FROM (SELECT run_id, coalesce(min(CASE WHEN patience_counter >= 3 THEN epoch END), max(epoch)) "
    "AS stop_epoch, min(CASE WHEN patience_counter >= 3 THEN epoch END) IS NOT NULL AS stopped_early "
    "FROM pe GROUP BY run_id) s JOIN pe USING (run_id) GROUP BY s.run_id, stop_epoch, stopped_early"))
def q_best_epoch(spark, d):
    from ..operators.runlog import run_summary
    return run_summary(fx.run_metrics(spark, d))


@register("cosine_lr_log", with_fixtures(
    "SELECT run_id, epoch, val_loss, lr * 1000000 AS lr_micro, CASE WHEN abs(lr * 1000000 - floor(lr * 1000000) - 0.5) > 0.000001 "
    "THEN round(lr * 1000000) END AS lr_shown_micro FROM ("
    " SELECT *, 0.0001 * 0.01 + (0.0001 - 0.0001 * 0.01) * "
    " (1 + cos(pi() * epoch / max(epoch) OVER (PARTITION BY run_id))) / 2 AS lr FROM run_metrics)",
    "run_metrics"))
def q_cosine_lr(spark, d):
    from ..operators.runlog import lr_log
    # learning rates are ~1e-4: compared in micro-units so that 6-decimal
    # rounding keeps their digits
    return lr_log(fx.run_metrics(spark, d)).select(
        "run_id", "epoch", "val_loss", (F.col("lr") * 1_000_000).alias("lr_micro"),
        # shown with 6 decimals; exactly half-way the last bit of lr decides, so not compared there
        F.when(F.abs(F.col("lr") * 1_000_000 - F.floor(F.col("lr") * 1_000_000) - 0.5) > 0.000001,
               F.col("lr_shown") * 1_000_000).alias("lr_shown_micro"))


@register("epoch_loss_runs", with_fixtures(
    "SELECT run_id, coalesce(avg(batch_loss), 0.0) AS epoch_loss, count(*) AS n_batches, "
    "round(coalesce(avg(batch_loss), 0.0), 4) AS epoch_loss_shown FROM batch_losses GROUP BY run_id",
    "batch_losses"))
def q_epoch_loss(spark, d):
    from ..operators.runlog import epoch_loss
    return epoch_loss(fx.batch_losses(spark, d))


# --- tokenizer corpus and byte-level BPE

from ..functions.text import BYTE_ALPHABET, SORTED_ALPHABET  # noqa: E402
from .oracle_sql import PRETOKEN_DUCK_SQL  # noqa: E402

_ALPHA_SQL = BYTE_ALPHABET.replace("'", "''")
_SALPHA_SQL = SORTED_ALPHABET.replace("'", "''")


def _duck_byte_char(p: str, i: str) -> str:
    return (f"substr('{_ALPHA_SQL}', CAST(('0x' || substr(hex(encode({p})), 2 * {i} + 1, 2)) AS INTEGER) + 1, 1)")


def _duck_symbols(p: str) -> str:
    return (f"array_to_string(list_transform(range(0, octet_length(encode({p}))), "
            f"lambda i: {_duck_byte_char(p, 'i')}), '')")


def _duck_symbol_ids(p: str) -> str:
    return (f"list_transform(range(0, octet_length(encode({p}))), "
            f"lambda i: CAST(instr('{_SALPHA_SQL}', {_duck_byte_char(p, 'i')}) + 4 AS INTEGER))")


_DOC_PRETOKENS = (f"SELECT unnest(regexp_extract_all(text, '{PRETOKEN_DUCK_SQL}')) AS pretoken FROM documents")


@register("pretokens_conv", with_fixtures(
    "SELECT pair_id, kind, CAST(pos AS INTEGER) AS pos, pretoken FROM conv_pretokens", "conv_pretokens"))
def q_pretokens(spark, d):
    return fx.conv_pretokens(spark, d)


@register("byte_symbols_conv", with_fixtures(
    f"SELECT DISTINCT pretoken, {_duck_symbols('pretoken')} AS symbols FROM conv_pretokens",
    "conv_pretokens"))
def q_byte_symbols(spark, d):
    pt = fx.conv_pretokens(spark, d).select("pretoken").distinct()
    return pt.select("pretoken", tx.byte_symbols("pretoken").alias("symbols"))


@register("byte_roundtrip_docs",
          "SELECT doc_id, text AS roundtrip FROM documents")
def q_byte_roundtrip(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", tx.byte_unsymbols(tx.byte_symbols("text")).alias("roundtrip"))


@register("pretoken_counts_docs",
          f"SELECT pretoken, count(*) AS n FROM ({_DOC_PRETOKENS}) GROUP BY pretoken")
def q_pretoken_counts(spark, d):
    from ..operators.corpus import pretoken_counts
    docs = fx.table(spark, d, "documents").select(F.col("text").alias("value"))
    return pretoken_counts(docs)


@register("pair_counts_docs",
          "WITH w AS (SELECT pretoken, count(*) AS n FROM (" + _DOC_PRETOKENS + ") GROUP BY pretoken), "
          f"s AS (SELECT n, {_duck_symbol_ids('pretoken')} AS syms FROM w), "
          "e AS (SELECT n, syms, unnest(range(1, len(syms))) AS i FROM s) "
          "SELECT syms[i] AS l, syms[i + 1] AS r, CAST(sum(n) AS BIGINT) AS c FROM e GROUP BY 1, 2")
def q_pair_counts(spark, d):
    from ..operators.bpe import pair_counts, word_table
    from ..operators.corpus import pretoken_counts
    docs = fx.table(spark, d, "documents").select(F.col("text").alias("value"))
    return pair_counts(word_table(pretoken_counts(docs)))


_MODELS: dict = {}


def _docs_bpe(spark, d, vocab_size=BPE_VOCAB):
    """Tokenizer trained on all documents (kept per application and folder:
    it is bounded by the vocabulary size)."""
    from ..operators.bpe import train_bpe
    key = (spark.sparkContext.applicationId, d, vocab_size)
    if key not in _MODELS:
        docs = fx.table(spark, d, "documents").select(F.col("text").alias("value"))
        _MODELS[key] = train_bpe(docs, vocab_size=vocab_size)
    return _MODELS[key]


@register("bpe_merges_docs", BPE_MERGES_SQL)
def q_bpe_merges(spark, d):
    """A4: merges learned on all documents."""
    return _docs_bpe(spark, d).merges_frame(spark)


@register("tokenizer_roundtrip_docs", BPE_MERGES_SQL)
def q_tokenizer_roundtrip(spark, d):
    """The tokenizer written as tables and read back."""
    from ..operators.bpe import read_tokenizer, write_tokenizer
    from ..session import shared_path
    path = shared_path(spark, "tokenizer")
    write_tokenizer(_docs_bpe(spark, d), spark, path)
    return read_tokenizer(spark, path).merges_frame(spark)


@register("bpe_vocab_docs", BPE_VOCAB_SQL)
def q_bpe_vocab(spark, d):
    """A5: specials, byte alphabet, merges."""
    return _docs_bpe(spark, d).vocab_frame(spark)


@register("bpe_encode_conv", BPE_ENCODE_SQL)
def q_bpe_encode(spark, d):
    """X4 + X10: pairs_conv texts encoded with the documents' BPE and
    decoded back."""
    from ..operators.encode import bpe_encode, decode_ids
    model = _docs_bpe(spark, d)
    enc = bpe_encode(fx.pairs_conv(spark, d).select("pair_id", "text"), model, "text")
    return enc.select("pair_id", "ids", decode_ids("ids", model).alias("decoded"))


# --- encoding, batching, next-token scorer

@register("token_ids_conv", with_fixtures(
    "SELECT pair_id, kind, CAST(pos AS INTEGER) AS pos, pretoken, id FROM tokens", "tokens"))
def q_token_ids(spark, d):
    return fx.conv_tokens(spark, d).select("pair_id", "kind", "pos", "pretoken", "id")


@register("encoded_pairs_conv", with_fixtures(
    "SELECT pair_id, src_ids[1:128] AS src, list_concat([0], tgt_ids[1:126], [2]) AS tgt FROM conv_encoded",
    "conv_encoded"))
def q_encoded_pairs(spark, d):
    from ..operators.encode import encode_pairs
    return encode_pairs(fx.conv_encoded(spark, d), max_len=128).select("pair_id", "src", "tgt")


def _padded(spark, d):
    from ..operators.encode import encode_pairs, padded_batches
    return padded_batches(encode_pairs(fx.conv_encoded(spark, d), max_len=128), 32, keys=fx.conv_keys(spark, d))


@register("padded_batches_conv", with_fixtures("SELECT * FROM padded", "padded"))
def q_padded(spark, d):
    return _padded(spark, d)


@register("next_token_table_conv", with_fixtures("SELECT * FROM next_token", "next_token"))
def q_next_token(spark, d):
    from ..operators.nexttoken import next_token_table
    return next_token_table(_padded(spark, d), fx.conv_vocab_size(spark, d))


_XENT_SQL = with_fixtures(
    "SELECT batch_id, avg(-ln((coalesce(nt.n, 0) + 0.1) / (coalesce(t.total, 0) + 0.1 * "
    "(SELECT 5 + count(DISTINCT pretoken) FROM conv_pretokens)))) AS batch_loss, count(*) AS n_tokens "
    "FROM (SELECT batch_id, unnest(tgt_in) AS prev, unnest(tgt_out) AS next FROM padded) pos "
    "LEFT JOIN next_token nt USING (prev, next) "
    "LEFT JOIN (SELECT DISTINCT prev, total FROM next_token) t USING (prev) "
    "WHERE pos.next <> 1 GROUP BY batch_id", "next_token")


@register("token_cross_entropy_conv", _XENT_SQL)
def q_xent(spark, d):
    from ..operators.nexttoken import next_token_table, token_cross_entropy
    v = fx.conv_vocab_size(spark, d)
    b = _padded(spark, d)
    return token_cross_entropy(b, next_token_table(b, v), v)


_XENT_HEAD, _XENT_BODY = _XENT_SQL.rsplit("\nSELECT batch_id, avg(", 1)


@register("epoch_loss_conv", _XENT_HEAD + "\nSELECT coalesce(avg(batch_loss), 0.0) AS epoch_loss, "
          "count(*) AS n_batches FROM (SELECT batch_id, avg(" + _XENT_BODY + ")")
def q_epoch_loss_conv(spark, d):
    from ..operators.nexttoken import next_token_table, token_cross_entropy
    v = fx.conv_vocab_size(spark, d)
    b = _padded(spark, d)
    per_batch = token_cross_entropy(b, next_token_table(b, v), v)
    return per_batch.agg(F.coalesce(F.avg("batch_loss"), F.lit(0.0)).alias("epoch_loss"),
                         F.count(F.lit(1)).alias("n_batches"))


# --- decoding rules on the logits / prefixes tables

_NEG = "'-inf'::DOUBLE"
_DEC = (
    f"g1 AS (SELECT seq_id, token_id, CASE WHEN token_id IN (0, 1, 3, 4) THEN {_NEG} ELSE logit END AS logit "
    " FROM logits), "
    "recent AS (SELECT DISTINCT seq_id, CAST(unnest(prefix[greatest(len(prefix) - 7, 1):len(prefix)]) AS BIGINT) "
    " AS token_id FROM prefixes), "
    "g2 AS (SELECT g1.seq_id, g1.token_id, CASE WHEN r.token_id IS NOT NULL THEN "
    " (CASE WHEN g1.logit > 0 THEN g1.logit / 1.5 ELSE g1.logit * 1.5 END) ELSE g1.logit END AS logit "
    " FROM g1 LEFT JOIN recent r ON g1.seq_id = r.seq_id AND g1.token_id = r.token_id), "
    f"g3 AS (SELECT g2.seq_id, token_id, CASE WHEN len(prefix) < 5 AND token_id = 2 THEN {_NEG} ELSE logit END "
    " AS logit FROM g2 JOIN prefixes p ON g2.seq_id = p.seq_id), "
    "bigrams AS (SELECT seq_id, CAST(i - 1 AS INTEGER) AS pos, prefix[i] AS t0, prefix[i + 1] AS t1, "
    " prefix[i + 2] AS t2 FROM (SELECT seq_id, prefix, unnest(range(1, len(prefix) - 1)) AS i FROM prefixes)), "
    "banned AS (SELECT DISTINCT b.seq_id, CAST(b.t2 AS BIGINT) AS token_id FROM bigrams b JOIN prefixes p "
    " ON b.seq_id = p.seq_id WHERE len(p.prefix) >= 4 AND b.t0 = p.prefix[len(p.prefix) - 1] "
    " AND b.t1 = p.prefix[len(p.prefix)]), "
    f"g4 AS (SELECT g3.seq_id, g3.token_id, CASE WHEN x.token_id IS NOT NULL THEN {_NEG} ELSE logit END AS logit "
    " FROM g3 LEFT JOIN banned x ON g3.seq_id = x.seq_id AND g3.token_id = x.token_id), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY logit DESC, token_id) AS rank FROM g4), "
    "top AS (SELECT seq_id, max(CASE WHEN rank = 1 THEN token_id END) AS best, "
    " max(CASE WHEN rank = 2 THEN token_id END) AS second FROM rk WHERE rank <= 2 GROUP BY seq_id)")


def _dec_sql(select: str) -> str:
    body = with_fixtures("SELECT 1", "logits", "prefixes")
    return f"{body[: body.rindex(chr(10) + 'SELECT 1')]},\n{_DEC}\n{select}"


def _vis(t: str) -> str:
    return (f"SELECT seq_id, token_id, CASE WHEN logit = {_NEG} THEN NULL ELSE logit END AS logit, "
            f"logit = {_NEG} AS excluded FROM {t}")


def _dec(spark, d):
    from ..operators import decoding as dc
    return dc, fx.logits(spark, d), fx.prefixes(spark, d)


@register("block_specials", _dec_sql(_vis("g1")))
def q_block_specials(spark, d):
    dc, c, _ = _dec(spark, d)
    return dc.visible(dc.block_specials(c))


@register("drop_blocked", with_fixtures(
    "SELECT seq_id, token_id, logit FROM logits WHERE token_id NOT IN (0, 1, 3, 4)", "logits"))
def q_drop_blocked(spark, d):
    dc, c, _ = _dec(spark, d)
    return dc.drop_blocked(c).select("seq_id", "token_id", "logit")


@register("recent_tokens", with_fixtures(
    "SELECT seq_id, list_sort(list_distinct(prefix[greatest(len(prefix) - 7, 1):len(prefix)])) AS recent "
    "FROM prefixes", "prefixes"))
def q_recent(spark, d):
    dc, _, p = _dec(spark, d)
    return dc.recent_tokens(p).select("seq_id", F.array_sort("recent").alias("recent"))


@register("prefix_token_flags", _dec_sql(
    "SELECT l.seq_id, l.token_id, l.logit, r.token_id IS NOT NULL AS in_recent FROM logits l "
    "LEFT JOIN recent r ON l.seq_id = r.seq_id AND l.token_id = r.token_id"))
def q_prefix_flags(spark, d):
    dc, c, p = _dec(spark, d)
    return dc.prefix_token_flags(c, p).select("seq_id", "token_id", "logit", "in_recent")


@register("repetition_penalty", _dec_sql(_vis("g2")))
def q_repetition(spark, d):
    dc, c, p = _dec(spark, d)
    return dc.visible(dc.repetition_penalty(dc.block_specials(c), p))


@register("min_length_rule", _dec_sql(_vis("g3")))
def q_min_length(spark, d):
    dc, c, p = _dec(spark, d)
    return dc.visible(dc.min_length(dc.repetition_penalty(dc.block_specials(c), p), p))


@register("prefix_bigrams", _dec_sql("SELECT seq_id, pos, t0, t1, t2 FROM bigrams"))
def q_bigrams(spark, d):
    dc, _, p = _dec(spark, d)
    return dc.prefix_bigrams(p)


@register("no_repeat_trigram", _dec_sql(_vis("g4")))
def q_trigram(spark, d):
    dc, c, p = _dec(spark, d)
    return dc.visible(dc.apply_rules(c, p))


@register("top2_token", _dec_sql(
    f"SELECT seq_id, token_id, CASE WHEN logit = {_NEG} THEN NULL ELSE logit END AS logit FROM rk WHERE rank = 2"))
def q_top2(spark, d):
    dc, c, p = _dec(spark, d)
    t = dc.top2_token(dc.apply_rules(c, p))
    return t.select("seq_id", "token_id", F.when(F.col("logit") == dc.NEG_INF, F.lit(None))
                    .otherwise(F.col("logit")).alias("logit"))


@register("pick_token", _dec_sql(
    "SELECT t.seq_id, CASE WHEN len(prefix) > 2 AND best = prefix[len(prefix)] AND best = prefix[len(prefix) - 1] "
    "AND second IS NOT NULL THEN second ELSE best END AS next_token, best, second "
    "FROM top t JOIN prefixes p ON t.seq_id = p.seq_id"))
def q_pick(spark, d):
    dc, c, p = _dec(spark, d)
    return dc.decode_step(c, p)


# --- generation and evaluation

def _summarizer(spark, d):
    from .flow import Summarizer, fit_scorer
    model = _docs_bpe(spark, d)
    train = scan.load_source(spark, "conv", "train", None, d)
    return Summarizer(model, fit_scorer(train, model))


@register("generate_summaries_conv", generate_duck(True))
def q_generate(spark, d):
    """G7 on every conversation pair."""
    from ..operators.generate import batch_generate
    s = _summarizer(spark, d)
    return batch_generate(fx.pairs_conv(spark, d).select("pair_id", "text"), s.model, s.table,
                          s.vocab_size).select("pair_id", "gen_ids")


@register("greedy_plain_conv", generate_duck(False))
def q_greedy_plain(spark, d):
    """G6 (rules off, eos dropped, sos kept) on every conversation pair."""
    from ..operators.generate import batch_generate
    s = _summarizer(spark, d)
    return batch_generate(fx.pairs_conv(spark, d).select("pair_id", "text"), s.model, s.table,
                          s.vocab_size, rules=False).select("pair_id", "gen_ids")


@register("evaluate_model_conv")
def q_evaluate(spark, d):
    """P2 on the whole conv test split: generate, pair, ROUGE-1/2/L/Lsum."""
    from .flow import evaluate_model
    return evaluate_model(spark, d, _summarizer(spark, d), num_samples=None)


from . import catalog_more  # noqa: E402, F401 - registers further queries
