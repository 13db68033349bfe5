"""Further registered queries (see ``catalog``): sinks, file sources, messages,
the bootstrap interval, the tokenizer file and the run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering, pairs, rouge
from ..session import shared_path
from ..sources import scan
from . import fixtures as fx
from .catalog import _F, _docs_bpe, _padded, _rouge_sql, register
from .oracle_sql import BPE_MERGES_SQL, with_fixtures


def _message(call) -> str | None:
    try:
        call()
    except ValueError as exc:
        return str(exc)
    return None


# --- S8, L1

@register("write_summaries_lines_docs", "SELECT coalesce(text, '') AS summary FROM documents")
def q_write_summaries_lines(spark, d):
    """Whole documents, line ends and all, as a text file of a line each
    and back."""
    from ..sources.sinks import read_summaries, write_summaries
    path = shared_path(spark, "summaries")
    write_summaries(fx.table(spark, d, "documents").select(F.col("text").alias("summary")), path, as_text=True)
    return read_summaries(spark, path)


@register("first_n_ties_docs", "SELECT k, source FROM (SELECT nullif(lang, 'de') AS k, source FROM documents) "
          "ORDER BY k NULLS FIRST, source NULLS FIRST LIMIT 700")
def q_first_n_ties(spark, d):
    """L1 on keys that very many rows repeat, null among them."""
    docs = fx.table(spark, d, "documents").select(F.nullif(F.col("lang"), F.lit("de")).alias("k"), "source")
    return ordering.first_n(docs, 700, ("k", "source"))


# --- S2, U2, S3, S6, F8, F9, X18

def _sources_by_lang(spark, d, broken: str | None = None):
    """(registry, folder): documents saved as a Parquet folder per language,
    one of them with a shard that breaks off."""
    from ..sources.files import file_system
    from ..sources.registry import Registry, SourceSpec
    docs = fx.table(spark, d, "documents").select("lang", "text", F.substring_index("text", "\n", 1).alias("summary"))
    path = shared_path(spark, "by-lang")
    langs = [r["lang"] for r in docs.select("lang").distinct().orderBy("lang").collect()]
    for lang in langs:
        docs.where(F.col("lang") == lang).select("text", "summary").write.parquet(f"{path}/{lang}")
    if broken:
        fs, p = file_system(spark, f"{path}/{broken}/part-99999.parquet")
        out = fs.create(p)
        out.write(b"PAR1 this shard breaks off")
        out.close()
    return Registry(tuple(SourceSpec(lang, parquet_files={"train": (lang,)}) for lang in langs)), path


@register("tolerant_union_shard",
          "SELECT lang AS source, CASE WHEN lang = 'es' THEN 'failed' ELSE 'loaded' END AS status, "
          "CASE WHEN lang = 'es' THEN 1 ELSE 0 END AS broken_files, "
          "CASE WHEN lang <> 'es' THEN count(*) FILTER (text <> '' AND split_part(text, chr(10), 1) <> '') END AS n_rows "
          "FROM documents GROUP BY lang")
def q_tolerant_shard(spark, d):
    """One source holds a shard that breaks off, which only its footer
    shows; the other sources load."""
    reg, path = _sources_by_lang(spark, d, broken="es")
    report: list = []
    df = scan.load_pairs(spark, "all", "train", None, path, reg, report)
    counts = df.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    return scan.report_frame(spark, report).select("source", "status", "broken_files").join(counts, "source", "left")


@register("file_inventory_docs", "SELECT lang AS folder, count(*) AS n_rows, 0 AS n_broken FROM documents GROUP BY lang")
def q_inventory(spark, d):
    """Row counts of the files of every source, from their footers."""
    from ..sources.files import inventory
    reg, path = _sources_by_lang(spark, d)
    files = inventory(spark, [f"{path}/{name}" for name in reg.names()])
    return files.groupBy(F.regexp_extract("plain", r"([^/]+)/[^/]+$", 1).alias("folder")).agg(
        F.sum("n").alias("n_rows"), F.count("error").cast("int").alias("n_broken"))


@register("validate_sources_docs", """
SELECT lang AS source, split, CASE
  WHEN lang NOT IN ('de', 'fr') THEN 'No source ''' || lang || '''; choose from: de, fr, all'
  WHEN lang = 'de' AND split <> 'train' THEN 'No split ''' || split || '''; choose from: train'
  WHEN split = 'validation' THEN 'No split ''validation''; choose from: train, test' END AS error
FROM (SELECT DISTINCT lang FROM documents), (SELECT unnest(['train', 'test', 'validation']) AS split)""")
def q_validate(spark, d):
    """S3: every language of the documents asked for as a source of a registry
    that has two of them, in every split."""
    from ..sources.registry import SPLITS, Registry, SourceSpec
    reg = Registry((SourceSpec("de", parquet_files={"train": ("a",)}), SourceSpec("fr", parquet_files={"train": ("b",), "test": ("c",)})))
    rows = [(name, split, _message(lambda: reg.validate(name, split)))
            for (name,) in fx.table(spark, d, "documents").select("lang").distinct().collect()  # a row per language
            for split in SPLITS]
    return spark.createDataFrame(rows, "source string, split string, error string")


@register("scan_text_files_docs", "SELECT doc_id, text || chr(10) AS text, octet_length(encode(text)) + 1 AS n_bytes "
          "FROM documents WHERE text IS NOT NULL")
def q_scan_text_files(spark, d):
    """Every document as a text file of its own, read back."""
    from ..sources.textfiles import scan_text_files, write_text_files
    path = shared_path(spark, "text-files")
    docs = fx.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("value"))
    write_text_files(docs, path, "doc_id")
    return scan_text_files(spark, path).where("error IS NULL").select(
        F.nullif(F.regexp_extract("path", r"doc_id=(-?\d+)\.txt$", 1), F.lit("")).cast("long").alias("doc_id"), "text", "n_bytes")


@register("require_nonempty_docs", """
SELECT lang, CASE WHEN count(*) FILTER (n_chars > 12000) = 0
  THEN 'no rows: the table of long documents in ' || lang || ' is empty' END AS error FROM documents GROUP BY lang""")
def q_require_nonempty(spark, d):
    """F8: the long documents of every language, of which there may be none."""
    docs = fx.table(spark, d, "documents")
    rows = [(lang, _message(lambda: pairs.require_nonempty(
        docs.where((F.col("lang") == lang) & (F.col("n_chars") > 12_000)), f"table of long documents in {lang}")))
        for (lang,) in docs.select("lang").distinct().collect()]  # a row per language
    return spark.createDataFrame(rows, "lang string, error string")


@register("require_split_docs", """
SELECT source AS folder, CASE WHEN count(*) FILTER (mod(doc_id, 10) = 0 AND lang = 'fr') = 0
  THEN 'no test split at ' || source || '; found: train' END AS error FROM documents GROUP BY source""")
def q_require_split(spark, d):
    """documents saved as a split dictionary per source; a source without a
    French test row has no test split."""
    from ..sources.saved import classify
    docs, path = fx.table(spark, d, "documents"), shared_path(spark, "split-dirs")
    rows = []
    for (name,) in docs.select("source").distinct().collect():  # a row per source
        own, folder = docs.where(F.col("source") == name).select("doc_id", "lang"), f"{path}/s{len(rows)}"
        own.write.parquet(f"{folder}/train")
        test = own.where("doc_id % 10 = 0 AND lang = 'fr'")
        if not test.isEmpty():
            test.write.parquet(f"{folder}/test")
        rows.append((name, _message(lambda: pairs.require_split(classify(spark, folder).splits, "test", name))))
    return spark.createDataFrame(rows, "folder string, error string")


@register("require_specials_docs",
          "SELECT token AS dropped, 'the vocabulary lacks special tokens: ' || token AS error "
          "FROM (SELECT unnest(['<s>', '<pad>', '</s>', '<unk>', '<mask>']) AS token) WHERE (SELECT count(*) FROM documents) > 0")
def q_require_specials(spark, d):
    """The documents' tokenizer without one special token after the other."""
    from ..functions.text import SPECIAL_TOKENS
    from ..operators.bpe import BpeModel, require_specials
    model = _docs_bpe(spark, d)
    require_specials(model)
    rows = [(t, _message(lambda: require_specials(BpeModel([x for x in model.tokens if x != t])))) for t in SPECIAL_TOKENS]
    return spark.createDataFrame(rows, "dropped string, error string")


# --- A11, S7

_WEIGHT = " + ".join(f"CAST(substr(h, 4 * j + 1, 4) >= '{s}' AS BIGINT)" for s in rouge.POISSON_STEPS)


@register("rouge_bootstrap_n", _rouge_sql(
    "SELECT metric, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.5), 6) AS mid, "
    "round(quantile_cont(mean, 0.975), 6) AS high, max(n) AS n_pairs FROM ("
    " SELECT metric, r, count(*) AS n, CAST(sum(w * f) AS DOUBLE) / CAST(sum(w) AS DOUBLE) / 100000000 AS mean FROM ("
    f"  SELECT metric, f, block * 8 + j AS r, {_WEIGHT} AS w FROM ("
    f"   SELECT metric, CAST(round({_F} * 100000000) AS BIGINT) AS f, block, md5('11,' || block || ',' || pair_id) AS h "
    "    FROM sc, range(25) b(block)), range(8) k(j)) GROUP BY metric, r HAVING sum(w) > 0) GROUP BY metric"))
def q_rouge_bootstrap(spark, d):
    """Interval of the corpus score over 200 resamplings."""
    scores = rouge.rouge_n(fx.rouge_pairs(spark, d))
    return rouge.rouge_bootstrap(scores, resamples=200, seed=11).select(
        "metric", *[F.round(c, 6).alias(c) for c in ("low", "mid", "high")], "n_pairs")


@register("tokenizer_file_docs", BPE_MERGES_SQL)
def q_tokenizer_file(spark, d):
    """The tokenizer written as the library's JSON file and read back."""
    from ..operators.bpe_file import read_tokenizer_file, write_tokenizer_file
    path = shared_path(spark, "tokenizer") + ".json"
    write_tokenizer_file(_docs_bpe(spark, d), spark, path)
    return read_tokenizer_file(spark, path).merges_frame(spark)


# --- P1

_EPOCHS = 6
_RUN_LOG_SQL = with_fixtures("SELECT 1", "padded").rsplit("\nSELECT 1", 1)[0] + f""",
pos AS (SELECT * FROM (SELECT batch_id, mod(batch_id, 5) = 0 AS held, unnest(tgt_in) AS prev, unnest(tgt_out) AS next FROM padded)
        WHERE next <> 1),
learned AS (SELECT prev, next, count(*) AS n FROM pos WHERE NOT held GROUP BY ALL),
totals AS (SELECT prev, sum(n) AS total FROM learned GROUP BY prev),
v AS (SELECT 5 + count(DISTINCT pretoken) AS size FROM conv_pretokens),
per_batch AS (
  SELECT epoch, batch_id, held, avg(-ln((epoch * coalesce(n, 0) + 0.1) / (epoch * coalesce(total, 0) + 0.1 * size))) AS batch_loss
  FROM pos LEFT JOIN learned USING (prev, next) LEFT JOIN totals USING (prev), v, (SELECT unnest(range(1, {_EPOCHS + 1})) AS epoch)
  GROUP BY epoch, batch_id, held),
losses AS (SELECT epoch, avg(batch_loss) FILTER (NOT held) AS train_loss, avg(batch_loss) FILTER (held) AS val_loss
           FROM per_batch GROUP BY epoch),
marked AS (SELECT *, val_loss < coalesce(min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                                         'inf'::DOUBLE) AS improved FROM losses),
counted AS (SELECT *, CAST(epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch), 0) AS INTEGER) AS patience_counter
            FROM marked)
SELECT CAST(epoch AS INTEGER) AS epoch, train_loss, val_loss,
       (0.0001 * 0.01 + (0.0001 - 0.0001 * 0.01) * (1 + cos(pi() * epoch / {_EPOCHS})) / 2) * 1000000 AS lr_micro, improved, patience_counter
FROM counted WHERE epoch <= coalesce((SELECT min(epoch) FROM counted WHERE patience_counter >= 3), {_EPOCHS})"""


@register("run_log_conv", _RUN_LOG_SQL)
def q_run_log(spark, d):
    """P1's run log: every fifth batch is held out, the others are counted; the
    losses of six passes, and the pass at which training stops."""
    from ..operators.nexttoken import epoch_losses, next_token_table
    from .flow import run_log
    v, batches = fx.conv_vocab_size(spark, d), _padded(spark, d)
    held = F.col("batch_id") % 5 == 0
    learned = next_token_table(batches.where(~held), v)
    log = run_log(epoch_losses(batches.where(~held), learned, v, _EPOCHS),
                  epoch_losses(batches.where(held), learned, v, _EPOCHS), _EPOCHS)
    # learning rates are ~1e-4: compared in micro-units
    return log.select("epoch", "train_loss", "val_loss", (F.col("lr") * 1_000_000).alias("lr_micro"), "improved", "patience_counter")
