"""DuckDB text of the derived tables, used by the oracle SQL of the catalog.

Each constant is a SELECT over the given tables; the catalog puts the ones a
query needs in a WITH clause.  DuckDB's regex engine has no look-ahead and no
``(?U)``; on the given tables (ASCII blanks, no blank runs before a word) the
shortened pre-token pattern splits the same way.
"""

from __future__ import annotations

PAIRS_CONV = """
SELECT conv_id * (SELECT max(turn) + 1 FROM conversations) + turn AS pair_id, mod(conv_id, 10) AS bucket, text, nt AS summary
FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND nr = 'assistant'"""

PAIRS_DOCS = """
SELECT doc_id AS pair_id, mod(doc_id, 10) AS bucket, text,
       split_part(text, chr(10), 1) AS summary
FROM documents WHERE lang = 'fr'"""

DOCS_ALL = """
SELECT doc_id AS pair_id, text, split_part(text, chr(10), 1) AS summary FROM documents"""

PAIRS_PAGES = """
SELECT page_id AS pair_id, mod(page_id, 10) AS bucket, url, html AS source,
       regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS target
FROM pages"""

DIRTY_PAIRS = """
SELECT pair_id, bucket,
       CASE WHEN mod(pair_id, 7) = 1 THEN '' WHEN mod(pair_id, 7) = 2 THEN '   ' ELSE text END AS text,
       CASE WHEN mod(pair_id, 7) = 0 THEN NULL ELSE summary END AS summary
FROM pairs_conv"""

ROUGE_PAIRS = "SELECT pair_id, text AS prediction, summary AS reference FROM pairs_conv"

RUN_METRICS = """
SELECT user_id AS run_id,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch,
       value AS val_loss
FROM events"""

BATCH_LOSSES = "SELECT run_id, epoch AS batch_id, val_loss AS batch_loss FROM run_metrics"

LOGITS = """
SELECT vec_id AS seq_id, i - 1 AS token_id, CAST(embedding[i] AS DOUBLE) * 10 AS logit
FROM embeddings, range(1, 65) t(i)"""

PREFIXES = """
SELECT vec_id AS seq_id,
       list_concat([0], list_transform(range(1, 4 + mod(vec_id, 12)),
                   lambda p: CAST(5 + mod(vec_id * 7 + p * p, 5) AS INTEGER))) AS prefix
FROM embeddings"""

# canonical sources (after F1-F3), with their split
SOURCES_ALL = """
SELECT 'conv' AS source, 0 AS source_rank, pair_id, bucket, text, summary FROM pairs_conv
WHERE text <> '' AND summary <> ''
UNION ALL
SELECT 'docs', 1, pair_id, bucket, text, summary FROM pairs_docs
WHERE text <> '' AND summary <> ''
UNION ALL
SELECT 'pages', 2, pair_id, bucket, source AS text, target AS summary FROM pairs_pages
WHERE source <> '' AND target <> ''"""

SPLIT_OF_BUCKET = "CASE WHEN bucket = 0 THEN 'test' WHEN bucket = 1 THEN 'validation' ELSE 'train' END"

# DuckDB form of the pre-token pattern (look-ahead branch dropped)
PRETOKEN_DUCK = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""


def rouge_tokens_duck(expr: str) -> str:
    return (f"list_filter(string_split(regexp_replace(lower(coalesce({expr}, '')), "
            f"'[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')")


def word_count_duck(expr: str) -> str:
    return f"len(regexp_extract_all(coalesce({expr}, ''), '[^\\s\\x1c-\\x1f]+'))"


PRETOKEN_DUCK_SQL = PRETOKEN_DUCK.replace("'", "''")

CONV_PRETOKENS = f"""
SELECT pair_id, kind, generate_subscripts(arr, 1) - 1 AS pos, unnest(arr) AS pretoken FROM (
  SELECT pair_id, 'text' AS kind, regexp_extract_all(text, '{PRETOKEN_DUCK_SQL}') AS arr FROM pairs_conv
  UNION ALL
  SELECT pair_id, 'summary', regexp_extract_all(summary, '{PRETOKEN_DUCK_SQL}') FROM pairs_conv)"""

TOKENS = """
SELECT pair_id, kind, pos, pretoken,
       CAST(5 + dense_rank() OVER (ORDER BY pretoken) - 1 AS INTEGER) AS id
FROM conv_pretokens"""

CONV_ENCODED = """
SELECT pair_id, list(id ORDER BY pos) FILTER (WHERE kind = 'text') AS src_ids,
       list(id ORDER BY pos) FILTER (WHERE kind = 'summary') AS tgt_ids
FROM tokens GROUP BY pair_id"""

VOCAB_SIZE = "(SELECT 5 + count(DISTINCT pretoken) FROM conv_pretokens)"

PADDED = """
WITH enc AS (SELECT pair_id, src_ids[1:128] AS src, list_concat([0], tgt_ids[1:126], [2]) AS tgt
             FROM conv_encoded),
b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY pair_id) - 1) / 32) AS BIGINT) AS batch_id,
             CAST(mod(row_number() OVER (ORDER BY pair_id) - 1, 32) AS INTEGER) AS pos_in_batch FROM enc),
l AS (SELECT *, max(len(src)) OVER (PARTITION BY batch_id) AS src_len,
             max(len(tgt)) OVER (PARTITION BY batch_id) AS tgt_len FROM b),
p AS (SELECT *, list_concat(src, list_transform(range(src_len - len(src)), lambda x: 1)) AS src_pad,
             list_concat(tgt, list_transform(range(tgt_len - len(tgt)), lambda x: 1)) AS tgt_pad FROM l)
SELECT batch_id, pos_in_batch, pair_id, src_len, tgt_len, src_pad,
       tgt_pad[1:len(tgt_pad) - 1] AS tgt_in, tgt_pad[2:len(tgt_pad)] AS tgt_out,
       list_transform(src_pad, lambda x: x = 1) AS src_mask,
       list_transform(tgt_pad[1:len(tgt_pad) - 1], lambda x: x = 1) AS tgt_mask
FROM p"""

NEXT_TOKEN = f"""
WITH pairs AS (SELECT batch_id, unnest(tgt_in) AS prev, unnest(tgt_out) AS next FROM padded),
cnt AS (SELECT prev, next, count(*) AS n FROM pairs WHERE next <> 1 GROUP BY prev, next)
SELECT prev, next, n, CAST(sum(n) OVER (PARTITION BY prev) AS BIGINT) AS total,
       ln((n + 0.1) / (sum(n) OVER (PARTITION BY prev) + 0.1 * {VOCAB_SIZE})) AS logp
FROM cnt"""

DEPENDS = {
    "pairs_conv": (PAIRS_CONV, ()),
    "docs_all": (DOCS_ALL, ()),
    "pairs_docs": (PAIRS_DOCS, ()),
    "pairs_pages": (PAIRS_PAGES, ()),
    "dirty_pairs": (DIRTY_PAIRS, ("pairs_conv",)),
    "rouge_pairs": (ROUGE_PAIRS, ("pairs_conv",)),
    "run_metrics": (RUN_METRICS, ()),
    "batch_losses": (BATCH_LOSSES, ("run_metrics",)),
    "logits": (LOGITS, ()),
    "prefixes": (PREFIXES, ()),
    "sources_all": (SOURCES_ALL, ("pairs_conv", "pairs_docs", "pairs_pages")),
    "conv_pretokens": (CONV_PRETOKENS, ("pairs_conv",)),
    "tokens": (TOKENS, ("conv_pretokens",)),
    "conv_encoded": (CONV_ENCODED, ("tokens",)),
    "padded": (PADDED, ("conv_encoded",)),
    "next_token": (NEXT_TOKEN, ("padded", "conv_pretokens")),
}


def with_fixtures(body: str, *names: str) -> str:
    """``WITH`` clause holding ``names`` and what they depend on, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPENDS[n][1]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({DEPENDS[n][0]})" for n in order)
    return f"WITH {ctes}\n{body}"


# --- byte-level BPE: one pair of CTEs per merge -------------------------------

BPE_VOCAB = 500
BPE_MERGES = BPE_VOCAB - 261


def _byte_char(p: str, i: str) -> str:
    from ..functions.text import BYTE_ALPHABET
    alphabet = BYTE_ALPHABET.replace("'", "''")
    return f"substr('{alphabet}', CAST(('0x' || substr(hex(encode({p})), 2 * {i} + 1, 2)) AS INTEGER) + 1, 1)"


def symbol_ids_duck(p: str) -> str:
    from ..functions.text import SORTED_ALPHABET
    alphabet = SORTED_ALPHABET.replace("'", "''")
    return (f"list_transform(range(0, octet_length(encode({p}))), "
            f"lambda i: CAST(instr('{alphabet}', {_byte_char(p, 'i')}) + 4 AS INTEGER))")


def ids_of(syms: str) -> str:
    return f"CAST(string_split(trim(replace({syms}, '><', ' '), '<>'), ' ') AS INT[])"


def bpe_ctes() -> str:
    """CTEs t1 .. tK (the pair that merge k takes), w0 .. wK (the words, with
    the symbols in brackets) and ``vocab``.  Conversation pre-tokens ride along
    with count 0, so that wK also encodes them."""
    from ..functions.text import SORTED_ALPHABET, SPECIAL_TOKENS
    base = [*SPECIAL_TOKENS, *SORTED_ALPHABET]
    names = ", ".join("'" + t.replace("'", "''") + "'" for t in base)
    parts = [
        f"conv_pairs AS ({PAIRS_CONV})",
        f"doc_pieces AS (SELECT unnest(regexp_extract_all(text, '{PRETOKEN_DUCK_SQL}')) AS pretoken FROM documents)",
        f"conv_pieces AS (SELECT unnest(regexp_extract_all(text, '{PRETOKEN_DUCK_SQL}')) AS pretoken FROM conv_pairs "
        f"UNION SELECT unnest(regexp_extract_all(summary, '{PRETOKEN_DUCK_SQL}')) FROM conv_pairs)",
        "pieces AS (SELECT pretoken, sum(n) AS n FROM (SELECT pretoken, count(*) AS n FROM doc_pieces GROUP BY 1 "
        "UNION ALL SELECT pretoken, 0 FROM conv_pieces) GROUP BY 1)",
        f"w0 AS MATERIALIZED (SELECT pretoken, n, '<' || array_to_string({symbol_ids_duck('pretoken')}, '><') || '>' "
        "AS syms FROM pieces)",
        f"v0 AS MATERIALIZED (SELECT generate_subscripts(b, 1) - 1 AS id, unnest(b) AS token FROM (SELECT [{names}] AS b))",
    ]
    for k in range(1, BPE_MERGES + 1):
        parts += [
            f"t{k} AS MATERIALIZED (SELECT ids[i] AS l, ids[i + 1] AS r, sum(n) AS c FROM (SELECT n, ids, "
            f"unnest(range(1, len(ids))) AS i FROM (SELECT n, {ids_of('syms')} AS ids FROM w{k - 1} "
            "WHERE contains(syms, '><'))) GROUP BY 1, 2 ORDER BY c DESC, l, r LIMIT 1)",
            f"w{k} AS MATERIALIZED (SELECT pretoken, n, replace(syms, '<' || l || '><' || r || '>', '<{260 + k}>') AS syms "
            f"FROM w{k - 1}, t{k})",
            f"v{k} AS MATERIALIZED (SELECT * FROM v{k - 1} UNION ALL SELECT {260 + k}, a.token || b.token "
            f"FROM t{k}, v{k - 1} a, v{k - 1} b WHERE a.id = l AND b.id = r)",
        ]
    parts += [f"coded AS MATERIALIZED (SELECT pretoken, {ids_of('syms')} AS ids FROM w{BPE_MERGES})",
              f"vocab AS MATERIALIZED (SELECT * FROM v{BPE_MERGES})"]
    return ",\n".join(parts)


def encoded_duck(text: str) -> str:
    """Ids of a text of ``conv_pairs``, by pair."""
    return (f"SELECT pair_id, flatten(list(ids ORDER BY pos)) AS ids FROM (SELECT pair_id, unnest(p) AS pretoken, "
            f"generate_subscripts(p, 1) AS pos FROM (SELECT pair_id, regexp_extract_all({text}, '{PRETOKEN_DUCK_SQL}') AS p "
            f"FROM conv_pairs)) JOIN coded USING (pretoken) GROUP BY pair_id")


BPE_MERGES_SQL = (f"WITH {bpe_ctes()}\nSELECT CAST(rank AS INT) AS rank, l AS left_id, r AS right_id, "
                  "CAST(rank + 261 AS INT) AS new_id, a.token AS left, b.token AS right FROM ("
                  + " UNION ALL ".join(f"SELECT {k - 1} AS rank, l, r FROM t{k}" for k in range(1, BPE_MERGES + 1))
                  + ") m, vocab a, vocab b WHERE a.id = l AND b.id = r")
BPE_VOCAB_SQL = f"WITH {bpe_ctes()}\nSELECT CAST(id AS INT) AS id, token FROM vocab"
BPE_ENCODE_SQL = (f"WITH {bpe_ctes()}\nSELECT pair_id, ids, text AS decoded FROM ({encoded_duck('text')}) "
                  "JOIN conv_pairs USING (pair_id)")


def generate_duck(rules: bool) -> str:
    """Generated ids of every conversation pair, one recursion step per token."""
    inf = "'-inf'::DOUBLE"
    x = (f"ln((coalesce(nt.n, 0) + 0.1) / (coalesce(tot.total, 0) + 0.1 * {BPE_VOCAB})) "
         "+ CASE WHEN list_contains(src, v.id) THEN 1.0 ELSE 0.0 END")
    if rules:
        x = f"CASE WHEN v.id IN (0, 1, 3, 4) THEN {inf} ELSE {x} END"
        x = f"CASE WHEN list_contains(ids[greatest(len(ids) - 7, 1):], v.id) THEN CASE WHEN ({x}) > 0 THEN ({x}) / 1.5 ELSE ({x}) * 1.5 END ELSE {x} END"
        x = f"CASE WHEN (len(ids) < 5 AND v.id = 2) OR list_contains(banned, v.id) THEN {inf} ELSE {x} END"
    banned = ("CASE WHEN len(ids) >= 4 THEN list_transform(list_filter(range(1, len(ids) - 1), lambda i: "
              "ids[i] = ids[len(ids) - 1] AND ids[i + 1] = ids[len(ids)]), lambda i: ids[i + 2]) ELSE [] END")
    pick = ("CASE WHEN len(ids) > 2 AND top[1] = ids[len(ids)] AND top[1] = ids[len(ids) - 1] THEN top[2] ELSE top[1] END"
            if rules else "top[1]")
    grown = "list_append(ids, next)" if rules else "CASE WHEN next = 2 THEN ids ELSE list_append(ids, next) END"
    limit = 150
    return f"""WITH RECURSIVE {bpe_ctes()},
src AS MATERIALIZED (SELECT pair_id, ids[1:{limit}] AS src FROM ({encoded_duck('text')})),
tgt AS (SELECT list_concat([0], ids[1:126], [2]) AS t FROM ({encoded_duck('summary')}) JOIN conv_pairs USING (pair_id)
        WHERE bucket NOT IN (0, 1) AND text <> '' AND summary <> ''),
nt AS MATERIALIZED (SELECT prev, next, count(*) AS n FROM (SELECT unnest(t[1:len(t) - 1]) AS prev, unnest(t[2:]) AS next
                    FROM tgt) WHERE next <> 1 GROUP BY 1, 2),
tot AS MATERIALIZED (SELECT prev, sum(n) AS total FROM nt GROUP BY prev),
g AS (
  SELECT pair_id, src, 0 AS step, [0] AS ids, false AS done FROM src
  UNION ALL
  SELECT pair_id, src, step + 1, {grown}, next = 2 FROM (
    SELECT pair_id, src, step, ids, {pick} AS next FROM (
      SELECT pair_id, any_value(src) AS src, any_value(step) AS step, any_value(ids) AS ids,
             list(id ORDER BY x DESC, id)[1:2] AS top
      FROM (SELECT pair_id, src, step, ids, v.id, {x} AS x
            FROM (SELECT *, {banned} AS banned, ids[len(ids)] AS last FROM g WHERE NOT done AND step < {limit}) s
            CROSS JOIN vocab v LEFT JOIN nt ON nt.prev = last AND nt.next = v.id LEFT JOIN tot ON tot.prev = last)
      GROUP BY pair_id))
)
SELECT pair_id, arg_max(ids, step) AS gen_ids FROM g GROUP BY pair_id"""
