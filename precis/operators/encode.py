"""Encoding and batching: X4 bpe_encode, J2 token_lookup, X10 decode_ids,
X5-X9 through ``encode_pairs`` / ``padded_batches``, W1 pad_length.

X4 plan: the JVM splits special-token literals out and pre-tokenizes
(``regexp_extract_all``); an Arrow UDF turns each distinct pre-token of a batch
into ids with the ranked merges, which are broadcast (their size is bounded
by the vocabulary size, not by the data) and cached per Python worker
together with already-encoded pre-tokens.  Encoding therefore needs no
shuffle at all: hot pre-tokens (' de', ' la') are cache hits, not a skewed
join key, and the text never leaves its partition.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import (PAD, frame_target, pad_ids, pad_mask, shift_input, shift_output,
                                truncate_ids)
from ..functions.text import (BYTE_ALPHABET, SORTED_ALPHABET, SPECIAL_TOKENS, byte_unsymbols,
                              pretokenize)
from .bpe import BpeModel
from .ordering import batch_rows, with_positions

_SPECIAL_ALT = "|".join(SPECIAL_TOKENS)
#: zero-width split before and after every special-token literal
SPECIAL_SPLIT = f"(?={_SPECIAL_ALT})|(?<={_SPECIAL_ALT})"


def pretokens_with_specials(text) -> Column:
    """Special literals become their own piece; the rest is pre-tokenized."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    segs = F.split(t, SPECIAL_SPLIT, -1)
    split = F.flatten(F.transform(
        segs, lambda s: F.when(s.isin(*SPECIAL_TOKENS), F.array(s)).otherwise(pretokenize(s))))
    # texts without '<' hold no special literal: one codegen'd regex, no lambda
    return F.when(F.instr(t, "<") == 0, pretokenize(t)).otherwise(split)


class _Encoder:
    """Per-worker BPE encoder (rank-ordered merges, pre-token cache)."""

    def __init__(self, merges):
        self.ranks = {}
        for rank, (l, r, n) in enumerate(merges):
            self.ranks.setdefault((l, r), (rank, n))
        sym = {ch: i + len(SPECIAL_TOKENS) for i, ch in enumerate(SORTED_ALPHABET)}
        self.byte_id = [sym[BYTE_ALPHABET[b]] for b in range(256)]
        self.specials = {t: i for i, t in enumerate(SPECIAL_TOKENS)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def word(self, piece: str) -> tuple[int, ...]:
        hit = self.cache.get(piece)
        if hit is not None:
            return hit
        if piece in self.specials:
            out = (self.specials[piece],)
        else:
            out = tuple(self.merged([self.byte_id[b] for b in piece.encode("utf-8")]))
        if len(self.cache) > 500_000:
            self.cache.clear()
        self.cache[piece] = out
        return out

    def merged(self, ids: list[int]) -> list[int]:
        """``ids`` after all merges, best rank first, leftmost first.  The
        symbols are a linked list and a heap holds the ranked pairs, so a piece
        of n symbols takes n log n steps; an entry whose pair is gone by the
        time it is drawn is passed over."""
        ranks, n = self.ranks, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i) for i in range(n - 1) if (m := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            m = ranks.get((ids[i], ids[j]))
            if m is None or m[0] != rank:
                continue
            ids[i], ids[j] = m[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                m = ranks.get((ids[i], ids[k]))
                if m is not None:
                    heapq.heappush(heap, (m[0], i))
            k = before[i]
            if k >= 0:
                m = ranks.get((ids[k], ids[i]))
                if m is not None:
                    heapq.heappush(heap, (m[0], k))
        return [x for x in ids if x >= 0]

    def encode(self, pieces) -> list[int]:
        return [i for p in pieces for i in self.word(p)]


#: the encoders of this worker's last models, and the driver's broadcasts, by digest of the merges
_ENCODERS: dict[str, _Encoder] = {}
_BROADCASTS: dict[tuple[str, str], object] = {}
_KEPT_ENCODERS = 4


def encode_arrow(enc: _Encoder, pieces: pa.Array) -> pa.Array:
    """Encode a batch of pre-token lists: each *distinct* piece of the batch
    goes through the BPE helper once; ids are gathered and regrouped per row
    with numpy on the Arrow offsets."""
    if isinstance(pieces, pa.ChunkedArray):
        pieces = pieces.combine_chunks()
    row_lens = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pieces.flatten()
    if len(flat) == 0:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(pieces) + 1, dtype=np.int32)),
                                        pa.array([], pa.int32()))
    denc = pc.dictionary_encode(flat)
    uniq = denc.dictionary.to_pylist()
    idx = denc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    coded = [enc.word(u) for u in uniq]
    lens = np.fromiter((len(c) for c in coded), dtype=np.int64, count=len(coded))
    vals = np.fromiter(itertools.chain.from_iterable(coded), dtype=np.int32, count=int(lens.sum()))
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    piece_len = lens[idx]
    piece_start = np.concatenate([[0], np.cumsum(piece_len)[:-1]])
    gather = np.arange(int(piece_len.sum())) + np.repeat(starts[idx] - piece_start, piece_len)
    piece_cum = np.concatenate([[0], np.cumsum(piece_len)])
    row_off = piece_cum[np.concatenate([[0], np.cumsum(row_lens)])]
    return pa.ListArray.from_arrays(pa.array(row_off.astype(np.int32)), pa.array(vals[gather], pa.int32()))


def bpe_encode_udf(spark, model: BpeModel):
    """An Arrow UDF ``array<string> pretokens -> array<int> ids`` bound to
    ``model`` through a broadcast variable."""
    sc = spark.sparkContext
    digest = hashlib.md5(repr(model.merges).encode()).hexdigest()
    bc = _BROADCASTS.get((sc.applicationId, digest))
    if bc is None:
        bc = _BROADCASTS[sc.applicationId, digest] = sc.broadcast(list(model.merges))

    @F.arrow_udf("array<int>")
    def encode(pieces: pa.Array) -> pa.Array:
        enc = _ENCODERS.pop(digest, None) or _Encoder(bc.value)
        _ENCODERS[digest] = enc  # the last used one stands last
        while len(_ENCODERS) > _KEPT_ENCODERS:
            del _ENCODERS[next(iter(_ENCODERS))]
        return encode_arrow(enc, pieces)

    return encode


def bpe_encode(df: DataFrame, model: BpeModel, text: str, out: str = "ids",
               max_pretokens: int | None = None) -> DataFrame:
    """Text -> ids.  With ``max_pretokens`` only the first pre-tokens are
    encoded (safe for truncation to that many ids: every pre-token gives at
    least one id)."""
    pieces = pretokens_with_specials(text)
    if max_pretokens is not None:
        pieces = F.slice(pieces, 1, max_pretokens)
    enc = bpe_encode_udf(df.sparkSession, model)
    return df.withColumn(out, enc(pieces))


def vocab_array(model: BpeModel) -> Column:
    """The vocabulary as one constant array (id -> token); the split of a
    literal is folded to a literal by the optimizer.  Byte-level tokens hold
    no space, so a space separates them."""
    return F.split(F.lit(" ".join(model.tokens)), " ")


def decode_ids(ids, model: BpeModel, strip: bool = False) -> Column:
    """Ids -> text; special ids are skipped, byte symbols are turned
    back into UTF-8 (invalid bytes -> U+FFFD).  ``strip`` trims the ends as
    ``summarize`` does."""
    specials = F.array(*[F.lit(i) for i in range(len(SPECIAL_TOKENS))])
    vocab = vocab_array(model)
    c = F.col(ids) if isinstance(ids, str) else ids
    kept = F.filter(c, lambda i: ~F.array_contains(specials, i))
    text = byte_unsymbols(F.array_join(F.transform(kept, lambda i: F.element_at(vocab, i + 1)), ""))
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "") if strip else text


def token_lookup(pieces: DataFrame, vocab: DataFrame, token: str = "pretoken") -> DataFrame:
    """Attach ``id`` to every token row.  AQE broadcasts the vocabulary
    when its measured bytes allow, and else splits the partitions of hot
    tokens of the shuffle join."""
    return pieces.join(vocab, token, "inner")


def dense_vocab(pieces: DataFrame, token: str = "pretoken", first_id: int = len(SPECIAL_TOKENS),
                keys: DataFrame | None = None) -> DataFrame:
    """Ids ``first_id + dense rank`` of the distinct tokens in byte order,
    computed without a single-task window.  Only a sample of the tokens is read
    when the plan is built (of ``keys``, if that is given: a table of about the
    same tokens); ranges and counts are part of the plan."""
    distinct = pieces.select(token).distinct()
    ranked = with_positions(distinct, [token], "pos", keys=(pieces if keys is None else keys).select(token))
    return ranked.select(token, (F.col("pos") + F.lit(first_id)).cast("int").alias("id"))


def encode_pairs(df: DataFrame, src: str = "src_ids", tgt: str = "tgt_ids",
                 max_len: int = 128) -> DataFrame:
    """X5 + X6: source truncated to ``max_len``; target truncated to
    ``max_len - 2`` then framed by sos/eos."""
    if max_len < 2:
        raise ValueError("max_len must be >= 2")
    return df.withColumn("src", truncate_ids(src, max_len)) \
             .withColumn("tgt", frame_target(truncate_ids(tgt, max_len - 2)))


def padded_batches(encoded: DataFrame, batch_size: int = 32, key: str = "pair_id",
                   pad: int = PAD, order_cols=None, keys: DataFrame | None = None) -> DataFrame:
    """L6 + W1 + X7-X9: consecutive rows in batches, each padded to the
    longest source / target of its batch (the window holds one batch)."""
    batched = batch_rows(encoded, batch_size, order_cols or (key,), keys)
    w = Window.partitionBy("batch_id")
    with_len = batched.withColumn("src_len", F.max(F.size("src")).over(w)) \
                      .withColumn("tgt_len", F.max(F.size("tgt")).over(w))
    padded = with_len.withColumn("src_pad", pad_ids("src", F.col("src_len"), pad)) \
                     .withColumn("tgt_pad", pad_ids("tgt", F.col("tgt_len"), pad))
    return padded.select(
        "batch_id", "pos_in_batch", key, "src_len", "tgt_len", "src_pad",
        shift_input("tgt_pad").alias("tgt_in"), shift_output("tgt_pad").alias("tgt_out"),
        pad_mask("src_pad", pad).alias("src_mask"), pad_mask(shift_input("tgt_pad"), pad).alias("tgt_mask"))
