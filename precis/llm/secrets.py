"""Secret scan: fixed patterns plus a token-efficiency test.

Base spans are the leftmost non-overlapping matches of three patterns, whole
match, in code points.  The method adds spans of kind ``random``: runs of
``[A-Za-z0-9+/=_-]`` of at least ``min_chars`` whose characters per token under
a byte-pair vocabulary lie below ``max_ratio``.  Text that the vocabulary knows
packs three and more characters into a token; random strings do not.  Where the
whole run is not below the ratio, its stretches between separators are tested,
and neighbouring stretches that are each below it are tested joined, so that
words beside a random string (a path, a name) do not hide it.  Left out are
known digests (hexadecimal of a digest's length), UUIDs, plain numbers, short
units repeated, identifiers (words of letters joined by ``_ - / +`` with at most
a short number, each one token or not below the ratio when split at case
changes), and what a base span covers.

Each whole text is scanned in one pass per row inside Arrow batches; nothing is
shuffled.  Null text counts as empty; a text without matches gives zeros, the
digest of the empty string and an empty ``spans``; repeated rows repeat.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns and lengths (given); letters of the first in either case.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the length can sit in the pattern
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
DIGEST = re.compile(r"(?i:[0-9a-f]+)\Z")
#: Hexadecimal digits of CRC-64 to SHA-512 (fixed values).
DIGEST_CHARS = {16, 32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"(?i:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})\Z")
IDENTIFIER = re.compile(r"[_/+=-]*[A-Za-z]+([_/+=-]+[A-Za-z]+)*[_/+=-]*\d{0,4}[_/+=-]*\Z")
STRETCH = re.compile(r"[A-Za-z0-9]+")
PARTS = re.compile(r"(?i:(?<![0-9a-z])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z]))|[A-Za-z0-9]+")
CASED = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MIN_CHARS, MAX_RATIO = 20, 2.2
RESULT = ("doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tiktoken encoding of a rank file; loaded once per worker."""
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    # fixed value: the pre-token pattern that goes with the vocabulary
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Digests, UUIDs, numbers and repeated short units."""
    return bool(STRETCH.sub(_no_digits, run).strip("=_-/+") == "" or UUID.match(run)
                or (len(run) in DIGEST_CHARS and DIGEST.match(run))
                or (run + run).find(run, 1) < min(len(run), MIN_CHARS))


def _no_digits(m: re.Match) -> str:
    return "" if m[0].isdigit() else m[0]


def n_tokens(text: str, path: str) -> int:
    return len(encoding(path).encode_ordinary(text))


def identifier(run: str, path: str, max_ratio: float) -> bool:
    """Words of letters, each one token or not below the ratio."""
    if not IDENTIFIER.match(run):
        return False
    for word in re.findall("[A-Za-z]+", run):
        if n_tokens(word, path) > 1 and len(word) < max_ratio * sum(n_tokens(x, path) for x in CASED.findall(word)):
            return False
    return True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, base: list, path: str, min_chars: int, max_ratio: float) -> list[tuple[int, int, int]]:
    def below(part: str) -> bool:
        return len(part) < max_ratio * n_tokens(part, path)

    starts = [b for b, _, _ in base]
    reach = list(accumulate((f for _, _, f in base), max))

    def inside_base(s: int, e: int) -> bool:
        """Some base span that starts no later ends no sooner."""
        n = bisect_right(starts, s)
        return n > 0 and reach[n - 1] >= e

    def random(s: int, e: int) -> bool:
        part = text[s:e]
        return (e - s >= min_chars and not known(part) and not inside_base(s, e)
                and below(part) and not identifier(part, path, max_ratio))

    out = []
    for m in RUN.finditer(text):
        s, e = m.span()
        run = m[0].strip("=_-/+")
        s += m[0].index(run) if run else 0
        e = s + len(run)
        if len(run) < min_chars or known(run) or inside_base(s, e):
            continue
        if random(s, e):
            out.append((s, 3, e))
            continue
        chain = None
        for part in PARTS.finditer(text, s, e):
            if "-" in part[0] or (len(part[0]) in DIGEST_CHARS and DIGEST.match(part[0])) or not below(part[0]):
                if chain and random(*chain):
                    out.append((chain[0], 3, chain[1]))
                chain = None
            else:
                chain = (chain[0] if chain else part.start(), part.end())
        if chain and random(*chain):
            out.append((chain[0], 3, chain[1]))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                 min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Rows as in ``RESULT``, one per row of ``docs``.  ``vocabulary`` must be
    a path that every executor has."""
    def scan(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                extra = random_spans(text, base, vocabulary, min_chars, max_ratio)
                n = [0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                rows.append((i, *n, len(extra), hashlib.sha256(joined(base).encode()).hexdigest(),
                             joined(sorted(base + extra))))
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.string()] * 2)],
                names=[x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(scan, RESULT)
