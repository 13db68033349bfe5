"""Column -> Column text functions (all JVM-side built-ins, no Python UDF).

X1 pretokenize, X2 byte_symbols, X3 byte_unsymbols, X11 word_count,
X12 char_count, X13 compression_pct / word_delta, X14 preview,
X17 rouge_tokens, F6 is_blank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Byte-level pre-tokenizer pattern (GPT-2 style), as the tokenizer library
# uses it.  ``(?U)`` makes Java's \s, \p{..} Unicode-aware.
PRETOKEN_PATTERN = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# Special tokens, in id order 0..4.
SPECIAL_TOKENS = ["<s>", "<pad>", "</s>", "<unk>", "<mask>"]
# Blank characters of Python's str.split()/str.strip(): Unicode White_Space
# plus the four separators U+001C..U+001F.
BLANK_CLASS = r"[\s\x1c-\x1f]"
# ---------------------------------------------------------------------------


def _byte_to_char(b: int) -> str:
    """Byte-level alphabet rule: printable bytes ('!'..'~', 0xA1..0xAC,
    0xAE..0xFF) keep their code point; the other 68 bytes are numbered from
    256 upwards in byte order."""
    keep = (33 <= b <= 126) or (161 <= b <= 172) or (174 <= b <= 255)
    if keep:
        return chr(b)
    others = [x for x in range(256)
              if not ((33 <= x <= 126) or (161 <= x <= 172) or (174 <= x <= 255))]
    return chr(256 + others.index(b))


#: 256 characters; character i is the symbol of byte i.
BYTE_ALPHABET = "".join(_byte_to_char(b) for b in range(256))
#: alphabet sorted by code point = base vocabulary order (ids 5..260)
SORTED_ALPHABET = "".join(sorted(BYTE_ALPHABET))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pretokenize(text) -> Column:
    """Array of pre-tokens (raw substrings) in text order."""
    return F.regexp_extract_all(_col(text), F.lit(PRETOKEN_PATTERN), F.lit(0))


#: the bytes whose symbol is another character, as ISO-8859-1 characters; byte
#: 0 goes apart, since ``translate`` cannot map to it
_MOVED = "".join(chr(b) for b in range(1, 256) if BYTE_ALPHABET[b] != chr(b))
_SYMBOLS = "".join(BYTE_ALPHABET[ord(c)] for c in _MOVED)
_LATIN = "ISO-8859-1"


def byte_symbols(text) -> Column:
    """Each UTF-8 byte of ``text`` as one printable character (string).
    The bytes are read as ISO-8859-1, one character each, and translated."""
    latin = F.decode(F.encode(_col(text), "UTF-8"), _LATIN)
    return F.replace(F.translate(latin, _MOVED, _SYMBOLS), F.lit("\0"), F.lit(BYTE_ALPHABET[0]))


def byte_symbol_array(text) -> Column:
    """X2 as an array of one-character strings (the symbols of BPE)."""
    symbols = byte_symbols(text)
    return F.when(symbols == "", F.array().cast("array<string>")).otherwise(F.split(symbols, ""))


def byte_unsymbols(symbols) -> Column:
    """Byte-level string back to text; invalid UTF-8 becomes U+FFFD."""
    latin = F.translate(F.replace(_col(symbols), F.lit(BYTE_ALPHABET[0]), F.lit("\0")), _SYMBOLS, _MOVED)
    return F.make_valid_utf8(F.encode(latin, _LATIN).cast("string"))


def word_count(text) -> Column:
    """X11: ``len(text.split())``; 0 for null or empty."""
    return F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def char_count(text) -> Column:
    """Number of code points; 0 for null."""
    return F.coalesce(F.length(_col(text)), F.lit(0))


def compression_pct(summary, text) -> Column:
    """``(1 - len(summary)/len(text)) * 100``; 0 if the text is empty.
    Negative when the summary is longer."""
    n_text = char_count(text)
    n_sum = char_count(summary)
    return F.when(n_text == 0, F.lit(0.0)).otherwise(
        (F.lit(1.0) - n_sum.cast("double") / n_text.cast("double")) * F.lit(100.0))


def word_delta(summary, text) -> Column:
    """Summary words minus source words."""
    return word_count(summary) - word_count(text)


def preview_always(text, width: int = 500) -> Column:
    """X14, first form: first ``width`` characters and always ``...``."""
    return F.concat(F.substring(F.coalesce(_col(text), F.lit("")), 1, width), F.lit("..."))


def preview_if_longer(text, width: int = 1000) -> Column:
    """X14, second form: ``...`` only when the text is longer than ``width``."""
    t = _col(text)
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("..."))).otherwise(t)


def is_blank(text) -> Column:
    """F6 predicate: null, empty or only blank characters."""
    return F.coalesce(_col(text), F.lit("")).rlike(r"(?U)\A[\s\x1c-\x1f]*\z")


def rouge_tokens(text, unicode: bool = False) -> Column:
    """The ROUGE default tokenizer (no stemming): lower-case, every run
    outside ``[a-z0-9]`` is a separator, empty pieces dropped.  Accented
    letters therefore split words.  ``unicode=True`` keeps letters and digits
    of every script instead."""
    sep = r"[^\p{L}\p{N}]+" if unicode else "[^a-z0-9]+"
    cleaned = F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), sep, " ")
    return F.filter(F.split(cleaned, " "), lambda x: x != F.lit(""))


def split_lines(text) -> Column:
    """Sentences for ROUGE-Lsum: split on newline, empty lines dropped."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), "\n"), lambda x: F.length(x) > 0)
