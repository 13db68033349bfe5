"""The tokenizer as one JSON file in the format of the ``tokenizers``
library, which loads what is written here and whose files are read here.

The file's size is bounded by the vocabulary.  It is written and read through
the Hadoop file system of its path, so it may lie in any store Spark knows.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPECIAL_TOKENS
from .bpe import BpeModel, base_tokens

#: Byte-level splitting without a space put before the text.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: The library's own defaults when it decodes and splits offsets.
_DECODER = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}


def tokenizer_json(model: BpeModel) -> str:
    special = [{"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
               for i, t in enumerate(SPECIAL_TOKENS)]
    bpe = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
           "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
           "vocab": {t: i for i, t in enumerate(model.tokens)},
           "merges": [[model.tokens[l], model.tokens[r]] for l, r, _ in model.merges]}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": special, "normalizer": None,
                       "pre_tokenizer": _BYTE_LEVEL, "post_processor": _DECODER, "decoder": _DECODER, "model": bpe},
                      ensure_ascii=False, indent=2)


def model_of_json(text: str) -> BpeModel:
    """The model of a library file.  ValueError if it is no byte-level BPE with
    the special tokens and byte symbols in their usual places: encoding counts
    on these ids."""
    found = json.loads(text)
    bpe, split = found.get("model") or {}, found.get("pre_tokenizer") or {}
    if bpe.get("type") != "BPE" or split.get("type") != "ByteLevel":
        raise ValueError(f"not a byte-level BPE tokenizer: model {bpe.get('type')}, pre-tokenizer {split.get('type')}")
    ids = dict(bpe["vocab"])
    ids.update({t["content"]: t["id"] for t in found.get("added_tokens", [])})
    tokens = [t for t, _ in sorted(ids.items(), key=lambda x: x[1])]
    base = base_tokens()
    if sorted(ids.values()) != list(range(len(ids))) or tokens[:len(base)] != base:
        raise ValueError(f"the first {len(base)} ids must be {', '.join(SPECIAL_TOKENS)} and the byte symbols, and no id may be missing")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
    return BpeModel(tokens, [(ids[a], ids[b], ids[a + b]) for a, b in pairs])


def write_tokenizer_file(model: BpeModel, spark: SparkSession, path: str) -> None:
    """One JSON file at ``path``; a file there is replaced."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(tokenizer_json(model).encode())
    finally:
        out.close()


def read_tokenizer_file(spark: SparkSession, path: str) -> BpeModel:
    row = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("text")).first()
    return model_of_json(row["text"])
