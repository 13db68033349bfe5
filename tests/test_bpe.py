"""BPE training, encoding and decoding against the ``tokenizers`` package
(used in tests only)."""

import json

import pytest
from pyspark.sql import functions as F

from precis.operators.bpe import read_tokenizer, require_specials, train_bpe, write_tokenizer
from precis.operators.encode import bpe_encode, decode_ids
from tests.conftest import SF_SMALL

tokenizers = pytest.importorskip("tokenizers")


def _library(texts, vocab_size):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers
    tok = Tokenizer(models.BPE())
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tok.decoder = decoders.ByteLevel()
    tr = trainers.BpeTrainer(vocab_size=vocab_size, special_tokens=["<s>", "<pad>", "</s>", "<unk>", "<mask>"],
                             initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False)
    tok.train_from_iterator([texts], trainer=tr)
    return tok


def _compare(model, tok):
    j = json.loads(tok.to_str())
    assert {t: i for i, t in enumerate(model.tokens)} == j["model"]["vocab"]
    lib = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
    assert [[model.tokens[l], model.tokens[r]] for l, r, _ in model.merges] == lib


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(F.col("text").alias("value"))


@pytest.fixture(scope="module")
def trained(spark, docs):
    texts = [r["value"] for r in docs.collect()]
    return train_bpe(docs, vocab_size=300), _library(texts, 300), texts


def test_documents_vocab_300_equal_library(trained):
    model, tok, _ = trained
    _compare(model, tok)


def test_documents_vocab_1000_equal_library(docs, trained):
    model = train_bpe(docs, vocab_size=1000)
    assert len(model.merges) == 739 and model.rounds < 150
    _compare(model, _library(trained[2], 1000))


def test_replaced_tables_are_deleted(spark, docs, tmp_path, monkeypatch):
    import os
    from precis.operators import bpe
    made = []
    plain = bpe.shared_path
    monkeypatch.setattr(bpe, "shared_path", lambda s, n: made.append(plain(s, n)) or made[-1])
    train_bpe(docs, vocab_size=290, rewrite_every=1)
    left = [p for p in made if os.path.exists(p.removeprefix("file:"))]
    assert len(made) > 5 and len(left) <= 1


def test_few_known_pairs_give_the_same_merges(spark, docs, trained):
    """The driver's list runs out many times and is made anew."""
    from precis.operators import bpe
    counted = []
    plain = bpe.known_pairs_of
    try:
        bpe.known_pairs_of = lambda state, most: counted.append(1) or plain(state, most)
        few = train_bpe(docs, vocab_size=300, known_pairs=8)
    finally:
        bpe.known_pairs_of = plain
    assert len(counted) > 3
    assert few.merges == trained[0].merges and few.tokens == trained[0].tokens


def test_runs_of_one_letter_equal_library(spark):
    """Pairs that overlap themselves, strings that may come about in several
    ways, and a list of known pairs that runs out until no pair is left."""
    import random
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("aaaab") for _ in range(rng.randint(1, 30))) for _ in range(10)) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    model = train_bpe(df, vocab_size=500, known_pairs=300)
    _compare(model, _library(texts, 500))


def test_block_merges_against_plain_lists():
    """A pass over a block equals merging every word by hand."""
    import random
    from collections import Counter

    import numpy as np

    from precis.operators import bpe_blocks as bb
    rng = random.Random(8)
    for _ in range(200):
        words = [[rng.randrange(4) for _ in range(rng.randint(2, 9))] for _ in range(12)]
        counts = [rng.randint(1, 5) for _ in words]
        merges = rng.choice([{(0, 0): 7}, {(0, 1): 7, (2, 3): 8}, {(1, 1): 9, (2, 2): 7, (3, 0): 8}])
        ids = np.array([x for w in words for x in [*w, -1]], np.int32)
        keys = sorted((bb.pack(a, b), n) for (a, b), n in merges.items())
        step = bb.Step(np.array([k for k, _ in keys]), np.array([n for _, n in keys], np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 10)
        out, left, changed, change = bb.merge(ids, np.array(counts), step, bb._tables(step.keys, 10))
        want, delta = [], Counter()
        for w, n in zip(words, counts):
            new, k = [], 0
            while k < len(w):
                if k + 1 < len(w) and (w[k], w[k + 1]) in merges:
                    new.append(merges[w[k], w[k + 1]])
                    k += 2
                else:
                    new.append(w[k])
                    k += 1
            for p in zip(w, w[1:]):
                delta[bb.pack(*p)] -= n
            for p in zip(new, new[1:]):
                delta[bb.pack(*p)] += n
            if len(new) > 1:
                want.append((new, n))
        got = [list(map(int, x.split())) for x in " ".join(map(str, out.tolist())).split("-1") if x.strip()]
        assert got == [w for w, _ in want] and left.tolist() == [n for _, n in want]
        assert dict(zip(changed.tolist(), change.tolist())) == {k: v for k, v in delta.items() if v}


def test_long_pretokens_equal_library_and_are_quick(spark, trained):
    import random
    import time
    from precis.operators.encode import _Encoder
    model, tok, texts = trained
    letters = [c for t in texts for c in t if c.isalpha()][:40_000]
    random.Random(3).shuffle(letters)
    enc = _Encoder(model.merges)
    for piece in ("".join(letters), "a" * 5001, "ab" * 3000, "".join(texts[0].split())):
        assert list(enc.word(piece)) == tok.encode(piece).ids or not piece.isalpha()
    enc = _Encoder(model.merges)
    start = time.time()
    enc.word("".join(letters))
    assert time.time() - start < 0.6


def test_encoders_and_broadcasts_are_kept_once_per_model(spark, trained):
    from precis.operators import encode
    model = trained[0]
    before = len(encode._BROADCASTS)
    df = spark.createDataFrame([("un texte",)], "text string")
    for _ in range(3):
        bpe_encode(df, model, "text").collect()
    assert len(encode._BROADCASTS) <= before + 1


def test_tokenizer_file_is_loaded_by_the_library_and_back(spark, trained, tmp_path):
    from precis.operators.bpe_file import read_tokenizer_file, write_tokenizer_file
    model, tok, texts = trained
    path = str(tmp_path / "tokenizer.json")
    write_tokenizer_file(model, spark, path)
    loaded = tokenizers.Tokenizer.from_file(path)
    for t in texts[:30] + ["Voici <s> un test </s>", "émoji 😀", ""]:
        ids = tok.encode(t).ids
        assert loaded.encode(t).ids == ids and loaded.decode(ids) == tok.decode(ids)
    back = read_tokenizer_file(spark, path)
    assert back.tokens == model.tokens and back.merges == model.merges
    tok.save(str(tmp_path / "library.json"))
    theirs = read_tokenizer_file(spark, str(tmp_path / "library.json"))
    assert theirs.tokens == model.tokens and theirs.merges == model.merges


def test_other_tokenizer_files_are_refused(spark, tmp_path):
    from precis.operators.bpe_file import model_of_json
    with pytest.raises(ValueError, match="not a byte-level BPE"):
        model_of_json('{"model": {"type": "Unigram"}, "pre_tokenizer": null}')
    with pytest.raises(ValueError, match="byte symbols"):
        model_of_json('{"model": {"type": "BPE", "vocab": {"a": 0}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel"}}')


@pytest.mark.parametrize("texts,size", [
    (["aaaa aaaa abab aaa", "abab aaa aaaa"], 300),
    (["aaa aaa aaa", "ab ab ab ba ba"], 280),
    (["l'été à Paris <s> xx", "été été étés"], 290),
])
def test_hand_made_words_equal_library(spark, texts, size):
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    model = train_bpe(df, vocab_size=size)
    _compare(model, _library(texts, size))


def test_batched_equals_one_by_one(spark, docs):
    a = train_bpe(docs, vocab_size=285, batched=True)
    b = train_bpe(docs, vocab_size=285, batched=False)
    assert a.merges == b.merges and a.tokens == b.tokens
    assert a.rounds <= b.rounds


def test_encode_equals_library_and_round_trips(spark, trained):
    model, tok, texts = trained
    sample = texts[:40] + ["Voici <s> un test </s>", "émoji 😀 ok", "  deux  blancs"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sample)], "id long, text string")
    enc = bpe_encode(df, model, "text").select("id", "ids", decode_ids("ids", model).alias("back"))
    got = {r["id"]: (r["ids"], r["back"]) for r in enc.collect()}
    for i, t in enumerate(sample):
        assert got[i][0] == tok.encode(t).ids, t[:40]
        if "<" not in t:
            assert got[i][1] == t
    assert got[len(sample) - 3][0].count(0) == 1  # literal <s> is special id 0


def test_tokenizer_tables_round_trip(spark, trained, tmp_path):
    model, _, _ = trained
    write_tokenizer(model, spark, str(tmp_path / "tok"))
    back = read_tokenizer(spark, str(tmp_path / "tok"))
    assert back.tokens == model.tokens and back.merges == model.merges
    assert require_specials(back)["<mask>"] == 4


def test_missing_special_named(trained):
    from precis.operators.bpe import BpeModel
    model, _, _ = trained
    broken = BpeModel(["<s>", "x", "</s>"], [])
    with pytest.raises(ValueError, match="<pad>, <unk>, <mask>"):
        require_specials(broken)
    assert require_specials(model)["<s>"] == 0


def test_decode_encode_random_texts(spark, trained):
    """decode(encode(x)) == x for texts without special literals."""
    import random
    model, tok, _ = trained
    rng = random.Random(11)
    alphabet = "abcdefghijklmnopqrstuvwxyz éèàçÉ'.,;:!?0123456789\n\t😀中文" + "  "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = bpe_encode(df, model, "text").select("id", "ids", decode_ids("ids", model).alias("back")).collect()
    for r in out:
        assert r["back"] == texts[r["id"]]
        assert r["ids"] == tok.encode(texts[r["id"]]).ids


def test_byte_symbols_of_every_byte(spark):
    from precis.functions import text as tx
    rows = [(k, "".join(chr(c) for c in range(k * 97, k * 97 + 97) if not 0xD800 <= c < 0xE000)) for k in range(30)]
    rows += [(100, "\x00a\x00"), (101, ""), (102, "😀é\x7f\xad")]
    df = spark.createDataFrame(rows, "k int, t string").select(
        "k", "t", tx.byte_symbols("t").alias("s"), tx.byte_symbol_array("t").alias("a"),
        tx.byte_unsymbols(tx.byte_symbols("t")).alias("back"))
    for r in df.collect():
        want = "".join(tx.BYTE_ALPHABET[b] for b in r["t"].encode())
        assert r["s"] == want and r["a"] == list(want) and r["back"] == r["t"]


def test_pairs_are_taken_from_distinct_words_only(spark):
    """No filter on the symbols of a word reaches the rows that are counted to words."""
    from precis.operators.bpe import pair_counts, word_table
    from precis.operators.corpus import pretoken_counts
    corpus = spark.createDataFrame([("aaa b aaa",), ("",), (None,), ("é",)], "value string")
    found = pair_counts(word_table(pretoken_counts(corpus)))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["c"] for r in found.collect()) == [1, 1, 1, 4]


def test_symbols_of_words_are_looked_up_by_byte(spark):
    from precis.operators import bpe_blocks as bb
    from precis.operators.bpe import symbol_ids
    words = spark.createDataFrame([(k + 1, w) for k, w in enumerate(["a", " é", "\0\n", "日本", "", "zz" * 40])], "n long, pretoken string")
    got = [r for r in bb.blocks(words.coalesce(1)).collect()]
    ids, counts = (b"".join(bytes(r[c]) for r in got) for c in ("ids", "counts"))
    import numpy as np
    words_of, held = [], []
    for x in np.frombuffer(ids, np.int32).tolist():
        if x == -1:
            words_of.append(held)
            held = []
        else:
            held.append(x)
    assert np.frombuffer(counts, np.int64).tolist() == [1, 2, 3, 4, 5, 6]
    assert words_of == [r["i"] for r in words.orderBy("n").select(symbol_ids(F.col("pretoken")).alias("i")).collect()]
