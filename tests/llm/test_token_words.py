"""Words of the token files: many go through the library in one text, and their ids are those that each has alone."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from corvane.llm import token_files


class Counted:
    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, add_special_tokens):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, add_special_tokens=add_special_tokens)


def test_words_are_encoded_together():
    tokens = token_files.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    draw = random.Random(7)
    kinds = [lambda: draw.randrange(33, 127), lambda: draw.randrange(0x80, 0x600), lambda: draw.randrange(0x1100, 0x1200), lambda: draw.choice([1, 0x27, 0x73, 0xA0, 0x301, 0x2028, 0x1F600])]
    words = {"".join(chr(draw.choice(kinds)()) for _ in range(draw.randrange(1, 9))) for _ in range(5000)}
    words = sorted(words | {"\x01", "\x01\x01", "a\x01b", "<|endoftext|>", "x<|startoftext|>", "'s", "<|endof", "text|>"})
    tokens.tokenizer = Counted(tokens.tokenizer)
    tokens._learn(words)
    odd = sum("\x01" in w for w in words)
    assert tokens.tokenizer.texts <= odd + len(words) // 32
    alone = tokens.tokenizer.inner.encode_batch_fast(words, add_special_tokens=False)
    for w, e in zip(words, alone, strict=True):
        assert tokens.known[w] == b"".join(i.to_bytes(2, "little") for i in e.ids)


def test_words_without_a_word_between():
    """A tokenizer that does not keep the word between apart gets each word by itself."""
    tokens = token_files.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    words = ["one", "two\x01", "three."]
    tokens._learn(words)
    joined, tokens.between, tokens.known = tokens.known, None, {}
    tokens._learn(words)
    assert tokens.known == joined


def test_easy_words_are_known_by_their_runs():
    """Words of ASCII and Latin letters share the runs that they are made of; ids are those of the whole text."""
    tokens = token_files.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    whole, tokens.bare = tokens.tokenizer, Counted(tokens.bare)
    chars = [chr(c) for c in [*range(1, 0x250), 0x301, 0x3A3, 0x2028, 0x1F600]]
    texts = [t for c in chars for t in (c, f"a{c}b", f"É{c}{c} 1{c}", f"x.{c}9 {c}É")]
    texts += ["", " \n", "<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|> <| end", "it's IT'LL 'tis", "Ÿ-ÑÑ(42)½ éA İx ſ"]
    n, ids = tokens.ids(pa.array([t.encode() for t in texts]), 2)
    want = [[*e.ids, 2] for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]

    tokens.known, tokens.bare.texts, tokens.tokenizer = {}, 0, None  # none of these needs the whole tokenizer
    tokens.ids(pa.array([f"{a}{w}{b}".encode() for w in ("word", "Word", "WORD") for a in ("", "(") for b in ("", ",", ".", "!!")]), 2)
    assert set(tokens.known) == {"word", "(", ",", ".", "!!"} and tokens.bare.texts == 1


def test_other_tokenizers_get_whole_words(tmp_path):
    """A tokenizer with other cuts is given the words as they are."""
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    other.save(str(tmp_path / "other.json"))
    tokens = token_files.WordTokens(str(tmp_path / "other.json"))
    assert tokens.bare is None
    n, ids = tokens.ids(pa.array([b"One, two3 (one)"]), 2)
    assert ids.tolist() == [*other.encode("One, two3 (one)").ids, 2] and n.tolist() == [len(ids)]


def test_spelled_ids_cost_what_their_frequency_asks():
    """Ids that nothing predicts take little more than their entropy, from the first block on; odd frequencies come back too."""
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.3, 400_000), 3000)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    data = token_files.pack(np.arange(1), np.array([len(ids)]), ids)
    assert (token_files.unpack(data)[2] == ids).all()
    assert 8 * len(data) < 1.1 * len(ids) * -(share * np.log2(share)).sum()
    for ids in (np.full(9000, 7), np.full(1, 65535), rng.permutation(65536), np.r_[np.zeros(70_000, dtype=int), np.arange(65536)], np.tile(np.arange(300), 40)):
        data = token_files.pack(np.arange(1), np.array([len(ids)]), ids)
        assert (token_files.unpack(data)[2] == ids).all()


def test_ranges_hold_several_files(spark, monkeypatch):
    """A range is a few files, as a task has fixed costs; rows and offsets do not depend on the ranges."""
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 20) AS text")
    want = sorted(map(tuple, token_files.digest(docs).collect()))
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    monkeypatch.setattr(token_files, "FILE_BYTES", size // 200)
    folder = token_files.write_files(docs)
    ranges = spark.read.parquet(folder).selectExpr("nth >> 32 AS r").distinct().count()
    assert 1 < ranges <= max(2 * spark.sparkContext.defaultParallelism, 51)
    assert sorted(map(tuple, token_files.read_files(spark, folder).collect())) == want
