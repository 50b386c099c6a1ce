"""Token counts of a byte-level BPE vocabulary, by merging whole batches of pre-tokens at once.

A batch of texts is one array of code points. Classes of code points (letter, digit, blank, other) give the pre-tokens'
starts by array operations; each distinct pre-token of a batch is encoded once. The pre-tokens that a worker has not met
before are held as ragged arrays of symbols: in each round every sequence joins all occurrences of its own pair of lowest
rank, from left to right, and a sequence that has no more pair of the vocabulary leaves. What is left of a sequence is its
count. The class of a code point is what the library itself splits, asked once for each code point that occurs.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import byte_rows, small_batches, text_bytes, tidy

#: Classes of code points.
OTHER, LETTER, DIGIT, BLANK, UNASKED = 0, 1, 2, 3, 255
#: Bytes of text whose pre-tokens are told apart at once (a longer text is taken whole); bytes of known pre-tokens a worker keeps, with what Python needs for an entry.
CHUNK, CACHE_BYTES, ENTRY = 4 << 20, 48_000_000, 150
#: What may follow an apostrophe that begins a pre-token, by its last letter but for one or two letters.
SHORT, LONG = "stmd", ("re", "ve", "ll")
NEVER = np.iinfo(np.int32).max


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The visible letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Counter:
    """Counts with one vocabulary; lives in a worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, before = said["model"], said["pre_tokenizer"] or {}
        plain = {"unk_token", "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"}
        odd_special = any(t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space") or said["normalizer"] or odd_special or any(model.get(k) for k in plain):
            raise ValueError("only byte-level BPE vocabularies without normaliser, prefix and stripping tokens are counted")
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.joined = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)  # by rank
        self.byte_id = np.array([vocab[c] for c in _byte_letters()], dtype=np.int32)
        self.special = sorted((t["content"].encode() for t in said["added_tokens"]), key=len, reverse=True)
        self.find = re.compile(b"|".join(map(re.escape, self.special))) if self.special else None
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.kind = np.full(0x110000, UNASKED, dtype=np.uint8)
        self.known: dict[bytes, int] = dict.fromkeys(self.special, 1)
        self.held = 0
        self._ask(np.arange(128))

    def _ask(self, points: np.ndarray) -> None:
        """Classes of code points: what joins a letter is one, what joins a digit, what joins a sign."""
        if not len(points):
            return
        starts = {o[0] for _, o in self.split("".join(f"a{chr(c)}!0{chr(c)}!\n" for c in points.tolist()))}
        for i, c in enumerate(points.tolist()):
            at = 7 * i
            if c == 0x20:
                self.kind[c] = BLANK
            else:
                self.kind[c] = LETTER if at + 1 not in starts else DIGIT if at + 4 not in starts else OTHER if at + 2 not in starts else BLANK

    def pre_tokens(self, body: bytes, ends: np.ndarray) -> np.ndarray:
        """Byte offsets where pre-tokens start, of texts (UTF-8) that stand one after another and end at ``ends``."""
        data = np.frombuffer(body, dtype=np.uint8)
        hard = np.zeros(len(data) + 1, dtype=bool)
        hard[0] = True
        hard[ends] = True
        spans = [m.span() for m in self.find.finditer(body)] if self.find else []
        # an added token does not cross from one text into the next
        spans = [(a, b) for a, b in spans if not hard[a + 1 : b].any()]
        for a, b in spans:
            hard[[a, b]] = True
        if body.isascii():
            points, place = data, None
        else:
            points = np.frombuffer(body.decode().encode("utf-32-le"), dtype=np.uint32)
            place = np.flatnonzero((data & 0xC0) != 0x80)
            self._ask(np.unique(points[self.kind[points] == UNASKED]))
            hard = np.r_[hard[place], True]
        kind = self.kind[points]
        n = len(points)
        start = hard.copy()
        start[1:-1] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(start[:-1])
        stop = np.r_[runs[1:], n]
        of = kind[runs]
        begins = start[:-1]
        # blanks before anything else of the same text: the last one leads what follows if it is a space, else it stands alone
        lead = (of == BLANK) & ~hard[stop]
        begins[stop[lead & (stop - runs > 1)] - 1] = True
        space = lead & (points[stop - 1] == 0x20)
        begins[stop[space]] = False
        # an apostrophe that begins a pre-token takes one or two letters along
        mark = np.flatnonzero((of == OTHER) & (stop - runs == 1) & ~hard[stop])
        mark = mark[(points[runs[mark]] == 0x27) & begins[runs[mark]]]
        mark = mark[of[mark + 1] == LETTER] if len(mark) else mark
        if len(mark):
            at = stop[mark]
            first = points[at]
            second = np.where(stop[mark + 1] - at > 1, points[np.minimum(at + 1, n - 1)], 0)
            takes = np.isin(first, [ord(c) for c in SHORT]).astype(np.int64)
            for pair in LONG:
                takes = np.where((first == ord(pair[0])) & (second == ord(pair[1])), 2, takes)
            at, takes = at[takes > 0], takes[takes > 0]
            begins[at] = False
            begins[(at + takes)[at + takes < n]] = True
        found = np.flatnonzero(begins)
        if place is not None:
            found = place[found]
        if spans:  # nothing starts inside an added token
            a, b = np.array(spans).T
            within = np.searchsorted(a, found, side="right") - 1
            found = found[(within < 0) | (found == a[within]) | (found >= b[within])]
        return found

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NEVER)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each of some byte strings (none empty) has after all merges."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out = np.zeros(len(words), dtype=np.int64)
        symbol = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.arange(len(words))
        first = np.cumsum(size) - size
        last = np.zeros(len(symbol), dtype=bool)
        last[first + size - 1] = True
        rank = np.full(len(symbol), NEVER, dtype=np.int32)  # of the pair with the next symbol
        some = np.flatnonzero(~last)
        rank[some] = self._ranks(symbol[some], symbol[some + 1])
        while len(word):
            low = np.minimum.reduceat(rank, first)
            done = low == NEVER
            if done.any():
                out[word[done]] = size[done]
                stay = np.repeat(~done, size)
                symbol, rank, last = symbol[stay], rank[stay], last[stay]
                word, size, low = word[~done], size[~done], low[~done]
                if not len(word):
                    break
            hit = rank == np.repeat(low, size)
            # of occurrences that overlap (one symbol repeated) every other one counts, from the left
            at = np.flatnonzero(hit)
            chain = np.r_[False, (np.diff(at) == 1) & (rank[at[1:]] == rank[at[:-1]]) & ~last[at[:-1]]]
            if chain.any():
                nth = np.arange(len(at))
                nth -= np.maximum.accumulate(np.where(chain, 0, nth))
                at = at[nth % 2 == 0]
            symbol[at] = self.joined[rank[at]]
            last[at] = last[at + 1]
            stay = np.ones(len(symbol), dtype=bool)
            stay[at + 1] = False
            whose = np.repeat(np.arange(len(word)), size)
            size = size - np.bincount(whose[at], minlength=len(word))
            where = np.cumsum(stay) - 1
            symbol, rank, last = symbol[stay], rank[stay], last[stay]
            first = np.cumsum(size) - size
            fresh = where[at]
            begin = np.zeros(len(symbol), dtype=bool)
            begin[first] = True
            fresh = np.unique(np.r_[fresh, fresh[~begin[fresh]] - 1])
            rank[fresh] = NEVER
            fresh = fresh[~last[fresh]]
            rank[fresh] = self._ranks(symbol[fresh], symbol[fresh + 1])
        return out

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text (UTF-8)."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(sizes)
        out = np.zeros(len(texts), dtype=np.int64)
        body = b"".join(texts)
        if not body:
            return out
        starts = self.pre_tokens(body, ends)
        offsets = pa.py_buffer(np.r_[starts, len(body)].astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(body)]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        got = [self.known.get(w, 0) for w in words]
        new = [i for i, n in enumerate(got) if not n]
        if new:
            fresh = [words[i] for i in new]
            if self.held > CACHE_BYTES:  # those of this batch and the added tokens stay
                self.known = {w: n for w, n in zip(words, got, strict=True) if n} | dict.fromkeys(self.special, 1)
                self.held = sum(len(w) + ENTRY for w in self.known)
            for i, w, n in zip(new, fresh, self.merge(fresh).tolist(), strict=True):
                got[i] = self.known[w] = n
            self.held += sum(len(w) + ENTRY for w in fresh)
        each = np.array(got, dtype=np.int64)[coded.indices.to_numpy()]
        total = np.r_[0, np.cumsum(each)]
        edge = np.searchsorted(starts, np.r_[0, ends])
        return total[edge[1:]] - total[edge[:-1]]


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def _slices(texts: list[bytes]):
    """Ranges of texts of about ``CHUNK`` bytes, each text whole."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHUNK:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _count(path: str):
    @tidy
    def run(batches):
        c = counter(path)
        for part, texts in byte_rows(batches):
            found = [c.counts(texts[a:b]) for a, b in _slices(texts)]
            n = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    path: a tokenizers file with a byte-level BPE vocabulary. Its added tokens count as one wherever their strings stand;
    nothing is put in front or at the end, nothing is cut. Null and empty texts have no tokens; rows
    that repeat come as often as they are, null ids stay; a very long text is counted whole, in one task; an
    empty table gives none. Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    each = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(_count(path or tokenizer_path()), "doc_id long, n_bytes long, n_tokens long")
    return each.withColumn("over_limit", F.col("n_tokens") > limit)
