"""Token-id files with an adaptive context-mixing range coder.

A file holds the ids of consecutive documents: a header with the documents' ids and lengths and with the frequencies of
the ids (order 0), then blocks of ``BLOCK`` ids. Every block is coded on its own, starting from fresh statistics, and has a
CRC-32 of its ids. In a block each id is compared with two predictions: the id that last
followed the two ids before it (order 2) and the id that last followed the one before it (order
1). Which of them holds, if any, is one decision of three outcomes. Its probabilities are a logistic mix of three
estimates: by how far order 2 is trusted, by how far order 1 is, and by how frequent order 0 finds the predicted
id; the weights are learned in the block. An id that neither foresees is spelled with the
frequencies of order 0. Decision and spelling are one step of the range coder. Counts change with every id; the tables
made of them are renewed at fixed places. All arithmetic is on integers, so files read alike on every machine.

Blocks are independent, so all blocks of a file are coded side by side, one position of every block per step,
with numpy. Encoder and decoder run the same model code and differ only in the coder.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from bisect import bisect_left
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import fresh_path, small_batches, text_bytes, tidy

MAGIC, BLOCK, SLOTS, END_ID = b"CVT3", 4096, 2048, 2
#: Files of a range, about, at most; bytes of text that go to one file, about; bytes of words that a worker remembers, with
#: what Python needs for an entry; words encoded in one call, as what the library holds for a call grows with their number.
RANGES_BITS, RANGE_FILES = 12, 4
FILE_BYTES, CACHE_BYTES, ENTRY, LEARN = 12_000_000, 160_000_000, 180, 8192
#: Words of one text that is encoded, with a word between them whose only id tells them apart.
JOINED, BETWEEN = 64, "\x01"
#: A state's range stays at 2**30 or more and is cut into 2**28 units: 12 bits of decision, 16 of an id's frequency.
_LEAST_BITS, _TOTAL, _WORD = 30, 28, 32
_LEAST, _REST = 1 << 30, (1 << 30) - 1


@lru_cache(1)
def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """stretch: 12-bit probability -> logit in units of 1/256; squash: its inverse, by logit + 2048."""
    squash = np.empty(4096, dtype=np.int64)
    points = [round(4096 / (1 + 2.718281828459045 ** (-(x / 256)))) for x in range(-2048, 2048)]
    squash[:] = np.clip(points, 16, 4080)
    stretch = np.searchsorted(squash, np.arange(4096), side="left") - 2048
    return np.clip(stretch, -2047, 2047).astype(np.int32), squash.astype(np.int32)


class Encoder:
    """Range coder of many blocks at once: 62-bit states, 32-bit words; a word's 33rd bit is a carry, settled at the end."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, dtype=np.int64)
        self.range = np.full(lanes, (1 << 62) - 1, dtype=np.int64)
        self.lanes, self.words = [], []

    def _put(self, lane: np.ndarray) -> None:
        low = self.low.take(lane)
        self.lanes.append(lane)
        self.words.append(low >> _LEAST_BITS)
        low &= _REST
        low <<= _WORD
        self.low[lane] = low

    def narrow(self, start: np.ndarray, size: np.ndarray) -> None:
        """A size is 1 unit at least and a unit 4, so one word makes a range large enough again."""
        r = self.range
        r >>= _TOTAL
        start *= r
        self.low += start
        r *= size
        lane = (r < _LEAST).nonzero()[0]
        if len(lane):
            self._put(lane)
            r[lane] = r.take(lane) << _WORD

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        if not len(every):
            return []
        for _ in range(2):
            self._put(every)
        lane = np.concatenate(self.lanes)
        lane = lane.astype(np.uint16 if len(every) <= 1 << 16 else np.uint32)
        words = np.concatenate(self.words)[np.argsort(lane, kind="stable")]
        at = np.flatnonzero(words >> 32)
        while len(at):  # a block's first word has no carry, so none goes from block to block
            words[at] &= 0xFFFFFFFF
            words[at - 1] += 1
            at = at[words[at - 1] >> 32 > 0] - 1
        ends = np.cumsum(np.bincount(lane, minlength=len(every))).tolist()
        data = words.astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]


class Decoder:
    def __init__(self, blobs: list[bytes]):
        longest = max(map(len, blobs)) // 4 + 4
        words = np.zeros((len(blobs), longest), dtype=np.int64)
        for i, b in enumerate(blobs):
            words[i, : len(b) // 4] = np.frombuffer(b[: len(b) // 4 * 4], dtype="<u4")
        self.ahead = words[:, 0] << 30 | words[:, 1] >> 2  # how far the code lies above the low end
        # a state holds 62 bits, so the words to come are cut two bits later
        self.words = ((words[:, 1:-1] & 3) << 30 | words[:, 2:] >> 2).astype(np.uint32).reshape(-1)
        self.range = np.full(len(blobs), (1 << 62) - 1, dtype=np.int64)
        self.at = np.arange(len(blobs)) * (longest - 2)

    def place(self) -> np.ndarray:
        """Where the code lies in the unit of 2**28."""
        self.range >>= _TOTAL
        place = self.ahead // self.range
        return np.minimum(place, (1 << _TOTAL) - 1, out=place)

    def narrow(self, start: np.ndarray, size: np.ndarray) -> None:
        r = self.range
        start *= r
        self.ahead -= start
        r *= size
        lane = (r < _LEAST).nonzero()[0]
        if len(lane):
            at = self.at.take(lane)
            ahead = self.ahead.take(lane)
            ahead <<= _WORD
            ahead |= self.words.take(at, mode="clip")
            self.ahead[lane] = ahead
            at += 1
            self.at[lane] = at
            r[lane] = r.take(lane) << _WORD


#: Trust levels of a prediction, classes of order-0 evidence, contexts of a decision.
TRUST, EVIDENCE = 4, 4
CONTEXTS = TRUST * TRUST * EVIDENCE * 2
#: Axes that are summed up for the hit rates by order-2 trust, by order-1 trust and by order-0 evidence.
_OTHERS = ((1, 2), (0, 2), (0, 1))
FORESEEN = np.int32(1 << 16)


class Decisions:
    """Which prediction holds: (order 2, order 1, neither), as cumulative 12-bit probabilities in each context.

    Three logits, of the hit rates by order-2 trust, by order-1 trust and by order-0 evidence, are mixed
    with weights that each block learns. Outcomes are noted with every id, counts and mixed tables are renewed at ``_due`` steps.
    Blocks are the last axis of all tables, so that sums over contexts run along them.
    """

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.seen = np.zeros(3 * CONTEXTS * lanes, dtype=np.int32)
        self.notes: list[np.ndarray] = []
        self.weights = np.full((2, 3, lanes), 26_000, dtype=np.int32)
        self.parts = np.zeros(3 * CONTEXTS * lanes, dtype=np.int32)
        self.renew()

    def _mix(self, hits: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """hits, n: (trust 2, trust 1, evidence, same, lanes). The mixed 12-bit probability of a hit."""
        stretch, squash = _logistic()
        logits = []
        for axes in _OTHERS:
            h, k = hits.sum(axis=axes, keepdims=True, dtype=np.int32), n.sum(axis=axes, keepdims=True, dtype=np.int32)
            logits.append(stretch[np.minimum(((2 * h + 1) * 4096) // (2 * k + 4), 4095)])

        def mixed():
            total = weights[0] * logits[0] + weights[1] * logits[1] + weights[2] * logits[2]
            total >>= 16
            total += 2048
            return squash.take(total, mode="clip")

        miss = hits * 4096 - n * mixed()
        every = np.maximum(n.sum(axis=(0, 1, 2, 3)), 1)
        for i, (s, axes) in enumerate(zip(logits, _OTHERS, strict=True)):
            weights[i] += ((miss.sum(axis=axes, keepdims=True) * s).sum(axis=(0, 1, 2, 3)) // every) >> 5
        np.clip(weights, -65_536, 131_072, out=weights)
        return np.clip(mixed(), 64, 4032)

    def renew(self) -> None:
        if self.notes:
            self.seen += np.bincount(np.concatenate(self.notes), minlength=len(self.seen)).astype(np.int32)
            self.notes = []
        by = self.seen.reshape(3, TRUST, TRUST, EVIDENCE, 2, self.lanes)
        other = by[1] + by[2]
        second = self._mix(by[0], by[0] + other, self.weights[0])
        first = self._mix(by[1], other, self.weights[1])
        until = second + ((4096 - second) * first >> 12)
        until[:, :, :, 1] = second[:, :, :, 1]  # equal predictions fail together
        parts = self.parts.reshape(3, *second.shape)  # start << 16 | size, by outcome
        parts[0], parts[1], parts[2] = second, second << 16 | until - second, until << 16 | 4096 - until


class Spelling:
    """Order 0: the share of each id in the file, out of 2**16 and at least 1 for an id that occurs."""

    def __init__(self, known: np.ndarray, size: np.ndarray):
        if int(size.sum()) != 1 << 16 or len(known) != len(size):
            raise ValueError("frequencies are damaged")
        shares = np.zeros(1 << 16, dtype=np.int64)
        shares[known] = size
        # start << 17 | share of each id; last, what stands for an id that was foreseen
        self.parts = np.r_[np.cumsum(shares) - shares << 17 | shares, 1 << 16]
        self.of = np.repeat(np.arange(1 << 16, dtype=np.int32), shares)
        self.evidence = 2 * np.digitize(shares, [16, 64, 256]).astype(np.int32)

    @staticmethod
    def count(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids that occur, their shares)."""
        counts = np.bincount(ids, minlength=1)
        known = np.flatnonzero(counts)
        ends = np.cumsum(counts[known]) * ((1 << 16) - len(known)) // len(ids) + np.arange(1, len(known) + 1)
        return known, np.diff(ends, prepend=0)


class Predictions:
    """What followed the last two ids and the last id, in a table for each order of slots by blocks: how often it was right since << 16 | id.

    Frequent slots of all blocks lie side by side.
    """

    def __init__(self, lanes: int):
        self.table = np.zeros(2 * SLOTS * lanes, dtype=np.int32)
        self.lanes = lanes
        self.first = np.arange(lanes) + np.array([[0], [SLOTS * lanes]])
        self.slot = np.zeros((2, lanes), dtype=np.int64)
        self.one = self.two = np.zeros(lanes, dtype=np.int64)

    def next(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, trusts) of order 2 and of order 1."""
        slot = self.slot
        np.multiply(self.one, 40503, out=slot[1])
        np.add(slot[1], self.two * 30011, out=slot[0])
        slot >>= 5
        slot &= SLOTS - 1
        slot *= self.lanes
        slot += self.first
        self.held = self.table.take(slot)
        trust = self.held >> 16
        return self.held & 0xFFFF, np.minimum(trust, TRUST - 1, out=trust)

    def add(self, got: np.ndarray, hit: np.ndarray) -> None:
        """A right prediction is trusted more; in place of a wrong one comes the id."""
        self.held += 1 << 16
        self.table[self.slot] = np.where(hit, self.held, got)
        self.two, self.one = self.one, got.astype(np.int64)


def _due(t: int) -> bool:
    """Tables are renewed often at first, then every 1024 ids."""
    return t % 1024 == 0 or t in (8, 16, 32, 64, 128, 256, 512)


def _run(coder, lanes: int, steps: int, spelling: Spelling, ids: np.ndarray | None) -> np.ndarray:
    """Codes (or, with ids None, decodes) blocks of so many steps side by side; ids are (steps, lanes)."""
    out = np.zeros((steps, lanes), dtype=np.uint16) if ids is None else ids
    predictions, decisions = Predictions(lanes), Decisions(lanes)
    every, outcome = np.arange(lanes), CONTEXTS * lanes
    for t in range(steps):
        if t and _due(t):
            decisions.renew()
        guess, trust = predictions.next()
        context = trust[0] * TRUST
        context += trust[1]
        context *= EVIDENCE * 2
        context += spelling.evidence.take(guess[0].astype(np.int64))
        context += (guess[0] == guess[1]).astype(np.int32)
        where = context.astype(np.int64)
        where *= lanes
        where += every
        if ids is None:
            place = coder.place()
            by2 = place >> 16 < decisions.parts.take(where)
            before = decisions.parts.take(where + 2 * outcome).astype(np.int64)
            share = before & 0xFFFF
            before -= share  # its place is 16 bits up, where the unit of a decision lies
            by1 = place < before
            place -= before
            place //= share
            got = np.where(by2, guess[0], np.where(by1, guess[1], spelling.of.take(place, mode="clip")))
            out[t] = got
        else:
            got = out[t].astype(np.int32)
        hit = guess == got
        miss = ~hit[0]
        spelled = miss & ~hit[1]
        kind = (miss.view(np.int8) + spelled.view(np.int8)).astype(np.int64)
        kind *= outcome
        where += kind
        decisions.notes.append(where)
        part = decisions.parts.take(where).astype(np.int64)
        word = spelling.parts.take(np.where(spelled, got, FORESEEN).astype(np.int64))
        share = part & 0xFFFF
        part -= share
        start = word >> 17
        start *= share
        start += part
        word &= 0x1FFFF
        word *= share
        coder.narrow(start, word)
        predictions.add(got, hit)
    return out


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: documents in order, ``counts`` ids each, ``ids`` (below 65536) of all of them."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids must be below 65536")
    n = -(-len(ids) // BLOCK)
    lengths = np.full(n, BLOCK, dtype=np.int64)
    header, sums, blobs = np.asarray(doc_ids, "<i8").tobytes() + np.asarray(counts, "<i8").tobytes(), [], []
    if n:
        lengths[-1] = len(ids) - BLOCK * (n - 1)
        table = np.full((n, int(lengths[0])), ids[-1], dtype=np.uint16)  # a short block goes on with its last id
        table.reshape(-1)[: len(ids)] = ids
        sums = [zlib.crc32(row[:k].astype("<u4").tobytes()) for row, k in zip(table, lengths, strict=True)]
        known, size = Spelling.count(ids)
        header += np.diff(known, prepend=0).astype("<u2").tobytes() + (size - 1).astype("<u2").tobytes()
        coder = Encoder(n)
        _run(coder, n, int(lengths[0]), Spelling(known, size), np.ascontiguousarray(table.T))
        blobs = coder.finish()
    header = zlib.compress(header)
    index = b"".join(struct.pack("<III", int(k), len(b), s) for k, b, s in zip(lengths, blobs, sums, strict=True))
    return MAGIC + struct.pack("<QQI", len(doc_ids), len(header), n) + header + index + b"".join(blobs)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a file; ValueError if a checksum does not hold."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, size, n = struct.unpack_from("<QQI", data, 4)
    at = 24
    head = zlib.decompress(data[at : at + size])
    doc_ids, counts = np.frombuffer(head, dtype="<i8", count=2 * docs).reshape(2, docs)
    at += size
    index = [struct.unpack_from("<III", data, at + 12 * i) for i in range(n)]
    at += 12 * n
    blobs = []
    for _, length, _ in index:
        blobs.append(data[at : at + length])
        at += length
    if not n:
        return doc_ids, counts, np.empty(0, dtype=np.uint16)
    known, size = np.frombuffer(head, dtype="<u2", offset=16 * docs).reshape(2, -1).astype(np.int64)
    lengths = np.array([x[0] for x in index], dtype=np.int64)
    table = np.ascontiguousarray(_run(Decoder(blobs), n, int(lengths[0]), Spelling(np.cumsum(known), size + 1), None).T)
    for i, (k, _, s) in enumerate(index):
        if zlib.crc32(table[i, :k].astype("<u4").tobytes()) != s:
            raise ValueError(f"block {i} is damaged")
    # all blocks but the last one are full, whatever BLOCK the writer had
    return doc_ids, counts, table.reshape(-1)[: int(lengths.sum())]


#: Tokenizers of this normalizer and these first cuts give the lower-case words below the ids of their runs, one after another.
_PLAIN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
)
#: Words of ASCII and of Latin letters that are composed and have one letter for lower case, without the apostrophe
#: and what special tokens begin with; the kinds of their bytes are other, letter, digit.
_EASY, _SPECIAL = r"^[!-&(-~À-ÖØ-öø-įı-ſ]+$", "<|"
_KIND = np.ones(256, dtype=np.uint8)
_KIND[:128] = [1 if chr(x).isalpha() else 2 if chr(x).isdigit() else 0 for x in range(128)]


def _runs(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(runs of letters, single digits and runs of others of lower-case easy words, where the runs of each word begin and the last ends)."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    kind, at = _KIND.take(data), offsets - offsets[0]
    new = np.ones(len(data) + 1, dtype=bool)
    new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    new[at] = True
    begins = np.flatnonzero(new).astype(np.int32)
    runs = pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(data))
    return runs, np.searchsorted(begins, at)


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


class WordTokens:
    """Ids of texts by a tokenizer that never joins across blanks: each distinct word, or run of an easy word, is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.size = 0
        self.between = self._between(self.tokenizer)
        config = json.loads(self.tokenizer.to_str())
        cuts = config["pre_tokenizer"] or {}
        #: The same vocabulary for runs, which need no normalizer and no further cut; None if this tokenizer is of another kind.
        self.bare = None
        if self.between is not None and (config["normalizer"], *cuts.get("pretokenizers", [])) == _PLAIN and config["post_processor"] is None:
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            if self._between(self.bare) != self.between:
                self.bare = None

    @staticmethod
    def _encode(tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _between(self, tokenizer) -> int | None:
        """The id of the word between words; None if this tokenizer does not keep it apart, then words are encoded one by one."""
        alone, x, joined = self._encode(tokenizer, [BETWEEN, "x", f"x {BETWEEN} x"])
        return alone[0] if len(alone) == 1 and joined == x + alone + x else None

    def _learn(self, words: list[str], bare: bool = False) -> None:
        """Calls of the library cost more than most words, so some words make one text; where its pieces are not as many as they, they are encoded one by one."""
        single = [w for w in words if BETWEEN in w] if self.between is not None else words
        rest = [w for w in words if BETWEEN not in w] if self.between is not None else []
        tokenizer = self.bare if bare else self.tokenizer
        for at in range(0, len(rest), LEARN):
            groups = [rest[k : k + JOINED] for k in range(at, min(at + LEARN, len(rest)), JOINED)]
            for some, ids in zip(groups, self._encode(tokenizer, [f" {BETWEEN} ".join(g) for g in groups]), strict=True):
                found = np.array(ids, dtype="<u2")
                cuts = 2 * np.flatnonzero(found == self.between)
                if len(cuts) != len(some) - 1:
                    single = single + some
                    continue
                data, cuts = found.tobytes(), cuts.tolist()
                for w, a, b in zip(some, [0, *(c + 2 for c in cuts)], [*cuts, len(data)], strict=True):
                    self.known[w] = data[a:b]
                self.size += sum(map(len, some)) + len(data) + ENTRY * len(some)
        for at in range(0, len(single), LEARN):
            some = single[at : at + LEARN]
            for w, ids in zip(some, self._encode(self.tokenizer, some), strict=True):
                self.known[w] = found = array("H", ids).tobytes()
                self.size += len(w) + len(found) + ENTRY

    def _table(self, runs: list[str], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each run, then of each word, all these ids)."""
        if self.size > CACHE_BYTES:
            self.known, self.size = {}, 0
        blobs = list(map(self.known.get, runs + words))
        new = [i for i, b in enumerate(blobs) if b is None]
        if new:
            k = bisect_left(new, len(runs))
            self._learn([runs[i] for i in new[:k]], bare=True)
            self._learn([words[i - len(runs)] for i in new[k:]])
            for i in new:
                blobs[i] = self.known[runs[i] if i < len(runs) else words[i - len(runs)]]
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 2
        return sizes, np.frombuffer(b"".join(blobs), dtype="<u2")

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each word, all these ids, place of each word among them): easy words come first, the others after them."""
        easy = np.zeros(len(words), dtype=bool)
        if self.bare is not None:
            fits = pc.and_not(pc.match_substring_regex(words, _EASY), pc.match_substring(words, _SPECIAL))
            easy = fits.to_numpy(zero_copy_only=False)
        runs, begins = _runs(pc.utf8_lower(words.filter(pa.array(easy))))
        coded = runs.dictionary_encode()
        sizes, ids = self._table(_strings(coded.dictionary), _strings(words.filter(pa.array(~easy))))
        n = len(coded.dictionary)
        ends = np.r_[0, np.cumsum(sizes)]
        by_run = pa.ListArray.from_arrays(pa.array(ends[: n + 1], pa.int32()), pa.array(ids[: ends[n]]))
        of_runs = np.r_[0, np.cumsum(sizes[coded.indices.to_numpy()])][begins]
        ids = np.concatenate([by_run.take(coded.indices).flatten().to_numpy(zero_copy_only=False), ids[ends[n] :]])
        place = np.empty(len(words), dtype=np.int64)
        place[np.argsort(~easy, kind="stable")] = np.arange(len(words))
        return np.r_[np.diff(of_runs), sizes[n:]], ids, place

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text with its end, all these ids): words and runs are told apart by Arrow, so Python sees each different one once."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.string()))
        coded = lists.flatten().dictionary_encode()
        sizes, ids, place = self._of_words(coded.dictionary)
        at = place[coded.indices.to_numpy()]
        table = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(ids))
        flat = table.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(sizes[at])][lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]]
        return np.diff(ends, prepend=0) + 1, np.insert(flat, ends, end)


@lru_cache(2)
def _words(path: str) -> WordTokens:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # single words are too short to share among threads
    return WordTokens(path)


def _write(path: str, end: int):
    def run(batches):
        tokens, made = _words(path), count(TaskContext.get().partitionId() << 32)
        doc_ids, held, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                doc_ids += part.column(0).to_pylist()
                held.append(part.column(1))
                size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
                if size >= FILE_BYTES + FILE_BYTES // 10:
                    yield _file(next(made), doc_ids, *tokens.ids(pa.concat_arrays(held), end))
                    doc_ids, held, size = [], [], 0
        if doc_ids:
            yield _file(next(made), doc_ids, *tokens.ids(pa.concat_arrays(held), end))

    def _file(nth, doc_ids, n, flat):
        known = np.array([-1 if d is None else d for d in doc_ids], dtype=np.int64)
        data = pack(known, n, flat)
        row = (nth, len(doc_ids), len(flat), doc_ids.count(None))
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in row), pa.array([data], pa.binary())], names=["nth", "docs", "tokens", "unnamed", "data"])

    return tidy(run)


#: nth: range and number of the file in it; files follow each other in this order.
FILE_SCHEMA = "nth long, docs long, tokens long, unnamed long, data binary"


def write_files(docs: DataFrame, path: str | None = None, to: str | None = None, end: int = END_ID) -> str:
    """Writes the token files of docs in ascending order of doc_id (null ids last) and returns their folder.

    The folder is a Parquet table with one file in each row (column data), as only Spark's own
    writers reach every kind of store; rows hold whole files, so they can be copied out as they are.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    small_batches(docs.sparkSession)
    to = to or fresh_path(docs.sparkSession, "token-files")
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    # Workers take several files of a range one after another, as long as there are ranges enough for all of them.
    files = max(1, -(-size // FILE_BYTES))
    ranges = max(min(files, 2 * docs.sparkSession.sparkContext.defaultParallelism), -(-files // RANGE_FILES))
    # The driver samples the keys that ranges are cut at: there the first bytes stand for a text, in the same order.
    cuts = [order[0], F.substring("text", 1, 32)]
    ranged = rows.repartitionByRange(ranges, *cuts).sortWithinPartitions(*order)
    ranged.mapInArrow(_write(path, end), FILE_SCHEMA).write.parquet(to)
    return to


def _read(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
            doc_ids, counts, ids = unpack(row["data"])
            ends = np.cumsum(counts)
            named = np.arange(len(doc_ids)) >= len(doc_ids) - row["unnamed"]
            flat = ids.astype("<u4")
            sums = [zlib.crc32(flat[e - n : e].tobytes()) for e, n in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, mask=named),
                    pa.array(ends - counts + row["offset"], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_files(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files; a damaged block raises an error.

    start counts the ids of all documents before it. Only the files' sizes are summed up: within
    groups of 2**RANGES_BITS ranges, then over the groups, of which ten million ranges make some thousands.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    sizes = files.select("nth", "tokens", F.shiftright("nth", 32 + RANGES_BITS).alias("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(parts, "part")
    rows = files.select("nth", "unnamed", "data").join(offsets.select("nth", (F.col("base") + F.col("offset")).alias("offset")), "nth")
    return rows.select("unnamed", "data", "offset").mapInArrow(tidy(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes docs as token files, reads these back and returns one row for each row of docs, as ``read_files``.

    Null and empty texts are only the end id. Repeated rows come one after another in order of
    text, rows without doc_id last; a very long text is encoded whole and may make its file longer. An empty table gives
    an empty result. Other columns are ignored.
    """
    return read_files(docs.sparkSession, write_files(docs, path))
