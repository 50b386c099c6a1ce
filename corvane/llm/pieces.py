"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf message; the few fields needed are read straight from its wire format.
From them the tokenizer is rebuilt: normaliser (identity, or the compiled character map),
blank marker and dummy prefix, unigram scores or, for BPE models, merges in order of piece
scores, and byte fallback. Where no piece of the vocabulary has a blank after another
character, a text is the sequence of its blank-led segments; each distinct segment of
a batch is encoded once (by the library's threads), checked against the original library and
kept in a bounded cache. Every document is decoded from its ids and compared with its text.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import byte_rows, small_batches, text_bytes, tidy

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
#: Bytes of segments kept from batch to batch of a task, with what Python needs for an entry.
CACHE_BYTES, ENTRY = 48_000_000, 180
#: Segments encoded in one call; what the library holds for a call grows with their number.
LEARN = 8192
_SEGMENT = re.compile(rb" ( *[^ ]*)")


def _cut(text: bytes) -> list[bytes]:
    """The blank-led segments of a text with a blank in front, each without its first blank."""
    if not text:
        return []
    led = b" " + text
    return _SEGMENT.findall(led) if b"  " in led else text.split(b" ")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of a protobuf message: ints, 4- and 8-byte values as bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True  # blanks at the ends go, runs of blanks become one
    escape: bool = True

    @property
    def unk(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    @property
    def cuts_at_blanks(self) -> bool:
        """True if a blank only ever begins a piece, so that segments are encoded on their own."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in self.pieces if t in (NORMAL, USER))

    @property
    def by_segment(self) -> bool:
        return self.cuts_at_blanks and not self.charsmap and not self.squeeze and self.dummy_prefix and self.escape and not any(t == USER for *_, t in self.pieces)


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.squeeze = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    return m


def _merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces in the order in which the original joins them: best score of the whole first."""
    ids = {p: i for i, (p, _, t) in enumerate(m.pieces) if t == NORMAL}
    found = []
    for p, i in ids.items():
        for k in range(1, len(p)):
            if p[:k] in ids and p[k:] in ids:
                found.append((-m.pieces[i][1], i, ids[p[:k]], ids[p[k:]]))
    return [(m.pieces[a][0], m.pieces[b][0]) for *_, a, b in sorted(found)]


def build_tokenizer(m: Model, whole: bool = True):
    """A tokenizers.Tokenizer; whole: for full texts, otherwise for segments that begin with their blanks."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk, m.byte_fallback)
    elif m.kind == BPE:
        vocab = {p: i for i, (p, *_) in enumerate(m.pieces)}
        model = models.BPE(vocab, _merges(m), unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    tokenizer = Tokenizer(model)
    steps = []
    if whole:
        if m.charsmap:
            steps.append(normalizers.Precompiled(m.charsmap))
        if m.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if whole and m.cuts_at_blanks:
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    return tokenizer


class Codec:
    """Encodes and decodes with one model; lives in a worker process."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.model = parse_model(f.read())
        self.peer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.segments = self.model.by_segment
        self.tokenizer = build_tokenizer(self.model, whole=not self.segments)
        self.known: dict[bytes, bytes] = {}
        self.size = self.odd = 0
        bytes_of = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(MARK, " ").encode()
            for p, _, t in self.model.pieces
        ]
        self.bytes_of = pa.array(bytes_of, pa.large_binary())

    def _learn(self, segments: list[bytes]) -> None:
        """Caches segments, named without the first of the blanks that lead them."""
        texts = [s.decode() for s in segments]
        got = [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        want = self.peer.encode(texts, num_threads=1)  # which adds the blank in front itself
        for s, a, b in zip(segments, got, want, strict=True):
            if a != b and s:
                self.odd += 1
                a = b
            self.known[s] = found = array("i", a).tobytes()
            self.size += len(s) + len(found) + ENTRY

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """ids of each text (UTF-8)."""
        if not self.segments:
            got = [e.ids for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
            want = self.peer.encode([t.decode() for t in texts], num_threads=1)
            odd = [a != b for a, b in zip(got, want, strict=True)]
            self.odd += sum(odd)
            return [np.array(b if o else a, dtype=np.int32) for a, b, o in zip(got, want, odd, strict=True)]
        cut = [_cut(t) for t in texts]
        seen = set().union(*cut)
        new = seen.difference(self.known)
        if self.size > CACHE_BYTES:
            self.known = {s: self.known[s] for s in seen.difference(new)}  # words that come again and again stay
            self.size = sum(len(s) + len(i) + ENTRY for s, i in self.known.items())
        new = list(new)
        for at in range(0, len(new), LEARN):
            self._learn(new[at : at + LEARN])
        return [np.frombuffer(b"".join(map(self.known.__getitem__, c)), dtype=np.int32) for c in cut]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The texts of sequences of ids, without the blank that encoding put in front."""
        if not any(map(len, ids)):
            return [b""] * len(ids)
        flat = np.concatenate(ids)
        pieces = self.bytes_of.take(pa.array(flat))
        starts, joined = np.frombuffer(pieces.buffers()[1], dtype=np.int64), pieces.buffers()[2].to_pybytes()
        ends = starts[np.cumsum([0, *map(len, ids)])].tolist()
        blank = self.model.dummy_prefix
        return [joined[a + (blank and joined[a : a + 1] == b" " and a < b) : b] for a, b in zip(ends, ends[1:])]

    def plain(self, text: bytes) -> bytes:
        """What decoding gives back: the text after normalisation."""
        if self.segments:
            return text.replace(MARK.encode(), b" ")
        return self.peer.decode(self.peer.encode(text.decode())).encode()


@lru_cache(2)
def codec(path: str) -> Codec:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", "2")  # each task's worker has its own threads, and each thread its own heap
    return Codec(path)


def _encode(path: str):
    @tidy
    def run(batches):
        c = codec(path)
        for part, texts in byte_rows(batches, chunk=256):
            odd = c.odd
            ids = c.encode(texts)
            ends = np.cumsum([0, *map(len, ids)])
            same = [back == c.plain(t) for back, t in zip(c.decode(ids), texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))),
                    pa.array(same),
                    pa.array([c.odd - odd] * len(ids), pa.int64()),
                ],
                names=["doc_id", "n_tokens", "ids", "round_trip", "mended"],
            )
        c.known, c.size = {}, 0  # a worker that waits for its next stage holds no segments

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids, round_trip, mended.

    round_trip: decoding the ids gives back the normalised text. mended: segments of the
    row's batch for which the rebuilt tokenizer differed from the original library, whose ids were then
    taken. Null and empty texts have no ids. Equal texts have equal ids, and rows that repeat come as often as they are; a very
    long text is encoded whole, in one task. An empty table gives none; other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids array<int>, round_trip boolean, mended long"
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(_encode(path or model_path()), schema)
