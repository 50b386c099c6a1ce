"""Scoring text with Brown class-based bigrams.

Training counts every word. The vocabulary is the ``HEAD`` most frequent words; all others share a unit with the words
that end alike, so every word has a class, even one never seen. Exchange clustering puts units into classes in two steps:

* the ``UNITS`` most frequent words, the endings and the end of texts are exchanged one by one until the likelihood of
  the training bigrams stops rising. Each of them is seen by every other, so this is one loop over a table of fixed size;
* every other word of the vocabulary is then moved, in ``ROUNDS`` rounds, to the class that gives its own neighbours' classes
  the best likelihood. In a round all words are judged at once against the same class bigrams, each by one task.

A token's probability mixes P(class | class before) * P(word | class) with the add-one unigram, which leaves mass for
unknown words.

The vocabulary, its classes and the class bigrams are of bounded size and are sent to the workers. Tokens outside the
vocabulary become rows that are joined with the whole table of counts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import byte_rows, discard, id_crc32, materialise, text_bytes, tidy

CLASSES, UNITS, ENDINGS, HEAD, SWEEPS, ROUNDS = 64, 512, 256, 262_144, 8, 1
#: Weight of the unigram besides the share of words seen once, its limit; added to each class transition.
MIX, MOST, ADD = 0.05, 0.5, 0.5
#: Distinct words that a counting worker holds before it passes them on; tokens whose neighbours are counted at once.
FLUSH, SLICE = 400_000, 1 << 21


def _count(batches):
    seen: Counter = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return batch

    for _, texts in byte_rows(batches):
        for t in texts:
            seen.update(t.lower().split())
        if len(seen) > FLUSH:
            yield out()
    yield out()


class Vocabulary(dict):
    """Word -> number: frequent words by rank, others by their ending, None (the end) last."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.head = len(words)
        self[None] = self.head + ENDINGS

    def __missing__(self, word: bytes) -> int:
        return self.head + zlib.crc32(word[-3:]) % ENDINGS

    def units(self) -> np.ndarray:
        """The clustering unit of each number."""
        own = min(UNITS, self.head)
        ends = [own + zlib.crc32(w[-3:]) % ENDINGS for w in list(self)[own : self.head]]
        return np.r_[np.arange(own), np.array(ends, dtype=np.int64), own + np.arange(ENDINGS + 1)].astype(np.int64)


def _tokens(texts: list[bytes]) -> tuple[list, np.ndarray]:
    """All tokens of some texts, each text closed by None, and how many tokens each has."""
    out, many = [], []
    for t in texts:
        words = t.lower().split()
        out += words
        out.append(None)
        many.append(len(words) + 1)
    return out, np.array(many, dtype=np.int64)


def _before(x: np.ndarray, end: int) -> np.ndarray:
    return np.r_[end, x[:-1]]


def _sequences(shared):
    """The vocabulary numbers of whole texts, one blob of three-byte numbers for each slice of rows."""

    @tidy
    def run(batches):
        vocabulary = shared.value
        for _, texts in byte_rows(batches):
            tokens, _ = _tokens(texts)
            ids = np.fromiter(map(vocabulary.__getitem__, tokens), "<u4", len(tokens))
            yield pa.RecordBatch.from_arrays([pa.array([ids.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()], pa.binary())], names=["ids"])

    return run


def _read(batches):
    """Numbers of some texts after another, at least ``SLICE`` at once but for the last."""
    held, size = [], 0
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            flat = np.zeros((len(blob) // 3, 4), dtype=np.uint8)
            flat[:, :3] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 3)
            held.append(flat.reshape(-1).view("<u4").astype(np.int64))
            size += len(held[-1])
            if size >= SLICE:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _cells(numbers: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(counts, pa.int64())], names=["cell", "n"])


def _pairs(shared):
    """(cell, n): how often a label follows another, cell = label before * size + label."""

    @tidy
    def run(batches):
        labels, size, end = shared.value
        total = np.zeros(size * size, dtype=np.int64)
        for ids in _read(batches):
            x = labels[ids]
            total += np.bincount(_before(x, end) * size + x, minlength=size * size)
        at = np.flatnonzero(total)
        yield _cells(at, total[at])

    return run


def _neighbours(shared):
    """(cell, n) of the words that have no unit of their own: cell = number * 2 * CLASSES + class before, or + CLASSES + class behind."""

    @tidy
    def run(batches):
        classes, low, high, end = shared.value
        for ids in _read(batches):
            c = classes[ids]
            own = (ids >= low) & (ids < high)
            before, behind = _before(c, end), np.r_[c[1:], end]
            keys = np.concatenate([ids[own] * (2 * CLASSES) + before[own], ids[own] * (2 * CLASSES) + CLASSES + behind[own]])
            keys, n = np.unique(keys, return_counts=True)
            yield _cells(keys, n)

    return run


def _f(x):
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(left: np.ndarray, right: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of each word that fits its neighbours best, all other words staying where they are.

    left, right: (words, classes) counts of the classes before and behind; own: the classes now; n: class bigrams with them.
    """
    i = np.arange(len(own))
    a, b = left.sum(axis=1), right.sum(axis=1)
    rows, columns = np.broadcast_to(n, (len(own), *n.shape)).copy(), np.broadcast_to(n.T, (len(own), *n.shape)).copy()
    rows[i, own] -= right  # without the word itself
    columns[i, own] -= left
    rows, columns = np.maximum(rows, 0), np.maximum(columns, 0)
    gain = (_f(rows + right[:, None, :]) - _f(rows)).sum(axis=2) + (_f(columns + left[:, None, :]) - _f(columns)).sum(axis=2)
    out, into = rows.sum(axis=2), columns.sum(axis=2)
    gain -= _f(out + b[:, None]) - _f(out) + _f(into + a[:, None]) - _f(into)
    to = gain.argmax(axis=1)
    return np.where(gain[i, to] > gain[i, own] + 1e-9, to, own)


def _settle(shared):
    """(number, class) of words that move, from all cells of some words."""

    @tidy
    def run(batches):
        classes, n = shared.value
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        cell, many = (np.concatenate(x) for x in zip(*parts, strict=True))
        word, row = np.unique(cell // (2 * CLASSES), return_inverse=True)
        for at in range(0, len(word), 128):
            some = (row >= at) & (row < at + 128) if len(word) > 128 else slice(None)
            k = min(128, len(word) - at)
            table = np.bincount((row[some] - at) * (2 * CLASSES) + cell[some] % (2 * CLASSES), many[some], k * 2 * CLASSES).reshape(k, -1)
            now = classes[word[at : at + 128]]
            to = best_classes(table[:, :CLASSES], table[:, CLASSES:], now, n)
            moved = to != now
            yield pa.RecordBatch.from_arrays([pa.array(word[at : at + 128][moved], pa.int64()), pa.array(to[moved], pa.int64())], names=["number", "class"])

    return run


def _summed(sequences: DataFrame, labels: np.ndarray, size: int, end: int) -> np.ndarray:
    """The table of how often a label follows another; size * size cells at most come to the driver."""
    shared = sequences.sparkSession.sparkContext.broadcast((labels, size, end))
    found = sequences.mapInArrow(_pairs(shared), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size * size, dtype=np.int64)
    total[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return total.reshape(size, size)


def _exchanged(sequences: DataFrame, classes: np.ndarray, low: int, high: int, end: int) -> np.ndarray:
    """classes after one round over the words with numbers from low to high; what comes to the driver are those that move."""
    if low >= high:
        return classes
    sc = sequences.sparkSession.sparkContext
    n = _summed(sequences, classes, CLASSES, int(classes[end])).astype(float)
    cells = sequences.mapInArrow(_neighbours(sc.broadcast((classes, low, high, int(classes[end])))), "cell long, n long")
    dealt = cells.repartition(F.expr(f"cell div {2 * CLASSES}"))
    moved = dealt.mapInArrow(_settle(sc.broadcast((classes, n))), "number long, class long").toArrow()
    out = classes.copy()
    out[moved.column(0).to_numpy()] = moved.column(1).to_numpy()
    return out


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit: each unit in turn moves to the class that gives the bigrams the best likelihood."""
    b = bigrams.astype(float)
    size = len(b)
    seen = b.sum(axis=0) + b.sum(axis=1)
    order = np.argsort(-seen, kind="stable")
    label = np.full(size, min(classes, size) - 1, dtype=np.int64)
    label[order[: classes - 1]] = np.arange(min(classes - 1, size))
    one = np.eye(classes)[label]
    n = one.T @ b @ one

    f = _f
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not seen[u]:
                continue
            own, self_count = label[u], b[u, u]
            right = np.bincount(label, b[u], classes)
            left = np.bincount(label, b[:, u], classes)
            right[own] -= self_count
            left[own] -= self_count
            n[own] -= right
            n[:, own] -= left
            n[own, own] -= self_count
            out, into = n.sum(axis=1) + left, n.sum(axis=0) + right  # what each class has wherever u goes
            gain = (f(n + right[None, :]) - f(n)).sum(axis=1) + (f(n.T + left[None, :]) - f(n.T)).sum(axis=1)
            d = n.diagonal()
            gain += f(d + right + left + self_count) + f(d) - f(d + right) - f(d + left)
            gain -= f(out + right.sum() + self_count) - f(out) + f(into + left.sum() + self_count) - f(into)
            to = int(np.argmax(gain))
            if gain[to] <= gain[own] + 1e-9:
                to = own
            n[to] += right
            n[:, to] += left
            n[to, to] += self_count
            label[u] = to
            moved += to != own
        if not moved:
            break
    return label


def _score(shared):
    """A row for each document, with its id, and one for each token outside the vocabulary; ``key`` ties them together."""

    @tidy
    def run(batches):
        vocabulary, classes, counts, transition, norm, mix = shared.value
        head, end = vocabulary.head, vocabulary.head + ENDINGS
        first = TaskContext.get().partitionId() << 36
        for part, texts in byte_rows(batches):
            tokens, many = _tokens(texts)
            at = np.fromiter(map(vocabulary.__getitem__, tokens), np.int64, len(tokens))
            c = classes[at]
            before = _before(c, classes[end])
            q = transition[before, c]
            n = counts[at]
            tail = (at >= head) & (at < end)
            base = np.where(tail, 0.0, np.log10((n + 1) / norm))
            mixed = (1 - mix) * q * n + mix * (n + 1) / norm
            score = np.where(tail, 0.0, np.log10(mixed))
            starts = np.cumsum(many) - many
            keys = first + np.arange(len(many))
            first += len(many)
            where = np.flatnonzero(tail)
            ours = pa.nulls(len(many), pa.binary())
            doc_id, held_out = part.column(0), part.column(2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[keys, keys[np.searchsorted(starts, where, side="right") - 1]]),
                    pa.concat_arrays([doc_id, pa.nulls(len(where), doc_id.type)]),
                    pa.concat_arrays([held_out, pa.nulls(len(where), held_out.type)]),
                    pa.concat_arrays([ours, pa.array([tokens[i] for i in where], pa.binary())]),
                    pa.array(np.r_[np.zeros(len(many)), q[where]]),
                    pa.array(np.r_[np.add.reduceat(base, starts), np.zeros(len(where))]),
                    pa.array(np.r_[np.add.reduceat(score, starts), np.zeros(len(where))]),
                    pa.array(np.r_[many, np.zeros(len(where), dtype=np.int64)]),
                    pa.array(np.r_[np.add.reduceat(((n > 0) & ~tail).astype(np.int64), starts), np.zeros(len(where), dtype=np.int64)]),
                ],
                names=["key", "doc_id", "held_out", "word", "q", "base", "score", "tokens", "known"],
            )

    return run


def _head(counts: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """The most frequent words, most frequent first: as many whole frequency steps as fit in ``limit``."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("s")).collect()  # some hundred rows
    least, total = None, 0
    for r in sizes:
        total += r["k"]
        if total > limit:
            break
        least = r["s"]
    if least is None:
        return []
    rows = counts.where(step >= least).select("word", "n").toArrow()  # ``limit`` rows at most
    found = zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)
    return sorted(found, key=lambda x: (-x[1], x[0]))


def cluster(sequences: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """(the class of each vocabulary number, the number of the end)."""
    units, end = vocabulary.units(), vocabulary.head + ENDINGS
    size = int(units[-1]) + 1
    classes = exchange(_summed(sequences, units, size, size - 1))[units]
    for _ in range(rounds):
        classes = _exchanged(sequences, classes, min(UNITS, vocabulary.head), vocabulary.head, end)
    return classes, end


def score(docs: DataFrame, held_out=None, limit: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, lower-cased in A-Z, and one end. Learns from the rows where ``held_out`` (by
    default crc32 of the id mod 7 is 2) is false. base_score: add-one unigram; score: log10 of
    the class model's probability of the text. Null and empty texts are only their end. Repeated
    rows count each time, in any order of the input. An empty table gives none. If nothing is left to learn from, both scores are the unigram's. Other columns are ignored.
    """
    spark = docs.sparkSession
    held_out = id_crc32() % 7 == 2 if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"), held_out.alias("held_out"))
    train = rows.where("NOT held_out").select("text")
    counts = materialise(train.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    ends = rows.where("NOT held_out").count()
    total, words = sums["n"] + ends, sums["v"] + (ends > 0)
    norm = float(total + words + 1)
    # the share of words seen once estimates that of unknown words, for which the unigram alone has mass
    mix = min(MOST, MIX + sums["once"] / total) if total else 1.0

    head = _head(counts, limit)
    vocabulary = Vocabulary([w for w, _ in head])
    shared = spark.sparkContext.broadcast(vocabulary)
    sequences = materialise(train.mapInArrow(_sequences(shared), "ids binary"), "sequences")
    label, end = cluster(sequences, vocabulary, rounds)
    pairs = _summed(sequences, label, CLASSES, int(label[end]))
    discard(sequences)
    to_class = (pairs + ADD) / (pairs.sum(axis=1, keepdims=True) + ADD * CLASSES)
    mass = pairs.sum(axis=0)
    transition = to_class / np.where(mass > 0, mass, math.inf)[None, :]
    numbers = np.r_[np.array([n for _, n in head], dtype=np.int64), np.zeros(ENDINGS, dtype=np.int64), ends]
    model = spark.sparkContext.broadcast((vocabulary, label, numbers, transition, norm, mix))

    schema = "key long, doc_id long, held_out boolean, word binary, q double, base double, score double, tokens long, known long"
    found = materialise(rows.mapInArrow(_score(model), schema), "scored")
    n = F.coalesce(F.col("n"), F.lit(0))
    mixed = (1 - mix) * F.col("q") * n + mix * (n + 1) / norm
    tail = (
        found.where("word IS NOT NULL")
        .select("key", "word", "q")
        .join(counts, "word", "left")
        .select("key", F.log10((n + 1) / norm).alias("base"), F.log10(mixed).alias("score"), F.col("n").isNotNull().cast("long").alias("known"))
    )
    added = tail.groupBy("key").agg(*(F.sum(c).alias(f"_{c}") for c in ("base", "score", "known")))
    whole = found.where("word IS NULL").drop("word", "q").join(added, "key", "left")

    def total_of(c: str):
        return F.col(c) + F.coalesce(f"_{c}", F.lit(0))

    return whole.select(
        "doc_id",
        "held_out",
        F.col("tokens").alias("n_tokens"),
        total_of("known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        total_of("base").alias("base_score"),
        total_of("score").alias("score"),
    )
