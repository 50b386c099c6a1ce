"""Incremental removal of repeated passages with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document. Of every window one anchor is
fingerprinted: the ``ANCHOR``-word run with the smallest hash among those it holds. Equal
windows have equal anchors, and neighbouring windows mostly share theirs, so the index
holds about an eighth of the word positions.

The index is a folder of immutable runs, each sorted by fingerprint: (h, doc_id, pos), and manifests that name the
runs in use. A new batch is written as the next run and merge-joined with all runs before it. Only windows whose
anchor was met twice are looked at again: their texts are verified by two further
independent hashes (64 and 32 bits) of the whole window, and all but the first start (smallest
doc_id, then position) of each are marked. Runs are compacted into one when there are more than
``MAX_RUNS``. Texts of earlier batches are read from the store they came from.

Hot passages: every task first decides equal keys among its own rows and passes one row of each
key on, so the task that gathers a key gets at most a row for every slice of rows mapped. What is passed on goes
through the shuffle in packets, one for each slice of rows and bucket of keys, not row by row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import byte_rows, discard, every, fresh_path, materialise, release, text_bytes, tidy
from corvane.llm.wordhash import WordHasher, cut_words

WINDOW, ANCHOR, MAX_RUNS = 20, 6, 2
#: Batches that a whole table is fed in; each one meets the runs of those before it.
BATCHES = 3
#: Rows that a task sorts before it sends packets, at least.
SLOTS = 1 << 18
#: Bytes of text hashed at once.
SLICE = 1 << 20


def _slices(batches: Iterator[pa.RecordBatch], column: str = "text"):
    """(rows, texts) of about SLICE bytes."""
    for part, texts in byte_rows(batches, column, 2048):
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= SLICE:
                yield part.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0
        if at < len(texts):
            yield part.slice(at, len(texts) - at), texts[at:]


def window_anchors(words: np.ndarray, owner: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows that lie inside one text, their anchors' positions, hashes of anchors by position)."""
    grams = WordHasher(11).windows(words, anchor)
    wide = window - anchor + 1
    n = len(words) - window + 1
    if n <= 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, grams
    # leftmost least gram of each window, by doubling: least[i] covers `have` grams from i on
    least, at, have = grams, np.arange(len(grams)), 1
    while have < wide:
        step = min(have, wide - have)
        a, b = slice(0, len(least) - step), slice(step, None)
        right = least[b] < least[a]
        least, at = np.where(right, least[b], least[a]), np.where(right, at[b], at[a])
        have += step
    start = np.flatnonzero(owner[:n] == owner[window - 1 :])
    return start, at[start], grams


def _first_words(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n))


def _anchors(window: int, anchor: int):
    hasher = WordHasher(7)

    @tidy
    def run(batches):
        for part, texts in _slices(batches):
            body, starts, lengths, owner = cut_words(texts)
            words = hasher.words(body, starts, lengths)
            _, at, grams = window_anchors(words, owner, window, anchor)
            at = np.unique(at)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            pos = at - _first_words(owner, len(texts))[owner[at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[at].view(np.int64)), pa.array(ids[owner[at]], pa.int64()), pa.array(pos.astype(np.int32))],
                names=["h", "doc_id", "pos"],
            )

    return run


def _candidates(window: int, anchor: int):
    """Hashes of the windows whose anchor is among the positions listed in ``at``."""
    hasher, checker = WordHasher(7), WordHasher(23)

    @tidy
    def run(batches):
        for part, texts in _slices(batches):
            body, starts, lengths, owner = cut_words(texts)
            words = hasher.words(body, starts, lengths)
            start, at, _ = window_anchors(words, owner, window, anchor)
            first = _first_words(owner, len(texts))
            lists = part.column(part.schema.get_field_index("at"))
            many = np.diff(lists.offsets.to_numpy())
            hit = np.zeros(len(words) + 1, dtype=bool)
            hit[lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(first, many)] = True
            start = start[hit[at]]
            other = checker.words(body, starts, lengths)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hasher.windows(words, window)[start].view(np.int64)),
                    pa.array((checker.windows(other, window)[start] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    pa.array(ids[owner[start]], pa.int64()),
                    pa.array((start - first[owner[start]]).astype(np.int32)),
                ],
                names=["w1", "w2", "doc_id", "start"],
            )

    return run


def _places(doc_id: np.ndarray, at: np.ndarray, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(at, pa.int32())], names=["doc_id", name])


def _new_keys(cols: list[np.ndarray], keys: int) -> np.ndarray:
    """Where another key begins, in rows sorted by the first ``keys`` columns."""
    new = np.zeros(len(cols[0]), dtype=bool)
    new[:1] = True
    for k in range(keys):
        new[1:] |= cols[k][1:] != cols[k][:-1]
    return new


def _sorted(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.lexsort(cols[::-1])
    return [c[order] for c in cols]


def _pack(cols: list[np.ndarray]) -> bytes:
    return b"".join(c.tobytes() for c in cols)


def _unpack(blob: bytes, kinds: list[np.dtype]) -> list[np.ndarray]:
    n = len(blob) // sum(k.itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(blob, dtype=k, count=n, offset=at))
        at += n * k.itemsize
    return out


def dealt_to(n: int) -> np.ndarray:
    """For each of n partitions a number that Spark deals there, so that buckets of keys fill all partitions alike.

    Spark's partition of a number is its 32-bit Murmur3 hash, seed 42, modulo n. Where that is not so buckets only meet more often.
    """
    found, at = np.full(n, -1, dtype=np.int64), 0
    while (found < 0).any():
        v = np.arange(at, at + 4 * n, dtype=np.uint32)
        k = v * np.uint32(0xCC9E2D51)
        k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        part = h.view(np.int32).astype(np.int64) % n
        found[part[::-1]] = np.where(found[part[::-1]] < 0, v[::-1], found[part[::-1]])
        at += 4 * n
    return found.astype(np.int32)


def _reduced(keys: int, first_only: bool, deal: np.ndarray, slots: int = SLOTS):
    """Combines equal keys before the shuffle, so that a hot key sends few rows from each task.

    Of rows with one key in a slice the first (in order of the other columns) goes on, in the packet of its key's bucket.
    The others are decided here: they go on in packets marked so, dealt by what they hold, as does the first unless ``first_only``.
    """
    buckets = len(deal)

    def flush(parts):
        cols = _sorted(parts)
        new = _new_keys(cols, keys)
        again = ~new if first_only else ~new | np.r_[~new[1:], False]
        first = [c[new] for c in cols]
        bucket = (first[0].view(np.uint64) >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, first = bucket[order].astype(np.int32), [c[order] for c in first]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        out = [(int(deal[bucket[a]]), False, _pack([c[a:b] for c in first])) for a, b in zip(cuts, cuts[1:], strict=False)]
        told = [c[again] for c in cols]
        packets = [_pack([c[at : at + 16384] for c in told]) for at in range(0, len(told[0]), 16384)]
        out += [(int(deal[zlib.crc32(p) % buckets]), True, p) for p in packets]
        kinds = (pa.int32(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["bucket", "told", "rows"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= max(slots, 16 * buckets):
                yield flush(parts)
                parts, size = [], 0
        if size:
            yield flush(parts)

    return run


def _decided(kinds: list[np.dtype], keys: int, first_only: bool, name: str):
    """(doc_id, name) of the rows whose key came more than once (first_only: without the first), bucket after bucket."""

    def group(parts):
        cols = _sorted(parts)
        new = _new_keys(cols, keys)
        hit = ~new if first_only else ~new | np.r_[~new[1:], False]
        return _places(cols[keys][hit], cols[keys + 1][hit], name)

    @tidy
    def run(batches):
        now, parts = None, []
        for batch in batches:
            for bucket, told, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                cols = _unpack(blob, kinds)
                if told:
                    yield _places(cols[keys], cols[keys + 1], name)
                    continue
                if bucket != now and parts:
                    yield group(parts)
                    parts = []
                now = bucket
                parts.append(cols)
        if parts:
            yield group(parts)

    return run


def _cover(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``starts``."""
    change = np.zeros(n + window + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change)[:n] > 0


def _rewrite(window: int, with_text: bool):
    @tidy
    def run(batches):
        for part, texts in byte_rows(batches):
            lists = part.column(part.schema.get_field_index("starts")).to_pylist()
            total, removed, out = [], [], []
            for text, starts in zip(texts, lists, strict=True):
                words = text.split()
                total.append(len(words))
                if starts:
                    gone = _cover(np.array(starts), len(words), window)
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                else:
                    removed.append(0)
                kept = b" ".join(words)
                out.append((kept if removed[-1] else text) if with_text else hashlib.sha256(kept).hexdigest())
            last = pa.array(out, pa.binary()).cast(pa.string()) if with_text else pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), last],
                names=["key", "n_words", "n_removed", "text" if with_text else "kept_sha256"],
            )

    return run


class SubstringIndex:
    """Runs in a folder of the shared storage; ``ingest`` takes the batches in order of doc_id.

    An index is opened again by its path: the last manifest tells its runs.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, anchor: int = ANCHOR, max_runs: int = MAX_RUNS):
        self.spark, self.path = spark, path or fresh_path(spark, "substring-index")
        self.window, self.anchor, self.max_runs = window, anchor, max_runs
        self.runs: list[str] = []
        self.made = self.written = 0
        known = sorted(n for n in self._names() if n.startswith("manifest-"))
        if known:
            rows = spark.read.json(f"{self.path}/{known[-1]}").collect()  # a row for each run
            self.runs = sorted(r["run"] for r in rows if r["run"])
            self.made = max(r["made"] for r in rows)
            self.written = int(known[-1][9:]) + 1

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        path, fs = self._fs()
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _commit(self) -> None:
        """Names the runs in use in the next manifest, and deletes those that the manifest before named and no one reads any more."""
        rows = [(r, self.made) for r in self.runs or [""]]
        self.spark.createDataFrame(rows, "run string, made int").coalesce(1).write.json(f"{self.path}/manifest-{self.written:08d}")
        self.written += 1
        _, fs = self._fs()
        kept = {r.rpartition("/")[2] for r in self.runs}
        for name in self._names():
            if name.startswith("run-") and name not in kept:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def _write_run(self, rows: DataFrame) -> str:
        to = f"{self.path}/run-{self.made:05d}"
        self.made += 1
        rows.sortWithinPartitions("h").write.parquet(to)
        return to

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema("h long, doc_id long, pos int").parquet(*runs)

    def ingest(self, batch: DataFrame, store: DataFrame | None = None) -> DataFrame:
        """(doc_id, starts): the repeated windows of the batch's documents, one row for each that has any.

        batch, store: (doc_id, text), ids distinct; every id of the batch is larger than
        those before it. store holds at least the documents of all earlier batches.
        """
        make = batch.select("doc_id", text_bytes().alias("text")).mapInArrow(
            _anchors(self.window, self.anchor), "h long, doc_id long, pos int"
        )
        history, run = list(self.runs), self._write_run(make)
        self.runs.append(run)
        new = self._read([run])
        hits = self._within(new)
        texts = batch.select("doc_id", "text")
        if history:
            old = self._read(history)
            # dealt anew (by something else than h, which would be optimized away), so that the joins have shuffles of
            # their own: those are split where a fingerprint is frequent
            known = old.join(new.select("h").distinct().repartition(F.xxhash64("h")), "h", "left_semi")
            again = new.join(old.select("h").distinct().repartition(F.xxhash64("h")), "h", "left_semi")
            hits = hits.unionByName(known.unionByName(again).select("doc_id", "pos"))
            texts = store.select("doc_id", "text").unionByName(texts)
        at = materialise(hits.groupBy("doc_id").agg(F.collect_set("pos").alias("at")), "met")
        release(self.spark)
        wide = at.join(texts, "doc_id").select("doc_id", text_bytes().alias("text"), "at")
        again = self._reduce(wide, "i8 i4 i8 i4", 2, True, "start", _candidates(self.window, self.anchor))
        if history:
            again = again.join(batch.select("doc_id"), "doc_id", "left_semi")
        found = materialise(again.groupBy("doc_id").agg(F.collect_set("start").alias("starts")), "repeats")
        discard(at)
        release(self.spark)
        if len(self.runs) > self.max_runs:
            self.compact()
        self._commit()
        return found

    def _reduce(self, rows: DataFrame, kinds: str, keys: int, first_only: bool, name: str, make=iter) -> DataFrame:
        """Decides equal keys first inside each task, then among one row of each slice of rows, by one shuffle.

        make turns batches of rows into those with the keys, in the same worker: a second one would hold its memory too.
        """
        deal = dealt_to(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        reduce = tidy(_reduced(keys, first_only, deal))
        split = rows.mapInArrow(lambda batches: reduce(make(batches)), "bucket int, told boolean, rows binary")
        dealt = split.repartition("bucket").sortWithinPartitions("told", "bucket")
        return dealt.mapInArrow(_decided([np.dtype(k) for k in kinds.split()], keys, first_only, name), f"doc_id long, {name} int")

    def _within(self, rows: DataFrame) -> DataFrame:
        """(doc_id, pos) of the fingerprints that occur more than once in rows."""
        return self._reduce(rows, "i8 i8 i4", 1, False, "pos")

    def compact(self) -> None:
        """Merges all runs into one; the old ones go with the next manifest."""
        self.runs = [self._write_run(self._read(self.runs).repartition(F.xxhash64("h", "doc_id")))]  # a frequent h is spread


def repeats(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW) -> DataFrame:
    """(doc_id, starts) for ``docs(doc_id long, text)`` with distinct ids, fed to a new index in batches of ascending ids."""
    spark = docs.sparkSession
    index, parts = SubstringIndex(spark, window=window), []
    cuts = []
    if batches > 1:
        cuts = [c for c in docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []]
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = docs
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        parts.append(index.ingest(part, docs.where(F.col("doc_id") <= low) if low is not None else None))
        release(spark)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """docs as (row struct, doc_id, text) where doc_id is distinct and never null.

    That is the table's own doc_id where it serves. Otherwise rows are numbered in order of
    (doc_id, text), null ids last, so that repeated rows count as documents one after another.
    """
    rows = docs.select(F.struct(*every(docs)).alias("row"), F.col("doc_id").cast("long"), "text")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("m")).first()
    many = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if seen["n"] == seen["m"] and many.isEmpty():
        return rows
    in_order = rows.orderBy(F.col("doc_id").asc_nulls_last(), "text")
    return materialise(in_order.withColumn("doc_id", F.monotonically_increasing_id()), "numbered")


def _apply(docs: DataFrame, batches: int, window: int, with_text: bool) -> DataFrame:
    keyed = _keyed(docs)
    found = repeats(keyed.select("doc_id", "text"), batches, window)
    joined = keyed.join(found, "doc_id", "left")
    last = "text string" if with_text else "kept_sha256 string"
    if not with_text:
        slim = joined.select(F.col("row.doc_id").alias("key"), text_bytes().alias("text"), "starts")
        return slim.mapInArrow(_rewrite(window, False), f"key long, n_words long, n_removed long, {last}").withColumnRenamed("key", "doc_id")
    # columns travel under numbers, so that no name of docs meets one of ours
    slots = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    fields = [F.col("row").getField(c).alias(n) for c, n in slots.items()]
    kind = docs.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in slots.items())).alias("key")).schema.simpleString()[7:-1]
    slim = joined.select(F.struct(*fields).alias("key"), text_bytes().alias("text"), "starts")
    out = slim.mapInArrow(_rewrite(window, True), f"{kind}, n_words long, n_removed long, {last}")
    return out.select(*(F.col(f"key.{slots[c]}").alias(c) if c != "text" else F.col("text") for c in docs.columns))


def repeat_report(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by a space).

    A word goes if a window that covers it starts earlier too: in a smaller doc_id, or earlier in
    the same document. Null, empty and short texts lose nothing. Repeated rows are judged as
    documents one after another; rows without doc_id come last. A very long text is hashed whole, by one task. An empty
    table gives none. Other columns are ignored.
    """
    return _apply(docs, batches, window, False)


def remove_repeats(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW) -> DataFrame:
    """docs with the same columns and rows; texts that lose words become the words left, joined by a space.

    Texts that lose nothing stay as they are, null becomes empty. Repeated rows, null ids and empty tables as in ``repeat_report``.
    """
    return _apply(docs, batches, window, True)
