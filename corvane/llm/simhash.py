"""Near-duplicate documents by SimHash, candidate keys by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into A (23 bits), B (23 bits) and C (18 bits). The perfect
binary Golay code of length 23 puts every 23-bit word within three bits of exactly one
codeword. The keys of a word are all codewords within four bits: one key in about 13 of
100 words, six in the rest. Two words at most two bits apart always share a key (the
codeword nearest to a word between them is within four bits of both).

With at most three differing bits (a, b, c in A, B, C) one of these holds, so no link is lost:

* c = 0 and a <= 2: C equal, a shared key of A;
* c = 0 and a = 3: then b = 0, B and C equal;
* c > 0, a = 0: A equal, a shared key of B (b <= 2);
* c > 0, b = 0: B equal, a shared key of A (a <= 2);
* a = b = c = 1: a shared key of A, one half of B equal, one half of C equal (four families).

Keys are 30 to 41 bits long, so unrelated fingerprints seldom meet. Only distinct
fingerprints are linked: exact copies cost one row. A key with more members than
``BLOCK_LIMIT`` is cut into blocks and every pair of blocks is verified by its own task,
which returns a spanning forest rather than pairs.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import byte_rows, every, materialise, text_bytes, tidy
from corvane.llm.graph import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: A key with more distinct fingerprints than this is verified in pairs of blocks.
BLOCK_LIMIT, BLOCK_SIZE = 1024, 512
#: Generator x^11+x^9+x^7+x^6+x^5+x+1 of the binary Golay code (fixed value).
GENERATOR = 0xAE3


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of UTF-8 bytes: majority of each bit over the XXH64 of all word shingles."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only ASCII blanks split
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return majority(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=">u8"))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: the bits that are set in over half of them; zero for none."""
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def _fingerprints(shingle: int):
    @tidy
    def run(batches):
        for part, texts in byte_rows(batches):
            found = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row for each row of docs; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(
        _fingerprints(shingle), "doc_id long, fp long"
    )


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the high 11 and low 12 bits; error patterns of up to four bits and how many, by syndrome."""

    def syndrome(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    high = np.array([syndrome(x << 12) for x in range(2048)], dtype=np.int64)
    low = np.array([syndrome(x) for x in range(4096)], dtype=np.int64)
    patterns, many = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = high[e >> 12] ^ low[e & 0xFFF]
            patterns[s, many[s]] = e
            many[s] += 1
    return high, low, patterns, many


def codeword_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index): every codeword within four bits of each 23-bit word."""
    high, low, patterns, many = _golay()
    s = high[words >> 12] ^ low[words & 0xFFF]
    row = np.repeat(np.arange(len(words)), many[s])
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many[s]) - many[s], many[s])
    return row, (words[row] ^ patterns[s[row], nth]) >> 11  # the twelve data bits name the codeword


def link_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the candidate keys of uint64 fingerprints."""
    f = fps.astype(np.uint64)
    a = (f >> np.uint64(41)).astype(np.int64)
    b = (f >> np.uint64(18)).astype(np.int64) & 0x7FFFFF
    c = f.astype(np.int64) & 0x3FFFF
    ra, ka = codeword_keys(a)
    rb, kb = codeword_keys(b)
    rows, keys = [ra, np.arange(len(f)), rb, ra], [
        ka << 18 | c[ra],
        (1 << 48) | b << 18 | c,
        (2 << 48) | a[rb] << 12 | kb,
        (3 << 48) | b[ra] << 12 | ka,
    ]
    for n, (half_b, half_c) in enumerate(((b >> 12, c >> 9), (b >> 12, c & 511), (b & 4095, c >> 9), (b & 4095, c & 511))):
        rows.append(ra)
        keys.append(((4 + n) << 48) | (half_b[ra] << 9 | half_c[ra]) << 12 | ka)
    return np.concatenate(rows), np.concatenate(keys)


@tidy
def _emit_keys(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            fps, reps = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            row, key = link_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row]), pa.array(reps[row])], names=["key", "fp", "rep"])


def _forest(fps: np.ndarray, reps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member of a block to the smallest rep it is linked with inside the block."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = reps.copy()
    while True:
        least = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (least == label).all():
            break
        label = least
    moved = label != reps
    return reps[moved], label[moved]


def _verify(radius: int):
    def linked(key, fps, reps):
        """Links of complete groups, given in order of key."""
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        us, vs = [], []
        small = np.repeat(size <= 12, size)
        for off in range(1, min(12, int(size.max(initial=0)))):
            i = np.flatnonzero(small[:-off] & (key[off:] == key[:-off]))
            i = i[np.bitwise_count(fps[i] ^ fps[i + off]) <= radius]
            us.append(reps[i])
            vs.append(reps[i + off])
        for at, n in zip(start[size > 12], size[size > 12], strict=True):
            u, v = _forest(fps[at : at + n], reps[at : at + n], radius)
            us.append(u)
            vs.append(v)
        edges = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], axis=1), axis=0) if us else np.empty((0, 2), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])

    @tidy
    def run(batches):
        kept = None  # the last group of a batch may go on in the next one
        for batch in batches:
            group, fps, reps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fps = fps.view(np.uint64)
            if kept is not None:
                group, fps, reps = (np.concatenate(x) for x in zip(kept, (group, fps, reps), strict=True))
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
            kept = group[cut:], fps[cut:], reps[cut:]
            if cut:
                yield linked(group[:cut], fps[:cut], reps[:cut])
        if kept is not None and len(kept[0]):
            yield linked(*kept)

    return run


def keyed(fps: DataFrame) -> DataFrame:
    """(key, fp, rep): the candidate keys of ``fps(fp long, rep long)``."""
    return fps.select("fp", "rep").mapInArrow(_emit_keys, "key long, fp long, rep long")


def links(fps: DataFrame, radius: int = RADIUS, block_limit: int = BLOCK_LIMIT, block_size: int = BLOCK_SIZE) -> DataFrame:
    """(u, v): edges between the reps of ``fps(fp long, rep long)`` (distinct fp) that
    connect exactly what links at ``radius`` or fewer differing bits connect."""
    keys = materialise(keyed(fps), "keys")
    many = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-keys")
    met = (
        # with bare shuffles on both sides a frequent key is split when the join is skewed
        keys.join(many, "key")
        .withColumn("blocks", F.when(F.col("n") > block_limit, F.ceil(F.col("n") / block_size)).otherwise(1))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    )
    grouped = met.select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "fp", "rep"
    )
    return grouped.repartition("group").sortWithinPartitions("group").mapInArrow(_verify(radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Words are lower-cased in A-Z; documents without words (null, empty, blank) have
    fingerprint zero and are linked like any other. component_id is the smallest doc_id
    reachable over links of at most ``radius`` bits. Repeated rows are returned as often as
    they come. A row without doc_id gets its group's component, or null if no member has
    an id. A very long text is hashed whole, by one task; an empty table gives none. Other columns are ignored, whatever
    their names.
    """
    found = materialise(fingerprints(docs, shingle), "fingerprints")
    fps = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(links(fps.where("rep IS NOT NULL"), radius))
    joined = fps.join(roots, fps.rep == roots.node, "left")
    classes = joined.select("fp", F.coalesce("root", "rep").alias("component_id"))
    return found.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the smallest doc_id, then hash of the text.

    Rows count one by one: rows that share a doc_id but no text go by their own groups, equal rows leave one, and rows
    without doc_id come last in their group. All columns stay, whatever their names.
    """
    line = F.xxhash64(F.col("doc_id").cast("long"), "text")
    rows = docs.select(line.alias("doc_id"), "text")
    groups = near_duplicates(rows, shingle, radius).select(F.col("doc_id").alias("line"), "component_id")
    named = docs.select(line.alias("line"), F.col("doc_id").cast("long").alias("doc_id")).join(groups.distinct(), "line")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "line")).alias("first"))
    whole = docs.select(line.alias("line"), F.struct(*every(docs)).alias("row"))
    return whole.join(first.select(F.col("first.line").alias("line")), "line", "left_semi").dropDuplicates(["line"]).select("row.*")
