"""What filters take from each other: every order of five filters, by first-failure lookup.

One pass over the texts gives each document a slim row: its part, the mask of the filters that its text fails, and
a digest of the text. The repeat filter needs the whole table: a text's first id is found by a pre-aggregated
minimum, and a row keeps that filter if it is the first one, by an equi-join on (digest, id), so that no copy of a
hot text meets the others. A table that is computed once says for each of the 32 masks and 120 orders
at which step a document goes. Batches of masks index it, ``np.bincount`` adds removals up by part,
order, step and label, and the partial sums of all tasks are summed. Everything else follows from these sums.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import byte_rows, materialise, small_batches, text_bytes, tidy
from corvane.llm.wordhash import cut_words

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Under so many words; percent of distinct words; percent of capitals; signs.
LEAST_WORDS, DISTINCT, CAPITALS, SIGNS = 200, 50, 3, b"#$%&*|"
#: Sums of a part: (order, step), step 0 for what stays; parts whose sums a task holds; rows that are looked up at once.
CELLS, PARTS, ROWS = len(ORDERS) * (STEPS + 1), 1024, 4096
REPEAT = 1 << FILTERS.index("E")


def first_failures() -> np.ndarray:
    """(masks, orders): the step at which a document that fails the filters of a mask goes, 0 if it stays."""
    out = np.zeros((1 << STEPS, len(ORDERS)), dtype=np.int64)
    for mask in range(1 << STEPS):
        for at, order in enumerate(ORDERS):
            out[mask, at] = next((step for step, f in enumerate(order, 1) if mask >> FILTERS.index(f) & 1), 0)
    return out


_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[*SIGNS]] = 1
_KINDS[ord("A") : ord("Z") + 1] = 2
_KINDS[0x80:0xC0] = 3  # continues a code point


def text_masks(texts: list[bytes]) -> np.ndarray:
    """The mask of A to D for each text (UTF-8)."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    body, starts, lengths, owner = cut_words(texts)
    words = np.bincount(owner, minlength=n)
    distinct = np.zeros(n, dtype=np.int64)
    if len(starts):
        offsets = pa.py_buffer(np.r_[starts, len(body)].astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(body)]).dictionary_encode()
        pair = np.sort(owner * len(coded.dictionary) + coded.indices.to_numpy())
        pair = pair[np.r_[True, pair[1:] != pair[:-1]]]
        distinct = np.bincount(pair // len(coded.dictionary), minlength=n)
    # no sign, capital or part of a code point is a blank, so the bytes of words have them all; blanks are code points of their own
    kind = _KINDS[body]
    whose = np.repeat(owner, lengths)
    signs, capitals, inner = (np.bincount(whose[kind == k], minlength=n) for k in (1, 2, 3))
    fails = [words < LEAST_WORDS, 100 * distinct < DISTINCT * words, 100 * capitals > CAPITALS * (sizes - inner), signs > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


@tidy
def _read(batches):
    for part, texts in byte_rows(batches, "text", 128):
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(text_masks(texts), pa.int32())], names=["doc_id", "part", "digest", "mask"])


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row, with all five filters; read from a table of its own."""
    small_batches(docs.sparkSession)
    text = text_bytes()
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    slim = materialise(rows.mapInArrow(_read, "doc_id long, part string, digest binary, mask int"), "masks")
    known = slim.where("doc_id IS NOT NULL")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    each = known.join(firsts, ["digest", "doc_id"], "left")
    full = each.select("doc_id", "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(REPEAT)).alias("mask"))
    return full.unionByName(slim.where("doc_id IS NULL").select("doc_id", "part", "mask"))


def _tally(table: np.ndarray):
    """Partial sums (part, cell, removed, good, toxic), cell = order * 6 + step."""
    base = np.arange(len(ORDERS)) * (STEPS + 1)

    def out(sums: dict[str, np.ndarray]):
        for name, cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * CELLS), pa.array(np.arange(CELLS), pa.int32()), *(pa.array(c) for c in cells)], names=["part", "cell", "removed", "good", "toxic"])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                coded = batch.column(0).dictionary_encode()
                parts, who = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                cell = who[:, None] * CELLS + base + table[batch.column(1).to_numpy()]
                labels = [np.ones(len(who), dtype=bool), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))]
                got = np.stack([np.bincount(cell[some].ravel(), minlength=len(parts) * CELLS).reshape(-1, CELLS) for some in labels], axis=1)
                for name, cells in zip(parts, got, strict=True):
                    sums[name] = sums[name] + cells if name in sums else cells
                if len(sums) > PARTS:
                    yield from out(sums)
                    sums = {}
        yield from out(sums)

    return run


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters: A under 200 words; B under half of the words distinct; C over 3 % capitals A-Z; D one of the signs; E a row
    with a smaller id has the same text. part: ``lang``, null counting as the empty string. Null texts are empty
    ones; a row without id repeats nobody and is repeated by nobody; rows that share an id and a text don't
    repeat each other. A document is good or toxic if any row of ``labels`` with its id says 1; other values, nulls and rows
    without id say nothing. An empty table gives no rows. Whole texts are read, however long; other columns are ignored, whatever their names.
    """
    full = masks(docs)
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    no = F.lit(False)
    named = full.where("doc_id IS NOT NULL").join(said, "doc_id", "left").select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    rows = named.unionByName(full.where("doc_id IS NULL").select("part", "mask", no.alias("good"), no.alias("toxic")))
    partial = rows.mapInArrow(_tally(first_failures()), "part string, cell int, removed long, good long, toxic long")
    sums = partial.groupBy("part", "cell").agg(*(F.sum(c).alias(c) for c in ("removed", "good", "toxic")))
    orders = F.array(*map(F.lit, ORDERS))
    step = (F.col("cell") % (STEPS + 1)).cast("int")
    cells = sums.select("part", F.get(orders, F.floor(F.col("cell") / (STEPS + 1)).cast("int")).alias("filter_order"), step.alias("step"), "removed", "good", "toxic")
    cells = cells.withColumn("filter", F.when(F.col("step") > 0, F.substring("filter_order", F.col("step"), F.lit(1))))
    one = Window.partitionBy("part", "filter_order")
    so_far = F.sum(F.when(F.col("step") > 0, F.col("removed")).otherwise(0)).over(one.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    own = Window.partitionBy("part", "filter")
    # all that fail a filter go at its step where it comes first, those that fail no other where it comes last
    fails, alone = (F.max(F.when(F.col("step") == k, F.col("removed"))).over(own) for k in (1, STEPS))
    told = cells.select(
        "part", "filter_order", "step", "filter", (F.sum("removed").over(one) - so_far).alias("kept"), "removed", "good", "toxic",
        (fails - F.col("removed")).alias("redundant"), alone.alias("unique_fails"), F.sum("removed").over(own).alias("shapley"),
    )
    told = told.where("step > 0")
    return told.select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
