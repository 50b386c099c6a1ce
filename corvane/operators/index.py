"""A BM25 index that is kept, grows by appends, and answers question sets from the parts they ask for.

The index is a folder of segments and a log of manifests (``sources.storage``). A segment holds, of the documents of one append:

* ``documents``: (doc, key, dl), in buckets of the key. ``doc`` is a number that never changes; 64 numbers in a row are a block.
* ``postings``: one row for each (term, block), in buckets of the term: which of the block's documents have the term, as 64 bits, the largest tf and
  the smallest length among them, which bound what any of them can score, and slots, tfs and dls of each. The documents of a block are numbered by one task, which packs
  their postings as well, so packed rows alone are shuffled. (A block that two tasks read has two rows of a term with different bits, which count like one.)
* ``terms``: (term, df): by how much the append changes the term's number of documents, in the same buckets. Replaced documents count negatively.
* ``dead``: (block, bits): documents of earlier segments that this append replaces.

A search reads the buckets of its terms only. Block bounds give what a question can score in a block at most; its two most promising blocks are
scored, and then only the blocks whose bound reaches the score that is needed by then. How many documents match at all, which the
scaled scores depend on, is counted from the bits. A question that needs every score (a negative weight, or all documents match) gets every block.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.frames import bounded_batches, spread
from corvane.functions.text import search_tokens
from corvane.operators import lexical
from corvane.operators.lexical import once
from corvane.settings import SETTINGS
from corvane.sources.storage import Log, bucket_of, materialise

BLOCK = 64
#: Documents that wait before an append, chunks of text in the reference's terms; blocks scored first.
DEFERRED, FIRST = 500, 4
#: A row of postings; documents that are packed at once.
PACKED, STEP = "term string, block long, entries array<int>", 1024


@dataclass
class Index:
    """An index in a folder; ``key`` names the id column of its documents, which may be of any type."""

    spark: SparkSession
    folder: str
    key: str = "doc_id"
    buckets: int = 32

    def __post_init__(self):
        self.folder = self.folder.rstrip("/")
        self.log = Log(self.spark, self.folder)
        self.tables: dict[tuple[str, str], DataFrame] = {}  # a segment never changes, so its files are listed once

    # what there is

    def state(self) -> dict:
        """The newest manifest: segments, n (documents), length (tokens), mean (idf over all terms before replacement), kind of key, next number, waiting batches, its version."""
        version = self.log.version()
        found = self.log.get(version) or {"segments": [], "n": 0, "length": 0, "mean": 0.0, "kind": None, "next": 0, "waiting": []}
        return found | {"version": version}

    def _read(self, name: str, segments: list[str], buckets: list[int] | None = None, kind: str = "string") -> DataFrame:
        """A table of some segments; of the given buckets only, if there are any given."""
        schema = {
            "documents": f"doc long, key {kind}, dl long, bucket int",
            "postings": "term string, block long, bits long, most int, least int, slots array<tinyint>, tfs array<int>, dls array<int>, bucket int",
            "terms": "term string, df long, bucket int",
            "dead": "block long, bits long",
        }[name]
        if not segments:
            return self.spark.createDataFrame([], schema)
        out = None
        for s in segments:
            if (s, name) not in self.tables:
                self.tables[s, name] = self.spark.read.schema(schema).parquet(f"{self.folder}/{s}/{name}")
            part = self.tables[s, name]
            out = part if out is None else out.unionByName(part)
        return out if buckets is None else out.where(F.col("bucket").isin(buckets))

    def documents(self) -> DataFrame:
        """(doc, key, dl) of the documents that count."""
        state = self.state()
        rows = self._read("documents", state["segments"], kind=state["kind"] or "string").select("doc", "key", "dl")
        return self._alive(rows.withColumn("block", F.shiftright("doc", 6)), state["segments"]).select("doc", "key", "dl")

    def _alive(self, rows: DataFrame, segments: list[str]) -> DataFrame:
        """rows(doc, block, ...) without dead documents."""
        if len(segments) < 2:  # only a later segment replaces anything
            return rows.drop("block")
        met = rows.join(self._dead(segments), "block", "left")
        return met.where("dead IS NULL OR shiftright(dead, CAST(doc % 64 AS INT)) & 1 = 0").drop("dead", "block")

    def _dead(self, segments: list[str]) -> DataFrame:
        return self._read("dead", segments).groupBy("block").agg(F.bit_or("bits").alias("dead"))

    # how it grows

    def append(self, docs: DataFrame, text: str = "text") -> None:
        """Takes in documents (key, text); one that is there already is replaced, of rows with one key the smallest text counts."""
        self._commit(self._segment(docs.select(self.key, text).withColumnRenamed(text, "text"), self.state()))

    def defer(self, docs: DataFrame, text: str = "text", least: int = DEFERRED) -> bool:
        """Keeps documents until ``least`` wait, then takes all in; True if it did. A search flushes first."""
        state = self.state()
        path = f"waiting/{uuid.uuid4().hex}"
        docs.select(self.key, F.col(text).alias("text"), F.lit(len(state["waiting"])).alias("batch")).write.parquet(f"{self.folder}/{path}")
        n = self.spark.read.parquet(f"{self.folder}/{path}").count()
        state["waiting"] = [*state["waiting"], [path, n]]
        self._commit(state)
        if sum(m for _, m in state["waiting"]) < least:
            return False
        return self.flush()

    def flush(self) -> bool:
        """Takes in what waits; of documents that wait twice the later batch counts."""
        state = self.state()
        if not state["waiting"]:
            return False
        rows = self.spark.read.parquet(*(f"{self.folder}/{p}" for p, _ in state["waiting"]))
        last = rows.groupBy(self.key).agg(F.max("batch").alias("batch"))
        done = dict(state, waiting=[])
        self._commit(self._segment(rows.join(last, [self.key, "batch"]).select(self.key, "text"), done))
        for path, _ in state["waiting"]:
            self.log.delete(f"{self.folder}/{path}")
        return True

    def _segment(self, docs: DataFrame, state: dict) -> dict:
        """Writes a segment and returns the manifest that has it."""
        number = 1 + max((int(s.split("-")[1]) for s in state["segments"]), default=0)
        name = f"segment-{number}-{uuid.uuid4().hex}"
        kind = docs.schema[self.key].dataType.simpleString()
        if state["kind"] not in (None, kind):
            raise ValueError(f"keys of this index are {state['kind']}, not {kind}")
        rows = spread(once(docs, self.key, "text")).select(F.col(self.key).alias("key"), "text")
        # a partition's documents have numbers in a row, so their blocks are full; documents of about one length share a block, whose bounds are tight then
        tokens = F.coalesce(search_tokens("text"), F.array().cast("array<string>")).alias("tokens")
        numbered = rows.sortWithinPartitions(F.length("text")).select((F.lit(state["next"]) + F.monotonically_increasing_id()).alias("doc"), "key", tokens)
        return self._write(name, materialise(numbered, "tokens"), state, kind)

    def _write(self, name: str, numbered: DataFrame, state: dict, kind: str) -> dict:
        folder = f"{self.folder}/{name}"
        bounded_batches(self.spark)
        packed = numbered.select("doc", "tokens").mapInArrow(_packed, PACKED).withColumn("bucket", bucket_of("term", self.buckets))
        _unpacked(packed.repartition("bucket").sortWithinPartitions("term", "block")).write.partitionBy("bucket").parquet(f"{folder}/postings")
        full = numbered.select("doc", "key", F.size("tokens").cast("long").alias("dl"))
        full.withColumn("bucket", bucket_of("key", self.buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/documents")
        # what this append replaces
        asked = [r[0] for r in numbered.select(bucket_of("key", self.buckets).alias("b")).distinct().collect()]  # bucket numbers
        old = self._read("documents", state["segments"], asked, kind).drop("bucket")
        old = self._alive(old.withColumn("block", F.shiftright("doc", 6)), state["segments"])
        gone = materialise(old.join(numbered.select("key"), "key", "left_semi"), "replaced")
        gone.groupBy(F.shiftright("doc", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(doc % 64 AS INT))")).alias("bits")).write.parquet(f"{folder}/dead")
        came = numbered.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0)).alias("length"), F.coalesce(F.max("doc"), F.lit(0)).alias("last")).first()
        left = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        change = self._read("postings", [name]).select("term", "bucket", F.bit_count("bits").cast("long").alias("df"))
        if left["n"]:
            dead = F.broadcast(self._read("dead", [name]).withColumnRenamed("bits", "dead"))  # 16 bytes for 64 documents
            less = self._read("postings", state["segments"]).join(dead, "block").select("term", "bucket", (-F.bit_count(F.expr("bits & dead"))).cast("long").alias("df"))
            change = change.unionByName(less)
        change = change.groupBy("term", "bucket").agg(F.sum("df").alias("df")).where("df <> 0")
        change.repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{folder}/terms")
        out = dict(state, segments=[*state["segments"], name], n=state["n"] + came["n"] - left["n"], length=state["length"] + came["length"] - left["length"], kind=kind)
        out["next"] = max(state["next"], (came["last"] // BLOCK + 1) * BLOCK)
        return out | {"mean": self._mean(out)}

    def _mean(self, state: dict) -> float:
        """The mean idf of all terms before negative ones are replaced."""
        df = self._read("terms", state["segments"]).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return df.agg(F.avg(_idf(F.col("df"), state["n"]))).first()[0] or 0.0

    def _commit(self, state: dict) -> None:
        """The next version, unless somebody else has written since ``state`` was read."""
        self.log.add({k: v for k, v in state.items() if k != "version"}, state["version"])

    def merge(self) -> None:
        """All segments as one, without dead documents and without reading a text again.

        The files of a segment hold a bucket each, so postings and documents are written where they are read, without a shuffle.
        """
        before = self.state()
        if not before["segments"]:
            return
        name = f"segment-{1 + max(int(s.split('-')[1]) for s in before['segments'])}-{uuid.uuid4().hex}"
        folder, segments = f"{self.folder}/{name}", before["segments"]
        docs = self._read("documents", segments, kind=before["kind"])
        self._alive(docs.withColumn("block", F.shiftright("doc", 6)), segments).sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{folder}/documents")
        rows = self._read("postings", segments).join(self._dead(segments), "block", "left")
        rows = rows.where("bits & ~coalesce(dead, 0L) <> 0")
        whole = rows.withColumns({c: F.expr(f"CASE WHEN bits & coalesce(dead, 0L) = 0 THEN {c} ELSE filter({c}, (e, i) -> shiftright(dead, CAST(slots[i] AS INT)) & 1 = 0) END") for c in ("slots", "tfs", "dls")} | {"bits": F.expr("bits & ~coalesce(dead, 0L)")})
        whole = whole.withColumns({"most": F.array_max("tfs"), "least": F.array_min("dls")}).drop("dead")
        whole.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{folder}/postings")
        df = self._read("terms", segments).groupBy("term", "bucket").agg(F.sum("df").alias("df")).where("df > 0")
        df.repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{folder}/terms")
        self._read("dead", []).write.parquet(f"{folder}/dead")
        self._commit(dict(before, segments=[name]))

    # how it answers

    def figures(self) -> DataFrame:
        """(term, df, idf) of the whole index."""
        state = self.state()
        df = self._read("terms", state["segments"]).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return df.withColumn("idf", _weight(F.col("df"), state))

    def search(self, queries: DataFrame, top: int, qkey: str | list[str] = "item_id") -> DataFrame:
        """(qkey, key, raw, score, rnk) as ``lexical.search`` gives them for the documents of the index; flushes first.

        The postings of a question set whose terms make a matrix of up to ``lexical.MATRIX_BYTES`` are dealt out by block and multiplied with it; those of a
        larger set are joined with it. Both leave out blocks that cannot reach a question's first ``top`` documents.
        """
        if self.state()["waiting"]:
            self.flush()
        state = self.state()
        q = [qkey] if isinstance(qkey, str) else list(qkey)
        terms = lexical.asked_terms(queries, q)
        found = terms.limit(lexical.BROADCAST_ROWS + 1).collect()
        names, keys = sorted({r["term"] for r in found}), sorted({tuple(r[k] for k in q) for r in found})
        if len(found) > lexical.BROADCAST_ROWS or len(names) * len(keys) * 8 > lexical.MATRIX_BYTES:
            return self._joined(terms, state, top, q)
        # which buckets these terms are in, and how many documents have them
        spark, segments = self.spark, state["segments"]
        asked = spark.createDataFrame(pa.table({"term": pa.array(names, pa.string())}), "term string").withColumn("bucket", bucket_of("term", self.buckets))
        buckets = sorted(r[0] for r in asked.select("bucket").distinct().collect())
        terms_of = F.broadcast(asked.select("term"))  # at most ``BROADCAST_ROWS``
        df = self._read("terms", segments, buckets).join(terms_of, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").withColumn("w", _weight(F.col("df"), state))
        known = {r["term"]: (r["df"], r["w"]) for r in df.collect()}  # asked terms only
        number, place = {k: i for i, k in enumerate(keys)}, {t: i for i, t in enumerate(names)}
        weights, asks = np.zeros((len(names), len(keys))), np.zeros((len(names), len(keys)), dtype=np.float32)
        for r in found:
            at = place[r["term"]], number[tuple(r[k] for k in q)]
            weights[at], asks[at] = r["qtf"] * known.get(r["term"], (0, 0.0))[1], 1
        most_met = np.array([known.get(t, (0, 0.0))[0] for t in names], dtype=float) @ (asks > 0)
        whole = (most_met >= state["n"]) | (weights < 0).any(axis=0)  # these need every score
        post = self._read("postings", segments, buckets).join(terms_of, "term", "left_semi")
        dead = F.lit(0).cast("long")
        if len(segments) > 1:
            post, dead = post.join(self._dead(segments), "block", "left"), F.coalesce("dead", F.lit(0).cast("long"))
        rows = post.select("block", "term", "bits", "most", "least", "slots", "tfs", "dls", dead.alias("dead"))
        rows = rows.repartition("block").sortWithinPartitions("block")
        shared = _blockwise(names, weights, asks, whole, state["length"] / state["n"] if state["length"] else 1.0, top)
        scored = rows.mapInArrow(shared, "_q int, doc_id long, raw double, high double, met long")
        spread = lexical.spread_out(scored, state["n"]).withColumnRenamed("doc_id", "doc").where("raw > 0 AND high > low")
        kind = state["kind"] or "string"
        named = spread.join(self._read("documents", segments, kind=kind).select("doc", "key"), "doc").withColumnRenamed("key", self.key)
        named = named.withColumn("score", F.round((F.col("raw") - F.col("low")) / (F.col("high") - F.col("low")), 6))
        rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), F.col(f"`{self.key}`")))
        kept = named.withColumn("rnk", rank).where(F.col("rnk") <= top)
        return kept.join(F.broadcast(lexical.numbered_queries(queries, keys, q)), "_q").select(*q, self.key, F.round("raw", 6).alias("raw"), "score", "rnk")

    def _joined(self, terms: DataFrame, state: dict, top: int, q: list[str]) -> DataFrame:
        """The same for a question set of any size."""
        segments = state["segments"]
        asked = sorted(r[0] for r in terms.select(bucket_of("term", self.buckets)).distinct().collect())  # bucket numbers
        df = self._read("terms", segments, asked).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        weights = materialise(terms.join(df, "term").select(*q, "term", (F.col("qtf") * _weight(F.col("df"), state)).alias("w")), "weights")
        post = self._read("postings", segments, asked)
        gain = _gain(state["length"] / state["n"] if state["length"] else 1.0)
        # what each question can score in each block, and which documents match
        met = post.select("term", "block", "bits", "most", "least").join(weights, "term")
        bound = F.sum(F.greatest(F.col("w"), F.lit(0.0)) * gain(F.col("most"), F.col("least")))
        blocks = met.groupBy(*q, "block").agg(bound.alias("bound"), F.bit_or("bits").alias("bits"), F.min("w").alias("w"))
        if len(segments) > 1:
            blocks = blocks.join(self._dead(segments), "block", "left").withColumn("bits", F.expr("bits & ~coalesce(dead, 0L)")).drop("dead")
        one = Window.partitionBy(*q)
        nth = F.row_number().over(one.orderBy(F.desc("bound"), "block"))
        whole = (F.min("w").over(one) < 0) | (F.sum(F.bit_count("bits")).over(one) >= F.lit(state["n"]))
        blocks = materialise(blocks.where("bits <> 0").select(*q, "block", "bound", nth.alias("nth"), whole.alias("whole"), F.max("bound").over(one).alias("most")), "blocks")

        def scored(some: DataFrame, *more: str) -> DataFrame:
            """(q, doc, raw, more) of some(q, block, more)."""
            each = post.select("term", "block", "slots", "tfs", "dls").join(weights, "term").join(some, [*q, "block"])
            # dealt out before entries become rows, as the terms of a block come from many buckets
            each = each.select(*q, *more, "block", "w", "slots", "tfs", "dls").repartition(*q, "block").select(*q, *more, "block", "w", F.explode(F.arrays_zip("slots", "tfs", "dls")).alias("e"))
            raw = F.sum(F.col("w") * gain(F.col("e.tfs"), F.col("e.dls")))
            out = each.groupBy(*q, *more, "block", F.col("e.slots").alias("slot")).agg(raw.alias("raw")).withColumn("doc", F.col("block") * BLOCK + F.col("slot"))
            return self._alive(out, segments).select(*q, *more, "doc", "raw")

        slack = 1e-5  # scores are rounded to six places of the best
        first = scored(blocks.where((F.col("nth") <= FIRST) & ~F.col("whole")).select(*q, "block"))
        k = F.row_number().over(one.orderBy(F.desc("raw")))
        needed = first.withColumn("k", k).where(F.col("k") == top).select(*q, F.col("raw").alias("needed"))
        # without top documents in the first blocks, or where every score is asked for, every block and document counts
        least = F.when(F.col("whole") | F.col("needed").isNull(), F.lit(float("-inf"))).otherwise(F.col("needed") - slack * F.col("most"))
        rest = blocks.join(needed, q, "left").withColumn("least", least).where(F.col("bound") >= F.col("least"))
        # a table of its own: where it is small Spark sends it to the postings instead of dealing these out
        rest = materialise(rest.select(*q, "block", "whole", "least"), "reached")
        found = scored(rest, "whole", "least").where(F.col("raw") >= F.col("least"))
        # where not all documents match the lowest score is 0 or, with negative weights, below
        matched = F.count(F.lit(1)).over(one)
        low = F.when(~F.col("whole"), F.lit(0.0)).when(matched < F.lit(state["n"]), F.least(F.lit(0.0), F.min("raw").over(one))).otherwise(F.min("raw").over(one))
        found = found.select(*q, "doc", "raw", low.alias("low"), F.max("raw").over(one).alias("high"), k.alias("k"))
        # what may be among the first after rounding: ties are broken by the key, which comes last
        last = F.max(F.when(F.col("k") <= top, -F.col("raw"))).over(one)
        found = found.withColumn("last", -last)
        near = found.where("raw > 0 AND high > low").where(F.col("raw") >= F.col("last") - slack * (F.col("high") - F.col("low")))
        named = near.join(self._read("documents", segments, kind=state["kind"] or "string").select("doc", "key"), "doc")
        named = named.withColumn("score", F.round((F.col("raw") - F.col("low")) / (F.col("high") - F.col("low")), 6))
        rank = F.row_number().over(one.orderBy(F.desc("score"), "key"))
        out = named.withColumn("rnk", rank).where(F.col("rnk") <= top)
        return out.select(*q, F.col("key").alias(self.key), F.round("raw", 6).alias("raw"), "score", "rnk")


def _packed(batches):
    """Rows of postings of (doc, tokens), whose blocks come one after another."""
    held = None  # the last block may go on in the next batch
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = pa.Table.from_batches([batch.slice(at, STEP)])
            part = part if held is None else pa.concat_tables([held, part])
            block = part.column(0).to_numpy() >> 6
            before = np.flatnonzero(block != block[-1])
            cut = int(before[-1]) + 1 if len(before) else 0
            yield from _pack(part.slice(0, cut))
            held = part.slice(cut)
    if held is not None:
        yield from _pack(held)


def _pack(part: pa.Table):
    tokens = part.column(1).combine_chunks()
    flat = tokens.flatten().dictionary_encode() if part.num_rows else ()
    if not len(flat):
        return
    docs, dl = part.column(0).to_numpy(), pc.list_value_length(tokens).to_numpy().astype(np.int32)
    blocks, nth = np.unique(docs >> 6, return_inverse=True)
    place, many = nth * BLOCK + (docs & 63), len(flat.dictionary)
    lengths = np.zeros(len(blocks) * BLOCK, dtype=np.int32)
    lengths[place] = dl
    place = np.repeat(place, dl)
    found, tf = np.unique(((place >> 6) * many + flat.indices.to_numpy()) << 6 | place & 63, return_counts=True)
    group, slot, tf = found >> 6, found & 63, tf.astype(np.int32)
    each = lengths[group // many * BLOCK + slot]
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    group, many_of = group[start], np.diff(np.r_[start, len(found)])
    # the slots of a row, then its tfs, then its dls
    at, entries = np.arange(len(found)) + np.repeat(2 * start, many_of), np.empty(3 * len(found), dtype=np.int32)
    for k, x in enumerate((slot, tf, each)):
        entries[at + k * np.repeat(many_of, many_of)] = x
    yield pa.RecordBatch.from_arrays(
        [
            flat.dictionary.take(pa.array(group % many)),
            pa.array(blocks[group // many]),
            pa.ListArray.from_arrays(pa.array(3 * np.r_[start, len(found)].astype(np.int32)), pa.array(entries)),
        ],
        names=["term", "block", "entries"],
    )


def _unpacked(rows: DataFrame) -> DataFrame:
    """Rows of postings as they are stored."""
    n = (F.size("entries") / 3).cast("int")
    slots, tfs, dls = (F.slice("entries", k * n + 1, n) for k in range(3))
    bits = F.aggregate("slots", F.lit(0).cast("long"), lambda b, s: b.bitwiseOR(F.call_function("shiftleft", F.expr("1L"), s.cast("int"))))
    split = rows.select("term", "block", slots.cast("array<tinyint>").alias("slots"), tfs.alias("tfs"), dls.alias("dls"), "bucket")
    return split.select("term", "block", bits.alias("bits"), F.array_max("tfs").alias("most"), F.array_min("dls").alias("least"), "slots", "tfs", "dls", "bucket")


def _blockwise(names: list[str], weights: np.ndarray, asks: np.ndarray, whole: np.ndarray, mean: float, top: int):
    """Scores of every question for the documents of one block after another; what a block can reach at most tells which questions it is scored for.

    weights, asks: (terms, questions); whole: questions that need the score of every document.
    """
    k1, b = SETTINGS.k1, SETTINGS.b
    queries = weights.shape[1]
    slack = 1e-6 * np.abs(weights).sum(axis=0) * (k1 + 1)

    def gain(tf, dl):
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))

    def run(batches):
        dictionary = pa.array(names, pa.string())
        low, high, met = np.full(queries, np.inf), np.full(queries, -np.inf), np.zeros(queries, dtype=np.int64)
        best: list = []
        needed = np.full(queries, -np.inf)

        def settle():
            nonlocal best
            best = [lexical.strongest(best, queries, top, slack)]
            q, _, r = best[0]
            first = np.searchsorted(q, np.arange(queries))
            full = np.searchsorted(q, np.arange(queries), side="right") - first >= top
            at = np.minimum(first + top - 1, max(len(r) - 1, 0))
            needed[full] = r[at[full]]

        def score(part: pa.RecordBatch | pa.Table, block: int) -> None:
            term = pc.index_in(part.column("term"), value_set=dictionary).to_numpy()
            bits = part.column("bits").to_numpy() & ~part.column("dead").to_numpy()
            there = (bits[:, None] >> np.arange(BLOCK)) & 1
            w = weights[term]
            hit = there.T.astype(np.float32) @ asks[term] > 0
            met[:] += hit.sum(axis=0)
            bound = gain(part.column("most").to_numpy().astype(float), part.column("least").to_numpy()) @ np.maximum(w, 0)
            asked = np.flatnonzero((hit.any(axis=0)) & (whole | (bound >= needed - slack)))
            if not len(asked):
                return
            slots, tfs, dls = (part.column(c).combine_chunks() if isinstance(part, pa.Table) else part.column(c) for c in ("slots", "tfs", "dls"))
            row = np.repeat(np.arange(len(term)), np.diff(slots.offsets.to_numpy()))
            matrix = np.zeros((len(term), BLOCK))
            matrix[row, slots.flatten().to_numpy()] = gain(tfs.flatten().to_numpy().astype(float), dls.flatten().to_numpy())
            raw = (matrix * there).T @ w[:, asked]
            hit = hit[:, asked]
            low[asked] = np.minimum(low[asked], np.where(hit, raw, np.inf).min(axis=0))
            high[asked] = np.maximum(high[asked], np.where(hit, raw, -np.inf).max(axis=0))
            i, j = np.nonzero(hit & (raw > 0) & (raw >= (needed - slack)[asked]))
            best.append((asked[j], block * BLOCK + i, raw[i, j]))
            if sum(len(x[0]) for x in best[1:]) > max(1 << 12, 2 * len(best[0][0])):
                settle()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)] if len(block) else np.array([0])
            for begin, end in zip(edges, edges[1:]):
                part = batch.slice(begin, end - begin)
                if held and held[0].column("block")[0].as_py() != part.column("block")[0].as_py():
                    score(pa.Table.from_batches(held).combine_chunks(), held[0].column("block")[0].as_py())
                    held = []
                held.append(part)
        if held:
            score(pa.Table.from_batches(held).combine_chunks(), held[0].column("block")[0].as_py())
        if sum(len(x[0]) for x in best):
            settle()
            q, d, r = best[0]
        else:
            q, d, r = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        yield lexical.spread_rows(q, d, r, pa.int64(), low, high, met)

    return run


def _idf(df: Column, n: int) -> Column:
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def _weight(df: Column, state: dict) -> Column:
    raw = _idf(df, state["n"])
    return F.when(raw < 0, F.lit(SETTINGS.epsilon * state["mean"])).otherwise(raw)


def _gain(mean: float):
    """What a term adds for its tf in a text of some length, per unit of weight."""
    k1, b = SETTINGS.k1, SETTINGS.b
    return lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(mean)))
