"""BM25 in two passes over the texts: document frequencies first, then only the terms that are asked for.

No text and no posting of a term that nobody asks for is ever shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.frames import bounded_batches, spread
from corvane.functions.text import search_tokens
from corvane.functions.topk import sortable
from corvane.settings import SETTINGS

#: Rows of (query, term) and bytes of their matrix that go to every task at most; a larger query set is joined by a shuffle.
BROADCAST_ROWS, MATRIX_BYTES = 200_000, 64 << 20
#: Scores that a task keeps before it sorts them, unless its best rows are half as many already.
KEPT = 1 << 18


def once(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with distinct keys: of rows that share one the smallest text counts. Rows without key are left out.

    Only keys are shuffled, unless some do repeat.
    """
    rows = docs.select(key, text).where(F.col(key).isNotNull())
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    if many.isEmpty():
        return rows
    first = rows.join(many, key, "left_semi").groupBy(key).agg(F.min(text).alias(text))
    return rows.join(many, key, "left_anti").unionByName(first)


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl, tokens), one row for each distinct key."""
    rows = spread(once(docs, key, text)).select(key, F.coalesce(search_tokens(text), F.array().cast("array<string>")).alias("tokens"))
    return rows.select(key, F.size("tokens").cast("long").alias("dl"), "tokens")


def _counted(tokens: str) -> Column:
    """(term, tf) of an array of terms, in order of term: equal ones lie side by side once it is sorted. Lambda variables hold the arrays, as a column would be computed anew for every element."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        return F.get(F.transform(F.array(starts), lambda s: F.transform(s, lambda i, k: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t)) - i).cast("long").alias("tf")))), F.lit(0))

    return F.when(F.size(tokens) > 0, F.get(F.transform(F.array(F.sort_array(tokens)), runs), F.lit(0)))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl, term, tf): the whole index, for one that is kept (``files.write_postings``). A document's terms are counted in its row, so nothing is held or shuffled for them."""
    each = tokenised(docs, key, text).select(key, "dl", F.explode_outer(_counted("tokens")).alias("_p"))
    return each.select(key, "dl", "_p.term", "_p.tf").where("term IS NOT NULL")


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return tokenised(docs, key, text).select(key, "dl")


def term_weights(tokens: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf) of ``tokenised``; a negative idf becomes epsilon times the mean idf before replacement."""
    # outer: an inferred filter on the number of tokens would tokenise every text once more, at the scan
    terms = tokens.select(F.explode_outer(F.array_distinct("tokens")).alias("term")).where("term IS NOT NULL")
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.withColumn("raw", F.ln(n_docs - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    idf = F.when(F.col("raw") < 0, SETTINGS.epsilon * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"))


def _figures(rows: DataFrame, asked: DataFrame) -> tuple[int, float, dict[str, float]]:
    """Documents, mean length and idf of the asked terms, from one pass over the texts.

    An empty term stands for the document itself. What comes to the driver are the asked terms and how many terms
    have each document frequency.
    """
    marks = F.array_append(F.array_distinct("tokens"), F.lit(""))
    each = rows.select(F.explode_outer(marks).alias("term"), "dl")
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl")).otherwise(0)).alias("m"))
    marked = df.join(F.broadcast(asked.withColumn("_asked", F.lit(True))), "term", "left")
    # one grouping: a row for each asked term and the document's, one for each frequency of the others
    own = F.when(F.col("_asked") | (F.col("term") == ""), F.col("term"))
    found = marked.groupBy(own.alias("term"), "df").agg(F.count(F.lit(1)).alias("terms"), F.sum("m").alias("m")).collect()
    whole = next((r for r in found if r["term"] == ""), None)
    if whole is None:
        return 0, 1.0, {}
    n = whole["df"]

    def idf(k: int) -> float:
        return math.log(n - k + 0.5) - math.log(k + 0.5)

    often = [(r["df"], r["terms"]) for r in found if r["term"] != ""]
    mean = sum(idf(k) * m for k, m in often) / max(1, sum(m for _, m in often))
    weights = {r["term"]: idf(r["df"]) if idf(r["df"]) >= 0 else SETTINGS.epsilon * mean for r in found if r["term"]}
    return n, whole["m"] / n, weights


def strongest(parts, queries: int, top: int, slack: np.ndarray):
    """(query, id, score) arrays, joined, without what is worse than a query's ``top`` best by more than its slack."""
    q, d, r = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((-r, q))
    q, d, r = q[order], d[order], r[order]
    first = np.searchsorted(q, np.arange(queries))
    many = np.searchsorted(q, np.arange(queries), side="right") - first
    last = np.where(many >= top, r[np.minimum(first + top - 1, len(r) - 1)], -np.inf)
    kept = r >= (last - slack)[q]
    return q[kept], d[kept], r[kept]


def spread_rows(q, d, r, kind: pa.DataType, low, high, met) -> pa.RecordBatch:
    """A task's best rows and, with a null id, what it has seen of each query: lowest and highest score, matching documents."""
    some = np.flatnonzero(met)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[q, some], pa.int32()),
            pa.concat_arrays([pa.array(d.tolist(), kind), pa.nulls(len(some), kind)]),
            pa.array(np.r_[r, low[some]]),
            pa.array(np.r_[np.zeros(len(q)), high[some]]),
            pa.array(np.r_[np.zeros(len(q), dtype=np.int64), met[some]], pa.int64()),
        ],
        names=["_q", "doc_id", "raw", "high", "met"],
    )


def asked_terms(queries: DataFrame, q: list[str]) -> DataFrame:
    """(q, term, qtf) of questions with text."""
    return queries.select(*q, F.explode_outer(search_tokens("text")).alias("term")).where("term IS NOT NULL").groupBy(*q, "term").agg(F.count(F.lit(1)).alias("qtf"))


def numbered_queries(queries: DataFrame, keys: list[tuple], q: list[str]) -> DataFrame:
    """(_q, q): the questions' numbers, from the driver."""
    kinds = [queries.schema[c].dataType.simpleString() for c in q]
    named = pa.table({"_q": pa.array(range(len(keys)), pa.int32()), **{c: [k[at] for k in keys] for at, c in enumerate(q)}})
    return queries.sparkSession.createDataFrame(named).select("_q", *(F.col(c).cast(kind).alias(c) for c, kind in zip(q, kinds, strict=True)))


def spread_out(scored: DataFrame, n: int) -> DataFrame:
    """(_q, doc_id, raw, low, high) of the rows of ``spread_rows``: with the spread of a query over all documents."""
    w = Window.partitionBy("_q")
    own = F.col("doc_id").isNull()  # the rows that tell a query's spread
    low = F.min(F.when(own, F.col("raw"))).over(w)
    low = F.when(F.sum("met").over(w) < n, F.least(F.lit(0.0), low)).otherwise(low)
    return scored.select("_q", "doc_id", "raw", low.alias("low"), F.max(F.when(own, F.col("high"))).over(w).alias("high")).where("doc_id IS NOT NULL")


def _score(names: list[str], weights: np.ndarray, asks: np.ndarray, avgdl: float, top: int, most: float):
    """Scores of every query for blocks of documents as products of matrices; a task returns its best rows and the spread of each query.

    weights: (terms, queries); asks: where a query has a term; most: below this distance ranks may change by rounding.
    """
    k1, b = SETTINGS.k1, SETTINGS.b
    terms, queries = weights.shape
    slack = most * np.abs(weights).sum(axis=0) * (k1 + 1)

    def cut(parts):
        return strongest(parts, queries, top, slack)

    def run(batches):
        dictionary = pa.array(names, pa.string())
        low, high, met = np.full(queries, np.inf), np.full(queries, -np.inf), np.zeros(queries, dtype=np.int64)
        best: list = []
        kind, most = None, KEPT
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists, kind = part.column(2), part.column(0).type
                at_term = pc.index_in(lists.flatten(), value_set=dictionary)
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                known = at_term.is_valid().to_numpy(zero_copy_only=False)
                cell = row[known] * terms + at_term.drop_null().to_numpy()
                cell, tf = np.unique(cell, return_counts=True)
                dl = part.column(1).to_numpy()[cell // terms]
                block = np.zeros(len(lists) * terms)
                block[cell] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                block = block.reshape(-1, terms)
                raw, hit = block @ weights, (block > 0).astype(np.float32) @ asks > 0
                met += hit.sum(axis=0)
                low = np.minimum(low, np.where(hit, raw, np.inf).min(axis=0))
                high = np.maximum(high, np.where(hit, raw, -np.inf).max(axis=0))
                i, j = np.nonzero(hit & (raw > 0))
                best.append((j, sortable(part.column(0))[i], raw[i, j]))
                if sum(len(x[0]) for x in best) > most:
                    best = [cut(best)]
                    most = max(KEPT, 2 * len(best[0][0]))
        if kind is None:
            return
        q, d, r = cut(best) if best and sum(len(x[0]) for x in best) else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        yield spread_rows(q, d, r, kind, low, high, met)

    return run


def search(docs: DataFrame, queries: DataFrame, top: int, qkey: str | list[str] = "item_id") -> DataFrame:
    """(qkey, doc_id, raw, score, rnk) for all queries at once.

    score: min-max over all documents of the corpus, those without a match counting as zero; a query whose
    scores are all equal has no result. Ranked by rounded score, then doc_id. Repeated documents count once.

    A query set whose terms make a matrix of up to ``MATRIX_BYTES`` is multiplied with blocks of documents, and each
    task returns its best rows; a larger one is joined with the documents' terms.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    q = [qkey] if isinstance(qkey, str) else qkey
    rows = tokenised(docs)
    terms = asked_terms(queries, q)
    found = terms.limit(BROADCAST_ROWS + 1).collect()
    names = sorted({r["term"] for r in found})
    keys = sorted({tuple(r[k] for k in q) for r in found})
    if len(found) > BROADCAST_ROWS or len(names) * len(keys) * 8 > MATRIX_BYTES:
        return _joined(rows, terms, top, q)
    number, place = {k: i for i, k in enumerate(keys)}, {t: i for i, t in enumerate(names)}
    asked = spark.createDataFrame(pa.table({"term": pa.array(names, pa.string())}), "term string")
    n, avgdl, idf = _figures(rows, asked)
    weights = np.zeros((len(names), len(keys)))
    asks = np.zeros(weights.shape, dtype=np.float32)
    for r in found:
        at = place[r["term"]], number[tuple(r[k] for k in q)]
        weights[at] = r["qtf"] * idf.get(r["term"], 0.0)
        asks[at] = 1
    shared = _score(names, weights, asks, avgdl or 1.0, top, 1e-6)
    scored = rows.select("doc_id", "dl", "tokens").mapInArrow(shared, f"_q int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, raw double, high double, met long")
    kept = _ranked(spread_out(scored, n), ["_q"], top)
    return kept.join(F.broadcast(numbered_queries(queries, keys, q)), "_q").select(*q, "doc_id", F.round("raw", 6).alias("raw"), "score", "rnk")


def _ranked(spread: DataFrame, q: list[str], top: int) -> DataFrame:
    kept = spread.where("raw > 0 AND high > low").withColumn("score", F.round((F.col("raw") - F.col("low")) / (F.col("high") - F.col("low")), 6))
    rank = F.row_number().over(Window.partitionBy(*q).orderBy(F.desc("score"), "doc_id"))
    return kept.withColumn("rnk", rank).where(F.col("rnk") <= top)


def _joined(rows: DataFrame, terms: DataFrame, top: int, q: list[str]) -> DataFrame:
    """The same for a query set of any size: an equi-join of the queries' terms with the documents' terms."""
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    asked = terms.select("term").distinct()
    each = rows.select("doc_id", "dl", F.explode_outer("tokens").alias("term")).join(asked, "term", "left_semi")
    post = each.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    weights = terms.join(term_weights(rows, sums["n"]), "term").select(*q, "term", (F.col("qtf") * F.col("idf")).alias("w"))
    k1, b = SETTINGS.k1, SETTINGS.b
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(sums["avgdl"] or 1.0)))
    scored = post.join(weights, "term").groupBy(*q, "doc_id").agg(F.sum(part).alias("raw"))
    w = Window.partitionBy(*q)
    low = F.when(F.count(F.lit(1)).over(w) < sums["n"], F.least(F.lit(0.0), F.min("raw").over(w))).otherwise(F.min("raw").over(w))
    spread = scored.select(*q, "doc_id", "raw", low.alias("low"), F.max("raw").over(w).alias("high"))
    return _ranked(spread, q, top).select(*q, "doc_id", F.round("raw", 6).alias("raw"), "score", "rnk")
