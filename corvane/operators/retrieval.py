"""Hybrid retrieval of a question set: variants, fusion, articles, boosts, compression, thresholds, confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.frames import dealt, spread
from corvane.functions.text import expand_question, sentences, wide
from corvane.operators import classify, hooks, lexical, vector
from corvane.operators.index import Index
from corvane.operators.vector import cosine
from corvane.settings import SETTINGS
from corvane.sources.storage import materialise

# Fixed value: what counts as a reference to an article.
REFERENCE = wide(r"(Art\.?|Article|المادة)\s*\d+")


def plan_questions(questions: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, text, alpha, top_k): a question's own weight of BM25 and number of results."""
    known = classify.analyse(questions.select(key, "text"))
    return known.select(key, "text", "alpha", F.least(F.lit(20), 5 + F.col("n_words")).alias("top_k"))


def variants(questions: DataFrame, vectors: DataFrame | None = None, key: str = "query_id") -> DataFrame:
    """(key, variant, text): a question and, if it differs, its expansion.

    With vectors (key, variant, embedding) an expansion goes whose cosine to the question exceeds ``same_variant``.
    """
    each = questions.select(key, F.posexplode(expand_question("text")).alias("variant", "text"))
    if vectors is None:
        return each
    v = vectors.select(key, "variant", F.col("embedding").cast("array<double>").alias("v"))
    first = v.where("variant = 0").select(key, F.col("v").alias("v0"))
    near = v.where("variant > 0").join(first, key).where(F.round(cosine(F.col("v"), F.col("v0")), 6) > SETTINGS.same_variant)
    return each.join(near.select(key, "variant"), [key, "variant"], "left_anti")


def merge_variants(scored: DataFrame, weights: tuple[float, ...] = (1.0, 0.8), key: str = "query_id", asked: DataFrame | None = None) -> DataFrame:
    """(key, chunk_id, score): weighted mean over a question's variants, absent counting as zero.

    asked (key, variant) tells which variants a question has; without it every question has all of ``weights``.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("variant") + 1)
    total = scored.groupBy(key, "chunk_id").agg(F.sum(w * F.col("score")).alias("score"))
    if asked is None:
        return total.select(key, "chunk_id", (F.col("score") / sum(weights)).alias("score"))
    whole = asked.groupBy(key).agg(F.sum(w).alias("_w"))
    return total.join(whole, key).select(key, "chunk_id", (F.col("score") / F.col("_w")).alias("score"))


def fuse(lexical: DataFrame, dense: DataFrame, alpha: float | DataFrame = 0.5) -> DataFrame:
    """(query_id, chunk_id, b, d, hybrid): full outer union, each score min-maxed over it, powers mixed by alpha.

    alpha: one weight of BM25, or a table (query_id, alpha).
    """
    both = lexical.join(dense, ["query_id", "chunk_id"], "full").na.fill(0.0, ["b", "d"])
    w = Window.partitionBy("query_id")

    def scaled(c: str):
        low, high = F.min(c).over(w), F.max(c).over(w)
        return (F.col(c) - low) / F.when(high == low, 1.0).otherwise(high - low)

    unit = both.select("query_id", "chunk_id", scaled("b").alias("b"), scaled("d").alias("d"))
    a = F.lit(alpha) if isinstance(alpha, float) else F.col("alpha")
    unit = unit if isinstance(alpha, float) else unit.join(alpha.select("query_id", "alpha"), "query_id")
    mix = a * F.pow("b", F.lit(SETTINGS.lexical_power)) + (1 - a) * F.pow("d", F.lit(SETTINGS.dense_power))
    return unit.withColumn("hybrid", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mix)), 6)).select("query_id", "chunk_id", "b", "d", "hybrid")


def date_boost(score: Column, dated: Column) -> Column:
    """5 % more for chunks of an article whose metadata hold a date or a year, at most 1."""
    return F.when(F.coalesce(dated, F.lit(False)), F.least(F.lit(1.0), score * 1.05)).otherwise(score)


def year_boost(score: Column, text: Column) -> Column:
    """The score raised slightly for a recent year named in the text, at most 1."""
    year = F.regexp_extract(text, r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int")
    gain = F.coalesce(F.greatest(F.lit(0), year - 2020), F.lit(0)) * 0.001
    return F.least(F.lit(1.0), score * (1 + gain))


def legal_boost(score: Column, text: Column, titled: Column) -> Column:
    """1.3 for a reference to an article, 1.1 for the penal code, 1.05 if the article has a title; at most 1."""
    b = F.when(text.rlike("(?iu)" + REFERENCE), F.lit(1.3)).otherwise(F.lit(1.0))
    b = b * F.when(F.contains(F.lower(text), F.lit("code pénal")), F.lit(1.1)).otherwise(F.lit(1.0))
    b = b * F.when(F.coalesce(titled, F.lit(False)), F.lit(1.05)).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), score * b)


def coherence(score: Column, query: Column, chunk: Column) -> Column:
    """Scaled by 0.8 to 1 with the cosine of question and chunk; without a vector the score stays."""
    return score * F.when(chunk.isNull() | query.isNull(), F.lit(1.0)).otherwise(0.8 + 0.2 * cosine(query, chunk))


def article_scores(fused: DataFrame, how: str = "weighted") -> DataFrame:
    """(query_id, article_id, n, score) from ``hybrid`` of an article's chunks; how: weighted, mean or max."""
    agg = fused.groupBy("query_id", "article_id").agg(
        F.avg("hybrid").alias("mean"), F.max("hybrid").alias("most"), F.stddev_pop("hybrid").alias("std"), F.count(F.lit(1)).alias("n")
    )
    base = {"mean": F.col("mean"), "max": F.col("most"), "weighted": 0.6 * F.col("mean") + 0.4 * F.col("most")}[how]
    score = (base + SETTINGS.spread_weight * (1 - F.col("std"))) / F.ln(1 + F.col("n"))
    return agg.select("query_id", "article_id", "n", F.round(score, 6).alias("score"))


def top_articles(scores: DataFrame, top: int = SETTINGS.article_k) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "article_id"))
    return scores.withColumn("rnk", rank).where(F.col("rnk") <= top)


def chunk_texts(wanted: DataFrame, *sources: DataFrame) -> DataFrame:
    """wanted (chunk_id) with text from the first source (chunk_id, text) that has one, else ``[EMPTY_CHUNK]``."""
    out, names = wanted, []
    for i, s in enumerate(sources):
        names.append(f"_t{i}")
        out = out.join(s.select("chunk_id", F.nullif("text", F.lit("")).alias(names[-1])), "chunk_id", "left")
    return out.withColumn("text", F.coalesce(*map(F.col, names), F.lit("[EMPTY_CHUNK]"))).drop(*names)


def distinct_texts(found: DataFrame) -> DataFrame:
    """Equal texts of one article once: the best of them, then the smallest chunk_id."""
    same = F.md5(F.concat_ws(":", "text", "article_id").cast("binary"))
    once = F.row_number().over(Window.partitionBy("query_id", same).orderBy(F.desc("hybrid"), "chunk_id"))
    return found.withColumn("_k", once).where("_k = 1").drop("_k")


def strongest(found: DataFrame) -> DataFrame:
    """Chunks above ``min_hybrid``, ranked by (hybrid, chunk_id), as many as min(max(5 * top_k, 20), 100) of a question."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hybrid"), "chunk_id"))
    limit = F.least(F.greatest(5 * F.col("top_k"), F.lit(20)), F.lit(100))
    return found.where(F.col("hybrid") > SETTINGS.min_hybrid).withColumn("rnk", rank).where(F.col("rnk") <= limit)


def drop_repeated_sentences(chunks: DataFrame, group: str | list[str], order: str | list[str], text: str = "text", least: int = 20, full: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(group, order, carry, text): sentences already seen in the group go, unless they name an article; chunks left with
    ``least`` characters or fewer go. full: sentences of under 30 letters and digits go too, unless they name one. carry: columns that come along."""
    group, order = ([x] if isinstance(x, str) else x for x in (group, order))
    rest = F.struct(*carry).alias("_rest") if carry else F.lit(None).cast("struct<x:int>").alias("_rest")
    each = spread(chunks.select(*group, *order, text, rest)).select(*group, *order, "_rest", F.posexplode(sentences(text)).alias("_pos", "_s"))
    each = each.withColumn("_key", F.regexp_replace(F.lower("_s"), r"[^\p{L}\p{M}\p{N}_]", "")).withColumn("_ref", F.col("_s").rlike("(?iu)" + REFERENCE))
    if full:
        each = each.where((F.length("_key") >= 30) | F.col("_ref"))
    first = F.row_number().over(Window.partitionBy(*group, "_key").orderBy(*order, "_pos"))
    kept = each.withColumn("_k", first).where("_k = 1 OR _ref").groupBy(*group, *order).agg(F.array_sort(F.collect_list(F.struct("_pos", "_s"))).alias("_parts"), F.first("_rest").alias("_rest"))
    out = kept.select(*group, *order, *(f"_rest.{c}" for c in carry), F.array_join(F.transform("_parts", lambda p: p["_s"]), " ").alias(text))
    return out.where(F.length(F.trim(text)) > least)


def compress(found: DataFrame, full: bool = False) -> DataFrame:
    """found with shorter texts, ranked anew: within a question's article a sentence is read once."""
    own = ["query_id", "article_id", "rnk", "chunk_id", "text"]
    out = drop_repeated_sentences(found, own[:2], own[2:4], full=full, carry=tuple(c for c in found.columns if c not in own))
    return out.withColumn("rnk", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hybrid"), "chunk_id"))).select(*found.columns)


def rerank(found: DataFrame, logit: str | None = None, failed: bool = False) -> DataFrame:
    """Adds final and keeps the question's top_k by it. logit: a reranker's column, mixed in by its sigmoid; without one
    final is hybrid, and where the model failed (failed, or a null logit) it is 0.7 hybrid + 0.3 b."""
    without = 0.7 * F.col("hybrid") + 0.3 * F.col("b")
    if logit is not None:
        final = F.coalesce(0.55 * F.col("hybrid") + 0.45 / (1 + F.exp(-F.col(logit))), without)
    else:
        final = without if failed else F.col("hybrid")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "chunk_id"))
    return found.withColumn("final", F.round(final, 6)).withColumn("rnk", rank).where(F.col("rnk") <= F.col("top_k"))


def above_threshold(found: DataFrame) -> DataFrame:
    """Results of at least max(0.3, half of the question's mean), ranked."""
    mean = F.avg("final").over(Window.partitionBy("query_id"))
    kept = found.withColumn("_m", mean).where(F.col("final") >= F.greatest(F.lit(SETTINGS.min_final), 0.5 * F.col("_m"))).drop("_m")
    return kept.withColumn("rnk", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "chunk_id")))


def named(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the chunks that wanted (chunk_id), a stored table, names. Up to ``lexical.BROADCAST_ROWS`` ids go to every task, so that no text or vector of another chunk is shuffled."""
    ids = wanted.select("chunk_id").distinct()
    few = wanted.limit(lexical.BROADCAST_ROWS + 1).count() <= lexical.BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if few else ids, "chunk_id", "left_semi")


def scores(
    questions: DataFrame, chunks: DataFrame, vectors: DataFrame, asked_vectors: DataFrame, where: Column | str | None = None, filter_lexical: bool = False, index: Index | None = None
) -> DataFrame:
    """(query_id, chunk_id, article_id, b, d, hybrid): the fused score of every chunk that either branch finds.

    questions (query_id, text, alpha, top_k); chunks (chunk_id, text, article_id, ...), with titled and dated as optional
    columns; vectors (chunk_id, embedding); asked_vectors (query_id, variant, embedding). Ids are integers or strings. where: a condition on
    chunks, which holds for the dense branch only unless ``filter_lexical``, with which BM25 knows these chunks only. index: an index of
    the chunks to search instead of their texts.
    """
    asked = variants(questions, asked_vectors)
    meant = chunks if where is None else chunks.where(where)
    keys = ["query_id", "variant"]
    if index is not None:
        if where is not None and filter_lexical:
            raise ValueError("an index knows all chunks: filter_lexical needs the texts")
        lex = index.search(asked, SETTINGS.retrieve_k, keys).withColumnRenamed(index.key, "chunk_id")
    else:
        corpus = (meant if filter_lexical else chunks).select(F.col("chunk_id").alias("doc_id"), "text")
        lex = lexical.search(corpus, asked, SETTINGS.retrieve_k, keys).withColumnRenamed("doc_id", "chunk_id")
    lex = lex.select("query_id", "variant", "chunk_id", "score")
    # a variant's vector is a query of its own
    here = asked_vectors.join(asked.select(*keys), keys).withColumn("vec_id", F.concat_ws("#", F.col("variant").cast("string"), F.col("query_id").cast("string")))
    known_vectors = vectors if where is None else vectors.join(meant.select("chunk_id"), "chunk_id", "left_semi")
    near = vector.min_max(vector.search(known_vectors.select(F.col("chunk_id").alias("vec_id"), "embedding"), here.select("vec_id", "embedding"), SETTINGS.retrieve_k))
    near = near.select(F.col("query_id").alias("asked"), F.col("vec_id").alias("chunk_id"), "score")
    dense = near.join(here.select(F.col("vec_id").alias("asked"), *keys), "asked").select(*keys, "chunk_id", "score")
    b = merge_variants(lex, asked=asked).withColumnRenamed("score", "b")
    d = merge_variants(dense, asked=asked).withColumnRenamed("score", "d")
    fused = materialise(fuse(b, d, questions.select("query_id", "alpha")), "mixed")
    dated = F.col("dated") if "dated" in chunks.columns else F.lit(False)
    known = chunks.select("chunk_id", "article_id", F.col("text").alias("_text"), dated.alias("_dated"))
    out = fused.join(named(known, fused), "chunk_id", "left")
    raised = F.round(year_boost(date_boost(F.col("hybrid"), F.col("_dated")), F.coalesce("_text", F.lit(""))), 6)
    article = F.coalesce("article_id", F.concat(F.lit("doc_"), F.col("chunk_id").cast("string")))
    return out.select("query_id", "chunk_id", article.alias("article_id"), "b", "d", raised.alias("hybrid"))


def candidates(scored: DataFrame, questions: DataFrame, chunks: DataFrame, vectors: DataFrame, asked_vectors: DataFrame) -> DataFrame:
    """Chunks of a question's best articles with text, boosted and scaled, equal texts once, the strongest ranked. scored is a stored table."""
    best = top_articles(article_scores(scored)).select("query_id", "article_id")
    chunks, vectors = named(chunks, scored), named(vectors, scored)
    near = chunk_texts(scored.join(best, ["query_id", "article_id"]), chunks)
    titled = F.col("titled") if "titled" in chunks.columns else F.lit(False)
    near = near.join(chunks.select("chunk_id", titled.alias("_titled")), "chunk_id", "left")
    near = dealt(near, "query_id", "chunk_id").withColumn("hybrid", F.round(legal_boost(F.col("hybrid"), F.col("text"), F.col("_titled")), 6))
    v = vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("_v"))
    q = asked_vectors.where("variant = 0").select("query_id", F.col("embedding").cast("array<double>").alias("_q"))
    met = distinct_texts(near).join(v, "chunk_id", "left").join(q, "query_id", "left")
    met = met.withColumn("hybrid", F.round(coherence(F.col("hybrid"), F.col("_q"), F.col("_v")), 6))
    return strongest(met.drop("_v", "_q", "_titled").join(questions.select("query_id", "top_k"), "query_id"))


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    asked_vectors: DataFrame,
    where: Column | str | None = None,
    filter_lexical: bool = False,
    index: Index | None = None,
    logits: DataFrame | None = None,
    reranker: Callable[[list[str], list[str]], list[float]] | None = None,
) -> DataFrame:
    """(query_id, chunk_id, article_id, b, d, hybrid, text, top_k, (logit,) final, rnk): the whole retrieval of a question set.

    Lexical and dense search of each variant, fusion by the question's own weight, articles, boosts,
    compression, ranks, compression again, and the threshold. Arguments as in ``scores``. Ranks take a model's logits, given as
    a table (query_id, chunk_id, logit; without query_id it holds for every question) or by a function of questions and texts; a result without logit is ranked as if the model had failed.
    What is used more than once is written to shared storage: the mixed scores, the fused scores and the candidates.
    """
    plan = plan_questions(questions)
    fused = materialise(scores(plan, chunks, vectors, asked_vectors, where, filter_lexical, index), "fused")
    found = compress(materialise(candidates(fused, plan, chunks, vectors, asked_vectors), "candidates"))
    if logits is not None:
        keys = [c for c in ("query_id", "chunk_id") if c in logits.columns]
        found = found.join(logits.select(*keys, "logit"), keys, "left")
    elif reranker is not None:
        asked = found.join(questions.select("query_id", F.col("text").alias("question")), "query_id")
        found = hooks.rerank_logits(asked, reranker).drop("question")
    ranked = rerank(found, "logit" if "logit" in found.columns else None)
    return above_threshold(compress(ranked, full=True))


def confidence(ranked: DataFrame, value: str = "hybrid") -> DataFrame:
    """(query_id, n, confidence, answered) of each question with results."""
    def some(k, fn):
        return fn(F.when(F.col("rnk") <= k, F.col(value)))

    score = 0.5 * some(1, F.max) + 0.3 * some(3, F.avg) + 0.2 * (1 - some(5, F.stddev_pop))
    out = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(score, 6).alias("confidence"))
    return out.withColumn("answered", (F.col("n") >= 2) & (F.col("confidence") >= SETTINGS.refuse_below))


def joined_context(ranked: DataFrame, chars: int = SETTINGS.chunk_chars) -> DataFrame:
    """(query_id, context): ``[article] text...`` of a question's results in order, between rules."""
    part = F.concat(F.lit("["), "article_id", F.lit("] "), F.substring("text", 1, chars), F.lit("..."))
    out = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rnk", part.alias("p")))).alias("ps"))
    return out.select("query_id", F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n---\n\n").alias("context"))


def for_evaluation(ranked: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, answer, context, chunk_ids, article_ids, n_contexts): one schema for every evaluator."""
    lists = ranked.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rnk", "chunk_id"))).alias("c"), F.sort_array(F.collect_set("article_id")).alias("article_ids"), F.count(F.lit(1)).alias("n_contexts")
    )
    out = answers.select("query_id", "answer").join(lists, "query_id", "left").join(joined_context(ranked), "query_id", "left")
    kind = ranked.schema["chunk_id"].dataType.simpleString()
    ids = F.coalesce(F.transform("c", lambda x: x["chunk_id"]), F.array().cast(f"array<{kind}>"))
    return out.select("query_id", "answer", F.coalesce("context", F.lit("")).alias("context"), ids.alias("chunk_ids"), "article_ids", F.coalesce("n_contexts", F.lit(0)).alias("n_contexts"))


def health(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: documents, chunks, articles, vectors, chunks that wait for a vector."""
    waiting = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti").agg(F.count(F.lit(1)).alias("pending"))
    counted = chunks.agg(F.countDistinct("doc_uid").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.countDistinct("article_id").alias("articles"))
    return counted.crossJoin(vectors.agg(F.count(F.lit(1)).alias("vectors"))).crossJoin(waiting)  # one row each
