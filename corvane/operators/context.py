"""Contexts of bounded length, prompts from them, and checks of answers against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import words
from corvane.settings import SETTINGS
from corvane.sources.storage import materialise

# Phrases that an answer should not contain, and what is answered instead of next to nothing.
HEDGES = ["je ne suis pas sûr", "peut-être", "il se peut que", "selon certaines sources", "d'après ce que je sais", "à mon avis"]
FALLBACK = "Je n'ai pas trouvé suffisamment d'informations fiables dans les documents juridiques pour répondre précisément à cette question."
SOURCES, USER_PART, GRAPH_PART, CUT = "=== SOURCES JURIDIQUES ===", "\n=== DOCUMENT UTILISATEUR ===", "\n=== RELATIONS ET CONCEPTS ===", "\n...[contexte tronqué]"

#: Our own wording: role, focus and rules of a prompt by mode.
PROFILES = (
    ("penal", "fr", "un juriste pénaliste", "droit pénal", "Qualifiez les faits, citez la peine prévue."),
    ("civil", "fr", "un juriste civiliste", "droit civil et obligations", "Distinguez conditions et effets."),
    ("general", "fr", "un juriste généraliste", "droit tunisien", "Citez chaque texte utilisé."),
    ("penal", "ar", "مختص في القانون الجزائي", "القانون الجزائي", "اذكر النص والعقوبة."),
    ("civil", "ar", "مختص في القانون المدني", "القانون المدني", "ميّز بين الشروط والآثار."),
    ("general", "ar", "مختص في القانون", "القانون التونسي", "اذكر كل نص مستعمل."),
)


def pack(chunks: DataFrame, budget: int = SETTINGS.context_chars) -> DataFrame:
    """(query_id, n_chunks, chars, context) of chunks(query_id, article_id, rnk, text).

    Three chunks of an article at most; the chunk that crosses 70 % of the budget is the last.
    """
    nth = F.row_number().over(Window.partitionBy("query_id", "article_id").orderBy("rnk"))
    part = F.concat(F.lit("**Source:** "), "article_id", F.lit("\n\n"), F.substring("text", 1, SETTINGS.chunk_chars))
    some = chunks.withColumn("nth", nth).where(F.col("nth") <= SETTINGS.per_article).withColumn("part", part)
    w = Window.partitionBy("query_id").orderBy("rnk").rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum(F.length("part")).over(w) + 2 * (F.count(F.lit(1)).over(w) - 1)  # as joined so far
    kept = some.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= 0.7 * budget)
    out = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_list(F.struct("rnk", "part"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")
    return out.select("query_id", "n_chunks", F.length(text).cast("long").alias("chars"), text.alias("context"))


def build(chunks: DataFrame, user_chunks: DataFrame | None = None, graph: DataFrame | None = None, budget: int = SETTINGS.context_chars) -> DataFrame:
    """(query_id, context, n_chunks, articles, graph_facts, chars, tokens): sources, then the user's own chunks, then the graph.

    user_chunks (query_id, rnk, text): three at most, of 500 characters. graph (query_id, graph_text): used if it has over
    50 characters and over 500 are left. A context over the budget is cut 100 characters before it.
    Every question of any input has a row.
    """
    base = pack(chunks, budget).select("query_id", "n_chunks", F.concat(F.lit(SOURCES + "\n\n"), "context").alias("_base"))
    arts = chunks.groupBy("query_id").agg(F.sort_array(F.collect_set("article_id")).alias("articles"))
    out = base.join(arts, "query_id", "left")
    if user_chunks is not None:
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rnk"))
        own = user_chunks.withColumn("_n", nth).where("_n <= 3").select("query_id", F.struct("rnk", F.concat(F.lit("[USER_DOC] "), F.substring("text", 1, 500)).alias("p")).alias("s"))
        own = own.groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("ps"))
        own = own.select("query_id", F.concat(F.lit(USER_PART + "\n\n"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n")).alias("_user"))
        out = out.join(own, "query_id", "full")
    out = out.join(graph.select("query_id", F.col("graph_text").alias("_graph")), "query_id", "full") if graph is not None else out.withColumn("_graph", F.lit(None).cast("string"))
    user = F.col("_user") if user_chunks is not None else F.lit(None).cast("string")
    so_far = F.concat_ws("\n\n", "_base", user)
    left = budget - F.length(so_far)
    used = (F.length(F.trim("_graph")) > 50) & (left > 500)
    facts = F.when(used, F.concat(F.lit(GRAPH_PART + "\n\n"), F.substring(F.col("_graph"), F.lit(1), (left - 100).cast("int"))))
    text = F.concat_ws("\n\n", F.nullif(so_far, F.lit("")), facts)
    cut = F.when(F.length(text) > budget, F.concat(F.substring(text, 1, budget - 100), F.lit(CUT))).otherwise(text)
    lines = F.size(F.filter(F.split("_graph", "\n"), lambda x: F.trim(x).startswith("-")))
    return out.withColumn("context", cut).select(
        "query_id",
        "context",
        F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"),
        F.coalesce("articles", F.array().cast("array<string>")).alias("articles"),
        F.when(used, lines).otherwise(0).cast("long").alias("graph_facts"),
        F.length("context").cast("long").alias("chars"),
        F.floor(F.length("context") / 4).cast("long").alias("tokens"),
    )


def check_answers(df: DataFrame, answer: str = "answer", context: str = "context", articles: str | None = None) -> DataFrame:
    """Adds final_answer, fallback, overlap (share of the answer's different words found in the context) and warning.

    An answer of under 30 characters is replaced. Of several warnings the last one found stays: no citation
    (where the context has articles), a forbidden phrase, little overlap.
    """
    a, c = F.array_distinct(words(F.lower(F.trim(answer)))), F.array_distinct(words(F.lower(context)))
    overlap = F.when(F.size(a) > 5, F.round(F.size(F.array_intersect(a, c)) / F.size(a), 3))
    low = F.trim(F.lower(F.col(answer)))
    hedge = F.coalesce(*(F.when(F.contains(low, F.lit(h)), F.concat(F.lit("pattern_interdit_detecte:"), F.lit(h))) for h in HEDGES))
    cited = F.contains(F.col(answer), F.lit("[")) | F.contains(F.col(answer), F.lit("**Source:**"))
    some = F.size(articles) > 0 if articles else F.lit(True)
    warning = (
        F.when(F.col("fallback"), "too_short")
        .when(F.col("overlap") < 0.1, "faible_overlap_avec_contexte")
        .when(hedge.isNotNull(), hedge)
        .when(~cited & some, "pas_de_citations_explicites")
        .otherwise("none")
    )
    out = df.withColumn("fallback", F.length(F.trim(answer)) < 30)
    out = out.withColumn("overlap", F.when(~F.col("fallback"), overlap)).withColumn("warning", warning)
    return out.withColumn("final_answer", F.when(F.col("fallback"), FALLBACK).otherwise(F.trim(answer)))


def running_means(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """(order, mean of each value over the rows so far), in order of one column (ties as one) and of any length.

    Rows are dealt out by ranges of the order; each range's sums, one row a range, tell the next ranges where to begin. Null values don't
    count; rows without an order come first.
    """
    rows = df.select(order, *values).repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    rows = materialise(rows, "ranges")
    sums = rows.groupBy("_part").agg(*(f(v).alias(f"_{n}_{v}") for v in values for n, f in (("s", F.sum), ("n", F.count))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    begun = sums.select("_part", *(F.coalesce(F.sum(f"_{n}_{v}").over(before), F.lit(0)).alias(f"_{n}_{v}") for v in values for n in "sn"))
    w = Window.partitionBy("_part").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    here = rows.join(F.broadcast(begun), "_part")
    return here.select(order, *(F.round((F.col(f"_s_{v}") + F.coalesce(F.sum(v).over(w), F.lit(0))) / F.nullif(F.col(f"_n_{v}") + F.count(v).over(w), F.lit(0)), 4).alias(v) for v in values))


def confidence_note(confidence: Column, sources: Column, arabic: Column) -> Column:
    """How sure an answer may sound: under 0.6, under 0.8, and above; Arabic has two bands."""
    n = sources.cast("string")
    sure = F.concat(F.lit("Certitude "), F.round(confidence * 100, 0).cast("int").cast("string"), F.lit(" % ("), n, F.lit(" documents) : "))
    weak = F.concat(sure, F.lit("dites ce qui manque et ne tranchez pas."))
    fair = F.concat(sure, F.lit("répondez et dites ce qui reste incertain."))
    good = F.concat(sure, F.lit("répondez clairement, sans dépasser les textes."))
    in_arabic = F.concat(n, F.when(confidence < 0.6, " documents seulement : ne tranchez pas.").otherwise(" documents : répondez clairement."))
    return F.when(arabic, in_arabic).when(confidence < 0.6, weak).when(confidence < 0.8, fair).otherwise(good)


def entity_lines(entities: Column, most: int = 3) -> Column:
    """``- name: a, b, c`` for each non-empty list of a map, ``most`` values each, by name."""
    pairs = F.array_sort(F.filter(F.map_entries(entities), lambda e: F.size(e["value"]) > 0))
    return F.array_join(F.transform(pairs, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.array_join(F.slice(e["value"], 1, most), ", "))), "\n")


def synthesis_prompts(df: DataFrame, chars: int = 8000) -> DataFrame:
    """(query_id, prompt) of df(query_id, mode, lang, context, entities map, confidence, sources).

    Role and rules come from a small table of profiles; unknown modes are general, languages other than ar are French.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(PROFILES, "mode string, lang string, role string, focus string, rule string")
    known = F.when(F.col("mode").isin("penal", "civil"), F.col("mode")).otherwise("general")
    rows = df.withColumn("mode", known).withColumn("lang", F.when(F.col("lang") == "ar", "ar").otherwise("fr"))
    rows = rows.join(F.broadcast(table), ["mode", "lang"])
    entities = F.nullif(entity_lines(F.col("entities")), F.lit(""))
    blocks = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Tu es "), "role", F.lit(". Domaine : "), "focus", F.lit(".")),
        "rule",
        F.when(entities.isNotNull(), F.concat(F.lit("ENTITÉS:\n"), entities)),
        F.lit("Citez les sources sous la forme [article]."),
        confidence_note(F.col("confidence"), F.col("sources"), F.col("lang") == "ar"),
        F.concat(F.lit("CONTEXTE:\n"), F.substring("context", 1, chars)),
        F.lit("QUESTION: {question}"),
    )
    return rows.select("query_id", blocks.alias("prompt"))


def plain_prompt(kind: str, *parts: Column) -> Column:
    """comparison (two texts), extraction (text, fields), query (question, context) or quick (question)."""
    heads = {
        "comparison": ("Comparez les deux textes.", ["TEXTE 1", "TEXTE 2"]),
        "extraction": ("Extrayez les champs en JSON.", ["TEXTE", "CHAMPS"]),
        "query": ("Répondez à partir du contexte.", ["QUESTION", "CONTEXTE"]),
        "quick": ("Répondez brièvement.", ["QUESTION"]),
    }
    head, names = heads[kind]
    return F.concat_ws("\n\n", F.lit(head), *(F.concat(F.lit(n + ":\n"), p) for n, p in zip(names, parts, strict=True)))


def chat_messages(messages: DataFrame, prompt: str, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, messages): the system prompt, then the conversation's messages in order, as (role, content)."""
    rows = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "role", F.col("text").alias("content")))).alias("ms"))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content")))
    rest = F.transform("ms", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.select(key, F.concat(first, rest).alias("messages"))
