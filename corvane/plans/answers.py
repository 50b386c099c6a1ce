"""Contexts, prompts, graph contexts, the answer cache and evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators import classify, context, evaluation, graph, semcache
from corvane.plans import samples
from corvane.plans.base import WRD, has, query, quote
from corvane.plans.base import table as _t
from corvane.settings import SETTINGS

_ASKS = f"WITH {samples.cte('asks', True)}"
_OWN_ASKS = f"WITH {samples.cte('asks')}"
_LAW = f"WITH {samples.cte('law')}"
ARABIC = r"(len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) / greatest(length(text), 1)) > 0.3"


# questions


@query(f"{_ASKS}, p AS (SELECT *, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_ \\t\\n\\r\\f]', '', 'g')) AS c FROM asks) SELECT query_id, (len({WRD.format('text')}) < 6 AND regexp_matches(c, {quote(classify.GATE)})) OR length(trim(text)) < 5 AS skipped FROM p")
def expansion_gate(spark, d):
    return samples.table(spark, "asks", d).select("query_id", classify.skip_expansion(F.col("text")).alias("skipped"))


@query(f"{_ASKS}, p AS (SELECT *, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_ \\t\\n\\r\\f]', '', 'g')) AS c FROM asks), g AS (SELECT *, (len({WRD.format('text')}) < 6 AND regexp_matches(c, {quote(classify.GATE)})) OR length(trim(text)) < 5 AS sk FROM p) SELECT query_id, CASE WHEN sk OR query_id % 3 = 0 THEN text ELSE text || chr(10) || chr(10) || 'réponse ' || query_id END AS combined, CASE WHEN sk OR query_id % 3 = 0 THEN text ELSE 'réponse ' || query_id END AS alone FROM g")
def hypothetical_queries(spark, d):
    told = F.when(F.col("query_id") % 3 != 0, F.concat(F.lit("réponse "), "query_id"))
    rows = samples.table(spark, "asks", d)
    return rows.select("query_id", classify.hypothesis(F.col("text"), told).alias("combined"), classify.hypothesis(F.col("text"), told, "hypo_only").alias("alone"))


@query(f"{_ASKS} SELECT query_id, regexp_matches(text, {quote('(?i)' + classify.APPOINTMENT)}) AS wanted FROM asks UNION ALL SELECT -conv_id * 1000 - turn, regexp_matches(text, {quote('(?i)' + classify.APPOINTMENT)}) FROM conversations")
def appointment_intent(spark, d):
    said = _t(spark, d, "conversations").select((-F.col("conv_id") * 1000 - F.col("turn")).alias("query_id"), "text")
    return samples.table(spark, "asks", d).unionByName(said).select("query_id", classify.wants_appointment(F.col("text")).alias("wanted"))


@query(f"WITH {samples.cte('modes', True)} SELECT id, CASE WHEN type IN ('articles_cp', 'articles_cpp', 'gravite', 'peine') THEN 'penal' WHEN type IN ('articles_coc', 'parties', 'montants') THEN 'civil' WHEN {has('lower(value)', classify.MODE_WORDS['penal'])} > 0 THEN 'penal' WHEN {has('lower(value)', classify.MODE_WORDS['civil'])} > 0 THEN 'civil' ELSE 'general' END AS mode FROM modes")
def legal_modes(spark, d):
    rows = samples.table(spark, "modes", d).groupBy("id").agg(F.collect_list(F.struct("type", "value")).alias("entities"))
    return rows.select("id", classify.legal_mode(F.col("entities")).alias("mode"))


@query("SELECT conv_id, turn, length(text) BETWEEN 3 AND 3000 AND turn + 1 BETWEEN 1 AND 20 AND role IN ('auto', 'penal', 'civil', 'general') AS valid, CASE WHEN lower(trim(role)) LIKE 'ar%' THEN 'ar' WHEN lower(trim(role)) LIKE 'en%' THEN 'en' ELSE 'fr' END AS lang, role IN ('legal_question', 'greeting', 'discussion', 'error') AND true AS valid_intent FROM (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'auto' WHEN role = 'system' THEN 'error' ELSE 'english' END AS role FROM conversations)")
def request_checks(spark, d):
    named = F.when(F.col("role") == "user", "auto").when(F.col("role") == "system", "error").otherwise("english")
    rows = _t(spark, d, "conversations").withColumn("role", named)
    valid = classify.valid_request(F.col("text"), F.col("turn") + 1, F.col("role"), F.lit(None).cast("string"))
    return rows.select("conv_id", "turn", valid.alias("valid"), classify.request_language(F.col("role")).alias("lang"), classify.valid_intent(F.col("role"), F.lit("fr"), F.lit(0.5)).alias("valid_intent"))


@query("WITH r AS (SELECT * FROM (SELECT event_id, CASE WHEN value > 60 THEN 'complex' WHEN value > 30 THEN 'intermediate' ELSE 'simple' END AS mode, round(value / 200, 4) AS confidence FROM events) ORDER BY event_id DESC LIMIT 100) SELECT count(*) AS n, round(count(*) FILTER (mode = 'simple') / count(*), 4) AS simple, round(count(*) FILTER (mode = 'intermediate') / count(*), 4) AS intermediate, round(count(*) FILTER (mode = 'complex') / count(*), 4) AS complex, round(avg(confidence), 4) AS confidence FROM r")
def route_stats(spark, d):
    mode = F.when(F.col("value") > 60, "complex").when(F.col("value") > 30, "intermediate").otherwise("simple")
    return classify.route_stats(_t(spark, d, "events").select("event_id", mode.alias("mode"), F.round(F.col("value") / 200, 4).alias("confidence")), "event_id")


# contexts and prompts


@query(
    f"""{_LAW}, n AS (SELECT 1 AS query_id, article_id, chunk_id AS rnk, '**Source:** ' || article_id || chr(10) || chr(10) || substr(text, 1, 600) AS part, row_number() OVER (PARTITION BY article_id ORDER BY chunk_id) AS k FROM law),
    b AS (SELECT '=== SOURCES JURIDIQUES ===' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY rnk) AS base, count(*) AS n FROM n WHERE k <= 3), a AS (SELECT string_agg(DISTINCT article_id, '|' ORDER BY article_id) AS arts FROM law),
    u AS (SELECT chr(10) || '=== DOCUMENT UTILISATEUR ===' || chr(10) || chr(10) || '[USER_DOC] ' || substr(repeat('mon bail ', 100), 1, 500) AS own),
    g AS (SELECT '- lien entre bail et loyer, établi par la loi du sol' || chr(10) || '- un autre lien' AS gt),
    t AS (SELECT base || chr(10) || chr(10) || own || chr(10) || chr(10) || chr(10) || '=== RELATIONS ET CONCEPTS ===' || chr(10) || chr(10) || gt AS text, n, arts FROM b, u, g, a)
    SELECT 1::BIGINT AS query_id, md5(text) AS digest, CAST(n AS BIGINT) AS n_chunks, arts AS articles, 2::BIGINT AS graph_facts, CAST(length(text) AS BIGINT) AS chars, CAST(length(text) // 4 AS BIGINT) AS tokens FROM t"""
)
def built_context(spark, d):
    chunks = samples.table(spark, "law").select(F.lit(1).cast("long").alias("query_id"), "article_id", F.col("chunk_id").alias("rnk"), "text")
    own = spark.createDataFrame([(1, 1, "mon bail " * 100)], "query_id long, rnk int, text string")
    known = spark.createDataFrame([(1, "- lien entre bail et loyer, établi par la loi du sol\n- un autre lien")], "query_id long, graph_text string")
    found = context.build(chunks, own, known)
    return found.select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"), "n_chunks", F.array_join("articles", "|").alias("articles"), "graph_facts", "chars", "tokens")


_TURN = "turns AS (SELECT conv_id, turn, text AS question, lead(text) OVER w AS answer, lead(role) OVER w AS r2, lag(text) OVER w AS bef, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), qa AS (SELECT conv_id, turn, question, answer, coalesce(bef, '') || ' ' || question AS context FROM turns WHERE role = 'user' AND r2 = 'assistant')"


def _pairs(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, d, "conversations").withColumns({"answer": F.lead("text").over(w), "r2": F.lead("role").over(w), "before": F.lag("text").over(w)})
    said = F.concat(F.coalesce("before", F.lit("")), F.lit(" "), "text").alias("context")
    return rows.where("role = 'user' AND r2 = 'assistant'").select("conv_id", "turn", "answer", said)


_AW = "list_distinct(" + WRD.format("lower(trim(answer))") + ")"
_CW = "list_distinct(" + WRD.format("lower(context)") + ")"
_HEDGE = "CASE " + " ".join(f"WHEN contains(low, {quote(h)}) THEN {quote('pattern_interdit_detecte:' + h)}" for h in context.HEDGES) + " END"


@query(
    f"""WITH {_TURN}, more AS (SELECT conv_id, turn, answer, context FROM qa UNION ALL SELECT -1, i, a, c FROM (VALUES (0, 'court', 'x'), (1, 'il se peut que le bail soit nul selon la cour [1]', 'le bail soit nul'), (2, 'le bail est un contrat entre deux parties', 'le bail est un contrat'), (3, 'aaa bbb ccc ddd eee fff ggg hhh iii', 'zzz')) AS v(i, a, c)),
    m AS (SELECT *, trim(lower(answer)) AS low, length(trim(answer)) < 30 AS fallback FROM more), o AS (SELECT *, CASE WHEN NOT fallback AND len({_AW}) > 5 THEN round(len(list_intersect({_AW}, {_CW})) / len({_AW}), 3) END AS overlap FROM m)
    SELECT conv_id, turn, fallback, overlap, CASE WHEN fallback THEN 'too_short' WHEN overlap < 0.1 THEN 'faible_overlap_avec_contexte' WHEN {_HEDGE} IS NOT NULL THEN {_HEDGE} WHEN NOT contains(answer, '[') AND NOT contains(answer, '**Source:**') THEN 'pas_de_citations_explicites' ELSE 'none' END AS warning,
    md5(CASE WHEN fallback THEN {quote(context.FALLBACK)} ELSE trim(answer) END) AS final FROM o"""
)
def answer_checks(spark, d):
    more = [(-1, 0, "court", "x"), (-1, 1, "il se peut que le bail soit nul selon la cour [1]", "le bail soit nul"), (-1, 2, "le bail est un contrat entre deux parties", "le bail est un contrat"), (-1, 3, "aaa bbb ccc ddd eee fff ggg hhh iii", "zzz")]
    rows = _pairs(spark, d).unionByName(spark.createDataFrame(more, "conv_id long, turn long, answer string, context string"))
    found = context.check_answers(rows)
    return found.select("conv_id", "turn", "fallback", "overlap", "warning", F.md5(F.col("final_answer").cast("binary")).alias("final"))


@query("SELECT conv_id, round(avg(conv_id % 13) OVER w, 4) AS chars, round(avg(conv_id % 5) OVER w, 4) AS latency FROM (SELECT DISTINCT conv_id FROM conversations) WINDOW w AS (ORDER BY conv_id)")
def running_means(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 13).alias("chars"), (F.col("conv_id") % 5).alias("latency"))
    return context.running_means(rows, "conv_id", ["chars", "latency"])


_SURE = "'Certitude ' || pc || ' % (' || n || ' documents) : '"
_NOTE = f"""CASE WHEN lang = 'ar' THEN n || CASE WHEN conf < 0.6 THEN ' documents seulement : ne tranchez pas.' ELSE ' documents : répondez clairement.' END
    WHEN conf < 0.6 THEN {_SURE} || 'dites ce qui manque et ne tranchez pas.' WHEN conf < 0.8 THEN {_SURE} || 'répondez et dites ce qui reste incertain.' ELSE {_SURE} || 'répondez clairement, sans dépasser les textes.' END"""
_PROFILES = ", ".join("(" + ", ".join(map(quote, p)) + ")" for p in context.PROFILES)


@query(
    f"""{_ASKS}, f AS (SELECT query_id, text, CASE query_id % 3 WHEN 0 THEN 'penal' WHEN 1 THEN 'civil' ELSE 'general' END AS mode, CASE WHEN {ARABIC} THEN 'ar' ELSE 'fr' END AS lang, (query_id % 10) / 10.0 AS conf, (query_id % 10) * 10 AS pc, query_id % 4 AS n FROM asks),
    p(mode, lang, role, focus, rule) AS (VALUES {_PROFILES})
    SELECT query_id, 'Tu es ' || role || '. Domaine : ' || focus || '.' || chr(10) || chr(10) || rule || chr(10) || chr(10) || 'ENTITÉS:' || chr(10) || '- articles: 1, 2, 3' || chr(10) || '- parties: ' || query_id || chr(10) || chr(10) || 'Citez les sources sous la forme [article].' || chr(10) || chr(10) || {_NOTE} || chr(10) || chr(10) || 'CONTEXTE:' || chr(10) || text || chr(10) || chr(10) || 'QUESTION: {{question}}' AS prompt FROM f JOIN p USING (mode, lang)"""
)
def synthesis_prompts(spark, d):
    k = F.col("query_id")
    names = F.create_map(F.lit("parties"), F.array(k.cast("string")), F.lit("articles"), F.array(*map(F.lit, "1234")), F.lit("none"), F.array().cast("array<string>"))
    rows = samples.table(spark, "asks", d).select(
        "query_id", F.when(k % 3 == 0, "penal").when(k % 3 == 1, "civil").otherwise("other").alias("mode"), F.when(F.col("text").rlike("[ء-ي]{3}"), "ar").otherwise("fr").alias("lang"),
        F.col("text").alias("context"), names.alias("entities"), ((k % 10) / 10).alias("confidence"), (k % 4).alias("sources"),
    )
    return context.synthesis_prompts(rows)


@query(f"{_ASKS} SELECT query_id, 'Répondez brièvement.' || chr(10) || chr(10) || 'QUESTION:' || chr(10) || text AS quick, 'Comparez les deux textes.' || chr(10) || chr(10) || 'TEXTE 1:' || chr(10) || text || chr(10) || chr(10) || 'TEXTE 2:' || chr(10) || query_id AS comparison FROM asks")
def plain_prompts(spark, d):
    t, k = F.col("text"), F.col("query_id").cast("string")
    return samples.table(spark, "asks", d).select("query_id", context.plain_prompt("quick", t).alias("quick"), context.plain_prompt("comparison", t, k).alias("comparison"))


@query("SELECT conv_id, 'system:P|' || string_agg(role || ':' || text, '|' ORDER BY turn) AS messages FROM conversations GROUP BY 1")
def chat_messages(spark, d):
    found = context.chat_messages(_t(spark, d, "conversations"), "P")
    return found.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("messages"))


# graph


_STATUS = "SELECT doc_id, CASE WHEN n > 1 THEN 'failed' ELSE 'processed' END AS status, CASE WHEN n > 1 THEN 'dup-' ELSE 'doc-' END || doc_id AS status_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents)"


@query(_STATUS)
def document_status(spark, d):
    return graph.doc_status(_t(spark, d, "documents"))


@query("SELECT doc_id FROM documents WHERE length(trim(text)) >= 50")
def insertable_texts(spark, d):
    return graph.insertable(_t(spark, d, "documents")).select("doc_id")


MEN = r"me AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda x: length(x) >= 12)) AS entity FROM documents)"


@query(f"WITH {MEN} SELECT entity, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS chunk_ids, CAST(count(*) AS INT) AS n FROM me GROUP BY 1")
def entity_lists(spark, d):
    found = graph.entity_lists(graph.mentions(_t(spark, d, "documents")))
    return found.select("entity", F.array_join(F.transform("chunk_ids", lambda c: c.cast("string")), ",").alias("chunk_ids"), "n")


@query("WITH p AS (SELECT DISTINCT least(l_suppkey, l_linenumber) || '<SEP>' || greatest(l_suppkey, l_linenumber) AS relation, l_orderkey AS k FROM lineitem WHERE l_suppkey <> l_linenumber) SELECT relation, CAST(count(*) AS INT) AS n, CAST(sum(k) AS BIGINT) AS total FROM p GROUP BY 1")
def relation_lists(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_linenumber").cast("long").alias("dst"), F.col("l_orderkey").alias("doc_id"))
    found = graph.relation_lists(rows.select(F.least("src", "dst").cast("string").alias("src"), F.greatest("src", "dst").cast("string").alias("dst"), "doc_id").withColumns({"src": F.lpad("src", 12, "0"), "dst": F.lpad("dst", 12, "0")}))
    ends = F.split("relation", "<SEP>")
    named = F.concat_ws("<SEP>", F.get(ends, F.lit(0)).cast("long").cast("string"), F.get(ends, F.lit(1)).cast("long").cast("string"))
    return found.select(named.alias("relation"), "n", F.aggregate("chunk_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


EDG = f"{MEN}, co AS (SELECT entity FROM me GROUP BY 1 HAVING count(*) >= 2), so AS (SELECT me.* FROM me JOIN co USING (entity)), ed AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM so a JOIN so b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(f"WITH {EDG} SELECT (SELECT count(*) FROM co) AS nodes, count(*) AS edges FROM ed")
def graph_stats(spark, d):
    found = graph.mentions(_t(spark, d, "documents"))
    nodes = graph.entity_chunks(found).where("n_chunks >= 2")
    return graph.stats(nodes, graph.edges(found))


def _context(mode: str) -> str:
    near = "nr AS (SELECT DISTINCT q.doc_id AS query_id, q.entity AS seed, b.dst AS neighbour, weight FROM qm q JOIN bo b ON b.src = q.entity)"
    far = "fr AS (SELECT a.query_id, e.src AS seed, e.dst AS neighbour, e.weight FROM (SELECT DISTINCT query_id, neighbour AS node FROM nr) a JOIN ed e ON e.src = a.node JOIN (SELECT DISTINCT query_id, neighbour AS node FROM nr) c ON c.query_id = a.query_id AND c.node = e.dst)"
    source = {"local": "SELECT * FROM nr", "global": "SELECT * FROM fr", "hybrid": "SELECT * FROM nr UNION ALL SELECT * FROM fr"}[mode]
    return f"""WITH {EDG}, bo AS (SELECT src, dst, weight FROM ed UNION ALL SELECT dst, src, weight FROM ed), qm AS ({MEN[7:-1].replace('documents', 'benchmark').replace('DISTINCT doc_id', 'DISTINCT item_id AS doc_id')}), {near}, {far}, al AS ({source}),
    on1 AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY query_id, least(seed, neighbour), greatest(seed, neighbour) ORDER BY seed) = 1)
    SELECT query_id, seed, neighbour, weight, CAST(row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, seed, neighbour) AS INT) AS rnk FROM on1 QUALIFY rnk <= 10"""


def _graph_context(spark, d, mode):
    items = _t(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id")
    asked = graph.mentions(items).withColumnRenamed("doc_id", "query_id")
    e = graph.edges(graph.mentions(_t(spark, d, "documents")))
    return graph.context(items.select(F.col("doc_id").alias("query_id")), asked, e, mode)


@query(_context("local"))
def graph_context_local(spark, d):
    return _graph_context(spark, d, "local")


@query(_context("global"))
def graph_context_global(spark, d):
    return _graph_context(spark, d, "global")


#: A generator by rule: long capitalised words are entities, each is related to the next one in the text.
_NAMES = "[A-Z][a-z]{6,}"
_STATED = f"""l AS (SELECT doc_id, regexp_extract_all(text, '{_NAMES}') AS ns FROM documents), m AS (SELECT doc_id, ns[i] AS n, ns[i + 1] AS after, i FROM (SELECT doc_id, ns, unnest(generate_series(1, len(ns))) AS i FROM l)),
    me AS (SELECT DISTINCT doc_id, upper(n) AS entity, CASE WHEN length(n) > 9 THEN 'long' ELSE 'short' END AS kind, n || ' of ' || doc_id % 3 AS description FROM m),
    re AS (SELECT doc_id, least(upper(n), upper(after)) AS src, greatest(upper(n), upper(after)) AS dst, 1.0::DOUBLE + i % 2 AS weight FROM m WHERE after IS NOT NULL AND upper(n) <> upper(after)),
    ed AS (SELECT src, dst, sum(weight) AS weight, count(DISTINCT doc_id) AS n_chunks FROM re GROUP BY 1, 2)"""


def _generator(texts):
    """For texts that begin with their id."""
    out = []
    for t in texts:
        doc_id, _, body = t.partition(" ")
        names = re.findall(_NAMES, body)
        entities = [{"name": n, "type": "long" if len(n) > 9 else "short", "description": f"{n} of {int(doc_id) % 3}"} for n in names]
        out.append({"entities": entities, "relations": [{"source": a, "target": b, "weight": 1.0 + i % 2} for i, (a, b) in enumerate(zip(names, names[1:]), 1)]})
    return out


def _extracted(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("text"))
    return graph.extract(rows, _generator)


@query(f"WITH {_STATED}, f AS (SELECT entity, description, min(doc_id) AS first FROM me GROUP BY 1, 2), de AS (SELECT entity, string_agg(description, '<SEP>' ORDER BY first, description) AS description FROM f GROUP BY 1) SELECT entity, min(kind) AS kind, count(DISTINCT doc_id) AS n_chunks, min(doc_id) AS first_chunk, any_value(de.description) AS description FROM me JOIN de USING (entity) GROUP BY 1")
def extracted_entities(spark, d):
    return graph.merged_entities(_extracted(spark, d)[0])


@query(f"WITH {_STATED} SELECT src, dst, weight, n_chunks FROM ed")
def extracted_relations(spark, d):
    return graph.merged_relations(_extracted(spark, d)[1]).drop("description")


@query(f"WITH {_STATED}, li AS (SELECT entity, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS chunk_ids, CAST(count(*) AS INT) AS n FROM (SELECT DISTINCT entity, doc_id FROM me) GROUP BY 1) SELECT * FROM li")
def extracted_lists(spark, d):
    found = graph.entity_lists(_extracted(spark, d)[0])
    return found.select("entity", F.array_join(F.transform("chunk_ids", lambda c: c.cast("string")), ",").alias("chunk_ids"), "n")


@query(
    f"""WITH {_STATED}, qm AS (SELECT DISTINCT item_id AS query_id, upper(unnest(regexp_extract_all(text, '{_NAMES}'))) AS entity FROM benchmark), bo AS (SELECT src, dst, weight FROM ed UNION ALL SELECT dst, src, weight FROM ed),
    nr AS (SELECT DISTINCT query_id, entity AS seed, dst AS neighbour, weight FROM qm JOIN bo ON src = entity), on1 AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY query_id, least(seed, neighbour), greatest(seed, neighbour) ORDER BY seed) = 1)
    SELECT query_id, seed, neighbour, weight, CAST(row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, seed, neighbour) AS INT) AS rnk FROM on1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, seed, neighbour) <= 10"""
)
def extracted_context(spark, d):
    """Contexts of the questions from stated relations instead of shared chunks."""
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = items.select("query_id", F.explode(F.regexp_extract_all("text", F.lit(_NAMES), F.lit(0))).alias("n")).select("query_id", F.upper("n").alias("entity")).distinct()
    return graph.context(items, asked, graph.merged_relations(_extracted(spark, d)[1]).select("src", "dst", "weight"), "local")


@query(_context("hybrid"))
def graph_context_hybrid(spark, d):
    return _graph_context(spark, d, "hybrid")


_PARSED = """SELECT * FROM (VALUES (1::BIGINT, 'Le bail lie le bailleur et le preneur|rien ici du tout, une phrase assez longue', 'Bailleur|Preneur|Locataire', 'bail -> loyer', 'Article 8 du code'), (2, 'a|b', 'x', '', 'c1'),
    (3, 'Une phrase suffisamment longue pour compter. Courte. Une autre phrase bien assez longue ici.', '', '', 'Une phrase suffisamment longue pour compter. Courte. Une autre phrase bien assez longue ici.'), (4, '', '', '', ''),
    (5, 'encore un autre élément', '', '', '- court' || chr(10) || '* un fait sans titre mais long' || chr(10) || '→ encore un autre élément')) AS v(query_id, facts, entities, relations, chunks)"""


@query(_PARSED)
def parsed_contexts(spark, d):
    found = graph.parse_context(samples.table(spark, "contexts"))
    return found.select("query_id", *(F.array_join(c, "|").alias(c) for c in graph.CAPS))


@query("SELECT 2::BIGINT AS query_id, 'FAITS RELATIONNELS:' || chr(10) || '  - a' || chr(10) || '  - b' || chr(10) || chr(10) || 'ENTITÉS: x' || chr(10) || chr(10) || 'EXTRAITS:' || chr(10) || '  • c1' AS text UNION ALL SELECT 4, ''")
def rendered_contexts(spark, d):
    found = graph.parse_context(samples.table(spark, "contexts").where("query_id IN (2, 4)"))
    return found.select("query_id", graph.render(found).alias("text"))


# cache


@query("WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS sim FROM q, embeddings v WHERE v.vec_id <> query_id AND v.label < 7), b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) = 1) SELECT count(*) AS lookups, count(*) FILTER (sim >= 0.9) AS hits, count(*) FILTER (sim < 0.9) AS misses, round(count(*) FILTER (sim >= 0.9) / count(*), 4) AS hit_rate, round(100 * (count(*) FILTER (sim >= 0.9)) / count(*), 2) AS hit_percent FROM b")
def cache_stats(spark, d):
    e = _t(spark, d, "embeddings")
    day = F.lit("2024-01-01 00:00:00").cast("timestamp")
    entries = e.withColumn("ts", day - F.make_dt_interval(hours=F.col("label")))
    return semcache.stats(semcache.lookup(entries, e.where("vec_id % 50 = 0"), now=day, ttl=6 * 3600))


def _led(source: str, threshold: float) -> str:
    """walk (vec_id, leader) of source (vec_id, e, k), k from 1 in order of arrival: one row after another meets the leaders so far."""
    return f"""nb AS MATERIALIZED (SELECT a.k, a.vec_id, list(b.vec_id ORDER BY b.k) FILTER (b.vec_id IS NOT NULL) AS near
      FROM {source} a LEFT JOIN {source} b ON b.k < a.k AND round(list_cosine_similarity(a.e, b.e), 6) > {threshold} GROUP BY 1, 2),
    walk(k, heads, vec_id, leader) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT
      UNION ALL SELECT k, CASE WHEN f IS NULL THEN list_append(heads, vec_id) ELSE heads END, vec_id, coalesce(f, vec_id)
      FROM (SELECT nb.k, nb.vec_id, w.heads, list_filter(coalesce(nb.near, []), lambda x: list_contains(w.heads, x))[1] AS f FROM walk w JOIN nb ON nb.k = w.k + 1))"""


def _put_sql(source: str, threshold: float) -> str:
    """The cache after new entries came, over source (vec_id, e): every second one is old."""
    return f"""WITH RECURSIVE {source}, o AS (SELECT vec_id, e, 'old ' || vec_id AS answer FROM src WHERE vec_id % 2 = 0),
    u AS (SELECT vec_id, e, 'a new and longer answer ' || vec_id AS answer FROM src WHERE vec_id % 2 = 1 AND vec_id % 9 <> 0),
    f AS (SELECT u.vec_id, min(o.vec_id) AS leader FROM u, o WHERE round(list_cosine_similarity(u.e, o.e), 6) > {threshold} GROUP BY 1),
    own AS (SELECT vec_id, e, row_number() OVER (ORDER BY vec_id) AS k FROM u WHERE vec_id NOT IN (SELECT vec_id FROM f)), {_led('own', threshold)},
    told AS (SELECT vec_id, leader FROM f UNION ALL SELECT vec_id, leader FROM walk WHERE k > 0),
    l AS (SELECT leader, arg_max(answer, u.vec_id) AS answer, max(u.vec_id) AS ts FROM told JOIN u USING (vec_id) GROUP BY 1)
    SELECT o.vec_id, coalesce(l.answer, o.answer) AS answer, coalesce(ts, 0) AS ts FROM o LEFT JOIN l ON l.leader = o.vec_id UNION ALL SELECT leader, answer, ts FROM l WHERE leader NOT IN (SELECT vec_id FROM o)"""


#: Every vector three times, twice with its even components stretched: neighbours of .97 to .995.
STRETCHED = "src AS (SELECT vec_id * 3 + r.k AS vec_id, list_transform(embedding::DOUBLE[], lambda x, i: x * CASE WHEN i % 2 = 0 THEN 1 + 0.3::DOUBLE * r.k ELSE 1 END) AS e FROM embeddings, (SELECT unnest([0, 1, 2]) AS k) r)"


def stretched(e):
    each = e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    moved = F.transform("v", lambda x, i: x * F.when(i % 2 == 1, 1 + F.lit(0.3) * F.col("k")).otherwise(F.lit(1.0)))
    return each.select((F.col("vec_id") * 3 + F.col("k")).alias("vec_id"), moved.alias("embedding"))


def _put(e, same: float):
    old = e.where("vec_id % 2 = 0").select("vec_id", "embedding", F.concat(F.lit("old "), "vec_id").alias("answer"), F.lit(0).cast("long").alias("ts"))
    told = F.when(F.col("vec_id") % 9 == 0, "short").otherwise(F.concat(F.lit("a new and longer answer "), "vec_id"))
    new = e.where("vec_id % 2 = 1").select("vec_id", "embedding", told.alias("answer"), F.col("vec_id").alias("ts"))
    return semcache.put(old, new, same=same).select("vec_id", "answer", "ts")


@query(_put_sql(STRETCHED, SETTINGS.cache_same))
def cache_put(spark, d):
    return _put(stretched(_t(spark, d, "embeddings")), SETTINGS.cache_same)


@query(_put_sql("src AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)", 0.3))
def cache_put_loose(spark, d):
    return _put(_t(spark, d, "embeddings"), 0.3)


_AS_OF = f"""WITH RECURSIVE {STRETCHED}, s AS MATERIALIZED (SELECT vec_id, e, ts FROM src JOIN events ON event_id = vec_id),
    w AS MATERIALIZED (SELECT vec_id, e, epoch_us(ts) // 1000000 AS since, row_number() OVER (ORDER BY ts, vec_id) AS k FROM s WHERE vec_id % 2 = 0), {_led('w', SETTINGS.cache_same)},
    v AS MATERIALIZED (SELECT w.vec_id AS version, leader, since, least(since + 432000, coalesce(lead(since) OVER (PARTITION BY leader ORDER BY w.k), since + 432000)) AS until FROM walk JOIN w USING (vec_id)),
    q AS (SELECT vec_id AS query_id, e, epoch_us(ts) // 1000000 AS asked_at FROM s WHERE vec_id % 2 = 1),
    p AS (SELECT query_id, version, round(list_cosine_similarity(q.e, h.e), 6) AS sim FROM q JOIN v ON since < asked_at AND asked_at <= until JOIN w h ON h.vec_id = v.leader),
    b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, version) = 1)
    SELECT q.query_id, version, sim, coalesce(sim >= {SETTINGS.cache_hit}, false) AS hit FROM q LEFT JOIN b USING (query_id)"""


@query(_AS_OF)
def cache_as_of(spark, d):
    """A cache of five days' memory that is written and asked at the times of events."""
    when = _t(spark, d, "events").select(F.col("event_id").alias("vec_id"), "ts")
    rows = stretched(_t(spark, d, "embeddings")).join(when, "vec_id")
    writes = rows.where("vec_id % 2 = 0").withColumn("answer", F.concat(F.lit("an answer that is long enough "), "vec_id"))
    return semcache.lookup_as_of(semcache.versions(writes, 5 * 86_400), rows.where("vec_id % 2 = 1"))


@query(f"WITH a AS ({_AS_OF}) SELECT count(*) AS lookups, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 4) AS hit_rate, round(100 * (count(*) FILTER (hit)) / count(*), 2) AS hit_percent FROM a")
def cache_as_of_stats(spark, d):
    return semcache.stats(cache_as_of(spark, d))


@query("SELECT user_id, max(ts) AS ts, count(*) AS n FROM (SELECT user_id, ts, event_type FROM events WHERE NOT contains(lower(event_type), 'click')) GROUP BY 1")
def cache_invalidate(spark, d):
    rows = _t(spark, d, "events").select("user_id", "ts", F.col("event_type").alias("question"))
    return semcache.invalidate(rows, "Click").groupBy("user_id").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY 1")
def cache_upsert(spark, d):
    return semcache.newest(_t(spark, d, "events"), "user_id", "ts").select("user_id", "ts")


@query("WITH k AS (SELECT md5(event_type || user_id) AS md5, max(ts) AS ts FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events) SELECT md5, ts FROM k, m WHERE ts + INTERVAL 24 HOUR >= now ORDER BY ts DESC, md5 LIMIT 2500")
def encoder_cache(spark, d):
    rows = _t(spark, d, "events").select(F.concat("event_type", "user_id").alias("text"), "ts")
    return semcache.distinct_vectors(rows, rows.agg(F.max("ts")).first()[0], 86_400, 2500)


# evaluation


_METRICS = "SELECT doc_id, quality * 0.9 AS faithfulness, toxic * 0.5 AS context_precision, (doc_id % 10) / 10.0 AS answer_relevancy, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 0.4 END AS context_recall, 0.25 AS answer_correctness FROM labels"


@query(f"SELECT doc_id, round(0.35::DOUBLE * coalesce(faithfulness, 0) + 0.25 * coalesce(context_precision, 0) + 0.2 * coalesce(answer_relevancy, 0) + 0.1 * coalesce(context_recall, 0) + 0.1 * answer_correctness, 6) AS composite, round(0.35::DOUBLE * coalesce(faithfulness, 0) + 0.25 * coalesce(context_precision, 0), 6) AS enabled FROM ({_METRICS})")
def model_composite(spark, d):
    k = F.col("doc_id")
    rows = _t(spark, d, "labels").select(
        "doc_id", (F.col("quality") * 0.9).alias("faithfulness"), (F.col("toxic") * 0.5).alias("context_precision"), ((k % 10) / 10).alias("answer_relevancy"), F.when(k % 3 != 0, 0.4).alias("context_recall"), F.lit(0.25).alias("answer_correctness")
    )
    return rows.select("doc_id", evaluation.model_composite().alias("composite"), evaluation.model_composite(("faithfulness", "context_precision")).alias("enabled"))


@query("SELECT conv_id, round(least(1, count(DISTINCT role) / 3.0), 6) AS coverage FROM conversations GROUP BY 1")
def article_coverage(spark, d):
    rows = _t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("articles"))
    return rows.select("conv_id", evaluation.article_coverage(F.col("articles")).alias("coverage"))


_OVER = "SELECT CASE WHEN conv_id % 5 = 0 THEN 'adversarial' ELSE 'standard' END AS suite, (conv_id % 10) / 10.0 AS composite FROM conversations"


@query(f"WITH c AS ({_OVER}), a AS (SELECT coalesce(round(avg(composite) FILTER (suite = 'standard'), 3), 0) AS standard, coalesce(round(avg(composite) FILTER (suite = 'adversarial'), 3), 0) AS adversarial FROM c) SELECT *, round(0.8::DOUBLE * standard + 0.2 * adversarial, 3) AS overall FROM a")
def overall_score(spark, d):
    suite = F.when(F.col("conv_id") % 5 == 0, "adversarial").otherwise("standard")
    return evaluation.overall(_t(spark, d, "conversations").select(suite.alias("suite"), ((F.col("conv_id") % 10) / 10).alias("composite")))


_T = f"WITH {samples.cte('tests', True)}"


@query(f"{_T} SELECT component, test_name, '  ' || repeat('█', CAST(floor(score * 20) AS BIGINT)) || repeat('░', CAST(20 - floor(score * 20) AS BIGINT)) || ' ' || lpad(format('{{:.1f}}', score * 100), 5, ' ') || '%  ' || component || '/' || test_name || CASE WHEN error IS NOT NULL THEN ' [ERR: ' || error || ']' ELSE '' END AS line FROM tests")
def report_lines(spark, d):
    return evaluation.test_lines(samples.table(spark, "tests", d))


@query(f"{_T} SELECT count(*) AS tests, round(avg(score), 4) AS global_score, round(count(*) FILTER (passed) / count(*), 4) AS pass_rate FROM tests")
def report_summary(spark, d):
    return evaluation.test_summary(samples.table(spark, "tests", d))


@query("SELECT * FROM (VALUES ('adversarial', 2::BIGINT), ('standard', 3)) AS v(suite, n)")
def builtin_cases(spark, d):
    return evaluation.cases(spark).groupBy("suite").agg(F.count(F.lit(1)).alias("n"))


# questions that ask for the graph


def _triggered(spark, d):
    asks = samples.table(spark, "asks")
    wants = classify.analyse(classify.graph_trigger(asks)).where("use_graph OR wants_graph")
    law = samples.table(spark, "law").select(F.col("chunk_id").alias("doc_id"), "text")
    asked = graph.mentions(wants.select(F.col("query_id").alias("doc_id"), "text"), 4).withColumnRenamed("doc_id", "query_id")
    return graph.context(wants.select("query_id"), asked, graph.edges(graph.mentions(law, 4), 1), "local")


@query(
    f"""{_OWN_ASKS}, {samples.cte('law')}, w AS (SELECT query_id, text FROM asks WHERE query_id IN ({{ids}})), qm AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_extract_all(lower(text), '\\p{{{{L}}}}+'), lambda x: length(x) >= 4)) AS entity FROM w),
    me AS (SELECT DISTINCT chunk_id AS doc_id, unnest(list_filter(regexp_extract_all(lower(text), '\\p{{{{L}}}}+'), lambda x: length(x) >= 4)) AS entity FROM law), ed AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM me a JOIN me b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY 1, 2),
    bo AS (SELECT src, dst, weight FROM ed UNION ALL SELECT dst, src, weight FROM ed), nr AS (SELECT DISTINCT query_id, entity AS seed, dst AS neighbour, weight FROM qm JOIN bo ON src = entity), on1 AS (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY query_id, least(seed, neighbour), greatest(seed, neighbour) ORDER BY seed) = 1)
    SELECT query_id, seed, neighbour, weight, CAST(row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, seed, neighbour) AS INT) AS rnk FROM on1 QUALIFY rnk <= 10""".format(ids="1, 2, 3, 7, 13, 15, 24, 34")
)
def triggered_graph(spark, d):
    return _triggered(spark, d)
