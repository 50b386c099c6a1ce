"""Registered queries over the driver tables, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as T
from corvane.operators import chunking, classify, evaluation, extract, graph, lexical, relational, retrieval, semcache, vector
from corvane.plans.base import ARA, QUERIES, SQL, TOK, WRD, apart, query
from corvane.plans.base import has as _has
from corvane.plans.base import quote as _quote
from corvane.plans.base import rx as _rx
from corvane.plans.base import table as _t
from corvane.plans import answers, documents, people, samples, search  # noqa: F401 - they register their queries
from corvane.plans.search import BM25, KNN, POST
from corvane.plans.samples import QUESTIONS as SAMPLES
from corvane.streaming import events as stream

__all__ = ["QUERIES", "SQL"]


@query(r"SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'), '[^\p{L}\p{M}\p{N}_ ]', ' ', 'g'), ' +', ' ', 'g')))) AS norm, md5(lower(trim(regexp_replace(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'), '[^\p{L}\p{M}\p{N}_ ]', ' ', 'g')))) AS loose FROM documents")
def text_normalize(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.normalize("text").cast("binary")).alias("norm"), F.md5(T.normalize("text", False).cast("binary")).alias("loose"))


@query(f"SELECT doc_id, CAST(len({TOK}) AS INT) AS n, md5(array_to_string({TOK}, ' ')) AS digest FROM documents")
def text_tokens(spark, d):
    t = T.search_tokens("text")
    return _t(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


@query(
    f"SELECT doc_id, CAST(floor(len({WRD.format('text')}) * 1.3::DOUBLE) AS BIGINT) AS by_words, "
    f"CAST(greatest(1, CASE WHEN {ARA.format('text')} > 0.3 THEN floor(length(text) / 0.9) ELSE floor(length(text) / 4) END) AS BIGINT) AS by_chars FROM documents"
)
def token_estimate(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.tokens_by_words("text").cast("long").alias("by_words"), T.tokens_by_chars("text").cast("long").alias("by_chars"))


@query(f"SELECT lang, CASE WHEN {ARA.format('text')} > 0.5 THEN 'ar' WHEN {ARA.format('text')} > 0.1 THEN 'mixed' ELSE 'fr' END AS guess, count(*) AS n FROM documents GROUP BY 1, 2")
def lang_ratio(spark, d):
    return _t(spark, d, "documents").groupBy("lang", T.language("text", 0.5, 0.1).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""SELECT doc_id, length(trim(text)) < 10 OR (len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) + len(regexp_extract_all(text, '[\x{E000}-\x{F8FF}]'))) / greatest(length(text), 1) > 0.05
    OR len(regexp_extract_all(text, '[\x{E000}-\x{F8FF}]')) > 50 AS garbage, text = '' OR len(regexp_extract_all(text, '(?i)\(cid:[0-9]+\)')) / nullif(len(list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda x: x <> '')), 0) > 0.3 IS TRUE AS cid,
    md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\(cid:[0-9]+\)', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS clean FROM documents"""
)
def garbage_flag(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.garbage("text").alias("garbage"), T.cid_garbage("text").alias("cid"), F.md5(T.clean_cid("text").cast("binary")).alias("clean"))


@query("SELECT doc_id, substr(sha256(substr(text, 1, 5000) || source), 1, 16) AS uid, substr(md5(text), 1, 8) AS short FROM documents")
def doc_uid(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.document_uid("text", "source").alias("uid"), F.substring(F.md5(F.col("text").cast("binary")), 1, 8).alias("short"))


@query(r"SELECT doc_id, CAST(len(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1))) AS INT) AS sentences, CAST(len(string_split_regex(text, '\n[ \t\n\r\f]*\n')) AS INT) AS paragraphs FROM documents")
def sentence_split(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(T.sentences("text")).alias("sentences"), F.size(T.paragraphs("text")).alias("paragraphs"))


@query(
    """WITH c AS (SELECT doc_id, text, substr(text, 1, 400) AS cut FROM documents), e AS (SELECT *, greatest(
    CASE WHEN instr(reverse(cut), ' .') > 0 THEN length(cut) - instr(reverse(cut), ' .') ELSE -1 END, CASE WHEN instr(reverse(cut), ' ?') > 0 THEN length(cut) - instr(reverse(cut), ' ?') ELSE -1 END,
    CASE WHEN instr(reverse(cut), ' !') > 0 THEN length(cut) - instr(reverse(cut), ' !') ELSE -1 END, CASE WHEN instr(reverse(cut), chr(10) || '.') > 0 THEN length(cut) - instr(reverse(cut), chr(10) || '.') ELSE -1 END) AS last FROM c)
    SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN last > 280 THEN substr(cut, 1, last) ELSE cut END AS head FROM e"""
)
def truncate_tokens(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.truncate_to_tokens("text", 100).alias("head"))


@query(
    """WITH e AS (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(1, ceil((length(text) - 480) / 1920.0)) AS INT) - 1)) AS idx FROM documents),
    c AS (SELECT doc_id, CAST(idx AS INT) AS idx, trim(substr(text, CAST(idx * 1920 + 1 AS BIGINT), 2400)) AS t FROM e)
    SELECT doc_id, idx, substr(sha256(doc_id || ':' || idx || ':' || substr(t, 1, 40)), 1, 16) AS chunk_id, CAST(length(t) AS INT) AS chars FROM c WHERE length(t) > 0 AND greatest(1, floor(length(t) / 4)) >= 100"""
)
def fixed_window_chunks(spark, d):
    return chunking.windows(_t(spark, d, "documents"), least=100).select("doc_id", "idx", "chunk_id", F.length("text").alias("chars"))


@query()
def paragraph_chunks(spark, d):
    return chunking.paragraphs(_t(spark, d, "documents")).drop("text", "normalized_text")


@query(
    r"""WITH s AS (SELECT source, doc_id, unnest(p) AS x, unnest(generate_series(1, len(p))) AS pos FROM (SELECT source, doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents)),
    k AS (SELECT *, row_number() OVER (PARTITION BY source, regexp_replace(lower(x), '[^\p{L}\p{M}\p{N}_]', '', 'g') ORDER BY doc_id, pos) AS k FROM s)
    SELECT source, doc_id, md5(string_agg(x, ' ' ORDER BY pos)) AS digest FROM k WHERE k = 1 OR regexp_matches(x, REFERENCE) GROUP BY 1, 2 HAVING length(trim(string_agg(x, ' ' ORDER BY pos))) > 20""".replace("REFERENCE", search.REF)
)
def sentence_dedup(spark, d):
    kept = retrieval.drop_repeated_sentences(_t(spark, d, "documents"), "source", "doc_id")
    return kept.select("source", "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


_ROWS = ", ".join("({}, '{}')".format(i, s.replace("'", "''")) for i, s in enumerate(SAMPLES))
ASK = f"asked AS (SELECT 'u' || conv_id || '_' || turn AS id, text FROM conversations WHERE role = 'user' UNION ALL SELECT 'f' || i, t FROM (VALUES {_ROWS}) AS v(i, t))"


def _asked(spark, d):
    said = _t(spark, d, "conversations").where("role = 'user'").select(F.concat(F.lit("u"), "conv_id", F.lit("_"), "turn").alias("id"), "text")
    return said.unionByName(_samples(spark))


def _all_texts(spark, d):
    docs = _t(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return _asked(spark, d).unionByName(docs)


def _samples(spark):
    return spark.createDataFrame([(f"f{i}", s) for i, s in enumerate(SAMPLES)], "id string, text string")


_LANG = f"CASE WHEN {ARA.format('text')} > 0.3 THEN 'ar' ELSE 'fr' END"
def _some(keywords: list[str]) -> str:
    return "list_filter([" + ", ".join(map(_quote, keywords)) + "], lambda k: contains(q, k))"


_LEN = f"CASE WHEN len({WRD.format('q')}) > 18 THEN 1.0 WHEN len({WRD.format('q')}) > 12 THEN 0.5 ELSE 0 END"


@query(
    f"""WITH {ASK}, a AS (SELECT *, trim(lower(text)) AS q, {_LANG} AS lg FROM asked),
    p AS (SELECT *, CASE WHEN regexp_matches(q, {_quote(classify.FACTUAL)}) THEN 0 ELSE round({_LEN} + 1.5 * CASE WHEN lg = 'ar' THEN {_has('q', classify.COMPLEX['ar'])} ELSE {_has('q', classify.COMPLEX['fr'])} END
    + CASE WHEN len(regexp_extract_all(q, {_quote(classify.ARTICLE_COUNT)})) >= 2 OR len(regexp_extract_all(q, 'code|loi|décret')) >= 2 THEN 1.0 WHEN len(regexp_extract_all(q, {_quote(classify.ARTICLE_COUNT)})) >= 1 THEN 0.3 ELSE 0 END, 6) END::DOUBLE AS route_score FROM a)
    SELECT id, route_score, CASE WHEN route_score >= 2 THEN 'complex' WHEN route_score >= 1 THEN 'intermediate' ELSE 'simple' END AS mode,
    CAST(CASE WHEN route_score >= 2 THEN 50 WHEN route_score >= 1 THEN 40 ELSE 30 END AS INT) AS top_k, round(route_score / (route_score + 1), 6) AS confidence, route_score >= 1 AS use_hypothesis, route_score >= 2 AS use_graph,
    CASE WHEN regexp_matches(q, {_quote(classify.FACTUAL)}) THEN 'factual' ELSE coalesce(nullif(concat_ws('; ', CASE WHEN len({WRD.format('q')}) > 18 THEN 'long' WHEN len({WRD.format('q')}) > 12 THEN 'medium' END,
    CASE WHEN len(CASE WHEN lg = 'ar' THEN {_some(classify.COMPLEX['ar'])} ELSE {_some(classify.COMPLEX['fr'])} END) > 0 THEN 'keywords: ' || array_to_string((CASE WHEN lg = 'ar' THEN {_some(classify.COMPLEX['ar'])} ELSE {_some(classify.COMPLEX['fr'])} END)[1:2], ', ') END,
    CASE WHEN len(regexp_extract_all(q, {_quote(classify.ARTICLE_COUNT)})) >= 2 OR len(regexp_extract_all(q, 'code|loi|décret')) >= 2 THEN 'several references' WHEN len(regexp_extract_all(q, {_quote(classify.ARTICLE_COUNT)})) >= 1 THEN 'one reference' END), ''), 'default') END AS reason FROM p"""
)
def route_queries(spark, d):
    return classify.route(_asked(spark, d)).select("id", "route_score", "mode", "top_k", "confidence", "use_hypothesis", "use_graph", "reason")


@query(
    f"""WITH {ASK}, a AS (SELECT *, lower(text) AS q, {_LANG} AS lg FROM asked),
    p AS (SELECT *, round((0.15 * CASE WHEN lg = 'ar' THEN {_has('q', classify.RELATIONAL['ar'])} ELSE {_has('q', classify.RELATIONAL['fr'])} END + {_LEN}
    + CASE WHEN regexp_matches(q, 'article|chapitre') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(q, ' et | ou |comparé| contre ') THEN 0.25 ELSE 0 END
    + CASE WHEN regexp_matches(q, {_quote(classify.MULTI_HOP)}) THEN 0.4 ELSE 0 END - CASE WHEN regexp_matches(q, {_quote(classify.FACTUAL)}) THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS trigger_score FROM a)
    SELECT id, trigger_score, trigger_score >= 0.5 AS use_graph, CASE WHEN trigger_score > 0.7 THEN 'hybrid' WHEN trigger_score > 0.5 THEN 'local' WHEN trigger_score >= 0.5 THEN 'global' ELSE 'disabled' END AS graph_mode, round(least(trigger_score / 1.5, 1), 6) AS graph_confidence FROM p"""
)
def trigger_scores(spark, d):
    return classify.graph_trigger(_asked(spark, d)).select("id", "trigger_score", "use_graph", "graph_mode", "graph_confidence")


@query(
    f"""WITH {ASK}, {search.analysed('asked')} SELECT id, {_LANG} AS lang, array_to_string(regexp_extract_all(text, {_quote('(?i)' + classify.ARTICLE_REFERENCE)}, 1), '|') AS article_refs, n_words, is_definition, is_procedural, is_precise, strategy, alpha,
    is_procedural OR is_definition OR contains(q, 'différence') OR contains(q, 'relation') AS wants_graph FROM sa"""
)
def query_alpha(spark, d):
    return classify.analyse(_asked(spark, d)).drop("text").withColumn("article_refs", F.array_join("article_refs", "|"))


@query(
    f"""WITH {ASK}, a AS (SELECT id, text, lower(text) AS q FROM asked), f AS (SELECT *, {_has('q', classify.GREETINGS)} > 0 AND length(text) < 50 AS g, {_has('q', classify.LEGAL)} > 0 AS l FROM a)
    SELECT id, CASE WHEN g THEN 'greeting' WHEN l THEN 'legal_question' ELSE 'discussion' END AS intent, (CASE WHEN g THEN 0.8 WHEN l THEN 0.6 ELSE 0.3 END)::DOUBLE AS intent_confidence, l AND NOT g AS is_legal, CASE WHEN g THEN 'fr' ELSE {_LANG} END AS lang FROM f"""
)
def intent_heuristic(spark, d):
    return classify.intent(_asked(spark, d)).drop("text")


@query(f"WITH {ASK}, a AS (SELECT id, {search.expanded('text')} AS q FROM asked), b AS (SELECT id, q, {search.widened('q')} AS e FROM a) SELECT id, q AS variant FROM b UNION ALL SELECT id, e FROM b WHERE e <> q")
def expand_query(spark, d):
    return _asked(spark, d).select("id", F.explode(T.expand_question("text")).alias("variant"))


def _type_sql(source: str) -> str:
    """source: asked AS (id, text, file_name)."""
    parts = []
    for i, (name, (weight, category, fr, ar)) in enumerate(classify.TYPES.items()):
        def some(ps, weight=weight, name=name):
            named = [f"CASE WHEN contains(fn, {_quote(h)}) THEN 0.15::DOUBLE ELSE 0 END" for h in classify.NAME_HINTS.get(name, [])]
            return " + ".join([f"CASE WHEN regexp_matches(head, {_quote('(?i)' + T.wide(p))}) THEN {weight / len(ps)!r}::DOUBLE ELSE 0 END" for p in ps] + named)

        def marks(ps, name=name):
            named = [f"CASE WHEN contains(fn, {_quote(h)}) THEN {_quote('filename:' + h)} END" for h in classify.NAME_HINTS.get(name, [])]
            return "list_filter([" + ", ".join([f"CASE WHEN regexp_matches(head, {_quote('(?i)' + T.wide(p))}) THEN {_quote(p[:40])} END" for p in ps] + named) + "], lambda x: x IS NOT NULL)[1:5]"

        parts.append(f"SELECT id, t, lg, {i} AS o, {_quote(name)} AS kind, {_quote(category)} AS c, least(1, CASE WHEN lg = 'ar' THEN {some(ar)} ELSE {some(fr)} END) AS s, CASE WHEN lg = 'ar' THEN {marks(ar)} ELSE {marks(fr)} END AS w FROM h")
    lang = f"CASE WHEN text = '' THEN 'fr' WHEN {ARA.format('text')} > 0.3 THEN 'ar' WHEN {ARA.format('text')} > 0.1 THEN 'mixed' ELSE 'fr' END"
    penal = _has("lower(substr(t, 1, 2000))", classify.PENAL_WORDS)
    return f"""WITH {source}, h AS (SELECT id, text AS t, substr(text, 1, 3000) AS head, {lang} AS lg, lower(coalesce(file_name, '')) AS fn FROM (SELECT id, coalesce(text, '') AS text, file_name FROM asked)),
    u AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, o) AS k FROM u)
    SELECT id, CASE WHEN s >= 0.1 AND t <> '' THEN kind ELSE 'Inconnu' END AS doc_type, CASE WHEN s >= 0.1 AND t <> '' THEN round(s, 3) ELSE 0 END AS type_confidence,
    CASE WHEN s < 0.1 OR t = '' THEN 'Général' WHEN {penal} > 0 THEN 'Pénal' ELSE c END AS category, lg AS doc_lang,
    array_to_string(CASE WHEN s >= 0.1 AND t <> '' THEN w WHEN t = '' THEN ['Texte vide'] ELSE ['Aucun pattern trouvé'] END, '~') AS signals FROM r WHERE k = 1"""


def _typed(rows, file_name=None):
    found = classify.detect_type(rows, file_name=file_name)
    return found.select("id", "doc_type", "type_confidence", "category", "doc_lang", F.array_join("signals", "~").alias("signals"))


@query(_type_sql(ASK.replace("asked AS (", "asked AS (SELECT *, NULL::VARCHAR AS file_name FROM (") + ")"))
def detect_type(spark, d):
    return _typed(_asked(spark, d))


@query(_type_sql("asked AS (SELECT doc_id AS id, text, source AS file_name FROM documents)"))
def detect_documents(spark, d):
    docs = _t(spark, d, "documents")
    return _typed(docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("file_name")), "file_name")


@query(_type_sql(f"{samples.cte('rulings', True)}, asked AS (SELECT id, text, regexp_extract(path, '[^/]+$') AS file_name FROM rulings)"))
def detect_rulings(spark, d):
    return _typed(samples.table(spark, "rulings", d).select("id", "text", F.regexp_extract("path", "[^/]+$", 0).alias("file_name")), "file_name")


def _list(p: str, most: int | str = "", distinct: bool = True, col: str = "text") -> str:
    found = f"regexp_extract_all({col}, {_rx(p)}, 1)"
    firsts = f"list_filter({found}, lambda x, i: list_position({found}, x) = i)" if distinct else found
    return f"array_to_string(({firsts})[1:{most}], '|')"


_ENT = f"""SELECT id, {_list(extract.ARTICLE, 10, col=apart())} AS articles, {_list(extract.DATE, 5)} AS dates, {_list(extract.AMOUNT, 3, False)} AS amounts,
    nullif(regexp_extract(text, {_rx(extract.NUMBER)}, 1), '') AS article_number, regexp_matches(trim(text), {_rx(extract.HEADER)}) AS is_header FROM asked"""


def _entities(rows):
    return extract.entities(rows).select("id", *(F.array_join(c, "|").alias(c) for c in ("articles", "dates", "amounts")), "article_number", "is_header")


@query(f"WITH {ASK} {_ENT}")
def extract_entities(spark, d):
    return _entities(_asked(spark, d))


@query(f"WITH asked AS (SELECT doc_id AS id, text FROM documents) {_ENT}")
def document_entities(spark, d):
    return _entities(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def _steps(col: str, steps, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {_quote('|'.join(keys))}) THEN {_quote(name)}" for name, keys in steps) + f" ELSE {_quote(other)} END"


@query(f"WITH {ASK}, asked2 AS (SELECT * FROM asked UNION ALL SELECT 'd' || doc_id, text FROM documents) SELECT id, {_list(extract.CP)} AS articles_cp, {_list(extract.CPP)} AS articles_cpp, {_list(extract.TRIBUNAL)} AS courts, {_steps('lower(text)', extract.INCIDENTS, 'Non spécifié')} AS incident, {_steps('lower(text)', extract.GRAVITY, 'Indéterminée')} AS gravity FROM asked2")
def extract_penal(spark, d):
    found = extract.penal(_all_texts(spark, d))
    return found.select("id", *(F.array_join(c, "|").alias(c) for c in ("articles_cp", "articles_cpp", "courts")), "incident", "gravity")


@query(
    f"""WITH {ASK}, asked2 AS (SELECT * FROM asked UNION ALL SELECT 'd' || doc_id, text FROM documents) SELECT id, {_steps('lower(substr(text, 1, 1000))', extract.DECISIONS, 'Decision_Judiciaire')} AS decision,
    coalesce({', '.join(f"nullif(regexp_extract(text, {_quote(p.replace('(?iu)', '(?i)'))}, 1), '')" for p in extract.COURTS)}) AS court, nullif(regexp_extract(text, {_quote(extract.CASE_NUMBER)}, 1), '') AS case_number,
    CASE WHEN regexp_matches(substr(text, 1, 500), {_quote(extract.DAY)}) THEN regexp_extract(substr(text, 1, 500), {_quote(extract.DAY)}, 3) || '-' || regexp_extract(substr(text, 1, 500), {_quote(extract.DAY)}, 2) || '-' || regexp_extract(substr(text, 1, 500), {_quote(extract.DAY)}, 1) END AS decided FROM asked2"""
)
def extract_juris(spark, d):
    return extract.decision(_all_texts(spark, d)).drop("text")


TURNS = "turns AS (SELECT conv_id, turn, text AS question, lead(text) OVER w AS answer, lead(role) OVER w AS r2, lag(text) OVER w AS before, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), qa AS (SELECT conv_id, turn, question, answer, coalesce(before, '') || ' ' || question AS context FROM turns WHERE role = 'user' AND r2 = 'assistant')"
_D = "list_distinct(" + WRD.format("lower({0})") + ")"


def _answers(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, d, "conversations").withColumns({"answer": F.lead("text").over(w), "r2": F.lead("role").over(w), "before": F.lag("text").over(w)})
    said = F.concat(F.coalesce("before", F.lit("")), F.lit(" "), "text").alias("context")
    return rows.where("role = 'user' AND r2 = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer", said)


FAITH = f"""{TURNS}, ev AS (SELECT *, round(least(1, 1.5 * coalesce(len(list_intersect({_D.format('answer')}, {_D.format('context')})) / nullif(len({_D.format('answer')}), 0), 0)), 6) AS faithfulness,
 round(least(length(context) / 2000, 1), 6) AS precision_proxy, round(coalesce(len(list_intersect({_D.format('question')}, {_D.format('answer')})) / nullif(len({_D.format('question')}), 0), 0), 6) AS correctness FROM qa),
 ec AS (SELECT *, round(0.35::DOUBLE * faithfulness + 0.25::DOUBLE * precision_proxy + 0.40::DOUBLE * correctness, 6) AS composite FROM ev)"""


@query(f"WITH {FAITH} SELECT conv_id, turn, faithfulness, precision_proxy, correctness, composite FROM ec")
def faithfulness_lexical(spark, d):
    return evaluation.faithfulness(_answers(spark, d)).drop("question", "answer", "context")


@query(f"WITH {FAITH} SELECT conv_id % 10 AS suite, count(*) AS cases, round(avg(faithfulness), 3) AS faithfulness, round(avg(composite), 3) AS composite, count(*) FILTER (composite >= 0.7) AS passed, round(count(*) FILTER (composite >= 0.7) / count(*), 3) AS pass_rate FROM ec GROUP BY 1")
def batch_report(spark, d):
    return evaluation.report(evaluation.faithfulness(_answers(spark, d)).withColumn("suite", F.col("conv_id") % 10), "suite")


@query(f"WITH {KNN}, o AS (SELECT query_id, vec_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS k FROM pairs WHERE query_id <> vec_id) SELECT query_id, vec_id, sim, sim >= 0.9 AS hit FROM o WHERE k = 1")
def cache_lookup(spark, d):
    e = _t(spark, d, "embeddings")
    return semcache.lookup(e, e.where("vec_id % 50 = 0"))


@query("SELECT * FROM (SELECT user_id AS key, max(ts) AS accessed_at, count(*) AS hits FROM events GROUP BY 1) ORDER BY accessed_at DESC, hits DESC, key LIMIT 100")
def cache_evict(spark, d):
    used = _t(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("accessed_at"), F.count(F.lit(1)).alias("hits"))
    return semcache.evict(used, 100)


MEN = r"me AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda x: length(x) >= 12)) AS entity FROM documents), ec AS (SELECT entity, count(*) AS n_chunks, min(doc_id) AS first_chunk FROM me GROUP BY 1)"
EDG = f"{MEN}, so AS (SELECT me.* FROM me JOIN ec USING (entity) WHERE n_chunks >= 2), ed AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM so a JOIN so b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(f"WITH {MEN} SELECT * FROM ec")
def entity_chunks(spark, d):
    return graph.entity_chunks(graph.mentions(_t(spark, d, "documents")))


@query(f"WITH {EDG} SELECT * FROM ed")
def cooc_edges(spark, d):
    return graph.edges(graph.mentions(_t(spark, d, "documents")))


@query(f"WITH {EDG}, en AS (SELECT src AS node, weight FROM ed UNION ALL SELECT dst, weight FROM ed) SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM en GROUP BY 1")
def node_degree(spark, d):
    return graph.degrees(graph.edges(graph.mentions(_t(spark, d, "documents"))))


@query(f"WITH {EDG}, bo AS (SELECT src, dst, weight FROM ed UNION ALL SELECT dst, src, weight FROM ed), se AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '\\p{{L}}+'), lambda x: length(x) >= 12)) AS node FROM benchmark) SELECT src AS seed, dst AS neighbour, weight FROM bo JOIN se ON node = src")
def one_hop(spark, d):
    seeds = graph.mentions(_t(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id")).select(F.col("entity").alias("node")).distinct()
    return graph.one_hop(graph.edges(graph.mentions(_t(spark, d, "documents"))), seeds)


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def group_count(spark, d):
    return relational.counts(_t(spark, d, "customer"), "c_mktsegment")


@query("WITH l AS (SELECT conv_id, turn, '[' || turn || '] ' || upper(role) || ': ' || text AS l FROM conversations) SELECT conv_id, count(*) AS n_turns, string_agg(l, chr(10) ORDER BY turn, l) AS transcript FROM l GROUP BY 1")
def transcript(spark, d):
    return relational.transcript(_t(spark, d, "conversations"))


@query("WITH f AS (SELECT conv_id, arg_min(trim(text), turn) AS t FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1) SELECT conv_id, CASE WHEN length(t) > 30 THEN substr(t, 1, 30) || '...' ELSE t END AS title FROM f")
def conv_title(spark, d):
    return relational.titles(_t(spark, d, "conversations"))


@query("WITH g AS (SELECT event_id, user_id, coalesce(ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 SECOND, false) AS limited FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (limited) AS n_limited FROM g GROUP BY 1")
def rate_limit_gaps(spark, d):
    return relational.gaps(_t(spark, d, "events"), 2).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("limited").alias("n_limited"))


_PERMS = ", ".join(f"('{r}', '{p}')" for r, ps in relational.PERMISSIONS.items() for p in ps)
_USERS = "SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN 'client' WHEN 1 THEN 'premium' WHEN 2 THEN 'lawyer' ELSE 'admin' END AS role, CASE WHEN c_acctbal < 0 THEN 'pending' WHEN c_acctbal < 8000 THEN 'active' ELSE 'banned' END AS status FROM {}"


@query(f"WITH u AS ({_USERS.format('customer')}), p(role, permission) AS (VALUES {_PERMS}) SELECT permission, count(*) AS n FROM u JOIN p USING (role) WHERE status = 'active' OR (status = 'pending' AND permission IN ('use_chatbot', 'request_appointment')) GROUP BY 1")
def permission_counts(spark, d):
    users = spark.sql(_USERS.format("{t}"), t=_t(spark, d, "customer"))
    return relational.counts(relational.allowed(users), "permission")


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'cancelled' END AS status, count(*) AS n FROM orders GROUP BY 1")
def cancel_appointments(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending")
    return relational.counts(_t(spark, d, "orders").select(relational.cancel(status).alias("status")), "status")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    return stream.windowed(_t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, k"""
)
def event_sessions(spark, d):
    found = stream.sessions(_t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))
