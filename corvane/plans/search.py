"""BM25, vectors and the whole retrieval, over the driver's tables and over a small literal body of law."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as T
from corvane.operators import chunking, classify, context, evaluation, index, lexical, retrieval, vector
from corvane.plans import samples
from corvane.plans.base import TOK, WRD, has, query, quote
from corvane.plans.base import table as _t
from corvane.sources.storage import fresh_path, materialise

POST = f"""lists AS MATERIALIZED (SELECT doc_id, {TOK} AS l FROM documents), tok AS (SELECT doc_id, unnest(l) AS term FROM lists), tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
dl AS (SELECT doc_id, len(l) AS dl FROM lists), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, s), me AS MATERIALIZED (SELECT avg(r) AS m FROM raw),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM raw, me)"""


@query(f"WITH {POST} SELECT term, df, round(idf, 6) AS idf FROM idf")
def term_stats(spark, d):
    docs = lexical.tokenised(_t(spark, d, "documents"))
    return lexical.term_weights(docs, docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"SELECT doc_id, CAST(len({TOK}) AS BIGINT) AS dl FROM documents")
def doc_lengths(spark, d):
    return lexical.lengths(_t(spark, d, "documents"))


@query(f"WITH {POST} SELECT doc_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tokens FROM tf GROUP BY 1")
def posting_counts(spark, d):
    post = lexical.postings(_t(spark, d, "documents"))
    return post.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"))


BM25 = f"""{POST}, qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOK}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT item_id, tf.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), s GROUP BY 1, 2),
mm AS (SELECT *, CASE WHEN count(*) OVER w < (SELECT n FROM s) THEN least(0, min(raw) OVER w) ELSE min(raw) OVER w END AS lo, max(raw) OVER w AS hi FROM sc WINDOW w AS (PARTITION BY item_id)),
un AS (SELECT item_id, doc_id, raw, round((raw - lo) / (hi - lo), 6) AS score FROM mm WHERE raw > 0 AND hi > lo),
bm AS (SELECT item_id, doc_id, round(raw, 6) AS raw, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rnk FROM un)"""


@query(f"WITH {BM25} SELECT item_id, doc_id, raw, score, CAST(rnk AS INT) AS rnk FROM bm WHERE rnk <= 10")
def bm25_topk(spark, d):
    return lexical.search(_t(spark, d, "documents"), _t(spark, d, "benchmark"), 10)


def _kept(spark, *batches):
    """An index that got its documents in batches."""
    made = index.Index(spark, fresh_path(spark, "index"))
    for b in batches:
        made.append(b)
    return made


_TOP10 = f"WITH {BM25} SELECT item_id, doc_id, raw, score, CAST(rnk AS INT) AS rnk FROM bm WHERE rnk <= 10"


@query(_TOP10)
def indexed_search(spark, d):
    """BM25 from an index that is written first and then read by the buckets of the questions' terms."""
    return _kept(spark, _t(spark, d, "documents")).search(_t(spark, d, "benchmark"), 10)


@query(_TOP10)
def indexed_appends(spark, d):
    """The same after three appends, the third of which brings documents of the first again, now with their right texts."""
    docs = _t(spark, d, "documents")
    third = F.col("doc_id") % 3 == 0
    return _kept(spark, docs.where(third).withColumn("text", F.concat(F.lit("older "), F.reverse("text"))), docs.where(~third), docs.where(third)).search(_t(spark, d, "benchmark"), 10)


@query(f"WITH {POST} SELECT term, df, round(idf, 6) AS idf FROM idf")
def indexed_merge(spark, d):
    """Figures of all terms after a merge of segments that replaced documents, some of which had waited."""
    docs = _t(spark, d, "documents")
    made = _kept(spark, docs.where("doc_id % 2 = 0").withColumn("text", F.reverse("text")), docs.where("doc_id % 2 = 1"))
    made.defer(docs.where("doc_id % 2 = 0"))
    made.flush()
    made.merge()
    return made.figures().select("term", "df", F.round("idf", 6).alias("idf"))


KNN = """pairs AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS sim FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rnk FROM pairs)"""


@query(f"WITH {KNN} SELECT query_id, vec_id, sim, CAST(rnk AS INT) AS rnk, round(greatest(0, least(1, (sim - min(sim) OVER w) / CASE WHEN max(sim) OVER w = min(sim) OVER w THEN 1 ELSE max(sim) OVER w - min(sim) OVER w END)), 6) AS score FROM nn WHERE rnk <= 10 WINDOW w AS (PARTITION BY query_id)")
def knn_cosine(spark, d):
    e = _t(spark, d, "embeddings")
    found = vector.min_max(vector.search(e, e.where("vec_id % 50 = 0"), 10))
    return found.select("query_id", "vec_id", "sim", "rnk", F.round("score", 6).alias("score"))


@query("WITH pairs AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS sim FROM embeddings v JOIN embeddings q USING (label) WHERE q.vec_id % 50 = 0), nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rnk FROM pairs) SELECT query_id, vec_id, sim, CAST(rnk AS INT) AS rnk FROM nn WHERE rnk <= 10")
def knn_filtered(spark, d):
    e = _t(spark, d, "embeddings")
    return vector.search(e, e.where("vec_id % 50 = 0"), 10, same="label")


@query(f"WITH {KNN}, vote AS (SELECT query_id, label, count(*) AS n, sum(sim) AS s FROM nn JOIN embeddings USING (vec_id) WHERE rnk BETWEEN 2 AND 6 GROUP BY 1, 2) SELECT query_id, label, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS k FROM vote) WHERE k = 1")
def label_vote(spark, d):
    e = _t(spark, d, "embeddings")
    near = vector.search(e, e.where("vec_id % 50 = 0"), 6).where("rnk >= 2").join(e.select("vec_id", "label"), "vec_id")
    votes = near.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "label"))
    return votes.withColumn("k", k).where("k = 1").drop("k")


def expanded(col: str) -> str:
    """The normalised form of a question."""
    out = rf"regexp_replace(lower({col}), {quote(T.wide(r'\b(art|art\.|article)\b\s*(\d+)'))}, 'article \2', 'g')"
    for a, b in T.REPLACEMENTS:
        out = f"replace({out}, {quote(a)}, {quote(b)})"
    return f"trim({out})"


def widened(q: str) -> str:
    """A normalised question with a word added that usually goes with it."""
    return f"{q} || CASE WHEN contains({q}, 'appel') AND NOT contains({q}, 'cour') THEN ' cour' ELSE '' END || CASE WHEN contains({q}, 'divorce') AND NOT contains({q}, 'juge') THEN ' juge' ELSE '' END"


def analysed(source: str) -> str:
    """f AS the marks of each question in a table (id, text, ...), s AS these with strategy and alpha."""
    return f"""f0 AS (SELECT *, lower(text) AS q, CAST(len({WRD.format('text')}) AS INT) AS n_words FROM {source}),
    f AS (SELECT *, regexp_matches(q, {quote(classify.DEFINITION)}) AS is_definition, {has('q', classify.PROCEDURAL)} > 0 AS is_procedural, regexp_matches(text, {quote(T.wide('\\d'))}) AND regexp_matches(q, 'art|المادة') AS is_precise FROM f0),
    s0 AS (SELECT *, CASE WHEN is_precise THEN 'bm25_heavy' WHEN is_definition THEN 'semantic' ELSE 'hybrid' END AS strategy FROM f),
    sa AS (SELECT *, round(CASE strategy WHEN 'bm25_heavy' THEN least(0.9, 0.5 + 0.02 * n_words) WHEN 'semantic' THEN 0.4 ELSE least(0.8, 0.4 + 0.02 * n_words) END::DOUBLE, 6) AS alpha FROM s0)"""


REF = quote("(?i)" + retrieval.REFERENCE)


def _compressed(name: str, source: str, full: bool) -> str:
    short = f"AND (length(key) >= 30 OR ref)" if full else ""
    return f"""{name}s AS (SELECT query_id, article_id, chunk_id, rnk, unnest(p) AS x, unnest(generate_series(1, len(p))) AS pos FROM (SELECT *, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM {source})),
    {name}k AS (SELECT *, regexp_replace(lower(x), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]', '', 'g') AS key, regexp_matches(x, {REF}) AS ref FROM {name}s),
    {name}f AS (SELECT *, row_number() OVER (PARTITION BY query_id, article_id, key ORDER BY rnk, chunk_id, pos) AS k FROM {name}k WHERE true {short}),
    {name}t AS (SELECT query_id, chunk_id, string_agg(x, ' ' ORDER BY pos) AS short FROM {name}f WHERE k = 1 OR ref GROUP BY 1, 2),
    {name} AS (SELECT b.* EXCLUDE (text, rnk), short AS text, row_number() OVER (PARTITION BY b.query_id ORDER BY hybrid DESC, b.chunk_id) AS rnk FROM {source} b JOIN {name}t t ON b.query_id = t.query_id AND b.chunk_id = t.chunk_id WHERE length(trim(short)) > 20)"""


_SCALE = "(c - min(c) OVER w) / CASE WHEN max(c) OVER w = min(c) OVER w THEN 1 ELSE max(c) OVER w - min(c) OVER w END"

#: The retrieval over qs (query_id, text), ch (chunk_id, article_id, text, titled, dated), ve (chunk_id, embedding), qv (query_id, variant, embedding).
HYB = f"""{analysed('qs')}, pq AS (SELECT query_id, alpha, least(20, 5 + n_words) AS top_k FROM sa),
qn AS (SELECT query_id, {expanded('text')} AS q FROM qs), v0 AS (SELECT query_id, 0 AS variant, q AS text FROM qn UNION ALL SELECT query_id, 1, {widened('q')} FROM qn WHERE {widened('q')} <> q),
cl AS (SELECT a.query_id FROM qv a JOIN qv b ON a.query_id = b.query_id AND a.variant = 1 AND b.variant = 0 WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) > 0.9),
va AS (SELECT * FROM v0 WHERE variant = 0 OR query_id NOT IN (SELECT query_id FROM cl)), vw AS (SELECT query_id, sum(CASE variant WHEN 0 THEN 1.0::DOUBLE ELSE 0.8 END) AS w FROM va GROUP BY 1),
vf AS (SELECT * FROM ve), lc AS (SELECT * FROM ch), lists AS MATERIALIZED (SELECT chunk_id, {TOK} AS l FROM lc), tok AS (SELECT chunk_id, unnest(l) AS term FROM lists), tf AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
dl AS (SELECT chunk_id, len(l) AS dl FROM lists), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, s), me AS MATERIALIZED (SELECT avg(r) AS m FROM raw),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM raw, me),
qt AS (SELECT query_id, variant, term, count(*) AS qtf FROM (SELECT query_id, variant, unnest({TOK}) AS term FROM va) GROUP BY 1, 2, 3),
sc AS (SELECT query_id, variant, tf.chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (chunk_id), s GROUP BY 1, 2, 3),
mm AS (SELECT *, CASE WHEN count(*) OVER w < (SELECT n FROM s) THEN least(0, min(raw) OVER w) ELSE min(raw) OVER w END AS lo, max(raw) OVER w AS hi FROM sc WINDOW w AS (PARTITION BY query_id, variant)),
un AS (SELECT query_id, variant, chunk_id, round((raw - lo) / (hi - lo), 6) AS score FROM mm WHERE raw > 0 AND hi > lo),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, chunk_id) AS rnk FROM un QUALIFY rnk <= 50),
dp AS (SELECT query_id, variant, chunk_id, round(list_cosine_similarity(qv.embedding::DOUBLE[], ve.embedding::DOUBLE[]), 6) AS c FROM qv JOIN va USING (query_id, variant), vf ve),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY c DESC, chunk_id) AS k FROM dp QUALIFY k <= 50),
dn AS (SELECT query_id, variant, chunk_id, {_SCALE} AS score FROM dr WINDOW w AS (PARTITION BY query_id, variant)),
mb AS (SELECT query_id, chunk_id, sum(CASE variant WHEN 0 THEN 1.0::DOUBLE ELSE 0.8 END * score) / any_value(w) AS b FROM bm JOIN vw USING (query_id) GROUP BY 1, 2),
md AS (SELECT query_id, chunk_id, sum(CASE variant WHEN 0 THEN 1.0::DOUBLE ELSE 0.8 END * score) / any_value(w) AS d FROM dn JOIN vw USING (query_id) GROUP BY 1, 2),
fu AS (SELECT query_id, chunk_id, coalesce(b, 0) AS b, coalesce(d, 0) AS d FROM mb FULL JOIN md USING (query_id, chunk_id)),
sb AS (SELECT query_id, chunk_id, {_SCALE.replace('(c ', '(b ').replace('(c)', '(b)')} AS b, {_SCALE.replace('(c ', '(d ').replace('(c)', '(d)')} AS d FROM fu WINDOW w AS (PARTITION BY query_id)),
h0 AS (SELECT sb.*, round(greatest(0, least(1, alpha * pow(b, 1.2) + (1 - alpha) * pow(d, 1.1))), 6) AS h, coalesce(ch.article_id, 'doc_' || sb.chunk_id) AS article_id, coalesce(text, '') AS text, coalesce(dated, false) AS dated
  FROM sb JOIN pq USING (query_id) LEFT JOIN ch ON ch.chunk_id = sb.chunk_id),
hy AS (SELECT query_id, chunk_id, article_id, b, d, round(least(1, CASE WHEN dated THEN least(1, h * 1.05) ELSE h END * (1 + coalesce(greatest(0, TRY_CAST(nullif(regexp_extract(text, '\\b((?:19|20)[0-9]{{2}})\\b', 1), '') AS INT) - 2020), 0) * 0.001)), 6) AS hybrid FROM h0),
ar AS (SELECT query_id, article_id, count(*) AS n, round((0.6 * avg(hybrid) + 0.4 * max(hybrid) + 0.2 * (1 - stddev_pop(hybrid))) / ln(1 + count(*)), 6) AS score FROM hy GROUP BY 1, 2),
ta AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS rnk FROM ar QUALIFY rnk <= 20),
c0 AS (SELECT hy.* EXCLUDE (hybrid), hybrid AS h, coalesce(nullif(text, ''), '[EMPTY_CHUNK]') AS text, coalesce(titled, false) AS titled FROM hy JOIN ta USING (query_id, article_id) LEFT JOIN ch ON ch.chunk_id = hy.chunk_id),
c1 AS (SELECT * EXCLUDE (h), round(least(1, h * (CASE WHEN regexp_matches(text, {REF}) THEN 1.3::DOUBLE ELSE 1 END * CASE WHEN contains(lower(text), 'code pénal') THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN titled THEN 1.05::DOUBLE ELSE 1 END)), 6) AS h FROM c0),
c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY query_id, text, article_id ORDER BY h DESC, chunk_id) = 1),
c3 AS (SELECT c2.* EXCLUDE (h), round(h * CASE WHEN ve.embedding IS NULL OR qv.embedding IS NULL THEN 1 ELSE 0.8 + 0.2 * list_cosine_similarity(qv.embedding::DOUBLE[], ve.embedding::DOUBLE[]) END, 6) AS hybrid
  FROM c2 LEFT JOIN ve ON ve.chunk_id = c2.chunk_id LEFT JOIN qv ON qv.query_id = c2.query_id AND qv.variant = 0),
ck AS (SELECT c3.*, top_k, row_number() OVER (PARTITION BY c3.query_id ORDER BY hybrid DESC, chunk_id) AS rnk FROM c3 JOIN pq ON pq.query_id = c3.query_id WHERE hybrid > 0.2 QUALIFY rnk <= least(greatest(5 * top_k, 20), 100)),
{_compressed('li', 'ck', False)},
rr AS (SELECT * EXCLUDE (rnk), hybrid AS final, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, chunk_id) AS rnk FROM li QUALIFY rnk <= top_k),
{_compressed('fl', 'rr', True)},
fi AS (SELECT * EXCLUDE (rnk, m), row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) AS rnk FROM (SELECT *, avg(final) OVER (PARTITION BY query_id) AS m FROM fl) WHERE final >= greatest(0.3, 0.5 * m))"""

TABLES = """qs AS (SELECT item_id AS query_id, text FROM benchmark), ch AS (SELECT doc_id AS chunk_id, 'art_' || (doc_id // 4) AS article_id, text, doc_id % 7 = 0 AS titled, false AS dated FROM documents),
ve AS (SELECT vec_id AS chunk_id, embedding FROM embeddings), qv AS (SELECT item_id AS query_id, v AS variant, embedding FROM benchmark, (VALUES (0), (1)) AS x(v) JOIN embeddings ON vec_id = item_id + 100 * v)"""
FLAG = f"WITH {TABLES}, {HYB}"
LAW = f"""WITH {samples.cte('asks')}, {samples.cte('law')}, qs AS (SELECT * FROM asks), ch AS (SELECT chunk_id, article_id, text, section IS NOT NULL AS titled, dated FROM law),
ve AS (SELECT chunk_id, embedding FROM law JOIN embeddings ON vec_id = chunk_id * 7), qv AS (SELECT query_id, v AS variant, embedding FROM asks, (VALUES (0), (1)) AS x(v) JOIN embeddings ON vec_id = query_id + 60 * v), {HYB}"""


def flagship(spark, d):
    """The arguments of ``retrieval.retrieve`` over the driver's tables: every benchmark passage is a question."""
    docs, items, e = (_t(spark, d, n) for n in ("documents", "benchmark", "embeddings"))
    questions = items.select(F.col("item_id").alias("query_id"), "text")
    article = F.concat(F.lit("art_"), F.expr("doc_id div 4").cast("string"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), article.alias("article_id"), "text", (F.col("doc_id") % 7 == 0).alias("titled"))
    return questions, chunks, e.select(F.col("vec_id").alias("chunk_id"), "embedding"), _asked(questions, e, 100)


def _asked(questions, e, step: int):
    """The vector of each question and of its second variant."""
    both = questions.select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("variant"))
    both = both.withColumn("vec_id", F.col("query_id") + step * F.col("variant"))
    return both.join(e.select("vec_id", "embedding"), "vec_id").select("query_id", "variant", "embedding")


def body_of_law(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    questions, law = samples.table(spark, "asks"), samples.table(spark, "law")
    chunks = law.select("chunk_id", "article_id", "text", F.col("section").isNotNull().alias("titled"), "dated")
    vectors = law.select("chunk_id", (F.col("chunk_id") * 7).alias("vec_id")).join(e, "vec_id").select("chunk_id", "embedding")
    return questions, chunks, vectors, _asked(questions, e, 60)


def _scores(spark, d, source=flagship):
    questions, *rest = source(spark, d)
    plan = retrieval.plan_questions(questions)
    return plan, retrieval.scores(plan, *rest), rest


_HY = "SELECT query_id, chunk_id, article_id, round(b, 6) AS b, round(d, 6) AS d, hybrid FROM hy"


@query(f"{FLAG} {_HY}")
def hybrid_score(spark, d):
    return _scores(spark, d)[1].select("query_id", "chunk_id", "article_id", F.round("b", 6).alias("b"), F.round("d", 6).alias("d"), "hybrid")


@query(f"{LAW} {_HY}")
def law_scores(spark, d):
    return _scores(spark, d, body_of_law)[1].select("query_id", "chunk_id", "article_id", F.round("b", 6).alias("b"), F.round("d", 6).alias("d"), "hybrid")


@query(f"{FLAG} SELECT query_id, article_id, n, score FROM ar")
def article_scores(spark, d):
    return retrieval.article_scores(_scores(spark, d)[1])


@query(f"{FLAG} SELECT query_id, article_id, n, score, CAST(rnk AS INT) AS rnk FROM ta")
def top_articles(spark, d):
    return retrieval.top_articles(retrieval.article_scores(_scores(spark, d)[1]))


_CK = "SELECT query_id, chunk_id, article_id, hybrid, top_k, CAST(rnk AS INT) AS rnk FROM ck"


def _candidates(spark, d, source=flagship):
    plan, scored, rest = _scores(spark, d, source)
    return retrieval.candidates(materialise(scored, "fused"), plan, *rest).select("query_id", "chunk_id", "article_id", "hybrid", "top_k", "rnk")


@query(f"{FLAG} {_CK}")
def candidate_dedup(spark, d):
    return _candidates(spark, d)


@query(f"{LAW} {_CK}")
def law_candidates(spark, d):
    return _candidates(spark, d, body_of_law)


_FI = "SELECT query_id, chunk_id, article_id, final, CAST(rnk AS INT) AS rnk, md5(text) AS digest FROM fi"


def _found(spark, d, source=flagship):
    found = retrieval.retrieve(*source(spark, d))
    return found.select("query_id", "chunk_id", "article_id", "final", "rnk", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"{FLAG} {_FI}")
def hybrid_retrieval(spark, d):
    return _found(spark, d)


@query(f"{LAW} {_FI}")
def law_retrieval(spark, d):
    return _found(spark, d, body_of_law)


#: Windows of the documents as chunks, whose ids are strings; every seventh document's chunks are meant, every chunk has one of the vectors, and a stand-in for a model gives logits.
_WINDOWS = f"""WITH wi AS (SELECT doc_id, unnest(generate_series(0, greatest(1, CAST(ceil((length(text) - 480) / 1920.0) AS INT)) - 1)) AS idx, text FROM documents),
wn AS (SELECT doc_id, idx, trim(substr(text, idx * 1920 + 1, 2400)) AS text FROM wi), nv AS (SELECT count(*) AS nv FROM embeddings),
qs AS (SELECT 'q' || item_id AS query_id, text FROM benchmark WHERE text IS NOT NULL),
ch AS (SELECT doc_id || '_' || idx AS chunk_id, 'art_' || doc_id AS article_id, text, doc_id % 7 = 0 AS titled, false AS dated FROM wn WHERE length(text) > 0),
ve AS (SELECT doc_id || '_' || idx AS chunk_id, embedding FROM wn, nv JOIN embeddings ON vec_id = (doc_id * 31 + idx) % nv WHERE length(text) > 0),
qv AS (SELECT 'q' || item_id AS query_id, v AS variant, embedding FROM benchmark, (VALUES (0), (1)) AS x(v) JOIN embeddings ON vec_id = item_id + 100 * v), {HYB}"""
_LOGIT = "((length(chunk_id) * 13 + length(text)) % 17 - 8) / 4.0"
_MEANT = _WINDOWS.replace("vf AS (SELECT * FROM ve)", "vf AS (SELECT ve.* FROM ve JOIN ch USING (chunk_id) WHERE titled)").replace(
    "rr AS (SELECT * EXCLUDE (rnk), hybrid AS final, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, chunk_id) AS rnk FROM li QUALIFY rnk <= top_k)",
    f"lf AS (SELECT li.*, 0.55 * hybrid + 0.45 / (1 + exp(-lg.logit)) AS f0, 0.7 * hybrid + 0.3 * b AS f1 FROM li LEFT JOIN (SELECT chunk_id, {_LOGIT} AS logit FROM ch WHERE chunk_id NOT LIKE '%3_0') lg USING (chunk_id)), rr AS (SELECT * EXCLUDE (rnk, f0, f1), round(coalesce(f0, f1), 6) AS final, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(f0, f1) DESC, chunk_id) AS rnk FROM lf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(f0, f1) DESC, chunk_id) <= top_k)",
)


def _logits(chunks):
    """A model that looks at texts only, and failed on some."""
    return chunks.where("chunk_id NOT LIKE '%3_0'").select("chunk_id", F.expr("((length(chunk_id) * 13 + length(text)) % 17 - 8) / 4.0D").alias("logit"))


def windows_of_documents(spark, d):
    """The arguments of ``retrieval.retrieve`` over the library's own chunks of ``documents``, which are cut once and stored."""
    docs, items, e = (_t(spark, d, n) for n in ("documents", "benchmark", "embeddings"))
    cut = chunking.windows(docs).withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("idx").cast("string")))
    cut = materialise(cut.select("chunk_id", "doc_id", "idx", "text"), "chunks")
    chunks = cut.select("chunk_id", F.concat(F.lit("art_"), F.col("doc_id").cast("string")).alias("article_id"), "text", (F.col("doc_id") % 7 == 0).alias("titled"))
    vectors = cut.withColumn("vec_id", (F.col("doc_id") * 31 + F.col("idx")) % e.count()).join(e, "vec_id").select("chunk_id", "embedding")
    questions = items.where("text IS NOT NULL").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), "text")
    asked = _asked(items.select(F.col("item_id").alias("query_id")), e, 100).withColumn("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    return questions, chunks, vectors, asked


@query(f"{_WINDOWS} {_FI}")
def retrieved_windows(spark, d):
    """Chunking, an index of the chunks that is written and read back, and the whole retrieval."""
    questions, chunks, *rest = windows_of_documents(spark, d)
    kept = index.Index(spark, fresh_path(spark, "index"), key="chunk_id")
    kept.append(chunks)
    found = retrieval.retrieve(questions, chunks, *rest, index=kept)
    return found.select("query_id", "chunk_id", "article_id", "final", "rnk", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"{_MEANT} {_FI}")
def filtered_retrieval(spark, d):
    """With a condition that only the dense branch knows, and a model's logits, which some chunks lack."""
    questions, chunks, *rest = windows_of_documents(spark, d)
    found = retrieval.retrieve(questions, chunks, *rest, where="titled", logits=_logits(chunks))
    return found.select("query_id", "chunk_id", "article_id", "final", "rnk", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"{_MEANT.replace('lc AS (SELECT * FROM ch)', 'lc AS (SELECT * FROM ch WHERE titled)')} {_FI}")
def filtered_both(spark, d):
    """With a condition that both branches know, and logits."""
    questions, chunks, *rest = windows_of_documents(spark, d)
    found = retrieval.retrieve(questions, chunks, *rest, where=F.col("titled"), filter_lexical=True, logits=_logits(chunks))
    return found.select("query_id", "chunk_id", "article_id", "final", "rnk", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"{FLAG} SELECT query_id, count(*) AS n, round(min(final), 6) AS least, round(avg(final), 6) AS mean FROM fi GROUP BY 1")
def final_threshold(spark, d):
    found = retrieval.retrieve(*flagship(spark, d))
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("final"), 6).alias("least"), F.round(F.avg("final"), 6).alias("mean"))


@query(f"{FLAG}, cf AS (SELECT query_id, count(*) AS n, round(0.5 * max(CASE WHEN rnk <= 1 THEN final END) + 0.3 * avg(CASE WHEN rnk <= 3 THEN final END) + 0.2 * (1 - stddev_pop(CASE WHEN rnk <= 5 THEN final END)), 6) AS confidence FROM fi GROUP BY 1) SELECT *, n >= 2 AND confidence >= 0.45 AS answered FROM cf")
def confidence_gate(spark, d):
    return retrieval.confidence(retrieval.retrieve(*flagship(spark, d)), "final")


@query(f"{LAW} SELECT query_id, string_agg('[' || article_id || '] ' || substr(text, 1, 600) || '...', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rnk) AS context FROM fi GROUP BY 1")
def answer_context(spark, d):
    return retrieval.joined_context(retrieval.retrieve(*body_of_law(spark, d)))


@query(f"{LAW}, ev AS (SELECT query_id, string_agg(CAST(chunk_id AS VARCHAR), '|' ORDER BY rnk) AS chunks, count(*) AS n_contexts, string_agg(DISTINCT article_id, '|' ORDER BY article_id) AS articles FROM fi GROUP BY 1) SELECT a.query_id, coalesce(chunks, '') AS chunks, articles, CAST(coalesce(n_contexts, 0) AS BIGINT) AS n_contexts FROM asks a LEFT JOIN ev ON a.query_id = ev.query_id")
def evaluation_rows(spark, d):
    questions, *_ = body_of_law(spark, d)
    rows = retrieval.for_evaluation(retrieval.retrieve(*body_of_law(spark, d)), questions.select("query_id", F.col("text").alias("answer")))
    return rows.select("query_id", F.array_join(F.transform("chunk_ids", lambda c: c.cast("string")), "|").alias("chunks"), F.array_join("article_ids", "|").alias("articles"), "n_contexts")


@query(
    f"""{FLAG}, pt AS (SELECT query_id, rnk, '**Source:** ' || article_id || chr(10) || chr(10) || substr(text, 1, 600) AS part, row_number() OVER (PARTITION BY query_id, article_id ORDER BY rnk) AS nth FROM fi),
    rs AS (SELECT *, coalesce(sum(length(part)) OVER w + 2 * (count(*) OVER w - 1), 0) AS bf FROM pt WHERE nth <= 3 WINDOW w AS (PARTITION BY query_id ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT query_id, count(*) AS n_chunks, CAST(sum(length(part)) + 2 * (count(*) - 1) AS BIGINT) AS chars, md5(string_agg(part, chr(10) || chr(10) ORDER BY rnk)) AS context FROM rs WHERE bf <= 10500 GROUP BY 1"""
)
def context_pack(spark, d):
    packed = context.pack(retrieval.retrieve(*flagship(spark, d)).select("query_id", "article_id", "rnk", "text"))
    return packed.withColumn("context", F.md5(F.col("context").cast("binary")))


@query("SELECT count(DISTINCT source) AS documents, count(*) AS chunks, count(DISTINCT doc_id // 4) AS articles, (SELECT count(*) FROM embeddings) AS vectors, count(*) FILTER (doc_id NOT IN (SELECT vec_id FROM embeddings)) AS pending FROM documents")
def index_health(spark, d):
    """Every document is a chunk of its source; those beyond the vectors wait for one."""
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return retrieval.health(_t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.expr("doc_id div 4").alias("article_id"), F.col("source").alias("doc_uid")), vectors)


@query(f"WITH {samples.cte('law')}, al AS (SELECT chunk_id, article_id, doc_uid, section FROM law UNION ALL SELECT 1000 + doc_id, 'art_' || (doc_id // 4), coalesce(source, 'x'), CASE WHEN doc_id % 5 > 0 THEN lang END FROM documents) SELECT article_id, min(doc_uid) AS doc_uid, arg_min(coalesce(section, ''), chunk_id) AS title, count(*) AS n_chunks, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY chunk_id) AS chunk_ids FROM al GROUP BY 1")
def article_index(spark, d):
    names = ["chunk_id", "article_id", "doc_uid", "section"]
    article = F.concat(F.lit("art_"), F.expr("doc_id div 4").cast("string"))
    more = _t(spark, d, "documents").select((1000 + F.col("doc_id")).alias("chunk_id"), article.alias("article_id"), F.coalesce("source", F.lit("x")).alias("doc_uid"), F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("section"))
    chunks = samples.table(spark, "law").select(*names).unionByName(more).withColumn("index", F.col("chunk_id"))
    found = vector.article_index(chunks.withColumn("section", F.coalesce("section", F.lit(""))))
    return found.select("article_id", "doc_uid", "title", "n_chunks", F.array_join(F.transform("chunk_ids", lambda c: c.cast("string")), ",").alias("chunk_ids"))


@query(f"WITH {BM25}, rel AS (SELECT item_id, doc_id FROM benchmark b JOIN documents t ON contains(t.text, b.text)), be AS (SELECT item_id, min(rnk) AS rnk FROM rel LEFT JOIN (SELECT * FROM bm WHERE rnk <= 10) USING (item_id, doc_id) GROUP BY 1) SELECT count(*) AS items, count(*) FILTER (rnk <= 1) AS hit_1, count(*) FILTER (rnk <= 10) AS hit_10, round(avg(coalesce(1.0 / rnk, 0)), 6) AS mrr FROM be")
def hit_at_k(spark, d):
    docs, items = _t(spark, d, "documents"), _t(spark, d, "benchmark")
    return evaluation.hit_at_k(lexical.search(docs, items, 10), evaluation.containing(docs, items))
