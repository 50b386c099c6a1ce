"""Documents and rulings: folders, extraction, chunks, text helpers; over literal rulings and, where they can say something, the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import sql
from corvane.functions import text as T
from corvane.functions.text import wide
from corvane.operators import chunking, classify, extract
from corvane.plans import samples
from corvane.plans.answers import STRETCHED, stretched
from corvane.plans.base import ARA, TOK, WRD, apart, has, query, quote, rx
from corvane.plans.base import table as _t
from corvane.settings import SETTINGS
from corvane.sources.storage import materialise

_W = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"
_R = f"WITH {samples.cte('rulings', True)}, r AS (SELECT id, path, category, coalesce(text, '') AS text FROM rulings)"


def _rulings(spark, d):
    """Literal rulings and the documents."""
    return samples.table(spark, "rulings", d)


def _joined(c: str, sep: str = "|"):
    return F.array_join(c, sep).alias(c)


def _all(p: str, col: str = "text", group: int = 1) -> str:
    return f"regexp_extract_all({col}, {rx(p)}, {group})"


def _distinct(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def _trims(expr: str, longer: int = 0) -> str:
    return f"list_filter(list_transform({expr}, lambda x: trim(x, {_W})), lambda x: length(x) > {longer})"


# folders and classes


@query(
    f"""{_R}, p AS (SELECT id, category AS given, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM r),
    q AS (SELECT *, len(parts) AS n, list_position(list_transform(parts, lambda x: contains(lower(x), 'corpus')), true) AS first FROM p),
    v AS (SELECT *, CASE WHEN first > 0 THEN first ELSE greatest(1, n - 3) END AS piv FROM q),
    h AS (SELECT *, CASE WHEN piv < n THEN parts[piv + 1:n - 1] ELSE parts[1:n - 1] END AS hier FROM v), t AS (SELECT *, lower(hier[1]) AS top FROM h)
    SELECT id, array_to_string(hier, '/') AS hierarchy, CASE WHEN len(hier) > 0 THEN array_to_string(hier, ' > ') ELSE 'racine' END AS context_path,
    CASE WHEN {has('top', ['civil', 'مدني'])} > 0 THEN 'Civil' WHEN {has('top', ['penal', 'pénal', 'جنائي'])} > 0 THEN 'Pénal' WHEN {has('top', ['admin', 'إداري'])} > 0 THEN 'Administratif' ELSE 'Général' END AS category,
    coalesce(hier[2], hier[1], 'général') AS subcategory FROM t"""
)
def folder_topology(spark, d):
    found = classify.topology(_rulings(spark, d))
    return found.select("id", F.array_join("hierarchy", "/").alias("hierarchy"), "context_path", "category", "subcategory")


@query(f"{_R} SELECT id, CASE WHEN lower(trim(coalesce(category, ''))) IN ('pénal', 'penal', 'pénale') THEN 'penal' WHEN lower(trim(coalesce(category, ''))) = 'civil' THEN 'contract' ELSE 'ruling' END AS extractor FROM r")
def extractor_choice(spark, d):
    return _rulings(spark, d).select("id", classify.extractor_for(F.col("category")).alias("extractor"))


@query("""SELECT * FROM (VALUES ('g1', 'Jugement'), ('g2', 'Bail'), ('g3', 'PV'), ('g4', 'Code_de_loi')) AS v(id, doc_type)""")
def golden_cases(spark, d):
    rows = [
        ("g1", "باسم الشعب التونسي\nتقضي المحكمة بإدانة المتهم", "حكم_2024.pdf"), ("g2", "contrat de bail d'habitation\nbailleur: Mohamed Ali\nlocataire: Ahmed", "bail.pdf"),
        ("g3", "procès-verbal dressé par l'officier de police judiciaire", "pv_123.pdf"), ("g4", "مجلة الجزاء التونسية\nالفصل الأول\nالباب الأول", "code_penal.pdf"),
    ]
    return classify.detect_type(spark.createDataFrame(rows, "id string, text string, file_name string"), file_name="file_name").select("id", "doc_type")


@query("SELECT * FROM (VALUES (4::BIGINT, 3::BIGINT, 75.0::DOUBLE)) AS v(n, n_right, percent)")
def detector_accuracy(spark, d):
    rows = [("contrat de bail d'habitation, bailleur", "bail.pdf", "Bail"), ("procès-verbal, officier de police judiciaire", "pv_1.pdf", "PV"), ("rien du tout", None, "Inconnu"), ("rien du tout", "contrat.pdf", "Bail")]
    return classify.detector_accuracy(spark.createDataFrame(rows, "text string, file_name string, expected string"))


@query("SELECT label, CASE WHEN label = 0 AND sim >= 0.6 THEN 'Bail' WHEN label = 0 THEN 'Inconnu' ELSE 'L' || label END AS nature FROM (SELECT label, max(embedding[1]) + 0.3 AS sim FROM embeddings GROUP BY 1)")
def final_nature(spark, d):
    rows = _t(spark, d, "embeddings").groupBy("label").agg((F.max(F.col("embedding")[0]) + F.lit(0.3).cast("float")).alias("sim"))
    given = F.when(F.col("label") == 0, "Inconnu").otherwise(F.concat(F.lit("L"), "label"))
    return rows.select("label", classify.nature(given, F.lit("Bail"), F.col("sim")).alias("nature"))


@query(f"{_R} SELECT id, CASE WHEN {has('path', ['حوادث', 'accident', 'مرور'])} > 0 THEN 'Accident de circulation' WHEN {has('path', ['مخدرات', 'stupéfiant', 'drogue'])} > 0 THEN 'Affaire de stupéfiants' END AS case_type FROM r UNION ALL SELECT 'x1', 'Accident de circulation' UNION ALL SELECT 'x2', 'Affaire de stupéfiants'")
def path_case_type(spark, d):
    rows = _rulings(spark, d).select("id", "path").unionByName(spark.createDataFrame([("x1", "Pénal > accident"), ("x2", "Pénal > drogue")], "id string, path string"))
    return rows.select("id", classify.case_type(F.col("path")).alias("case_type"))


# extraction


def _marked(pattern: str, col: str = "t") -> str:
    """Parts around every match: the even ones (from 1) are matches."""
    return f"string_split(regexp_replace({col}, {rx('(?iu)(' + pattern + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1))"


@query(
    f"""{_R}, c AS (SELECT id, replace(replace(replace(regexp_replace(text, {quote(wide('(\\d)\\s+(\\d{3})'))}, '\\1\\2', 'g'), '٠', '0'), '١', '1'), '٢', '2') AS t FROM r),
    p AS (SELECT id, t, unnest(ps) AS m, unnest(generate_series(1, len(ps))) AS i, list_transform(ps, lambda x: length(x)) AS sizes FROM (SELECT id, t, {_marked(extract.MONEY)} AS ps FROM c)),
    m AS (SELECT id, t, m, i, coalesce(list_sum(sizes[1:i - 1]), 0) AS p0 FROM p WHERE i % 2 = 0)
    SELECT id, replace(regexp_extract(m, {rx(extract.MONEY_PARTS)}, 1), ' ', '') AS value, regexp_extract(m, {rx(extract.MONEY_PARTS)}, 2) AS currency,
    trim(substr(t, CAST(greatest(p0 - 19, 1) AS BIGINT), CAST(length(m) + 20 + least(p0, 20) AS BIGINT)), {_W}) AS context FROM m"""
)
def contract_amounts(spark, d):
    found = extract.contract(_rulings(spark, d))
    return found.select("id", F.inline("amounts"))


_C = f"{_R}, c AS (SELECT id, replace(replace(replace(regexp_replace(text, {quote(wide('(\\d)\\s+(\\d{3})'))}, '\\1\\2', 'g'), '٠', '0'), '١', '1'), '٢', '2') AS text FROM r)"
_PARTIES = _distinct("(" + " || ".join(_trims(_all(p), 3) for p in extract.PARTIES) + ")")
_KINDS = ", ".join(f"{{'n': {has('lower(text)', keys)}, 'o': {-i}, 't': '{name}'}}" for i, (name, keys) in enumerate(extract.TRANSACTIONS.items()))


@query(
    f"""{_C}, t AS (SELECT *, list_reverse_sort([{_KINDS}])[1] AS best FROM c)
    SELECT id, array_to_string(({_PARTIES})[1:10], '|') AS parties, array_to_string({_distinct(_all(extract.CONTRACT_DATE))}, '|') AS dates, array_to_string({_distinct(_all(extract.COC))}, '|') AS articles_coc,
    CASE WHEN best.n > 0 THEN best.t ELSE 'non_identifie' END AS transaction, CASE {' '.join(f"WHEN contains(text, {quote(c)}) THEN {quote(c)}" for c in extract.CITIES)} END AS city,
    array_to_string(({_trims(_all(extract.DUTY), -1)})[1:5], '|') AS duties, array_to_string({_distinct(_all(extract.GOODS))}, '|') AS goods, array_to_string({_distinct(_all(extract.DURATION))}, '|') AS durations,
    array_to_string(list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '{extract.TELLING}'))[1:3], '|') AS snippets FROM t"""
)
def extract_contract(spark, d):
    found = extract.contract(_rulings(spark, d))
    return found.select("id", *(_joined(c) for c in ("parties", "dates", "articles_coc")), "transaction", "city", *(_joined(c) for c in ("duties", "goods", "durations", "snippets")))


def _section(p: str) -> str:
    body = f"trim(regexp_extract(text, {rx(p)}, 1), {_W})"
    return f"CASE WHEN regexp_matches(text, {rx(p)}) THEN CASE WHEN length({body}) > 2000 THEN substr({body}, 1, 2000) || '...' ELSE {body} END END"


_PRINCIPLES = "(" + " || ".join(f"list_transform(list_filter({_all(p)}, lambda x: length(x) > 20), lambda x: trim(x, {_W}))" for p in extract.PRINCIPLES) + ")[1:10]"
_RULED = f"""array_to_string({' || '.join(_trims(_all(p), -1) for p in extract.PLAINTIFFS)}, '|') AS plaintiffs, array_to_string({' || '.join(_trims(_all(p), -1) for p in extract.DEFENDANTS)}, '|') AS defendants,
    {_section(extract.FACTS)} AS facts, {_section(extract.MEANS)} AS means, {_section(extract.HOLDING_TEXT)} AS holding, array_to_string({_PRINCIPLES}, '|') AS principles,
    array_to_string({_all('(?iu)' + extract.APPLIED, 'text', 0)}, '|') AS refs, array_to_string({_all('(?iu)' + extract.APPLIED, 'text', 2)}, '|') AS numbers, array_to_string({_all('(?iu)' + extract.APPLIED, 'text', 3)}, '|') AS codes"""


@query(f"{_R} SELECT id, {_RULED} FROM r")
def extract_rulings(spark, d):
    found = extract.ruling(_rulings(spark, d), strict=False)
    parts = {"refs": "reference", "numbers": "number", "codes": "code"}
    applied = [F.array_join(F.col(f"applied.{n}"), "|").alias(c) for c, n in parts.items()]
    return found.select("id", _joined("plaintiffs"), _joined("defendants"), "facts", "means", "holding", _joined("principles"), *applied)


@query(f"{_R} SELECT id, CASE WHEN regexp_matches(text, {rx(extract.HOLDING)}) THEN '' END AS holding FROM r")
def strict_holdings(spark, d):
    return extract.ruling(_rulings(spark, d)).select("id", "holding")


_COURT = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {rx(p)}, 1), '')" for p in extract.COURTS) + ")"
_GRAVE = " OR ".join(f"contains(lower(text), {quote(k)})" for _, keys in extract.GRAVITY for k in keys)


@query(
    f"""{_C}, t AS (SELECT c.id, c.text, r.text AS plain, CASE WHEN lower(trim(coalesce(category, ''))) IN ('pénal', 'penal', 'pénale') THEN 'penal' WHEN lower(trim(coalesce(category, ''))) = 'civil' THEN 'contract' ELSE 'ruling' END AS extractor FROM c JOIN r USING (id)),
    v AS (SELECT id, extractor, len(({_PARTIES})[1:10]) >= 2 OR regexp_matches(text, {rx('(?iu)' + extract.MONEY)}) AS c FROM t), w AS (SELECT id, extractor, plain AS text FROM t),
    x AS (SELECT id, {_COURT} IS NOT NULL OR coalesce({_section(extract.FACTS)}, '') <> '' OR coalesce({_section(extract.MEANS)}, '') <> '' AS j, regexp_matches(text, {rx(extract.CP)}) OR regexp_matches(text, {rx(extract.CPP)}) OR {_GRAVE} AS p FROM w)
    SELECT v.id, extractor, CASE extractor WHEN 'contract' THEN c WHEN 'ruling' THEN j ELSE p END AS valid FROM v JOIN x USING (id)"""
)
def extractor_validity(spark, d):
    return extract.dispatch(_rulings(spark, d)).select("id", "extractor", "valid")


@query(
    f"""{_R}, p AS (SELECT id, text, 4 AS pages, string_split(regexp_replace(text, {rx('(' + extract.PAGE + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS ps FROM r),
    e AS (SELECT id, text, pages, list_transform(ps, lambda x: length(x)) AS sizes, len(ps) AS n FROM p),
    m AS (SELECT id, text, pages, list_transform(list_filter(generate_series(1, n), lambda i: i % 2 = 0), lambda i: list_sum(sizes[1:i - 1])) AS marks FROM e)
    SELECT id, array_to_string(list_transform(CASE WHEN len(marks) < pages - 1 THEN list_transform(generate_series(1, pages - 1), lambda i: i * CAST(floor(length(text) / pages) AS BIGINT)) ELSE marks END, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS breaks FROM m"""
)
def page_breaks(spark, d):
    rows = _rulings(spark, d)
    return rows.select("id", F.array_join(F.transform(extract.page_breaks(F.col("text"), F.lit(4)), lambda x: x.cast("string")), ",").alias("breaks"))


# chunks

_BREAKS = r"(\n[ \t\n\r\f]*\n|\r\n[ \t\n\r\f]*\r\n)"


@query(
    f"""{_R}, p AS (SELECT id, string_split(regexp_replace(text, '{_BREAKS}', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS ps FROM r),
    e AS (SELECT id, unnest(ps) AS t, unnest(generate_series(1, len(ps))) AS i, list_transform(ps, lambda x: length(x)) AS sizes FROM p)
    SELECT id, trim(t, {_W}) AS text, CAST(coalesce(list_sum(sizes[1:i - 1]), 0) AS INT) AS start, CAST(coalesce(list_sum(sizes[1:i]), 0) AS INT) AS "end" FROM e WHERE i % 2 = 1 AND trim(t, {_W}) <> ''"""
)
def paragraph_offsets(spark, d):
    return _rulings(spark, d).select("id", F.inline(T.placed_paragraphs("text")))


_CHUNK = f"""b AS (SELECT doc_id, t, 0 AS idx, 0 AS p0, {{end}} AS stop FROM (SELECT doc_id, t, 0 AS p0 FROM docs WHERE t <> '') UNION ALL
    SELECT doc_id, t, idx + 1, p0, {{end}} FROM (SELECT doc_id, t, idx, greatest(p0 + 1, stop - {SETTINGS.overlap_chars}) AS p0, stop FROM b WHERE stop < length(t)))"""
_LOW = f"greatest(p0, least(p0 + {SETTINGS.window_chars}, length(t)) - 200)"
_STOP = f"least(p0 + {SETTINGS.window_chars}, length(t))"
_SNAP = f"length(regexp_extract(substr(t, CAST({_LOW} + 1 AS BIGINT), CAST({_STOP} - {_LOW} AS BIGINT)), '(?s)^.*[.!?][ \\t\\n\\r\\f]+'))"
_END = f"CAST(CASE WHEN {_STOP} < length(t) AND {_SNAP} > 0 THEN {_LOW} + {_SNAP} ELSE {_STOP} END AS INT)"
_TOKENS = f"greatest(1, CASE WHEN {ARA.format('text')} > 0.3 THEN floor(length(text) / 0.9) ELSE floor(length(text) / 4) END)"


@query(
    f"""WITH RECURSIVE docs AS (SELECT doc_id, trim(text, {_W}) AS t FROM documents), {_CHUNK.format(end=_END)},
    c AS (SELECT doc_id, CAST(idx AS INT) AS idx, trim(substr(t, CAST(p0 + 1 AS BIGINT), CAST(stop - p0 AS BIGINT)), {_W}) AS text FROM b)
    SELECT doc_id, idx, substr(sha256(doc_id || ':' || doc_id || ':' || idx || ':' || substr(text, 1, 40)), 1, 16) AS chunk_id, CAST(length(text) AS INT) AS chars,
    md5(lower(trim(regexp_replace(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_ ]', ' ', 'g')))) AS norm FROM c WHERE text <> '' AND {_TOKENS} >= {SETTINGS.min_tokens}"""
)
def snapped_chunks(spark, d):
    found = chunking.snapped(_t(spark, d, "documents"))
    return found.select("doc_id", "idx", "chunk_id", F.length("text").alias("chars"), F.md5(F.col("normalized_text").cast("binary")).alias("norm"))


@query(
    f"""WITH RECURSIVE docs AS (SELECT doc_id, trim(text, {_W}) AS t FROM documents), {_CHUNK.format(end=_END)},
    c AS (SELECT doc_id, CAST(idx AS INT) AS idx, trim(substr(t, CAST(p0 + 1 AS BIGINT), CAST(stop - p0 AS BIGINT)), {_W}) AS text FROM b)
    SELECT doc_id, idx, md5(text) AS digest, CAST(len({TOK}) AS INT) AS tokens,
    md5(lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_ ]', ' ', 'g'), ' +', ' ', 'g')))) AS norm FROM c"""
)
def sql_windows(spark, d):
    """Chunking, tokens and normalising said in SQL."""
    sql.register(spark)
    call = f"SELECT d.doc_id, w.idx, md5(CAST(w.text AS BINARY)) AS digest, size(search_tokens(w.text)) AS tokens, md5(CAST(normalized_text(w.text) AS BINARY)) AS norm FROM {{docs}} d, LATERAL snap_windows(d.text, {SETTINGS.window_chars}, {SETTINGS.overlap_chars}) w"
    return spark.sql(call, docs=_t(spark, d, "documents"))


@query()
def sql_packed(spark, d):
    """The chunks of ``paragraph_chunks`` by a table function."""
    sql.register(spark)
    return spark.sql(f"SELECT d.doc_id, p.* FROM {{docs}} d, LATERAL pack_paragraphs(d.text, {SETTINGS.pack_tokens}, {SETTINGS.pack_overlap}) p", docs=_t(spark, d, "documents"))


@query(
    """WITH p AS (SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT x, y, sim FROM p"""
)
def sql_cosines(spark, d):
    """Neighbouring vectors compared by the function of SQL."""
    sql.register(spark)
    call = "SELECT a.vec_id AS x, b.vec_id AS y, round(vector_cosine(CAST(a.embedding AS ARRAY<DOUBLE>), CAST(b.embedding AS ARRAY<DOUBLE>)), 6) AS sim FROM {e} a JOIN {e} b ON b.vec_id = a.vec_id + 1"
    return spark.sql(call, e=_t(spark, d, "embeddings"))


@query("SELECT doc_id, CAST(idx AS INT) AS idx, CAST(length(trim(substr(text, CAST(idx * 2400 + 1 AS BIGINT), 2400))) AS INT) AS chars FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(1, ceil(length(text) / 2400.0)) AS INT) - 1)) AS idx FROM documents) WHERE trim(substr(text, CAST(idx * 2400 + 1 AS BIGINT), 2400)) <> ''")
def basic_chunks(spark, d):
    return chunking.pieces(_t(spark, d, "documents")).select("doc_id", "idx", F.length("text").alias("chars"))


@query(
    """WITH s AS (SELECT vec_id // 25 AS doc_id, vec_id % 25 AS pos, 'phrase ' || vec_id AS text, embedding::DOUBLE[] AS e FROM embeddings),
    l AS (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM s),
    i AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND round(list_cosine_similarity(e, before), 6) < 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS INT) AS idx, count(*) AS n, string_agg(text, ' ' ORDER BY pos) AS text FROM i GROUP BY doc_id, island"""
)
def semantic_chunks(spark, d):
    e = _t(spark, d, "embeddings")
    rows = e.select(F.expr("vec_id div 25").alias("doc_id"), (F.col("vec_id") % 25).alias("pos"), F.concat(F.lit("phrase "), "vec_id").alias("text"), "embedding")
    return chunking.semantic(rows, 0.2)


@query(
    f"""WITH {STRETCHED}, s AS (SELECT vec_id // 75 AS doc_id, vec_id % 75 AS pos, 'phrase ' || vec_id AS text, e FROM src), l AS (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM s),
    i AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND round(list_cosine_similarity(e, before), 6) < 0.75 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS INT) AS idx, count(*) AS n, string_agg(text, ' ' ORDER BY pos) AS text FROM i GROUP BY doc_id, island"""
)
def semantic_chunks_close(spark, d):
    """With the usual cut, over vectors of which every three are near copies."""
    e = stretched(_t(spark, d, "embeddings"))
    rows = e.select(F.expr("vec_id div 75").alias("doc_id"), (F.col("vec_id") % 75).alias("pos"), F.concat(F.lit("phrase "), "vec_id").alias("text"), "embedding")
    return chunking.semantic(rows)


@query()
def packed_rulings(spark, d):
    number = F.substring("id", 2, 12).cast("long")
    rows = _rulings(spark, d).select(F.when(F.col("id").startswith("d"), number + 1000).otherwise(number).alias("doc_id"), "id", "path", "text")
    rows = rows.withColumn("uid", T.document_uid(F.coalesce("text", F.lit("")), "path")).withColumn("page_breaks", extract.page_breaks(F.coalesce("text", F.lit("")), F.lit(3)))
    return chunking.paragraphs(rows, 60, 120)


@query(
    f"""WITH RECURSIVE docs AS (SELECT doc_id, trim(text, {_W}) AS t FROM documents WHERE doc_id % 3 = 2), {_CHUNK.format(end=_END)},
    c AS (SELECT doc_id, CAST(idx AS INT) AS idx, trim(substr(t, CAST(p0 + 1 AS BIGINT), CAST(stop - p0 AS BIGINT)), {_W}) AS text FROM b),
    k AS (SELECT 0 AS kind, doc_id, 0 AS idx, 'c' || doc_id AS chunk_id, text FROM documents WHERE doc_id % 3 = 0
      UNION ALL SELECT 1, doc_id, 0, substr(sha256(doc_id || ':' || doc_id || ':0:' || substr(text, 1, 40)), 1, 16), text FROM documents WHERE doc_id % 3 = 1 AND length(trim(text)) >= 10
      UNION ALL SELECT 2, doc_id, idx, substr(sha256(doc_id || ':' || doc_id || ':' || idx || ':' || substr(text, 1, 40)), 1, 16), text FROM c WHERE text <> '' AND {_TOKENS} >= {SETTINGS.min_tokens})
    SELECT kind, doc_id, idx, chunk_id, md5(text) AS digest FROM k"""
)
def chosen_chunks(spark, d):
    """A third of the documents has chunks already, a third semantic ones, the rest gets windows."""
    docs = _t(spark, d, "documents")
    known = docs.where("doc_id % 3 = 0").select("doc_id", F.lit(0).alias("idx"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.lit("a").alias("article_id"), "text")
    meant = docs.where("doc_id % 3 = 1").select("doc_id", F.lit(0).alias("idx"), F.lit(1).alias("n"), "text")
    found = chunking.choose(docs, known, meant)
    return found.select((F.col("doc_id") % 3).cast("int").alias("kind"), "doc_id", "idx", "chunk_id", F.md5(F.col("text").cast("binary")).alias("digest"))


# text helpers


@query(
    f"""WITH {samples.cte('answers', True)}, b AS (SELECT id, regexp_extract(regexp_replace(text, '```(?:json)?', '', 'g'), '(?s)\\{{.*\\}}') AS body FROM answers)
    SELECT id, CASE WHEN body = '' THEN '{{}}' ELSE regexp_replace(body, '[ \\t\\n\\r\\f]+', ' ', 'g') END AS clean FROM b"""
)
def sanitised_json(spark, d):
    return samples.table(spark, "answers", d).select("id", T.sanitise_json("text").alias("clean"))


_STRIP = "text"
for _m in (r"\*\*", r"\*", "__", "_"):
    _STRIP = f"regexp_replace({_STRIP}, '{_m}(.*?){_m}', '\\1', 'g')"
_HTML = f"({_STRIP})"
for _a, _b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
    _HTML = f"replace({_HTML}, {quote(_a)}, '{_b}')"
_HTML = f"""replace(regexp_replace({_HTML}, '(https?://[^ \\t\\n\\r\\f]+)', '<a href="\\1" target="_blank" style="color: var(--accent-green); text-decoration: underline;">\\1</a>', 'g'), chr(10), '<br>')"""


@query(f"WITH {samples.cte('marked', True)} SELECT id, {_STRIP} AS plain, {_HTML} AS html FROM marked")
def html_text(spark, d):
    return samples.table(spark, "marked", d).select("id", T.strip_markdown("text").alias("plain"), T.to_html("text").alias("html"))


def _said(lang: str) -> str:
    words = ", ".join(map(quote, T.STOP_WORDS[lang]))
    return f"len(list_filter({WRD.format('lower(text)')}, lambda w: w IN ({words})))"


@query(f"SELECT doc_id, CASE WHEN {ARA.format('text')} > 0.3 THEN 'ar' WHEN {_said('fr')} > {_said('en')} THEN 'fr' WHEN {_said('en')} > {_said('fr')} THEN 'en' ELSE 'fr' END AS guess FROM documents")
def stop_word_language(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.detected_language("text").alias("guess"))


@query(
    """WITH known AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS word FROM part), asked AS (SELECT DISTINCT word, replace(word, 'e', 'x') AS typed FROM known WHERE contains(word, 'e')),
    near AS (SELECT typed, k.word, levenshtein(typed, k.word) AS n FROM asked a, known k WHERE levenshtein(typed, k.word) <= 2), best AS (SELECT typed, arg_min(word, {'n': n, 'w': word}) AS word FROM near GROUP BY 1)
    SELECT a.typed, coalesce(best.word, a.typed) AS corrected FROM asked a LEFT JOIN best USING (typed)"""
)
def spell_fix(spark, d):
    known = _t(spark, d, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("word")).distinct()
    asked = known.where("contains(word, 'e')").select(F.replace("word", F.lit("e"), F.lit("x")).alias("typed"))
    fixed = classify.correct_words(asked.select(F.col("typed").alias("id"), F.col("typed").alias("text")), known)
    return fixed.select(F.col("id").alias("typed"), F.col("text").alias("corrected"))


@query(
    """WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents), known AS MATERIALIZED (SELECT word FROM w GROUP BY 1 HAVING count(*) >= 10),
    a AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark), e AS (SELECT item_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos FROM a),
    u AS MATERIALIZED (SELECT DISTINCT word FROM e WHERE word NOT IN (SELECT word FROM known)),
    best AS (SELECT u.word, arg_min(k.word, {'n': levenshtein(u.word, k.word), 'w': k.word}) AS fixed FROM u, known k WHERE abs(length(u.word) - length(k.word)) <= 2 AND levenshtein(u.word, k.word) <= 2 GROUP BY 1),
    t AS (SELECT item_id, string_agg(coalesce(fixed, e.word), ' ' ORDER BY pos) AS text FROM e LEFT JOIN best ON best.word = e.word GROUP BY 1)
    SELECT item_id, coalesce(t.text, '') AS text FROM a LEFT JOIN t USING (item_id)"""
)
def spell_benchmark(spark, d):
    """Every benchmark text by the dictionary of words that ten documents have."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    known = _t(spark, d, "documents").select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("word")
    asked = _t(spark, d, "benchmark").select("item_id", F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), " ").alias("text"))
    return classify.correct_words(asked, materialise(known, "dictionary"), key="item_id")


_ARA = ARA.format("text")


@query(
    f"""WITH {samples.cte('asks', True)}, {samples.cte('rulings', True)}, t AS (SELECT query_id, text FROM asks UNION ALL SELECT 1000 + CAST(substr(id, 2) AS BIGINT), text FROM rulings)
    SELECT query_id, CASE WHEN {_ARA} > 0.5 THEN 'ar' WHEN {_ARA} > 0.1 THEN 'mixed' ELSE 'fr' END AS of_page, CASE WHEN {_ARA} > 0.3 THEN 'ar' WHEN {_ARA} > 0.1 THEN 'mixed' ELSE 'fr' END AS of_document,
    CASE WHEN {_ARA} > 0.3 THEN 'ar' ELSE 'fr' END AS of_question FROM t"""
)
def language_thresholds(spark, d):
    more = _rulings(spark, d).select((1000 + F.substring("id", 2, 12).cast("long")).alias("query_id"), "text")
    rows = samples.table(spark, "asks", d).unionByName(more)
    return rows.select("query_id", T.language("text", 0.5, 0.1).alias("of_page"), T.language("text", 0.3, 0.1).alias("of_document"), T.language("text", 0.3).alias("of_question"))


@query(f"{_R} SELECT id, replace(replace(replace(regexp_replace(text, {quote(wide('(\\d)\\s+(\\d{3})'))}, '\\1\\2', 'g'), '٠', '0'), '١', '1'), '٢', '2') AS text FROM r UNION ALL SELECT 'x', '102 30 1000'")
def repaired_numbers(spark, d):
    rows = _rulings(spark, d).select("id", F.coalesce("text", F.lit("")).alias("text")).unionByName(spark.createDataFrame([("x", "١٠٢ 30 1 000")], "id string, text string"))
    return rows.select("id", T.repair_numbers("text").alias("text"))


_KEY = r"trim(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}_ \t\n\r\f]', '', 'g'))"


@query(f"SELECT * FROM (VALUES (1::BIGINT, 'ete  cafe'), (2, 'fin 2'), (3, '')) AS v(id, key) UNION ALL SELECT 1000 + conv_id * 1000 + turn, {_KEY} FROM conversations")
def plain_keys(spark, d):
    rows = spark.createDataFrame([(1, "Été  «Café»!"), (2, "ﬁn ②"), (3, None)], "id long, text string")
    said = _t(spark, d, "conversations").select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return rows.unionByName(said).select("id", T.plain_key("text").alias("key"))


@query(f"WITH {samples.cte('answers', True)} SELECT id, CASE id WHEN 0 THEN '{{\"a\":1}}' WHEN 1 THEN '{{\"b\":[1,2]}}' ELSE CASE WHEN id < 1000 THEN '{{}}' WHEN id % 1000 % 3 = 0 THEN '{{\"turn\":' || id % 1000 || '}}' WHEN id % 1000 % 3 = 2 THEN '{{\"a\":[' || id % 1000 || ']}}' ELSE '{{}}' END END AS value FROM answers")
def parsed_json(spark, d):
    return samples.table(spark, "answers", d).select("id", F.to_json(T.parse_json("text")).alias("value"))


_DOC_ENTITIES = f"array_to_string(({_distinct(_all(extract.ARTICLE, apart()))})[1:10], '|') AS articles, array_to_string(({_distinct(_all(extract.DATE))})[1:5], '|') AS dates"


@query(f"{_R} SELECT id, false AS from_model, 'Inconnu' AS classification, {_DOC_ENTITIES} FROM r")
def structured_fallback(spark, d):
    rows = extract.structured(_rulings(spark, d), path="path")
    return rows.select("id", "from_model", "classification", F.array_join("structured.articles_cites", "|").alias("articles"), F.array_join("structured.dates_importantes", "|").alias("dates"))
