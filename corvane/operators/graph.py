"""Entity graphs as tables: co-occurrence edges, inverted lists, neighbourhoods, and contexts read from them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.frames import spread
from corvane.functions.text import plain_key, sanitise_json, sentences
from corvane.operators import hooks
from corvane.sources.storage import materialise

# What names a section of a graph context, and what begins a bullet.
HEADINGS = (
    ("facts", ["fact", "fait"]),
    ("entities", ["entit"]),
    ("relations", ["relation", "liens"]),
    ("chunks", ["chunk", "extrait", "text", "source", "contexte", "passage"]),
)
BULLET = r"^(-|•|\*|→|▸|›)"
#: Ids in a list of an entity or a relation, about.
PAGE = 100_000
CAPS = {"facts": 15, "entities": 15, "relations": 10, "chunks": 5}


def mentions(docs: DataFrame, least_length: int = 12) -> DataFrame:
    """(doc_id, entity): long words stand in for entities that a model would extract."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    return spread(docs.select("doc_id", "text")).select("doc_id", F.explode(F.filter(found, lambda w: F.length(w) >= least_length)).alias("entity"))


def insertable(docs: DataFrame, least: int = 50) -> DataFrame:
    """Texts long enough for a graph, with what a hook would be given."""
    return docs.where(F.length(F.trim("text")) >= least)


def doc_status(docs: DataFrame) -> DataFrame:
    """(doc_id, status, status_id): of documents with equal texts the smallest id is processed, the others are failed duplicates."""
    key = F.md5(F.col("text").cast("binary"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("doc_id"))
    rows = docs.select("doc_id", nth.alias("n"))
    again = F.col("n") > 1
    return rows.select("doc_id", F.when(again, "failed").otherwise("processed").alias("status"), F.concat(F.when(again, "dup-").otherwise("doc-"), F.col("doc_id").cast("string")).alias("status_id"))


def entity_chunks(found: DataFrame) -> DataFrame:
    return found.groupBy("entity").agg(F.countDistinct("doc_id").alias("n_chunks"), F.min("doc_id").alias("first_chunk"))


def _listed(rows: DataFrame, key: str, page: int) -> DataFrame:
    """(key, page, chunk_ids, n) of distinct rows(key, doc_id): a list for every ``page`` ids or so, n is all of a key's."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n"))
    dealt = rows.join(counts, key).withColumn("page", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / page)).cast("int"))
    return dealt.groupBy(key, "page", "n").agg(F.sort_array(F.collect_list("doc_id")).alias("chunk_ids")).select(key, "page", "chunk_ids", "n")


def entity_lists(found: DataFrame, page: int = PAGE) -> DataFrame:
    """(entity, page, chunk_ids, n): the inverted list of each entity, in pages, with its whole length."""
    return _listed(found.where("doc_id IS NOT NULL").select("entity", "doc_id").distinct(), "entity", page)


def relation_lists(pairs: DataFrame, page: int = PAGE) -> DataFrame:
    """(relation, page, chunk_ids, n) of pairs(src, dst, doc_id): one list for a pair in either order, in pages."""
    key = F.concat_ws("<SEP>", F.least("src", "dst"), F.greatest("src", "dst"))
    return _listed(pairs.where("src <> dst AND doc_id IS NOT NULL").select(key.alias("relation"), "doc_id").distinct(), "relation", page)


def edges(found: DataFrame, least: int = 2) -> DataFrame:
    """(src, dst, weight), src < dst: entities that share ``least`` chunks, however frequent they are.

    Pairs come from a join of the mentions with themselves, whose large chunks Spark can split, not from lists that every row carries along.
    """
    many = entity_chunks(found).where(F.col("n_chunks") >= least).select("entity")  # rarer ones can't share as many
    each = found.where("doc_id IS NOT NULL").select("doc_id", "entity").distinct().join(many, "entity")
    pairs = each.select("doc_id", F.col("entity").alias("src")).join(each.select("doc_id", F.col("entity").alias("dst")), "doc_id").where("src < dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)


#: What a generator answers for a text, as JSON.
GRAPH = "entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,description:string,weight:double>>"


def extract(chunks: DataFrame, generator: Callable[[list[str]], list[str | dict | None]], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Entities (doc_id, entity, kind, description) and relations (doc_id, src, dst, description, weight) that a generator finds in chunks(doc_id, text).

    The generator answers a list of texts with JSON texts or dicts of the form ``GRAPH``; equal texts are sent once. Names are compared in capitals,
    without blanks at their ends; nameless entities, relations without one of their ends or with itself, and answers that are no JSON give nothing. A relation
    without weight counts 1. Ends that no entity names become entities of kind ``unknown``.
    """

    def answers(texts: list[str]) -> list[str | None]:
        return [a if a is None or isinstance(a, str) else json.dumps(a) for a in generator(texts)]

    told = hooks.apply(chunks.select("doc_id", F.col(text).alias("text")), "text", answers, "_said", "string")
    read = materialise(told.select("doc_id", F.from_json(sanitise_json("_said"), GRAPH).alias("g")), "extracted")

    def name(c: str) -> Column:
        return F.nullif(F.upper(F.trim(c, F.lit(" \t\n\r\f"))), F.lit(""))

    each = read.select("doc_id", F.explode("g.relations").alias("r")).select("doc_id", name("r.source").alias("a"), name("r.target").alias("b"), "r.description", F.coalesce("r.weight", F.lit(1.0)).alias("weight"))
    relations = each.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("doc_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "description", "weight")
    named = read.select("doc_id", F.explode("g.entities").alias("e")).select("doc_id", name("e.name").alias("entity"), F.coalesce("e.type", F.lit("unknown")).alias("kind"), "e.description").where("entity IS NOT NULL")
    ends = relations.select("doc_id", F.explode(F.array("src", "dst")).alias("entity")).distinct().join(named.select("doc_id", "entity").distinct(), ["doc_id", "entity"], "left_anti")
    entities = named.unionByName(ends.withColumns({"kind": F.lit("unknown"), "description": F.lit(None).cast("string")}))
    return entities, relations


def _described(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, description): the first ``most`` different descriptions in order of their first chunk, joined by the separator."""
    first = rows.where("description IS NOT NULL AND description <> ''").groupBy(*keys, "description").agg(F.min("doc_id").alias("_first"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_first", "description"))
    kept = first.withColumn("_n", nth).where(F.col("_n") <= most)
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "description"))), lambda x: x["description"]), "<SEP>").alias("description"))


def merged_entities(entities: DataFrame, most: int = 20) -> DataFrame:
    """(entity, kind, n_chunks, first_chunk, description): an entity over all its chunks. The most frequent kind counts, a known one before ``unknown``."""
    kinds = entities.groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("n"))
    best = kinds.groupBy("entity").agg(F.min(F.struct(F.col("kind") == "unknown", -F.col("n"), "kind"))["kind"].alias("kind"))
    return best.join(entity_chunks(entities), "entity").join(_described(entities, ["entity"], most), "entity", "left").select("entity", "kind", "n_chunks", "first_chunk", "description")


def merged_relations(relations: DataFrame, most: int = 20) -> DataFrame:
    """(src, dst, weight, n_chunks, description): a relation over all its chunks, weights added up; the edges for ``context``, ``degrees`` and ``one_hop``."""
    sums = relations.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.countDistinct("doc_id").alias("n_chunks"))
    return sums.join(_described(relations, ["src", "dst"], most), ["src", "dst"], "left")


def degrees(e: DataFrame) -> DataFrame:
    ends = e.select(F.col("src").alias("node"), "weight").unionByName(e.select(F.col("dst").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def one_hop(e: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, neighbour, weight) of seeds(node)."""
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.join(seeds.select(F.col("node").alias("src")), "src").select(F.col("src").alias("seed"), F.col("dst").alias("neighbour"), "weight")


def stats(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """One row: nodes and edges."""
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))  # one row each


def context(questions: DataFrame, found: DataFrame, e: DataFrame, mode: str = "hybrid", top: int = 10) -> DataFrame:
    """(query_id, seed, neighbour, weight, rnk): the strongest edges around what a question mentions.

    local: edges that touch a mentioned entity; global: the strongest edges between neighbours of mentioned ones;
    hybrid: both, an edge once. found (query_id, entity) are the questions' mentions.
    """
    asked = found.join(questions.select("query_id"), "query_id", "left_semi").select("query_id", F.col("entity").alias("seed")).distinct()
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    near = asked.join(both, F.col("seed") == F.col("src")).select("query_id", "seed", F.col("dst").alias("neighbour"), "weight")
    parts = [near] if mode != "global" else []
    if mode != "local":
        around = near.select("query_id", F.col("neighbour").alias("node")).distinct()
        a = around.join(e, F.col("node") == F.col("src")).select("query_id", "src", "dst", "weight")
        far = a.join(around.withColumnRenamed("node", "dst"), ["query_id", "dst"])
        parts.append(far.select("query_id", F.col("src").alias("seed"), F.col("dst").alias("neighbour"), "weight"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    pair = F.struct(F.least("seed", "neighbour"), F.greatest("seed", "neighbour"))
    once = F.row_number().over(Window.partitionBy("query_id", pair).orderBy("seed"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "seed", "neighbour"))
    return out.withColumn("_k", once).where("_k = 1").drop("_k").withColumn("rnk", rank).where(F.col("rnk") <= top)


def _heading(low: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, keys in reversed(HEADINGS):
        out = F.when(low.rlike("|".join(keys)), name).otherwise(out)
    return out


def parse_lines(contexts: DataFrame, key: str = "query_id", raw: str = "raw") -> DataFrame:
    """(key, pos, kind, item): what each line of a graph context that is not JSON holds.

    A line that contains a heading's word opens a section. Bullets belong to their section, or are facts if
    they have over ten characters. Other lines are chunks in a chunk section, entities of 4 to 99 characters in an entity
    section, relations if they hold an arrow in a relation section, and facts if they have over 20 characters.
    """
    lines = contexts.select(key, F.posexplode(F.split(raw, r"\r\n|\n|\r")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line", F.lit(" \t\f"))).where("line <> ''").withColumn("head", _heading(F.lower("line")))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.last("head", ignorenulls=True).over(w)).where("head IS NULL")
    bullet, n = F.col("line").rlike(BULLET), F.length("line")
    content = F.trim(F.substring("line", 2, 1 << 30), F.lit(" \t\f"))
    arrow = F.col("line").rlike("->|→|--")
    section = F.col("section")
    kind = (
        F.when(bullet & section.isNotNull(), section)
        .when(bullet & (F.length(content) > 10), "facts")
        .when(bullet, None)
        .when((section == "relations") & arrow, "relations")
        .when((section == "entities") & (n > 3) & (n < 100), "entities")
        .when(section == "chunks", "chunks")
        .when(n > 20, "facts")
    )
    out = rows.select(key, "pos", kind.alias("kind"), F.when(bullet, content).otherwise(F.col("line")).alias("item"))
    return out.where("kind IS NOT NULL")


def _json_lists(raw: Column) -> Column:
    shape = "struct<facts:array<string>,entities:array<string>,relations:array<string>,chunks:array<string>,context:array<string>>"
    return F.from_json(raw, shape)


def parse_context(contexts: DataFrame, key: str = "query_id", raw: str = "raw") -> DataFrame:
    """(key, facts, entities, relations, chunks): JSON objects as they are, other texts by their lines.

    A text without facts, entities and relations gives its sentences of over 20 characters, ten at most, as facts. Facts and
    entities that differ in case, accents or signs only count once; 15 facts, 15 entities, 10 relations and
    5 chunks stay; without a chunk the first 500 characters are one. Blank texts give empty lists.
    """
    rows = contexts.select(key, F.coalesce(raw, F.lit("")).alias("raw"))
    is_json = F.try_parse_json("raw").isNotNull() & F.trim("raw").startswith("{")
    none = F.array().cast("array<string>")
    typed = rows.where(is_json).withColumn("j", _json_lists(F.col("raw")))
    chunks = F.coalesce("j.chunks", "j.context", none)
    from_json = typed.select(key, *(F.coalesce(f"j.{n}", none).alias(n) for n in ("facts", "entities", "relations")), chunks.alias("chunks"))
    plain = rows.where(~is_json & (F.trim("raw", F.lit(" \t\n\r\f")) != ""))
    lines = parse_lines(plain, key, "raw")
    known = lines.where("kind <> 'chunks'").select(key).distinct()
    said = plain.join(known, key, "left_anti").select(key, F.posexplode(sentences(F.substring("raw", 1, 2000))).alias("pos", "item"))
    said = said.withColumn("item", F.trim("item", F.lit(" \t\n\r\f"))).where(F.length("item") > 20)
    said = said.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where("_n <= 10").drop("_n")
    each = lines.unionByName(said.select(key, "pos", F.lit("facts").alias("kind"), "item"))
    signed = F.when(F.col("kind").isin("facts", "entities"), plain_key("item")).otherwise(F.col("item"))
    each = each.withColumn("same", signed).where("same <> ''")
    first = F.row_number().over(Window.partitionBy(key, "kind", "same").orderBy("pos"))
    nth = F.row_number().over(Window.partitionBy(key, "kind").orderBy("pos"))
    cap = F.element_at(F.create_map(*(F.lit(x) for kv in CAPS.items() for x in kv)), F.col("kind"))
    kept = each.withColumn("_k", first).where("_k = 1").withColumn("_k", nth).where(F.col("_k") <= cap)

    def items(kind: str) -> Column:
        got = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "item"))))
        return F.transform(got, lambda x: x["item"]).alias(kind)

    grouped = kept.groupBy(key).agg(*(items(k) for k in CAPS))
    out = plain.join(grouped, key, "left")
    filled = [F.coalesce(k, none).alias(k) for k in ("facts", "entities", "relations")]
    some = F.when(F.size(F.coalesce("chunks", none)) > 0, F.col("chunks")).otherwise(F.array(F.substring("raw", 1, 500)))
    from_lines = out.select(key, *filled, some.alias("chunks"))
    blank = rows.where(~is_json & (F.trim("raw", F.lit(" \t\n\r\f")) == "")).select(key, *(none.alias(k) for k in CAPS))
    return from_json.unionByName(from_lines).unionByName(blank)


def render(df: DataFrame, most: int = 1500) -> Column:
    """A context string: 10 facts, 15 entities, 10 relations, 5 extracts of 300 characters, cut at ``most`` characters."""

    def some(name: str, n: int) -> Column:
        return F.slice(df[name], 1, n)

    def lines(items: Column, mark: str) -> Column:
        return F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"  {mark} "), x)), "\n")

    text = F.concat_ws(
        "\n",
        F.when(F.size(df["facts"]) > 0, F.concat(F.lit("FAITS RELATIONNELS:\n"), lines(some("facts", 10), "-"))),
        F.when(F.size(df["entities"]) > 0, F.concat(F.lit("\nENTITÉS: "), F.array_join(some("entities", 15), ", "))),
        F.when(F.size(df["relations"]) > 0, F.concat(F.lit("\nRELATIONS: "), F.array_join(some("relations", 10), ", "))),
        F.when(F.size(df["chunks"]) > 0, F.concat(F.lit("\nEXTRAITS:\n"), lines(F.transform(some("chunks", 5), lambda c: F.substring(c, 1, 300)), "•"))),
    )
    return F.substring(text, 1, most)
