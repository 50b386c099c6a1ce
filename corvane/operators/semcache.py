"""A semantic answer cache as a table: lookups, near-equal entries, expiry and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.leaders import lead
from corvane.operators.vector import nearer_than, search
from corvane.settings import SETTINGS
from corvane.sources.storage import materialise


def lookup(entries: DataFrame, questions: DataFrame, threshold: float = SETTINGS.cache_hit, now=None, ttl: int | None = None, keep_self: bool = False) -> DataFrame:
    """(query_id, vec_id, sim, hit): the best entry, other than the question itself unless ``keep_self``.

    With now and ttl only entries (with ts) that have not expired are looked at.
    """
    alive = entries if now is None else live(entries, now, ttl)
    return search(alive, questions, 1, keep_self).select("query_id", "vec_id", "sim", (F.col("sim") >= threshold).alias("hit"))


def counted(entries: DataFrame, found: DataFrame, now) -> DataFrame:
    """entries with hits and accessed_at as they are after the lookups ``found``."""
    used = found.where("hit").groupBy("vec_id").agg(F.count(F.lit(1)).alias("_n"))
    out = entries.join(used, "vec_id", "left")
    return out.withColumns({"hits": F.col("hits") + F.coalesce("_n", F.lit(0)), "accessed_at": F.when(F.col("_n") > 0, F.lit(now)).otherwise(F.col("accessed_at"))}).drop("_n")


def stats(found: DataFrame) -> DataFrame:
    """One row: lookups, hits, misses, hit_rate to four places and hit_percent to two."""
    n = F.count(F.lit(1))
    share = F.coalesce(F.try_divide(F.count_if("hit"), n), F.lit(0.0))
    return found.agg(n.alias("lookups"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(share, 4).alias("hit_rate"), F.round(100 * share, 2).alias("hit_percent"))


def live(entries: DataFrame, now, ttl: int | Column) -> DataFrame:
    secs = F.lit(ttl) if isinstance(ttl, int) else ttl
    return entries.where(F.col("ts") + F.make_dt_interval(secs=secs) >= F.lit(now))


def put(entries: DataFrame, new: DataFrame, same: float = SETTINGS.cache_same, least: int = 20) -> DataFrame:
    """entries(vec_id, embedding, answer, ts) after new ones came, one after another in order of their ids.

    Answers of under ``least`` characters are ignored, as are new rows without a usable vector. An answer whose question is nearer than
    ``same`` to an entry, the first one in order of ids with old entries before new ones, replaces that entry's answer and time;
    otherwise it becomes an entry itself, which later ones are compared with. New ids are distinct and none is an old one.
    """
    usable = materialise(new.where(F.length(F.trim("answer")) >= least).select("vec_id", "embedding", "answer", "ts"), "new")
    to_old = materialise(nearer_than(entries, usable, same).select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("entry")), "known")
    own = usable.join(to_old.select("vec_id"), "vec_id", "left_anti")
    to_new = lead(own, same).withColumnRenamed("leader", "entry")
    told = to_old.unionByName(to_new).join(usable.select("vec_id", "answer", "ts"), "vec_id")
    last = told.groupBy("entry").agg(F.max_by(F.struct("answer", "ts"), "vec_id").alias("_new"))
    fresh = own.join(to_new.where("vec_id = entry").select("vec_id"), "vec_id", "left_semi")
    both = entries.select("vec_id", "embedding", "answer", "ts").unionByName(fresh).join(last, F.col("vec_id") == F.col("entry"), "left")
    return both.select("vec_id", "embedding", F.coalesce("_new.answer", "answer").alias("answer"), F.coalesce("_new.ts", "ts").alias("ts"))


def versions(writes: DataFrame, ttl: int, same: float = SETTINGS.cache_same, least: int = 20) -> DataFrame:
    """(entry, version, embedding, answer, since, until): what a cache that got ``writes`` held, and when, in seconds.

    writes (vec_id, embedding, answer, ts) arrive in order of (ts, vec_id) and are taken in as by ``put``. A version begins with its write and ends when
    the next one replaces it or, without one, when it has not been replaced for ``ttl`` seconds. An entry that has expired is replaced
    like any other. ts is a timestamp; vec_id is a number.
    """
    usable = writes.where((F.length(F.trim("answer")) >= least) & F.col("ts").isNotNull())
    # arrival as one sortable string, so that the order of ids is the order of arrival
    key = F.format_string("%020d-%020d", F.unix_micros(F.col("ts").cast("timestamp")), F.col("vec_id"))
    rows = materialise(usable.select(key.alias("vec_id"), F.col("vec_id").alias("version"), "embedding", "answer", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("since")), "writes")
    told = lead(rows, same).join(rows, "vec_id")
    heads = rows.select(F.col("vec_id").alias("leader"), F.col("version").alias("entry"), F.col("embedding").alias("_head"))
    nth = Window.partitionBy("leader").orderBy("vec_id")
    until = F.least(F.col("since") + ttl, F.coalesce(F.lead("since").over(nth), F.col("since") + ttl))
    return told.withColumn("until", until).drop("embedding").join(heads, "leader").select("entry", "version", F.col("_head").alias("embedding"), "answer", "since", "until")


def lookup_as_of(held: DataFrame, questions: DataFrame, threshold: float = SETTINGS.cache_hit) -> DataFrame:
    """(query_id, version, sim, hit): what each question (vec_id, embedding, ts) met in ``versions`` of a cache at its time.

    A question sees versions that began before it and had not ended. The best by cosine counts, the smaller id among equals; a question that sees nothing,
    or has no usable vector, is a miss without version.
    """
    seen = held.select(F.col("version").alias("vec_id"), "embedding", "since", "until")
    asked = questions.where("ts IS NOT NULL").select("vec_id", "embedding", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    found = search(seen, asked, 1, timed=True).select("query_id", F.col("vec_id").alias("version"), "sim")
    every = questions.select(F.col("vec_id").alias("query_id")).join(found, "query_id", "left")
    return every.select("query_id", "version", "sim", F.coalesce(F.col("sim") >= threshold, F.lit(False)).alias("hit"))


def evict(entries: DataFrame, most: int) -> DataFrame:
    """The ``most`` entries used last, more hits first among equals."""
    return entries.orderBy(F.desc("accessed_at"), F.desc("hits"), "key").limit(most)


def invalidate(entries: DataFrame, category: str) -> DataFrame:
    """entries without those whose question, or category_hint if there is one, holds the category."""
    key = F.lit(category.lower())
    gone = F.contains(F.lower("question"), key)
    if "category_hint" in entries.columns:
        gone = gone | F.contains(F.lower(F.coalesce("category_hint", F.lit(""))), key)
    return entries.where(~F.coalesce(gone, F.lit(False)))


def newest(entries: DataFrame, key: str, ts: str) -> DataFrame:
    """Upsert: the last row of each key stays; of rows with one time the one that is last in order of a hash of all columns."""
    every = F.xxhash64(*(F.col(f"`{c}`") for c in entries.columns))
    return entries.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), every.desc()))).where("_k = 1").drop("_k")


def distinct_vectors(texts: DataFrame, now, ttl: int, most: int) -> DataFrame:
    """(md5, ts): what an encoder's cache of ``most`` texts holds: those encoded last, none older than ttl."""
    rows = texts.select(F.md5(F.col("text").cast("binary")).alias("md5"), "ts")
    return live(rows.groupBy("md5").agg(F.max("ts").alias("ts")), now, ttl).orderBy(F.desc("ts"), "md5").limit(most)
