"""Reading and writing of document folders, tables, indexes, caches, graphs and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import garbage
from corvane.sources.storage import StoredTable, write_beside

# What may hold a document.
SUFFIXES = [".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp", ".gif"]


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, depth, suffix) of the supported files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    hidden = F.col("path").rlike(r"/\.[^/]*$")
    depth = F.size(F.split("path", "/")) - 1
    return found.withColumns({"suffix": suffix, "depth": depth}).where(F.col("suffix").isin(SUFFIXES) & ~hidden).dropDuplicates(["path"])


def supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(SUFFIXES) & ~path.rlike(r"/\.[^/]*$")


def unseen(files: DataFrame, done: DataFrame, key: str = "path", done_key: str = "source_file") -> DataFrame:
    """files that no row of the output table ``done`` names as its source."""
    name = done_key if done_key in done.columns else key
    return files.join(done.select(F.col(name).alias(key)), key, "left_anti")


def read_texts(spark: SparkSession, files: DataFrame, parser: Callable[[bytes], list[str]], reader: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, text, engine, pages, error) of the files of a listing, by functions of the user's.

    parser gives the pages of a PDF, joined by a newline; where it fails or gives garbage, and for images, reader gives the pages it sees, joined
    by a blank line. A file that fails is a row with engine ``failed`` and the error; the others go on.
    """

    def one(path: str, body: bytes) -> tuple[str, str, int, str | None]:
        problem = None
        if path.lower().endswith(".pdf"):
            try:
                pages = parser(body)
                text = "\n".join(pages)
                if not _garbage(text):
                    return text, "parser", len(pages), None
            except Exception as e:  # noqa: BLE001 - reported in the row
                problem = str(e)
        if reader is not None:
            try:
                pages = reader(body)
                return "\n\n".join(pages), "reader", len(pages), None
            except Exception as e:  # noqa: BLE001 - reported in the row
                problem = str(e)
        return "", "failed", 0, problem or "no text"

    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            rows = [(p, *one(p, b)) for p, b in zip(f["path"], f["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "text", "engine", "pages", "error"])

    paths = [r["path"] for r in files.select("path").limit(1_000_001).collect()]
    if len(paths) > 1_000_000:
        raise ValueError("list the files of one batch at a time")
    body = spark.read.format("binaryFile").load(paths).select("path", "content") if paths else spark.createDataFrame([], "path string, content binary")
    return body.mapInPandas(run, "path string, text string, engine string, pages int, error string")


def _garbage(text: str) -> bool:
    """``functions.text.garbage`` for one text in a worker."""
    control = sum(c < " " and c not in "\t\n\r" for c in text)
    private = sum("\ue000" <= c <= "\uf8ff" for c in text)
    return len(text.strip()) < 10 or (control + private) / max(len(text), 1) > 0.05 or private > 50


def usable_texts(texts: DataFrame) -> DataFrame:
    """Texts that are not garbage, as the visual reader's output is judged."""
    return texts.where(~garbage("text"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(uid, index, article_id, text): JSON documents; a missing article id is taken from the metadata's section, the section, or the position."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    each = rows.select("uid", F.posexplode("chunks").alias("index", "chunk"))
    has = {f.name for f in each.schema["chunk"].dataType.fields}
    parts = [F.nullif(f"chunk.{n}", F.lit("")) for n in ("article_id",) if n in has]
    if "metadata" in has and "section" in {f.name for f in each.schema["chunk"].dataType["metadata"].dataType.fields}:
        parts.append(F.col("chunk.metadata.section"))
    parts += [F.col("chunk.section")] if "section" in has else []
    return each.select("uid", "index", F.coalesce(*parts, F.concat(F.lit("pos_"), "index")).alias("article_id"), "chunk.text")


def write_documents(docs: DataFrame, folder: str, by: tuple[str, ...] = ("category", "subcategory")) -> None:
    """JSON documents in folders by category and subcategory, in place of those that are there."""
    write_beside(docs, folder, lambda rows, to: rows.write.partitionBy(*by).json(to))


def write_postings(postings: DataFrame, folder: str) -> None:
    """A flat table of postings; ``operators.index`` keeps one that can be searched and appended to."""
    write_beside(postings, folder, lambda rows, to: rows.repartition("term").sortWithinPartitions("term").write.parquet(to))


def read_postings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(postings, document lengths) of an index written before."""
    post = spark.read.parquet(folder)
    key = next(c for c in post.columns if c not in ("dl", "term", "tf"))
    return post, post.select(key, "dl").distinct()


def read_table(spark: SparkSession, name: str, url: str | None = None, folder: str | None = None, **options: str) -> DataFrame:
    """A table of a database by JDBC (url), or of a folder of Parquet tables."""
    if url:
        return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_cache(entries: DataFrame, folder: str) -> int:
    """A new snapshot of the cache and its version; readers see the one before until it is whole, and for good if the write fails."""
    return StoredTable(entries.sparkSession, folder).replace(entries)


def read_cache(spark: SparkSession, folder: str, now: float) -> DataFrame:
    """Entries (timestamp and ttl in seconds) that have not expired."""
    return StoredTable(spark, folder).read().where(F.col("timestamp") + F.col("ttl") >= F.lit(now))


def upsert_vectors(chunks: DataFrame, vectors: DataFrame, folder: str, key: str = "chunk_id", newest_by: str = "ingested") -> int:
    """Stores the vectors of chunks by key, the newest of each, and returns the version. Nothing is written unless every chunk has one vector."""
    both = chunks.select(key).join(vectors, key, "left")
    n = chunks.count()
    told = both.agg(F.count(F.lit(1)).alias("rows"), F.count("embedding").alias("vectors")).first()
    if (told["rows"], told["vectors"]) != (n, n):
        raise ValueError(f"{told['vectors']} vectors for {n} chunks: not written")
    return StoredTable(chunks.sparkSession, folder, key).upsert(both, newest_by)


def append_stats(spark: SparkSession, folder: str, **values) -> None:
    """One line of an ingestion's figures and when it was."""
    row = spark.createDataFrame([tuple(map(str, values.values()))], list(values))
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(folder)


def last_stats(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(folder).orderBy(F.desc("at")).limit(1)


def write_report(report: DataFrame, folder: str) -> None:
    write_beside(report, folder, lambda rows, to: rows.coalesce(1).write.json(to))


def graph_nodes(spark: SparkSession, path: str, tag: str = "node") -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).load(path)


def graph_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst): the ends of each edge of a GraphML file, the smaller name first."""
    rows = graph_nodes(spark, path, "edge")
    return rows.select(F.least("_source", "_target").alias("src"), F.greatest("_source", "_target").alias("dst"))


def key_value(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a JSON object that maps keys to values of one type."""
    body = spark.read.text(path, wholetext=True)
    return body.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def graph_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: nodes and edges of a GraphML file."""
    nodes = graph_nodes(spark, path).agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.crossJoin(graph_nodes(spark, path, "edge").agg(F.count(F.lit(1)).alias("edges")))  # one row each


def create_tables(spark: SparkSession, database: str, tables: dict[str, str]) -> None:
    """Tables (name -> columns) that do not exist yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
