"""What the registered queries share: the register, table access and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BLANK = r"[ \t\n\r\f]+"
EDGE = r"' ' || chr(9) || chr(10) || chr(13) || chr(12)"


def tok(col: str) -> str:
    """The search tokens of a column."""
    return rf"list_filter(regexp_extract_all(lower({col}), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: length(x) > 1)"


TOK = tok("text")
WRD = r"list_filter(string_split_regex({0}, '[ \t\n\r\f]+'), lambda x: x <> '')"
ARA = r"(len(regexp_extract_all({0}, '[\x{{0600}}-\x{{06FF}}]')) / greatest(length({0}), 1))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(col: str, words: list[str]) -> str:
    """How many of the words a column holds."""
    return "(" + " + ".join(f"CAST(contains({col}, {quote(w)}) AS INT)" for w in words) + ")"


def rx(pattern: str) -> str:
    """A pattern of ours as a literal of the other engine, whose classes are Unicode without a flag."""
    return quote(pattern.replace("(?iu)", "(?i)").replace("(?isu)", "(?is)").replace(NO_WORD, ""))


#: What the other engine lacks: no letter or digit may stand before. Its texts lose the words of which that is true.
NO_WORD = r"(?<![\p{L}\p{N}_])"


def apart(col: str = "text") -> str:
    return rf"regexp_replace({col}, '([\p{{L}}\p{{N}}_])(المادة|الفصل|الباب)', '\1', 'g')"
