"""The library's text functions and chunkers under names of their own in SQL.

``register(spark)`` adds them to a session: scalar functions are SQL expressions, so Catalyst sees through them; chunkers are table
functions for ``LATERAL``, one Python step for each text.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corvane.functions.text import TOKEN
from corvane.operators import chunking
from corvane.settings import SETTINGS

#: name(arguments) -> (type, expression).
SCALARS = {
    "search_tokens(t STRING)": ("ARRAY<STRING>", f"filter(regexp_extract_all(lower(t), r'{TOKEN}', 0), x -> length(x) > 1)"),
    "normalized_text(t STRING)": ("STRING", r"lower(trim(regexp_replace(regexp_replace(regexp_replace(t, r'[ \t\n\r\f]+', ' '), r'[^\p{L}\p{M}\p{N}_ ]', ' '), ' +', ' ')))"),
    "arabic_share(t STRING)": ("DOUBLE", r"regexp_count(t, r'[\x{0600}-\x{06FF}]') / greatest(length(t), 1)"),
    "vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": (
        "DOUBLE",
        "coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D)",
    ),
    "bm25_gain(tf BIGINT, dl BIGINT, mean DOUBLE)": ("DOUBLE", f"tf * {SETTINGS.k1 + 1}D / (tf + {SETTINGS.k1}D * (1 - {SETTINGS.b}D + {SETTINGS.b}D * dl / mean))"),
}


@udtf(returnType="idx int, text string, article string, char_start int, char_end int")
class Pack:
    """Chunks of packed paragraphs of one text, as ``chunking.paragraphs`` makes them; none of a null or blank one."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        for i, (chunk, article, start, end, _) in enumerate(chunking.pack(text or "", size, overlap)):
            yield i, chunk, article, start, end


@udtf(returnType="idx int, text string")
class Snap:
    """Windows of one text that end with sentences, as ``chunking.snapped`` makes them, whatever their number of tokens."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        whole = (text or "").strip(chunking.BLANKS)
        for i, (start, end) in enumerate(chunking.cuts(whole, size, overlap) if whole else []):
            yield i, whole[start:end].strip(chunking.BLANKS)


def register(spark: SparkSession) -> None:
    """Adds the functions to the session, in place of temporary ones with their names."""
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("pack_paragraphs", Pack)
    spark.udtf.register("snap_windows", Snap)
