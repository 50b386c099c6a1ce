"""Chunks of documents: sliding windows as an explode; packing and snapped windows as functions of one document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.frames import bounded_batches
from corvane.functions.text import BLANK_SET, DIGIT_SET, chunk_uid, normalize, short_sha, tokens_by_chars
from corvane.operators import extract
from corvane.operators.vector import cosine
from corvane.settings import SETTINGS

BLANKS = " \t\n\r\f"


def windows(docs: DataFrame, size: int = SETTINGS.window_chars, overlap: int = SETTINGS.overlap_chars, least: int = 0) -> DataFrame:
    """(doc_id, idx, chunk_id, text): windows at a fixed stride; the first that reaches the end is the last."""
    stride = size - overlap
    many = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / stride)).cast("int")
    each = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), many - 1)).alias("idx"))
    cut = each.select("doc_id", "idx", F.trim(F.substring("text", F.col("idx") * stride + 1, F.lit(size))).alias("text"))
    chunk = short_sha("doc_id", "idx", F.substring("text", 1, 40))
    return cut.where((F.length("text") > 0) & (tokens_by_chars("text") >= least)).select("doc_id", "idx", chunk.alias("chunk_id"), "text")


def pieces(docs: DataFrame, size: int = 600 * 4) -> DataFrame:
    """(doc_id, idx, chunk_id, text): fixed size, no overlap."""
    return windows(docs, size, 0)


def _python(pattern: str) -> re.Pattern:
    """A pattern of ``extract`` for Python's engine, which has no Unicode classes."""
    plain = pattern.replace("(?iu)", "").replace(f"[{BLANK_SET}]", "\\s").replace(DIGIT_SET, "\\d")
    return re.compile(plain.replace("[\\p{L}\\p{N}_]", "\\w").replace("\\x{0600}-\\x{06FF}", "؀-ۿ"), re.IGNORECASE)


_HEADER, _NUMBER = _python(extract.HEADER), _python(extract.NUMBER)
_PARAGRAPHS = re.compile(r"(\n\s*\n|\r\n\s*\r\n)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _estimate(text: str) -> int:
    return int(len(text.split()) * 1.3)


def _is_header(text: str) -> bool:
    return bool(_HEADER.match(text.strip()))


def _placed(text: str) -> Iterator[tuple[str, int, int]]:
    """Non-blank paragraphs with where they start and end."""
    at = 0
    for i, part in enumerate(_PARAGRAPHS.split(text)):
        if i % 2 == 0 and part.strip():
            yield part.strip(), at, at + len(part)
        at += len(part)


@dataclass
class Packer:
    """One document's chunks: (text, article number, start, end, whole) where whole tells packed paragraphs from sentences."""

    size: int
    overlap: int
    out: list[tuple[str, str | None, int, int, bool]] = field(default_factory=list)
    held: list[tuple[str, int, int]] = field(default_factory=list)
    article: str | None = None

    def tokens(self) -> int:
        return sum(_estimate(t) for t, _, _ in self.held)

    def flush(self) -> None:
        if self.held:
            self.out.append(("\n\n".join(t for t, _, _ in self.held), self.article, self.held[0][1], self.held[-1][2], True))

    def tail(self) -> list[tuple[str, int, int]]:
        """What the next chunk starts with: whole paragraphs from the end while they fit, then the end of one if over 50 characters are left."""
        left, kept = self.overlap, []
        for text, start, end in reversed(self.held):
            if len(text) > left:
                if left > 50:
                    kept.append((text[-left:], end - left, end))
                break
            kept.append((text, start, end))
            left -= len(text)
        return kept[::-1]

    def sentences(self, text: str, start: int) -> None:
        """Sentences of an oversized paragraph; each chunk but the first begins with the last sentence of the one before."""
        now, begin, at = "", start, start
        for s in _SENTENCE.split(text):
            if now and _estimate(now) + _estimate(s) > self.size:
                self.out.append((now.strip(), self.article, begin, at, False))
                again = now.rpartition(". ")[2] if ". " in now else ""
                now, begin = f"{again} {s}" if again else s, at - len(again)
            else:
                now = f"{now} {s}" if now else s
            at += len(s) + 1
        if now.strip():
            self.out.append((now.strip(), self.article, begin, start + len(text), False))

    def run(self, text: str) -> list[tuple[str, str | None, int, int, bool]]:
        for unit, start, end in _placed(text):
            if _is_header(unit) and (m := _NUMBER.search(unit)):
                self.article = m[1]
            n = _estimate(unit)
            if n > self.size:
                self.flush()
                self.held = []
                self.sentences(unit, start)
                continue
            if self.held and self.tokens() + n > self.size:
                self.flush()
                self.held = self.tail()
            self.held.append((unit, start, end))
        self.flush()
        return self.out


def pack(text: str, size: int, overlap: int) -> list[tuple[str, str | None, int, int, bool]]:
    """(chunk, article number, start, end, whole) of one text; a text of up to ``size`` tokens is one chunk."""
    if not text.strip():
        return []
    if _estimate(text) <= size:
        return [(text, None, 0, len(text), True)]
    return Packer(size, overlap).run(text)


def _pack_all(size: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            rows = []
            for d, u, t, b in zip(f["doc_id"], f["uid"], f["text"], f["breaks"], strict=True):
                found = pack(t or "", size, overlap)
                alone = len(found) == 1 and _estimate(t or "") <= size
                for i, (c, a, start, end, whole) in enumerate(found):
                    page = 1 if alone else sum(x <= start for x in b) + 1 if whole and b is not None and len(b) else None
                    section = "header" if whole and _is_header(c) else None
                    rows.append((d, i, f"{u}_chunk_{i}", u, None if alone else a, alone, page, section, start, end, len(c.split()), c))
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "chunk_id", "uid", "article", "alone", "page", "section", "char_start", "char_end", "word_count", "text"]).astype({"page": "Int32"})

    return run


def paragraphs(docs: DataFrame, size: int = SETTINGS.pack_tokens, overlap: int = SETTINGS.pack_overlap) -> DataFrame:
    """(doc_id, idx, chunk_id, uid, article_id, page, section, char_start, char_end, word_count, text, normalized_text).

    docs (doc_id, text), with uid and page_breaks as optional columns. Packing carries state from unit to unit, so each
    document is one Python step. overlap counts characters, size counts tokens. A small document is its own
    article; otherwise the last numbered header names the article. Blank texts have no chunk.
    """
    uid = F.col("uid") if "uid" in docs.columns else F.col("doc_id").cast("string")
    breaks = F.col("page_breaks") if "page_breaks" in docs.columns else F.lit(None).cast("array<int>")
    rows = docs.select("doc_id", uid.alias("uid"), F.coalesce("text", F.lit("")).alias("text"), breaks.cast("array<int>").alias("breaks"))
    schema = "doc_id long, idx int, chunk_id string, uid string, article string, alone boolean, page int, section string, char_start int, char_end int, word_count int, text string"
    bounded_batches(docs.sparkSession)
    found = rows.mapInPandas(_pack_all(size, overlap), schema)
    number = F.substring(F.md5(F.col("article").cast("binary")), 1, 8)
    article = F.when(F.col("alone"), F.col("uid")).otherwise(F.concat("uid", F.lit("_art_"), F.coalesce(number, F.lit("0"))))
    return found.withColumn("article_id", article).withColumn("normalized_text", normalize("text")).drop("article", "alone")


def cuts(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows whose ends move back to the last sentence end of their last 200 characters; the first that reaches the end is the last."""
    out, at = [], 0
    while True:
        end = min(at + size, len(text))
        if end < len(text):
            low = max(at, end - 200)
            found = re.match(r"(?s).*[.!?][ \t\n\r\f]+", text[low:end])
            end = low + found.end() if found else end
        out.append((at, end))
        if end >= len(text):
            return out
        at = max(at + 1, end - overlap)


def _cut_all(size: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]):
        for f in frames:
            rows = []
            for d, u, a, t in zip(f["doc_id"], f["uid"], f["article_id"], f["text"], strict=True):
                t = (t or "").strip(BLANKS)
                rows += [(d, i, u, a, t[x:y].strip(BLANKS)) for i, (x, y) in enumerate(cuts(t, size, overlap))] if t else []
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "uid", "article_id", "text"])

    return run


def snapped(docs: DataFrame, size: int = SETTINGS.window_chars, overlap: int = SETTINGS.overlap_chars, least: int = SETTINGS.min_tokens) -> DataFrame:
    """(doc_id, idx, chunk_id, uid, article_id, text, normalized_text): windows that end with sentences, those under ``least`` tokens left out.

    docs (doc_id, text), with uid and article_id as optional columns; without one a document is its own article.
    """
    uid = F.col("uid") if "uid" in docs.columns else F.col("doc_id").cast("string")
    article = F.col("article_id") if "article_id" in docs.columns else uid
    rows = docs.select("doc_id", uid.alias("uid"), F.coalesce(article, uid).alias("article_id"), "text")
    bounded_batches(docs.sparkSession)
    cut = rows.mapInPandas(_cut_all(size, overlap), "doc_id long, idx int, uid string, article_id string, text string")
    kept = cut.where((F.length("text") > 0) & (tokens_by_chars("text") >= least))
    return kept.select("doc_id", "idx", chunk_uid("uid", "article_id", "idx", "text").alias("chunk_id"), "uid", "article_id", "text", normalize("text", False).alias("normalized_text"))


def semantic(sentences: DataFrame, cut: float = 0.75, long: int = 300, block: int = 150) -> DataFrame:
    """(doc_id, idx, n, text) of sentences(doc_id, pos, text, embedding): neighbours stay together while their cosine is ``cut`` or more.

    Sentences of five characters or fewer are left out; documents of over ``long`` sentences are cut in blocks first.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = sentences.withColumn("text", F.trim("text", F.lit(BLANKS))).where(F.length("text") > 5)
    rows = rows.withColumn("_n", F.row_number().over(order) - 1).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    v = F.col("embedding").cast("array<double>")
    apart = (F.round(cosine(v, F.lag(v).over(order)), 6) < cut) | ((F.col("_all") > long) & (F.col("_n") % block == 0))
    island = F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("_i", island)
    grouped = marked.groupBy("doc_id", "_i").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("ps"))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("_i")) - 1
    return grouped.select("doc_id", idx.alias("idx"), "n", F.array_join(F.transform("ps", lambda p: p["text"]), " ").alias("text"))


def choose(docs: DataFrame, existing: DataFrame | None = None, by_meaning: DataFrame | None = None) -> DataFrame:
    """(doc_id, idx, chunk_id, article_id, text) to index: a document's existing chunks, else its semantic ones, else snapped windows.

    existing (doc_id, idx, chunk_id, article_id, text); by_meaning as ``semantic`` returns it, of which pieces of under 10 characters go.
    """
    names, parts, rest = ["doc_id", "idx", "chunk_id", "article_id", "text"], [], docs
    if existing is not None:
        parts.append(existing.select(*names))
        rest = rest.join(existing.select("doc_id"), "doc_id", "left_anti")
    if by_meaning is not None:
        some = by_meaning.join(rest.select("doc_id"), "doc_id", "left_semi").where(F.length(F.trim("text")) >= 10)
        own = F.col("doc_id").cast("string")
        parts.append(some.select("doc_id", "idx", chunk_uid(own, own, "idx", "text").alias("chunk_id"), own.alias("article_id"), "text"))
        rest = rest.join(by_meaning.select("doc_id"), "doc_id", "left_anti")
    parts.append(snapped(rest).select(*names))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
