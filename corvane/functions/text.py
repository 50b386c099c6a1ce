"""Text functions as column expressions: normalising, counting, splitting, identifiers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{M}\p{N}_]+"
BLANKS = r"[ \t\n\r\f]+"
ARABIC = r"[\x{0600}-\x{06FF}]"


#: Every blank of Unicode and every decimal digit, as both are spelled out where a pattern says ``\\s`` or ``\\d``.
BLANK_SET = r"\t\n\x0B\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
DIGIT_SET = r"\p{Nd}"


def wide(pattern: str) -> str:
    """A pattern whose ``\\s`` and ``\\d`` are blanks and digits of any script (engines take them for ASCII only)."""
    out, within, at = [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two in (r"\s", r"\d"):
            known = BLANK_SET if two == r"\s" else DIGIT_SET
            out.append(known if within or two == r"\d" else f"[{known}]")
        else:
            two = two if two[0] == "\\" else two[0]
            within = two == "[" or within and two != "]"
            out.append(two)
        at += len(two)
    return "".join(out)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c) -> Column:
    """Blank-separated words."""
    return F.filter(F.split(_col(c), BLANKS), lambda w: w != "")


def normalize(c, squeeze: bool = True) -> Column:
    """Lower case, letters, digits and single blanks only; squeeze=False keeps the runs that removed signs leave."""
    out = F.regexp_replace(F.regexp_replace(_col(c), BLANKS, " "), r"[^\p{L}\p{M}\p{N}_ ]", " ")
    return F.lower(F.trim(F.regexp_replace(out, " +", " ") if squeeze else out))


_CID = r"(?i)\(cid:[0-9]+\)"


def clean_cid(c) -> Column:
    """A blank for each (cid:N) mark, without runs of blanks and of more than two newlines."""
    out = F.regexp_replace(_col(c), _CID, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), "\n{3,}", "\n\n"))


def cid_garbage(c) -> Column:
    """True for an empty text and one with over 0.3 marks a word; a text of blanks has no words and is not."""
    n = F.size(words(c))
    return (_col(c) == "") | ((n > 0) & (F.regexp_count(_col(c), F.lit(_CID)) / F.greatest(n, F.lit(1)) > 0.30))


def garbage(c) -> Column:
    """Under ten characters, over 5 % control or private-use characters, or over 50 private ones."""
    control = F.regexp_count(_col(c), F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    private = F.regexp_count(_col(c), F.lit(r"[\x{E000}-\x{F8FF}]"))
    share = (control + private) / F.greatest(F.length(_col(c)), F.lit(1))
    return (F.length(F.trim(_col(c))) < 10) | (share > 0.05) | (private > 50)


def tokens_by_words(c) -> Column:
    return F.floor(F.size(words(c)) * F.lit(1.3))


def arabic_share(c) -> Column:
    return F.regexp_count(_col(c), F.lit(ARABIC)) / F.greatest(F.length(_col(c)), F.lit(1))


def language(c, arabic: float = 0.3, mixed: float | None = None) -> Column:
    """ar above one share of Arabic letters, mixed above a smaller one if that is given, else fr."""
    out = F.when(arabic_share(c) > arabic, "ar")
    if mixed is not None:
        out = out.when(arabic_share(c) > mixed, "mixed")
    return out.otherwise("fr")


def tokens_by_chars(c) -> Column:
    n = F.length(_col(c))
    return F.greatest(F.lit(1), F.when(arabic_share(c) > 0.3, F.floor(n / 0.9)).otherwise(F.floor(n / 4)))


def truncate_to_tokens(c, tokens: int) -> Column:
    """The first 4 * tokens characters, cut after the last sentence end if that lies beyond 70 % of them."""
    cut = F.substring(_col(c), 1, 4 * tokens)
    back = F.reverse(cut)
    ends = [F.when(F.locate(e, back) > 0, F.length(cut) - F.locate(e, back)).otherwise(-1) for e in (" .", " ?", " !", "\n.")]
    last = F.greatest(*ends)
    return F.when(F.length(_col(c)) <= 4 * tokens, _col(c)).when(last > 0.7 * 4 * tokens, F.substring(cut, F.lit(1), last)).otherwise(cut)


def search_tokens(c) -> Column:
    """Lower-cased words of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) > 1)


def sentences(c) -> Column:
    return F.split(F.regexp_replace(_col(c), r"([.!?])[ \t\n\r\f]+", "$1\x01"), "\x01")


_BREAK = r"(\n[ \t\n\r\f]*\n|\r\n[ \t\n\r\f]*\r\n)"


def paragraphs(c) -> Column:
    return F.split(_col(c), r"\n[ \t\n\r\f]*\n")


def starts(parts: Column) -> Column:
    """How many characters lie before each part."""
    return F.transform(parts, lambda _, i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, p: n + F.length(p)))


def placed_paragraphs(c) -> Column:
    """(text, start, end) of each non-blank paragraph; offsets are those before blanks at its ends go."""
    parts = F.split(F.regexp_replace(_col(c), _BREAK, "\x01$1\x01"), "\x01")
    each = F.zip_with(parts, starts(parts), lambda p, at: F.struct(F.trim(p, F.lit(" \t\n\r\f")).alias("text"), at.alias("start"), (at + F.length(p)).alias("end")))
    return F.filter(each, lambda x, i: (i % 2 == 0) & (x["text"] != ""))


def matches(c, pattern: str) -> Column:
    """(text, start) of every match of a pattern without groups."""
    parts = F.split(F.regexp_replace(_col(c), f"({pattern})", "\x01$1\x01"), "\x01")
    each = F.zip_with(parts, starts(parts), lambda p, at: F.struct(p.alias("text"), at.alias("start")))
    return F.filter(each, lambda x, i: i % 2 == 1)


#: Replacements of question words, in order.
REPLACEMENTS = (
    ("c koi", "qu'est-ce que"),
    ("c'est quoi", "qu'est-ce que"),
    ("delai", "délai procédure"),
    ("délais", "délai procédure"),
    ("pb", "problème"),
    ("prq", "pourquoi"),
)


def expand_question(c) -> Column:
    """One or two variants of a question: normalised, and with a word added that usually goes with it."""
    q = F.regexp_replace(F.lower(_col(c)), wide(r"\b(art|art\.|article)\b\s*(\d+)"), "article $2")
    for a, b in REPLACEMENTS:
        q = F.replace(q, F.lit(a), F.lit(b))
    q = F.trim(q)
    more = F.concat(
        q,
        F.when(F.contains(q, F.lit("appel")) & ~F.contains(q, F.lit("cour")), " cour").otherwise(""),
        F.when(F.contains(q, F.lit("divorce")) & ~F.contains(q, F.lit("juge")), " juge").otherwise(""),
    )
    return F.array_distinct(F.array(q, more))


def repair_numbers(c) -> Column:
    return F.translate(F.regexp_replace(_col(c), wide(r"(\d)\s+(\d{3})"), "$1$2"), "٠١٢", "012")


def strip_markdown(c) -> Column:
    """Without the signs of bold and italic text, pair by pair."""
    out = _col(c)
    for mark in (r"\*\*", r"\*", "__", "_"):
        out = F.regexp_replace(out, f"{mark}(.*?){mark}", "$1")
    return out


def to_html(c) -> Column:
    out = strip_markdown(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    link = '<a href="$1" target="_blank" style="color: var(--accent-green); text-decoration: underline;">$1</a>'
    out = F.regexp_replace(out, r"(https?://[^ \t\n\r\f]+)", link)
    return F.replace(out, F.lit("\n"), F.lit("<br>"))


def sanitise_json(c) -> Column:
    """The outermost braces of a text that may be fenced, with single blanks; ``{}`` if there are none."""
    body = F.regexp_extract(F.regexp_replace(_col(c), r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.when(body == "", "{}").otherwise(F.regexp_replace(body, BLANKS, " "))


def parse_json(c) -> Column:
    """The value as VARIANT: as it is, else its outermost braces, else an empty object."""
    body = F.regexp_extract(_col(c), r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(_col(c)), F.try_parse_json(body), F.parse_json(F.lit("{}")))


def short_sha(*parts, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)


def document_uid(text, path) -> Column:
    """16 hex digits of the first 5000 characters and the path, one after the other."""
    return F.substring(F.sha2(F.concat(F.substring(_col(text), 1, 5000), _col(path)), 256), 1, 16)


def chunk_uid(doc, article, index, text) -> Column:
    return short_sha(_col(doc), _col(article), _col(index).cast("string"), F.substring(_col(text), 1, 40))


def article_uid(doc, number) -> Column:
    """Of the article with a number in a document; without a number the document's first article."""
    number = F.substring(F.md5(_col(number).cast("binary")), 1, 8)
    return F.concat(_col(doc), F.lit("_art_"), F.coalesce(number, F.lit("0")))


#: Fixed values of our own: frequent words that tell the languages apart.
STOP_WORDS = {
    "fr": ("le", "la", "les", "des", "est", "une", "dans", "pour", "que", "et"),
    "en": ("the", "of", "and", "is", "to", "in", "that", "for", "with", "are"),
}


def detected_language(c, fallback: str = "fr") -> Column:
    """ar above 0.3 Arabic letters, else fr or en by which frequent words occur more often, else the fallback."""
    low = words(F.lower(_col(c)))

    def said(lang: str) -> Column:
        return F.size(F.filter(low, lambda w: w.isin(*STOP_WORDS[lang])))

    fr, en = said("fr"), said("en")
    return F.when(arabic_share(c) > 0.3, "ar").when(fr > en, "fr").when(en > fr, "en").otherwise(fallback)


def plain_key(c) -> Column:
    """Compatibility-decomposed, lower-cased, without signs: Spark has no such decomposition of its own."""

    def run(text: pd.Series) -> pd.Series:
        flat = text.fillna("").map(lambda t: unicodedata.normalize("NFKD", t).lower())
        return flat.str.replace(r"[^\w\s]", "", regex=True).str.strip()

    return F.pandas_udf(run, "string")(_col(c))
