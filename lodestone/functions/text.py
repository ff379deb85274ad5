"""Text functions as column expressions (JVM side throughout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE = r"(?<=[.!?])\s+"
SENTENCE_OR_BLANK = r"(?<=[.!?])\s+(?=\p{Lu})|(?<=\n)\n+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Trimmed non-empty sentences: a break is white space after . ! or ?"""
    return F.filter(F.transform(F.split(text, SENTENCE), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: F.length(s) > 0)


def sentences_or_blank(text: Column) -> Column:
    """Sentences that start with a capital, or stretches between blank lines."""
    return F.filter(F.transform(F.split(text, SENTENCE_OR_BLANK), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 0)


def long_sentences(text: Column, least: int = 20) -> Column:
    """Sentences of more than `least` characters, for compression."""
    return F.filter(sentences(text), lambda s: F.length(s) > least)


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)


def estimate_tokens(text: Column) -> Column:
    """1.3 tokens a word, rounded down."""
    return F.floor(F.size(words(text)) * F.lit(1.3)).cast("int")


def quarter_tokens(text: Column) -> Column:
    """A token for every four characters."""
    return F.floor(F.length(text) / 4).cast("int")


def truncate_middle(text: Column, head: int = 4000, tail: int = 4000, marker: str = "\n\n[...]\n\n") -> Column:
    """Head, marker and tail of texts longer than both together."""
    return F.when(F.length(text) > head + tail, F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(tail)))).otherwise(text)


def strip_html(html: Column, drop: tuple[str, ...] = ("script", "style")) -> Column:
    """Visible text: dropped elements gone, tags become line breaks, lines trimmed, empty ones left out."""
    out = html
    for tag in drop:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    parts = F.filter(F.transform(F.split(out, "\n|  "), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    return F.array_join(parts, "\n")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def main_part(html: Column) -> Column:
    """The first of main, article and body that the page has; the page if it has none."""
    found = [F.nullif(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", 1), F.lit("")) for t in ("main", "article", "body")]
    return F.coalesce(*found, html)


def phrases(query: Column) -> Column:
    """Parts between , ; : and or; the query itself first unless it is a part; up to five words over four letters; ten in all."""
    parts = F.filter(F.transform(F.split(F.lower(query), r"[,;:]|\band\b|\bor\b"), lambda s: F.trim(s)), lambda p: F.length(p) > 0)
    parts = F.when(F.array_contains(parts, query), parts).otherwise(F.concat(F.array(query), parts))
    big = F.slice(F.filter(words(query), lambda w: F.length(w) > 4), 1, 5)
    return F.slice(F.concat(parts, big), 1, 10)


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct lower-cased words that the text has."""
    q = F.array_distinct(words(F.lower(query)))
    both = F.size(F.array_intersect(q, words(F.lower(text))))
    return F.when(F.size(q) > 0, both / F.size(q)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    x, y = words(F.lower(a)), words(F.lower(b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def content_key(*parts: Column) -> Column:
    """A deterministic id for a derived row."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)
