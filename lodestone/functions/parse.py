"""Parsers of model output. Nothing raises: what can't be read takes the documented default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda x: F.length(x) > 0)


def citations(answer: Column, sources: Column) -> Column:
    """Zero-based numbers of the sources cited as [n], in range, ascending, each once."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int") - 1)
    return F.array_sort(F.array_distinct(F.filter(found, lambda i: (i >= 0) & (i < sources))))


def number(text: Column, label: str) -> Column:
    """The number after a line's label; null if there is none."""
    raw = F.regexp_extract(text, rf"(?m)^\s*{label}:\s*(-?\d+(?:\.\d+)?)\s*$", 1)
    return F.nullif(raw, F.lit("")).try_cast("double")


def verdict(text: Column) -> Column:
    """fully, partially or not, from the VERDICT line; partially if it has none. 'not' is looked for as a word first."""
    line = F.lower(F.regexp_extract(text, r"(?m)^\s*VERDICT:\s*(.*)$", 1))
    return F.when(line.rlike(r"\b(not|un\w+)\b"), "not").when(line.contains("fully"), "fully").otherwise("partially")


def verdict_score(text: Column) -> Column:
    """The SCORE line clamped to 0..1; without one .9 for fully, .1 for not, else .5."""
    default = F.when(verdict(text) == "fully", 0.9).when(verdict(text) == "not", 0.1).otherwise(0.5)
    score = number(text, "SCORE")
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(default)


def _label(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("entail"), "entailment").when(low.contains("contradict"), "contradiction").otherwise("neutral")


def nli(text: Column) -> Column:
    """struct(label, confidence, evidence) of LABEL, CONFIDENCE and EVIDENCE lines; neutral, .5 and an empty text where one lacks."""
    line = lambda name: F.regexp_extract(text, rf"(?m)^\s*{name}:\s*(.*)$", 1)
    sure = F.coalesce(number(text, "CONFIDENCE"), F.lit(0.5))
    return F.struct(_label(line("LABEL")).alias("label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"), F.trim(line("EVIDENCE")).alias("evidence"))


def nli_label(text: Column) -> Column:
    """entailment, contradiction or neutral (the default) from the LABEL line."""
    return nli(text)["label"]


def nli_batch(text: Column, claims: Column) -> Column:
    """An array of struct(label, confidence, evidence), one for each of `claims` numbered claims, of lines
    `CLAIM_n: label | confidence | evidence`; a claim without a line is neutral with confidence .5."""

    def one(n: Column) -> Column:
        line = F.call_function("regexp_extract", text, F.concat(F.lit(r"(?m)^\s*CLAIM_"), n.cast("string"), F.lit(r":\s*(.*)$")), F.lit(1))
        part = lambda i: F.trim(F.coalesce(F.get(F.split(line, r"\|"), F.lit(i)), F.lit("")))
        sure = F.coalesce(part(1).try_cast("double"), F.lit(0.5))
        return F.struct(_label(part(0)).alias("label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"), part(2).alias("evidence"))

    return F.transform(F.when(claims > 0, F.sequence(F.lit(1), claims.cast("int"))).otherwise(F.array().cast("array<int>")), one)


def support(text: Column) -> Column:
    """supported, contradicted or neutral, anchored at the start so that 'unsupported' and 'not supported' don't count."""
    return F.when(text.rlike(r"(?i)^\s*supported\b"), "supported").when(text.rlike(r"(?i)^\s*contradicted\b"), "contradicted").otherwise("neutral")


def yes(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*yes\b")


def first_number(text: Column, default: float, low: float = 0.0, high: float = 1.0) -> Column:
    raw = F.nullif(F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(raw, F.lit(default))))


def score_list(text: Column, n: int, default: float = 5.0, high: float = 10.0) -> Column:
    """The first n numbers, clamped to 0..high, padded with the default."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: F.least(F.lit(high), x.try_cast("double")))
    return F.slice(F.concat(found, F.array_repeat(F.lit(default), n)), 1, n)


def claims(text: Column) -> Column:
    """Lines without leading numbering, of more than ten characters, twenty at most."""
    found = F.transform(_lines(text), lambda x: F.regexp_replace(x, r"^[0-9.\-•) ]+", ""))
    return F.slice(F.filter(found, lambda x: F.length(x) > 10), 1, 20)


def sub_queries(text: Column) -> Column:
    """Lines without leading numbering and bullets."""
    found = F.transform(_lines(text), lambda x: F.regexp_replace(x, r"^[0-9.\-*•) ]+", ""))
    return F.filter(found, lambda x: F.length(x) > 0)


def variations(query: Column, text: Column, wanted: int = 4) -> Column:
    """The query, then the rewrites in a model's answer; plain prefixes fill up what is missing."""
    line = F.transform(_lines(text), lambda x: F.regexp_replace(x, r"^(?:[-•*]|[1-5]\.|[1-4]\))\s*", ""))
    line = F.transform(line, lambda x: F.regexp_replace(x, r"(?i)^(query|rewrite|alternative):\s*", ""))
    line = F.transform(line, lambda x: F.regexp_replace(x, r"""^["'`](.+)["'`]$""", "$1"))
    line = F.filter(line, lambda x: (F.length(x) >= 5) & ~F.lower(x).rlike("here are|alternative|rewrite|variation") & (F.lower(x) != F.lower(query)))
    bare = F.trim(F.replace(F.replace(F.lower(query), F.lit("what is"), F.lit("")), F.lit("?"), F.lit("")))
    spare = F.array(*(F.concat(F.lit(p + " "), bare, F.lit("?")) for p in ("What is", "Define", "Explain")))
    return F.slice(F.array_distinct(F.concat(F.array(query), F.slice(line, 1, wanted), spare)), 1, wanted)


def json_object(text: Column, schema: str) -> Column:
    """The first {...} of a text read by a schema; null if it is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"})


def follow_ups(text: Column) -> Column:
    return F.transform(F.filter(_lines(text), lambda x: F.lower(x).startswith("follow-up:")), lambda x: F.trim(F.substring(x, 11, 1 << 30)))


def reasoning_and_answer(text: Column) -> Column:
    """A struct of what stands before the first 'Therefore' and what begins there (all of it as answer if there is none)."""
    at = F.instr(text, "Therefore")
    return F.struct(F.when(at > 0, F.trim(F.substring(text, F.lit(1), at - 1))).otherwise(F.lit("")).alias("reasoning"), F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text).alias("answer"))
