"""Snippets of matching text, in column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pattern(terms: list[str]) -> str:
    words = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"


def _once(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used inside."""
    return F.transform(F.array(value), then)[0]


def _literal(tag: str) -> str:
    """A tag as a replacement means itself, dollars and backslashes too."""
    return tag.replace("\\", "\\\\").replace("$", "\\$")


def highlight(text: Column, terms: list[str], start: str = "<b>", end: str = "</b>") -> Column:
    """The text with each whole-word hit between tags; without terms, the text."""
    return F.regexp_replace(text, _pattern(terms), f"{_literal(start)}$0{_literal(end)}") if terms else text


def snippet_positions(text: Column, terms: list[str], limit: int | None = None, offset: int = 0) -> Column:
    """[begin, end) of each hit, in bytes of UTF-8; without terms, none."""
    if not terms:
        return F.when(text.isNotNull(), F.array().cast("array<array<int>>"))

    def of(x: Column) -> Column:
        # what is between the hits, and the hits: a running sum of their lengths gives the places
        gaps = F.transform(F.split(x, _pattern(terms), -1), F.octet_length)
        hits = F.transform(F.regexp_extract_all(x, F.lit(_pattern(terms)), F.lit(0)), F.octet_length)
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("spans"))
        parts = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))

        def step(a: Column, p: Column) -> Column:
            start = a["at"] + p["gap"]
            return F.struct((start + p["hit"]).alias("at"), F.concat(a["spans"], F.array(F.array(start, start + p["hit"]))).alias("spans"))

        return F.aggregate(parts, begin, step)["spans"]

    return F.slice(_once(text, of), offset + 1, limit if limit is not None else 2**30)


def windows(text: Column, terms: list[str], max_chars: int = 150) -> Column:
    """(score, text) of runs of as many whole words as make about max_chars (eight each); no hit is cut off. score: its
    distinct terms, then its hits."""
    size = max(1, max_chars // 8)
    low = [t.lower() for t in terms]
    clean = lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))

    def of(words: Column) -> Column:
        begins = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(words) - 1) / size), F.lit(0)).cast("int")), lambda i: i * size + 1)

        def one(b: Column) -> Column:
            part = F.transform(F.slice(words, b, size), clean)
            hits = F.size(F.filter(part, lambda w: w.isin(*low)))
            kinds = F.size(F.array_intersect(part, F.array(*[F.lit(t) for t in low])))
            return F.struct((kinds * 1000 + hits).alias("score"), (-b).alias("place"), F.array_join(F.slice(words, b, size), " ").alias("text"))

        return F.filter(F.transform(begins, one), lambda w: w["score"] > 0)

    return _once(F.split(text, r"\s+"), of)


def snippet(text: Column, terms: list[str], start: str = "<b>", end: str = "</b>", max_chars: int = 150) -> Column:
    """The best window with its hits between tags; null without a hit."""
    return highlight(F.array_max(windows(text, terms, max_chars))["text"], terms, start, end)


def snippets(text: Column, terms: list[str], start: str = "<b>", end: str = "</b>", max_chars: int = 150, limit: int = 5, offset: int = 0, by_score: bool = True) -> Column:
    """The windows with hits, best first or in order of the text."""
    found = windows(text, terms, max_chars)
    ordered = F.reverse(F.array_sort(found)) if by_score else F.reverse(F.array_sort(F.transform(found, lambda w: F.struct(w["place"], w["score"], w["text"]))))
    return F.transform(F.slice(ordered, offset + 1, limit), lambda w: highlight(w["text"], terms, start, end))


def token_snippet(text: Column, terms: list[str], start: str, end: str, ellipsis: str, tokens: int) -> Column:
    """A run of `tokens` words from just before the first hit, with an ellipsis where text is left out."""
    words = F.split(text, r"\s+")
    low = [t.lower() for t in terms]
    clean = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    first = F.array_min(F.transform(F.array(*[F.lit(t) for t in low]), lambda t: F.nullif(F.array_position(clean, t), F.lit(0).cast("long"))))
    begin = F.greatest(first - tokens // 2, F.lit(1)).cast("int")
    body = F.array_join(F.slice(words, begin, tokens), " ")
    out = F.concat(F.when(begin > 1, F.lit(ellipsis)).otherwise(""), highlight(body, terms, start, end), F.when(begin + tokens - 1 < F.size(words), F.lit(ellipsis)).otherwise(""))
    return F.when(first.isNotNull(), out)
