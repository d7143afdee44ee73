"""Column functions on terms of a place lexicon and on places in sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon_values as V
from .text import HAN, col


def _any(words: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, words))


def normalised(term: Column | str) -> Column:
    """A term without spaces and marks around it, and without one word for "around" or "towards" behind two characters or more."""
    marks = "".join("\\" + c if c in "-|" else c for c in V.WRAPPING)
    x = F.regexp_replace(F.regexp_replace(col(term), r"(?U)^\s+|\s+$", ""), f"^[{marks}]+|[{marks}]+$", "")
    return F.regexp_replace(F.regexp_replace(x, f"(?s)^(..+)(?:{_any(V.AROUND_ENDS)})$", "$1"), r"(?U)^\s+|\s+$", "")


def admin_name(term: Column | str) -> Column:
    """Whether a term is the name of a city, province or region, or of a city after its province."""
    names = (*V.CITIES, *V.PROVINCES, *V.REGIONS)
    return F.coalesce(col(term), F.lit("")).rlike(f"^(?:{_any(V.PROVINCES)})?(?:{_any(tuple(sorted(set(names), key=len, reverse=True)))})$")


def valid_term(term: Column | str, shortest: int = 2, longest: int = 6) -> Column:
    """Whether a term may enter the lexicon by itself; null is not valid."""
    t = F.coalesce(col(term), F.lit(""))
    ok = F.length(t).between(shortest, longest) & ~t.rlike(r"(?U)\d") & t.rlike(HAN) & ~t.isin(*V.NOISE_WORDS) & ~admin_name(t)
    ok &= ~t.rlike(f"(?:{_any(V.METAPHOR_ENDS + V.AREA_ENDS)})$")
    return ok & ~t.rlike(_any(V.SENTENCE_MARKS + V.STRUCTURE_WORDS + V.GENERIC_WORDS))


def _terms(text: Column, line: str) -> Column:
    """Valid terms of the lines that ``line`` finds, distinct, in order."""
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(line), F.lit(1)), lambda x: F.split(x, V.BETWEEN_TERMS, -1)))
    return F.array_distinct(F.filter(F.transform(parts, normalised), lambda t: valid_term(t)))


def topic_terms(text: Column | str) -> Column:
    return _terms(F.coalesce(col(text), F.lit("")), V.TOPIC_LINE)


def heading_terms(text: Column | str) -> Column:
    return _terms(F.coalesce(col(text), F.lit("")), V.HEADING_LINE)


def truncated_at_clause(text: Column | str) -> Column:
    """What comes before the first character from the third on that ends a clause."""
    marks = "".join("\\" + c if c in "[]()?/~" else c for c in V.CLAUSE_ENDS)
    return F.regexp_replace(col(text), f"(?s)^(..[^{marks}]*)[{marks}].*$", "$1")


def place_like(name: Column | str) -> Column:
    """Whether a text may be a place: 2 to 10 characters, some of them Chinese, nothing that belongs to a sentence or a heading."""
    n = F.regexp_replace(F.coalesce(col(name), F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.length(n).between(2, V.PLACE_LONGEST) & n.rlike("[\\u4e00-\\u9fa5]") & ~n.rlike(V.NOT_A_PLACE)


def places_in(text: Column | str) -> Column:
    """Places that verbs of visiting stand before, cut at the clause and without what stands behind them, distinct, in order."""
    raw = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(V.PLACE_AFTER), F.lit(1))
    bare = F.transform(raw, lambda x: F.trim(F.regexp_replace(truncated_at_clause(F.trim(x)), V.PLACE_TAIL, "")))
    return F.array_distinct(F.filter(bare, lambda x: place_like(x)))


def booking(question: Column | str) -> Column:
    """Whether a question asks to book or buy something."""
    return F.coalesce(col(question), F.lit("")).rlike(V.BOOKING)
