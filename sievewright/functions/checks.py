"""Checks of answers against instructions, as boolean columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import is_json
from .text import lines, strip, words

#: What an answer says that refuses, in any case.
REFUSALS = ("i cannot", "i can't help", "i won't provide", "cannot assist", "sorry")
FRENCH = "de du en est et la le les un une".split()


def _full(c: Column, sep: str = "\n") -> Column:
    """The pieces that are not blank."""
    return F.filter(F.split(c, sep), lambda x: strip(x) != "")


def _share_upper(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")) / letters).otherwise(0.0)


def _val(v: object) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _int(v: object) -> Column:
    return _val(v).cast("int")


#: Checks of the light benchmark: name -> function of text and value (a literal or a column).
LIGHT: dict[str, Callable[[Column, object], Column]] = {
    "contains": lambda c, v: F.contains(F.lower(c), F.lower(_val(v))),
    "not_contains": lambda c, v: ~F.contains(F.lower(c), F.lower(_val(v))),
    "max_words": lambda c, v: F.size(words(c)) <= _int(v),
    "min_list_items": lambda c, v: F.size(F.filter(lines(c), lambda x: x.rlike(r"(?U)^\s*(?:[-*]|\d+\.)\s+"))) >= _int(v),
    "starts_with": lambda c, v: F.startswith(F.lower(strip(c)), F.lower(_val(v))),
    "json_parseable": lambda c, v: is_json(c),
}

#: Checks of the study.
STRICT: dict[str, Callable[[Column, object], Column]] = {
    "sentence_count": lambda c, v: F.size(_full(c, "[.!?]")) == _int(v),
    "starts_with_numbers": lambda c, v: F.size(F.filter(F.split(strip(c), "\n"), lambda x: strip(x).rlike(r"(?U)^\d+[.):]"))) >= _int(v),
    "no_word": lambda c, v: ~F.contains(F.lower(c), F.lower(_val(v))),
    "is_uppercase": lambda c, v: _share_upper(c) >= 0.8,
    "word_count": lambda c, v: F.abs(F.size(words(c)) - _int(v)) <= 2,
    "bullet_format": lambda c, v: F.exists(F.split(c, "\n"), lambda x: F.startswith(strip(x), _val(v))),
    "ends_with": lambda c, v: F.endswith(strip(c), _val(v)),
    "haiku_lines": lambda c, v: F.size(_full(strip(c))) == _int(v),
    "ordered_markers": lambda c, v: F.forall(v if isinstance(v, Column) else F.array(*[F.lit(x) for x in v]), lambda x: F.contains(c, x)),
    "paragraph_count": lambda c, v: F.size(_full(c, "\n\n")) == _int(v),
    "language_french": lambda c, v: F.size(F.array_intersect(words(F.lower(c)), F.array(*[F.lit(x) for x in FRENCH]))) >= 3,
}


def check(c: Column, kind: str, value: object = None, strict: bool = False) -> Column:
    """One check; an unknown kind fails, as does a null text."""
    f = (STRICT if strict else LIGHT).get(kind)
    return F.coalesce(f(c, value), F.lit(False)) if f else F.lit(False)


def checks_passed(c: Column, checks: Column, json: Column) -> Column:
    """How many of an array of (type, value) a text passes. json: is the text JSON?"""

    def one(x: Column) -> Column:
        out = F.lit(False)
        for kind, f in LIGHT.items():
            if kind != "json_parseable":  # a Python function cannot stand within an array's
                out = F.when(x["type"] == kind, f(c, x["value"])).otherwise(out)
        return F.coalesce(out, F.lit(False))

    return F.size(F.filter(checks, one)) + F.when(json, F.size(F.filter(checks, lambda x: x["type"] == "json_parseable"))).otherwise(0)


def case_score(passed: list[Column]) -> Column:
    """Share of checks passed, in percent; 0 without checks."""
    return sum((p.cast("int") for p in passed), F.lit(0)) * F.lit(100.0 / len(passed)) if passed else F.lit(0.0)


def refuses(c: Column) -> Column:
    return F.coalesce(c.rlike("(?iu)" + "|".join(REFUSALS)), F.lit(False))
