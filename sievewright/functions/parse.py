"""What answers of a model hold: scores, reasoning, JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .text import strip


def judge_score(c: Column, low: float = 1.0, high: float = 5.0) -> Column:
    """A text that is a number counts if it is in range, and as nothing if not; of other texts the last number in range."""
    s = strip(c)
    whole = F.regexp_extract(s, r"^(\d+(?:\.\d+)?)$", 1)
    inside = F.filter(F.transform(F.regexp_extract_all(s, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double")), lambda x: x.between(low, high))
    last = F.when(F.size(inside) > 0, F.element_at(inside, -1))
    return F.when(whole != "", F.when(whole.cast("double").between(low, high), whole.cast("double"))).otherwise(last)


def ten_point_score(c: Column) -> Column:
    """The last number that stands alone, between 0 and 10, times ten; 0 without one."""
    found = F.regexp_extract_all(c, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))
    return F.coalesce(F.when(F.size(found) > 0, F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.element_at(found, -1).cast("double"))) * 10), F.lit(0.0))


def first_rating(c: Column, default: float = 5.0) -> Column:
    """The first whole number from 1 to 10 that stands alone."""
    hit = F.regexp_extract(F.coalesce(c, F.lit("")), r"\b(10|[1-9])\b", 1)
    return F.when(hit == "", default).otherwise(hit.cast("double"))


def reasoning(c: Column) -> Column:
    """struct(reasoning, answer): what is thought aloud first, and the text without any such part."""
    return F.struct(
        strip(F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1)).alias("reasoning"),
        strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", "")).alias("answer"),
    )


def read_criteria(text: str | None, names: list[str]) -> dict[str, float] | None:
    """Scores from 1 to 5 by name: of the JSON object in a text, else of phrases such as `name: 4`. None if there is none.

    JSON that is no object gives none; in an object, strings of numbers count too, what else is no number is left out.
    """
    if text is None:
        return None
    inside = text.strip()
    if fence := re.search(r"(?s)```(?:json)?(.*?)```", inside):
        inside = fence[1].strip()
    lo, hi = inside.find("{"), inside.rfind("}")
    if -1 < lo < hi:
        inside = inside[lo : hi + 1]
    found: dict[str, object] = {}
    try:
        data = json.loads(inside)
        if isinstance(data, dict):
            found = {n: data.get(n) for n in names}
    except ValueError:
        for n in names:
            if hit := re.search(rf"(?i){re.escape(n)}\s*[:=]\s*(\d+(?:\.\d+)?)", text):
                found[n] = hit[1]
    out = {}
    for n, v in found.items():
        try:
            if v is not None and 1 <= float(v) <= 5:
                out[n] = float(v)
        except (TypeError, ValueError):
            continue
    return out or None


def criteria_scores(c: Column, names: list[str]) -> Column:
    """map of name -> score, as read_criteria() gives it; Python's JSON, which no built-in function has."""
    read = F.pandas_udf(lambda s: s.map(lambda t: read_criteria(t, names)), "map<string,double>")
    return read(c)


def weighted_score(scores: Column, weights: dict[str, float]) -> Column:
    """Weights are made to sum to 1; a missing criterion counts 0."""
    total = sum(weights.values())
    return F.round(sum((F.coalesce(scores[k], F.lit(0.0)) * F.lit(w / total) for k, w in weights.items()), F.lit(0.0)), 4)


def _is_json(text: str | None) -> bool:
    try:
        json.loads(text or "")
        return True
    except ValueError:
        return False


@F.pandas_udf(BooleanType())
def is_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Is the whole text JSON? By Python's rules."""
    for s in batches:
        yield s.map(_is_json).astype(bool)


def _holds_json(text: str | None) -> bool:
    if not text:
        return False
    try:
        json.loads(text)
        return True
    except ValueError:
        pass
    part = re.search(r"\{[^{}]*\}|\[[^\[\]]*\]", text)
    try:
        return part is not None and json.loads(part.group()) is not ...
    except ValueError:
        return False


@F.pandas_udf(BooleanType())
def holds_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Is the text JSON, or its first flat object or array? Python's rules, which no built-in function has."""
    for s in batches:
        yield s.map(_holds_json).astype(bool)


def json_part(text: str) -> str:
    """The inside of a code fence; else a text that begins as JSON does; else from the first brace to the last; else the text."""
    text = text.strip()
    if fence := re.search(r"(?s)```(?:json)?(.*?)```", text):
        return fence[1].strip()
    if text[:1] in ("{", "["):
        return text
    brace = re.search(r"(?s)\{.*\}", text)
    return brace[0] if brace else text


def variants(text: str, n: int) -> list[str]:
    """The lines of a numbered list, without their numbers, n at most."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        for k in range(1, n + 2):
            for sign in (". ", ") ", ": "):
                line = line.removeprefix(f"{k}{sign}")
        out.append(line.strip())
    return out[:n]
