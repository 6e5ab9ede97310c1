"""Text functions as column expressions, all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)\w+"


def strip(c: Column) -> Column:
    """Without white space (Unicode's) at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^(?U)\s+", ""), r"(?U)\s+$", "")


def blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def tokens(c: Column) -> Column:
    """Runs of word characters in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def normalized(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def words(c: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def lines(c: Column) -> Column:
    """Lines, however they end; what follows the last end is a line too."""
    return F.split(c, r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]")


def estimated_tokens(c: Column) -> Column:
    """A quarter of the stripped length, 1 at least; 0 for blank."""
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(s == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(s) / 4))).cast("long")


def prompt_tokens(c: Column) -> Column:
    """A fifth of the length as it is, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 5)).cast("long")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ngrams(a: Column, n: int) -> Column:
    """All runs of n items as strings; an array shorter than n has none."""

    def runs(a: Column) -> Column:
        m = F.greatest(F.lit(0), F.size(a) - (n - 1))
        out = F.slice(a, 1, m)
        for k in range(1, n):  # shifted copies side by side: linear in the length
            out = F.zip_with(out, F.slice(a, k + 1, m), lambda x, y: F.concat(x, F.lit(" "), y))
        return out

    return let(a, runs)


def shingles(a: Column, n: int) -> Column:
    """Distinct n-grams; what is shorter is one shingle as a whole, nothing has none."""
    whole = lambda a: F.when(F.size(a) == 0, F.array().cast("array<string>")).when(F.size(a) < n, F.array(F.array_join(a, " "))).otherwise(F.array_distinct(ngrams(a, n)))
    return let(a, whole)


def preview(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def prefix_key(c: Column, n: int = 96) -> Column:
    """What requests with a common beginning share."""
    return F.substring(c, 1, n)
