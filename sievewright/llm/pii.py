"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers find and check the boundaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import col, table

SCHEMES = ("http", "https", "ftp", "ftps", "ssh", "sftp")
#: Words after which a secret stands, and words after which an account number stands.
SECRETS = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "access_key", "bearer")
ACCOUNTS = ("account", "acct", "iban", "konto", "compte", "cuenta", "card", "karte", "carte", "tarjeta")
#: Words after which a phone number stands in a national form.
PHONES = ("tel", "telephone", "telefon", "téléphone", "teléfono", "telefono", "phone", "mobile", "mobil", "móvil", "cell", "fax")
#: Words that may stand between a cue for an account or phone and its number: one of each, in this order.
LINKS = (("number", "nummer", "numéro", "número", "numero", "no", "nr", "n°"), ("is", "ist", "est", "es"))
#: Characters between a cue and what it announces, at most, and what they may be.
GAP, BETWEEN = 12, " =:\"'!#$%&*.\t"

Found = tuple[int, int, str]  # start, end, kind


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


def email(t: str, at: int) -> Found | None:
    """at: the place of an at-sign."""
    lo = at
    while lo > 0 and at - lo < 65 and (t[lo - 1].isalnum() or t[lo - 1] in "._%+-"):
        lo -= 1
    while lo < at and t[lo] in ".-+%":
        lo += 1
    local = t[lo:at]
    if not local or len(local) > 64 or local[-1] == "." or ".." in local:
        return None
    hi = at + 1
    while hi < len(t) and hi - at < 255 and (t[hi].isalnum() or t[hi] in ".-"):
        hi += 1
    labels = t[at + 1 : hi].split(".")
    while labels and (not labels[-1] or labels[-1][-1] == "-"):  # the full stop of a sentence
        hi -= 1 if not labels[-1] else len(labels[-1]) - len(labels[-1].rstrip("-"))
        labels = t[at + 1 : hi].split(".")
        if hi <= at + 1:
            return None
    if len(labels) < 2 or not (labels[-1].isalpha() and len(labels[-1]) >= 2) or not all(0 < len(x) < 64 and x[0] != "-" and x[-1] != "-" for x in labels):
        return None
    return lo, hi, "email"


def url(t: str, at: int) -> Found | None:
    """at: the place of :// or of www. at the beginning of a word."""
    lo = at
    if t.startswith("://", at):
        while lo > 0 and t[lo - 1].isascii() and t[lo - 1].isalpha():
            lo -= 1
        if t[lo:at].lower() not in SCHEMES:
            return None
        host = at + 3
    else:
        if at > 0 and (_word(t[at - 1]) or t[at - 1] in "/.-@"):
            return None
        host = at
    hi = host
    while hi < len(t) and not t[hi].isspace() and t[hi] not in "<>\"'`|{}\\^":
        hi += 1
    while hi > host and t[hi - 1] in ".,;:!?)]*":
        hi -= 1
    name = t[host:hi]
    for stop in "/?#":
        name = name.split(stop)[0]
    name = name.rpartition("@")[2].partition(":")[0]
    labels = name.split(".")
    if len(labels) < 2 or not all(x and all(c.isalnum() or c == "-" for c in x) for x in labels):
        return None
    return lo, hi, "url"


def _run(t: str, at: int) -> int:
    while at < len(t) and _digit(t[at]):
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _ipv4(t: str, at: int) -> Found | None:
    hi = at
    for k in range(4):
        end = _run(t, hi)
        if not 0 < end - hi < 4 or int(t[hi:end]) > 255:
            return None
        hi = end
        if k < 3:
            if hi >= len(t) or t[hi] != ".":
                return None
            hi += 1
    if hi < len(t) and (_word(t[hi]) or t[hi] == "." and hi + 1 < len(t) and _digit(t[hi + 1])):
        return None
    return at, hi, "ip"


def phone(t: str, at: int) -> Found | None:
    """at: the place of a plus sign. A country code of 1 to 3 digits, then groups of 2 to 10 with single separators or brackets; ten digits after +1, else 8 to 15 in all."""
    if at > 0 and _word(t[at - 1]):
        return None
    end = _run(t, at + 1)
    code = end - at - 1
    if not code:
        return None
    want = 11 if t[at + 1] == "1" else 15
    digits, hi = code, end
    if code <= 3:
        while digits < want:
            p = hi
            if p < len(t) and t[p] in " .-":
                p += 1
            bracket = p < len(t) and t[p] == "("
            p += bracket
            end = _run(t, p)
            if not 2 <= end - p <= 10 or digits + end - p > want:
                break
            if bracket:
                if end >= len(t) or t[end] != ")":
                    break
                digits, hi = digits + end - p, end + 1
            else:
                digits, hi = digits + end - p, end
    if digits < (11 if want == 11 else 8) or digits > want or hi < len(t) and _word(t[hi]):
        return None
    return at, hi, "phone"


def _iban(t: str, at: int) -> Found | None:
    """at: the place of two capitals."""
    body, hi, last = "", at, at
    while hi < len(t) and len(body) < 34:
        c = t[hi]
        if c.isascii() and (c.isdigit() or c.isupper()):
            body += c
            hi = last = hi + 1
        elif c == " " and hi > last - 1 and len(body) % 4 == 0 and body:
            hi += 1
            if hi < len(t) and not (t[hi].isascii() and (t[hi].isdigit() or t[hi].isupper())):
                break
        else:
            break
    for n in range(len(body), 14, -1):  # a capital or number may follow after a space
        moved = body[4:n] + body[:4]
        if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1:
            end, left = at, n
            while left:
                left -= t[end] != " "
                end += 1
            if end >= len(t) or not _word(t[end]):
                return at, end, "iban"
    return None


def number(t: str, at: int) -> Found | None:
    """at: the first digit of a run, not inside a word. An IP address, social security number, phone number of the form 555-123-4567, or card number by its check digit."""
    if at > 1 and t[at - 2 : at].isascii() and t[at - 2 : at].isupper() and t[at - 2 : at].isalpha() and (at == 2 or not _word(t[at - 3])):
        return _iban(t, at - 2)
    if at > 0 and (_word(t[at - 1]) or t[at - 1] == "." and at > 1 and _digit(t[at - 2])):
        return None
    end = _run(t, at)
    if end - at <= 3 and (ip := _ipv4(t, at)):
        return ip
    parts, hi = [t[at:end]], end
    sep = t[hi] if hi < len(t) and t[hi] in " -" else ""
    while sep and len(parts) < 5 and hi < len(t) and t[hi] == sep and 0 < (stop := _run(t, hi + 1)) - hi - 1 <= 6:
        parts.append(t[hi + 1 : stop])
        hi = stop
    sizes = [len(p) for p in parts]
    if sep == "-" and sizes[:3] == [3, 2, 4] and len(parts) == 3 and not (hi < len(t) and _word(t[hi])):
        if parts[0] not in ("000", "666") and parts[0] < "900" and parts[1] != "00" and parts[2] != "0000":
            return at, hi, "ssn"
        return None
    if sep == "-" and sizes == [3, 3, 4] and not (hi < len(t) and (_word(t[hi]) or t[hi] == "-")) and not (at > 0 and t[at - 1] == "-"):
        return at, hi, "phone"
    if sizes[0] == 4 and len(parts) > 2:  # a card number in groups
        for n in (5, 4, 3):
            if n <= len(parts):
                stop = at + sum(sizes[:n]) + n - 1
                if 13 <= sum(sizes[:n]) <= 19 and luhn("".join(parts[:n])) and not (stop < len(t) and _word(t[stop])):
                    return at, stop, "card"
    if 13 <= end - at <= 19 and not (end < len(t) and _word(t[end])) and luhn(t[at:end]):
        return at, end, "card"
    return None


def _after(t: str, end: int) -> int:
    hi = end
    while hi < len(t) and hi - end < GAP and t[hi] in BETWEEN:
        hi += 1
    return hi


def _linked(t: str, end: int) -> int:
    """The place after a cue's end, signs and LINKS; end itself if no sign follows the cue."""
    lo = _after(t, end)
    for words in LINKS if lo > end else ():
        for word in words:
            stop = lo + len(word)
            if t[lo:stop].lower() == word and not t[stop : stop + 1].isalpha():
                lo = _after(t, stop)
                break
    return lo


def _groups(t: str, at: int) -> tuple[int, list[int]]:
    """(end, sizes) of groups of digits with single separators, the first perhaps in brackets."""
    hi, sizes = at, []
    if hi < len(t) and t[hi] == "(":
        end = _run(t, hi + 1)
        if end == hi + 1 or t[end : end + 1] != ")":
            return at, []
        sizes, hi = [end - hi - 1], end + 1
    while True:
        p = hi + (bool(sizes) and t[hi : hi + 1] in (" ", ".", "-", "/"))
        if (end := _run(t, p)) == p:
            return hi, sizes
        sizes.append(end - p)
        hi = end


def bracketed(t: str, at: int) -> Found | None:
    """at: an opening bracket. A phone number in a national form: an area code of 2 to 5 digits in it, which is three long or begins with 0, then groups of 2 to 8; 8 to 12 digits in all, ten if the code is no 0 code."""
    if at > 0 and _word(t[at - 1]):
        return None
    hi, sizes = _groups(t, at)
    if len(sizes) < 2 or not 2 <= sizes[0] <= 5 or any(not 2 <= n <= 8 for n in sizes[1:]) or hi < len(t) and _word(t[hi]):
        return None
    if t[at + 1] == "0" and 8 <= sum(sizes) <= 12 or sizes in ([3, 3, 4], [3, 7]):
        return at, hi, "phone"
    return None


def cued_phone(t: str, at: int, cue: str) -> Found | None:
    """at: the place of a cue. 7 to 12 digits in groups after it, perhaps with LINKS between; forms with a plus sign are phone()'s."""
    end = at + len(cue)
    if at > 0 and t[at - 1].isalnum() or (lo := _linked(t, end)) == end:
        return None
    hi, sizes = _groups(t, lo)
    if not 7 <= sum(sizes) <= 12 or hi < len(t) and _word(t[hi]) or _ipv4(t, lo):
        return None
    return lo, hi, "phone"


def secret(t: str, at: int, cue: str) -> Found | None:
    """at: the place of a cue. Of 16 characters or more, with letters and digits, after a sign between."""
    end = at + len(cue)
    if at > 0 and t[at - 1].isalnum():
        return None
    lo = _after(t, end)
    if lo == end:
        return None
    hi = lo
    while hi < len(t) and t[hi].isascii() and (t[hi].isalnum() or t[hi] in "_-/+"):
        hi += 1
    value = t[lo:hi]
    if len(value) < 16 or not any(map(str.isdigit, value)) or not any(map(str.isalpha, value)):
        return None
    return lo, hi, "secret"


def account(t: str, at: int, cue: str) -> Found | None:
    """at: the place of a cue. A number of 6 to 19 digits after it, perhaps with LINKS between, as in "account number is"."""
    end = at + len(cue)
    if at > 0 and t[at - 1].isalnum():
        return None
    lo = _linked(t, end)
    if lo == end:
        return None
    hi, digits, last = lo, 0, lo
    while hi < len(t) and (_digit(t[hi]) or t[hi] in " -" and hi + 1 < len(t) and _digit(t[hi + 1]) and digits):
        digits += _digit(t[hi])
        hi += 1
    last = hi
    if not 6 <= digits <= 19 or last < len(t) and _word(t[last]):
        return None
    return lo, last, "account"


def _anchors() -> dict[str, list[tuple[int, Callable]]]:
    """Anchor -> (order among those of one place, parser of text and place)."""
    found: dict[str, list] = {"@": [(0, email)], "://": [(0, url)], "www.": [(0, url)], "+": [(0, phone)], "(": [(0, bracketed)]}
    found |= {d: [(1, number)] for d in "0123456789"}
    for cue in SECRETS:
        found.setdefault(cue, []).append((0, lambda t, at, cue=cue: secret(t, at, cue)))
    for cue in ACCOUNTS:
        found.setdefault(cue, []).append((0, lambda t, at, cue=cue: account(t, at, cue)))
    for cue in PHONES:
        found.setdefault(cue, []).append((0, lambda t, at, cue=cue: cued_phone(t, at, cue)))
    return found


ANCHORS = _anchors()


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, parsers in ANCHORS.items():
        a.add_word(word, (len(word), parsers))
    a.make_automaton()
    return a


def _lower(t: str) -> str:
    low = t.lower()
    return low if len(low) == len(t) else "".join(x if len(x := c.lower()) == 1 else c for c in t)


def settle(found: list[Found]) -> list[Found]:
    """Without overlaps: the earliest, of those the longest, stays; of equal ones the least by kind."""
    out: list[Found] = []
    for f in sorted(set(found), key=lambda f: (f[0], -f[1], f[2])):
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def find(t: str | None, a: ahocorasick.Automaton) -> list[Found]:
    """All that the parsers confirm at the text's anchors, in order of place."""
    found = []
    if t:
        last = -2
        for end, (n, parsers) in a.iter(_lower(t)):
            at = end - n + 1
            if n == 1 and "0" <= t[at] <= "9":
                inside, last = last == at - 1, at
                if inside:
                    continue  # one try for each run of digits
            for _, parser in parsers:
                if (f := parser(t, at)) is not None:
                    found.append(f)
    return settle(found)


def entities(df: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(doc_id, kind, start, end, value): a row for each piece of personal data; places count characters from 0.

    kind: email, url, ip, phone, card, iban, ssn, account, secret. The whole of every text is searched. Null and
    empty texts and texts without any give no row; rows with equal ids or texts each give their own. doc_id may
    be null. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in batches:
            ids, texts = b.column(0), [None if x is None else x.decode("utf-8", "replace") for x in b.column(1).cast(pa.large_binary()).to_pylist()]
            rows = [(k, kind, lo, hi, t[lo:hi]) for k, t in enumerate(texts) for lo, hi, kind in find(t, a)]
            at, kinds, los, his, values = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(los, pa.int64()), pa.array(his, pa.int64()), pa.array(values, pa.string())], names=["doc_id", "kind", "start", "end", "value"])

    kind = dict(df.dtypes)[order]
    return df.select(col(order).alias("doc_id"), col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, kind string, start long, end long, value string")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The frame with each piece of personal data in the text replaced by its kind, as [EMAIL]; null stays null."""

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = automaton()
        for b in batches:
            out = []
            for x in b.cast(pa.large_binary()).to_pylist():
                t = None if x is None else x.decode("utf-8", "replace")
                for lo, hi, kind in reversed(find(t, a)):
                    t = f"{t[:lo]}[{kind.upper()}]{t[hi:]}"
                out.append(t)
            yield pa.array(out, pa.string())

    return df.withColumn(text, clean(col(text)))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(table(spark, sf_dir, "documents"))


QUERIES = {"op7_pii": op7_pii}
SQL: dict[str, str] = {}
