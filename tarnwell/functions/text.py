"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(c: Column | str) -> Column:
    """Lower-case A-Z only; other letters keep their case, as catalogue comparisons are ASCII-insensitive."""
    return F.translate(F.col(c) if isinstance(c, str) else c, UPPER, LOWER)


def same(c: Column | str, value: str | None) -> Column | None:
    """Equality but for ASCII case; None if there is no value, so that no predicate is planned."""
    return None if value is None else fold(c) == F.lit(value.translate(str.maketrans(UPPER, LOWER)))


def holds(c: Column | str, part: str) -> Column:
    """Contains ``part`` but for ASCII case; nothing in it is a wildcard. Null columns do not match."""
    return F.coalesce(F.contains(fold(c), fold(F.lit(part))), F.lit(False))


def filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.trim(c) != "")


def tokens(c: Column | str) -> Column:
    """Search tokens: runs of letters and digits, lower-cased, without those of over 40 characters."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.length(t) <= 40))


def when_all(*conditions: Column | None) -> Column:
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def epoch_text(seconds: Column | str) -> Column:
    """UTC time of epoch seconds; "never" for 0 and below."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.when(s > 0, F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss")).otherwise("never")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot / size)


def summary(*parts: Column | str) -> Column:
    """The parts that are there, joined by commas."""
    return F.concat_ws(", ", *parts)


def truncated(c: Column | str, most: int) -> Column:
    """At most ``most`` characters, the last three of them dots if something is cut off; no character is split."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, max(0, most - 3)), F.lit("...")))
