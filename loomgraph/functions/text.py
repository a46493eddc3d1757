"""Column expressions on texts, ids and times; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: One run of a-z, 0-9 and underscore in a lower-cased text.
WORD = "[a-z0-9_]+"

#: White space as Python's str.strip takes it off, at both ends.
OUTER_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def letters_digits(text: Column) -> Column:
    """The letters and digits of Unicode of ``text`` in order; null stays null."""
    return F.regexp_replace(text, r"[^\p{L}\p{Nd}]+", "")


def folded(text: Column) -> Column:
    """``text`` with letter case levelled; upper first, so that letters with several lower forms meet."""
    return F.lower(F.upper(text))


def key_form(ident: Column) -> Column:
    """Letters and digits of an id in lower case; null for a null id and for one without any."""
    return F.nullif(F.lower(letters_digits(ident)), F.lit(""))


def stripped(text: Column) -> Column:
    """``text`` without outer white space of any kind."""
    return F.regexp_replace(text, OUTER_BLANKS, "")


def utc_time(text: Column) -> Column:
    """Timestamp of an ISO-8601 text; no offset means UTC, a date alone its midnight, an unreadable text gives null."""
    t = stripped(text)
    t = F.when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00"))).otherwise(t)
    zoned = t.rlike(r"([zZ]|[+-]\d{2}:?\d{2}|[+-]\d{2})$") & t.rlike(r"\d{2}:\d{2}")
    return F.when(zoned, t).otherwise(F.concat(t, F.lit("+00:00"))).try_cast("timestamp")


def month(ts: Column) -> Column:
    """'yyyy-MM' in UTC of a timestamp, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM")


def words(*texts: Column) -> Column:
    """Distinct words of the texts joined by a blank, in order of first occurrence; null counts as empty."""
    joined = F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])
    return F.array_distinct(F.regexp_extract_all(F.lower(joined), F.lit(WORD), F.lit(0)))
