"""Text, case and time-stamp functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def utrim(c: Column) -> Column:
    """Trim every Unicode white-space character; ``trim`` alone only strips U+0020."""
    return F.trim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return utrim(c) == ""


def ascii_upper(c: Column) -> Column:
    """Upper-case a-z only; ``upper`` would turn ß into SS. Pure ASCII takes the fast way."""
    return F.when(_is_ascii(c), F.upper(c)).otherwise(F.translate(c, _LOWER, _UPPER))


def ascii_lower(c: Column) -> Column:
    return F.when(_is_ascii(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def uni_upper(c: Column) -> Column:
    return F.upper(c)


def byte_len(c: Column) -> Column:
    return F.octet_length(c)


def cache_key(ticker: Column, news_only: bool = False) -> Column:
    """Key under which a result is reused; the two modes never share results."""
    key = ascii_upper(utrim(ticker))
    return F.concat(F.lit("news_only:"), key) if news_only else key


def stamp_minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmm")


def stamp_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def preview(c: Column) -> Column:
    """First 512 characters of an error body, for failure messages."""
    return F.substring(c, 1, 512)


def new_request_id() -> Column:
    return F.concat(F.lit("tp_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)
