"""Text expressions: header names, null tokens, dirty numbers, glob patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantspark.functions.timefx import as_col
from plantspark.schema import BASIC_NULL_TOKENS, RESERVED_NAMES

#: Header words that are translated to the standard ones.
LOCAL_HEADERS = {"日期": "Date", "時間": "Time", "时间": "Time"}


def sanitise_sensor(name: Column | str) -> Column:
    return F.regexp_replace(as_col(name), "[-.:]", "_")


def snake_case(name: Column | str) -> Column:
    """Header text to a snake_case identifier; null when no identifier remains.

    Both camel-case splits use capture groups, so any RE2-style engine gives the same result.
    A unit with the prefix kilo stays one word (``power(kW)`` -> ``power_kw``).
    """
    c = F.trim(as_col(name))
    c = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")
    c = F.regexp_replace(c, "([A-Z])([A-Z][a-z])", "$1_$2")
    c = F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")
    c = F.regexp_replace(c, "_+", "_")
    c = F.regexp_replace(c, "^([0-9])", "col_$1")
    c = F.regexp_replace(c, "_$", "")
    c = F.regexp_replace(F.lower(c), "(^|_)k_(wh|w|pa|var|va|v|j)(_|$)", "$1k$2$3")
    c = F.when(c.rlike("^[a-z][a-z0-9_]*$"), c)
    return F.when(c.isin(RESERVED_NAMES), F.concat(c, F.lit("_col"))).otherwise(c)


def standard_header(name: Column | str) -> Column:
    """Quotes, blanks and the ``<>`` prefix off; local-language date and time words mapped."""
    c = F.trim(F.regexp_replace(F.regexp_replace(as_col(name), "[\"']", ""), "<>", ""))
    out = c
    for local, standard in LOCAL_HEADERS.items():
        out = F.when(c == F.lit(local), F.lit(standard)).otherwise(out)
    return out


def null_if_token(c: Column | str, tokens: Iterable[str] = tuple(BASIC_NULL_TOKENS)) -> Column:
    x = F.trim(as_col(c))
    return F.when(~x.isin(list(tokens)), x)


def to_double(c: Column | str) -> Column:
    """Cast that gives null for text that is no number."""
    return as_col(c).try_cast("double")


def scrub_number(c: Column | str, tokens: Iterable[str] = ()) -> Column:
    """Drop unit text around a number (``25.3 C`` -> 25.3) and cast; null when nothing is left."""
    x = null_if_token(c, tokens) if tokens else as_col(c)
    digits = F.regexp_replace(x, "[^0-9.\\-eE]", "")
    return F.nullif(digits, F.lit("")).try_cast("double")


def glob_to_regex(pattern: str) -> str:
    """Shell glob (``*``, ``?``, ``[seq]``, ``[!seq]``) as an anchored regex."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out.append("[^" + body[1:] + "]" if body.startswith("!") else "[" + body + "]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return "^" + "".join(out) + "$"


def has_bom(c: Column | str) -> Column:
    return as_col(c).contains("\ufeff")


def has_nul(c: Column | str) -> Column:
    return as_col(c).contains("\u0000")
