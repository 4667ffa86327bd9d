"""Column expressions over text; everything here stays inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# 32-bit FNV-1a parameters and the identifier layout.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
ID_SEPARATOR = "\u001f"
ID_PREFIX = "fd_"
EVIDENCE_LIMIT = 160

# The catalogues mean ASCII word boundaries; java.util.regex on Java 17 tests Unicode letters for \b.
# They mean every Unicode space by \\s, and line and paragraph separators and the byte-order mark with them; Java means ASCII.
_SPACE = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_ASCII_BOUNDARY = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def java_regex(pattern: str, flags: str = "") -> str:
    """Give a catalogue pattern its intended meaning under ``java.util.regex``."""
    inline = "".join(flag for flag in "ims" if flag in flags)
    out, inside, negated = [], False, False
    for m in re.finditer(r"(?s)\[\\s\\S\]|\\.|.", pattern):
        token = m.group()
        if token == r"[\s\S]":
            # Any sign at all; as a class Java would try its ranges one after the other at every step of a quantifier.
            token, inside = (f"[{_SPACE}\\S]" if inside else "(?s:.)"), False
        elif not inside and token == "[":
            inside, negated = True, pattern.startswith("^", m.end())
        elif inside and token == "]":
            inside = False
        elif token == r"\b" and not inside:
            token = _ASCII_BOUNDARY
        elif token == r"\s":
            token = _SPACE if inside else f"[{_SPACE}]"
        elif token == r"\S" and not (inside and negated):
            token = f"[^{_SPACE}]"
        out.append(token)
    return (f"(?{inline})" if inline else "") + "".join(out)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chars(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def fnv1a(text: Column) -> Column:
    codes = F.transform(chars(text), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(
        codes,
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)),
    )


def stable_id(*parts: Column) -> Column:
    joined = F.concat_ws(ID_SEPARATOR, *[p.cast("string") for p in parts])
    return F.concat(F.lit(ID_PREFIX), F.lower(F.lpad(F.hex(fnv1a(joined)), 8, "0")))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 3)), F.lit("...")))


def compact_evidence(text: Column, limit: int = EVIDENCE_LIMIT) -> Column:
    return clip(collapse_spaces(text), limit)


def mask_secret(text: Column) -> Column:
    value = F.trim(text)
    return F.when(F.length(value) <= 12, F.lit("[redacted]")).otherwise(
        F.concat(F.left(value, F.lit(6)), F.lit("..."), F.right(value, F.lit(4)))
    )


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character.

    Sorting the characters turns equal ones into runs; the sorted order also makes the floating-point sum repeatable.
    """
    runs = F.regexp_extract_all(F.array_join(F.sort_array(chars(text)), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    share = lambda run: F.length(run) / F.length(text)
    return F.aggregate(runs, F.lit(0.0), lambda acc, run: acc - share(run) * F.log2(share(run)))


def distinct_ratio(text: Column) -> Column:
    cs = chars(text)
    return F.when(F.size(cs) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(cs)) / F.size(cs))


def longest_run(text: Column) -> Column:
    """Length of the longest repetition of one character."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)(.)\1*"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def character_classes(text: Column) -> Column:
    kinds = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"]
    return sum((text.rlike(k).cast("int") for k in kinds), F.lit(0))


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the last path segment; empty when there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)\z", 1))


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def utc_day(ms: Column) -> Column:
    """Calendar day of an epoch-millisecond value in UTC, whatever the session zone is."""
    return F.date_from_unix_date(F.floor(ms / F.lit(86_400_000)).cast("int"))
