"""Text expressions over columns; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def found(col: Column | str, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def found_all(col: Column | str, pattern: str, group: int = 1) -> Column:
    """Group of every match, in order; null for null."""
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def strip(col: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def cut(col: Column, n: int, mark: str = "...") -> Column:
    """The first n characters, marked if there were more."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(mark))).otherwise(col)


def literals_of(pattern: str) -> tuple[str, ...]:
    """For each alternative of a pattern the longest plain text that every match holds, in lower case; () if one has none."""
    best, run, out, i = "", "", [], 0

    def close() -> None:
        nonlocal best, run
        best, run = max(best, run, key=len), ""

    while i <= len(pattern):
        c = pattern[i] if i < len(pattern) else "|"
        if c == "|":
            close()
            if not best:
                return ()
            out.append(best.lower())
            best = ""
        elif c == "(" or c == "[":
            close()
            depth, listed = 0, False
            while True:  # to the end of the group or list
                d = pattern[i]
                if d == "\\":
                    i += 1
                elif listed:
                    listed = d != "]"
                elif d == "[":
                    listed = True
                    i += pattern[i + 1 : i + 2] == "]"
                elif d in "()":
                    depth += 1 if d == "(" else -1
                if depth == 0 and not listed:
                    break
                i += 1
        elif c == "\\":
            i += 1
            if pattern[i].isalnum():
                close()
            else:
                run += pattern[i]
        elif c in "?*{":
            run = run[:-1]
            close()
            if c == "{":
                i = pattern.index("}", i)
        elif c in "+.^$":
            close()
        else:
            run += c
        i += 1
    return tuple(out)


def matches(col: Column | str, low: Column | str, pattern: str, flags: str = "") -> Column:
    """Whether a pattern matches; where its texts must hold something plain, that is looked for first in ``low``, the column in lower case."""
    c = F.col(col) if isinstance(col, str) else col
    test = c.rlike(flags + pattern)
    need = literals_of(pattern)
    if not need:
        return test
    holds = F.contains(low, F.lit(need[0]))
    for text in need[1:]:
        holds = holds | F.contains(low, F.lit(text))
    return holds & test


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column | str) -> Column:
    """Lower case of A-Z only, as the search of the store compares."""
    return F.translate(col, _UPPER, _LOWER)


def has_ci(col: Column | str, part: Column | str) -> Column:
    """Substring test without ASCII letter case; wildcards in ``part`` are plain characters."""
    return F.contains(ascii_lower(col), ascii_lower(F.lit(part) if isinstance(part, str) else part))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


# What is redacted and in which order; a token that reads as a date is no account.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
DATE_TOKEN = r"(?:19[7-9]\d|20\d\d)(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:(?:[01]\d|2[0-3])[0-5]\d[0-5]\d)?"
ACCOUNT = rf"\b(?!{DATE_TOKEN}\b)\d{{8,16}}\b"


def redact(col: Column | str) -> Column:
    """E-mail, phone, social security and account numbers replaced, in this order."""
    out = F.regexp_replace(col, EMAIL, "[EMAIL]")
    out = F.regexp_replace(out, PHONE, "[PHONE]")
    out = F.regexp_replace(out, SSN, "[SSN]")
    return F.regexp_replace(out, ACCOUNT, "[ACCT]")
