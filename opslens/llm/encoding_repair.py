"""Text that was decoded with a wrong encoding: which rows, and what they said.

Each line is scored by how plausible its characters are next to each other (no model of a
language is needed: mixed scripts in a word, symbols inside words, runs of accented
letters, control characters). A line with an implausible word starts a best-first search:
states are texts, steps re-encode a text in the encoding it may have been read with and
decode it as the one it may have been written in, or unescape it. States are hashed so
that none is opened twice, the cheapest state is opened first, and the cheapest text
reached replaces the line if it is clearly more plausible. The search ends when no text
within the cost bound can be cheaper than the best; no number of states ends it. Where the whole line cannot be
re-encoded (garbled and right parts side by side), each word is searched alone. A run of
escapes (entities, \\u, percent or quoted-printable codes) is searched if the text that it
stands for is implausible, whether or not its line holds anything beyond ASCII.

Defined results
  null or empty text      no case, returned as it is
  escapes of right text   no case
  ASCII, correct text in other scripts, symbols, frames    no case
  replacement characters or control characters of 0x80-0x9F     a case, even if lost for good
  very long lines         searched whole
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cost of steps that a search spends at most on one text: two changes of table, a dozen of UTF-8. All texts within it are looked at.
MAX_SPENT = 1.2
#: A word of at least this cost starts a search.
SUSPECT = 1.2
#: Cost of a step: bytes that are valid UTF-8 are strong evidence, another table is not.
STEP_UTF8, STEP_TABLE = 0.1, 0.5

#: Encodings that text is read with by mistake, and those it is written in (fixed values).
READ_AS = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp850", "cp437", "koi8-r", "cp866", "iso8859-15", "cp1250", "mac_cyrillic", "iso8859-5")
WRITTEN_IN = ("utf-8", "cp1252", "cp1251", "koi8-r", "cp866", "mac_roman", "cp850", "cp437")
_HOLES = {c: chr(c) for c in range(0x80, 0xA0)}


@lru_cache(maxsize=None)
def _tables(name: str) -> tuple[dict[int, int], str]:
    """Character to byte and byte to character; bytes that an encoding leaves open stand for themselves."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {ord(c): b for b, c in reversed(list(enumerate(chars)))}, "".join(chars)


def _encode(text: str, name: str) -> bytes | None:
    to_byte = _tables(name)[0]
    try:
        return bytes([to_byte[ord(c)] for c in text])
    except KeyError:
        return None


def _decode(data: bytes, name: str) -> str | None:
    if name == "utf-8":
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return None
    chars = _tables(name)[1]
    return "".join([chars[b] for b in data])


_COMMON = set("äöüßÄÖÜéèêëàâçùûîïôœæñáíóúõãÉÈÊÀÂÇÙÛÎÏÔŒÆÑÁÍÓÚÕÃØøÅåìòÌÒ")
_FREQUENT = set("äöüßéèêàóíáñçÄÖÜÉ")
_RUSSIAN = re.compile("[А-Яа-яЁё]")
_RARE_RUSSIAN = set("ъЪэЭщЩфФцЦюЮыЫЬ")
_QUOTES = set("’‘“”«»„–—…•¿¡→←✓\u2010\u2011\u00a0")
_SIGNS = set("°§·€£™©®×÷±½¼¾²³ªº")
_END = set("¬\u2010\u00ad\u2011-")
_PART = re.compile(r"[^\s\x00-\x2f\x3a-\x3f\x5b-\x60\x7b-\x7e]*[^\x00-\x7f][^\s\x00-\x2f\x3a-\x3f\x5b-\x60\x7b-\x7e]*")


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0xFB00 <= o <= 0xFB06:
        return "L"
    if 0x370 <= o < 0x400:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    return "O"


@lru_cache(maxsize=65536)
def word_cost(word: str) -> float:
    """Implausibility of one word with characters beyond ASCII; 0 to about 1 is ordinary text."""
    cost, scripts, accents, prev = 0.0, set(), 0, ""
    n = len(word)
    letters = [c.isalpha() for c in word]
    for i, c in enumerate(word):
        o = ord(c)
        if o < 0x80:
            if letters[i]:
                scripts.add("L")
            accents = 0
        elif o == 0xFFFD:
            cost += 4.0
            accents = 0
        elif o < 0xA0:
            cost += 4.0
        elif letters[i] and c not in "ªº":
            s = _script(c)
            scripts.add(s)
            if s == "C":
                if not _RUSSIAN.match(c):
                    cost += 2.0
                if prev and prev.islower() and c.isupper():
                    cost += 1.5
            elif s == "L":
                accents += 1
                cost += (0.25 if c in _FREQUENT else 0.4 if c in _COMMON or 0xFB00 <= o else 1.2) + (0.4 if accents == 2 else 1.2 if accents > 2 else 0.0)
                if c.isupper() and prev and prev.islower():
                    cost += 1.5
                if accents == 2 and word[i - 1].isupper() and not word.isupper():
                    cost += 0.5
            else:
                cost += 1.2
        else:
            accents = 0
            before, after = i > 0 and letters[i - 1], i + 1 < n and letters[i + 1]
            if c in _END and not after:
                pass
            elif c == "\u00ad":
                cost += 2.0 if i and ord(word[i - 1]) >= 0x80 else 0.0
            elif c in _QUOTES:
                if before and after and c not in "’‘":
                    cost += 2.0
                elif before and ord(word[i - 1]) >= 0x80 and c not in "’”»…–—‘“„" or after and ord(word[i + 1]) >= 0x80 and c not in "’“«„¿¡‘–—”":
                    cost += 1.2
            elif c in _SIGNS and not (before and after):
                if (before or after) and word[i : i + 2] not in ("°C", "°F"):
                    cost += 1.2
            elif before or after:
                cost += 2.0
        prev = c if letters[i] else ""
    if len(scripts) > 1:
        cost += 3.0
    if n > 2 and not scripts:  # frames repeat their lines; a word read as signs does not
        signs = [c for c in word if ord(c) >= 0x2200]
        if len(set(signs)) > 2 and 2 * sum(c in "─═━│║" for c in signs) < len(signs):
            cost += 0.5 * len(signs)
    if scripts == {"C"} and n > 3 and word.isupper():
        cost += 0.25 * n if sum(c in _RARE_RUSSIAN for c in word) * 4 > n else 0.1 * n
    return cost


def text_cost(text: str) -> float:
    """Sum of the costs of the words beyond ASCII, and of escapes."""
    cost = sum(word_cost(w) for w in _PART.findall(text))
    return cost + 0.8 * len(_ESCAPES.findall(text))


_ESCAPES = re.compile(r"&(?:amp;)*(?:#\d{2,5}|#x[0-9a-fA-F]{2,4}|[A-Za-z][A-Za-z0-9]{1,7});|\\u[0-9a-fA-F]{4}|(?:%[89A-Fa-f][0-9A-Fa-f]){2,}|(?:=[89A-F][0-9A-F]){2,}")


def _unescape(text: str) -> Iterator[str]:
    if "&" in text:
        yield html.unescape(text)
    if "\\u" in text:
        yield re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)), text)
    if "%" in text or "=" in text:
        for mark in "%=":
            def run(m: re.Match, mark: str = mark) -> str:
                return unquote_to_bytes(m.group().replace(mark, "%")).decode("utf-8", "surrogateescape")

            t = re.sub(rf"(?:{mark}[0-9A-Fa-f]{{2}})+", run, text)
            if t != text and not re.search("[\ud800-\udfff]", t):
                yield t


def _unescaped(text: str) -> Iterator[str]:
    """What a text stands for after one level of escapes and after each further one."""
    for t in _unescape(text):
        yield t
        if t != text and _ESCAPES.search(t):
            yield from _unescaped(t)


def _steps(text: str) -> Iterator[tuple[str, float]]:
    """Texts one step away with the step's cost, the likeliest kind of step first."""
    encoded = [(read, data) for read in READ_AS if (data := _encode(text, read)) is not None]
    for _, data in encoded:
        if (t := _decode(data, "utf-8")) is not None and t != text:
            yield t, STEP_UTF8
    if _ESCAPES.search(text):
        yield from ((t, STEP_UTF8) for t in _unescape(text))
    for read, data in encoded:
        for written in WRITTEN_IN[1:]:
            if written != read and (t := _decode(data, written)) != text:
                yield t, STEP_TABLE


def _settled(text: str) -> bool:
    return all(word_cost(w) < SUSPECT for w in _PART.findall(text))


@lru_cache(maxsize=16384)
def search(text: str) -> tuple[str, float, float]:
    """The cheapest reachable text, its own cost, and the cost of ``text``; the steps to a text count in the choice."""
    first = raw = text_cost(text)
    best, best_cost = text, first
    queue: list[tuple[float, int, float, str]] = [(first, 0, 0.0, text)]
    seen, order = {hash(text): 0.0}, 0
    while queue:
        _, _, spent, state = heapq.heappop(queue)
        utf8 = True
        for t, step in _steps(state):
            if utf8 and step != STEP_UTF8:
                utf8 = False
                if best_cost <= 0.4 * first and _settled(best):  # no other table can beat valid UTF-8
                    return best, raw, first
            paid = spent + step
            if paid >= best_cost or paid > MAX_SPENT:  # costs are never negative: nothing behind it can win
                continue
            h = hash(t)
            if seen.get(h, math.inf) <= paid:
                continue
            seen[h] = paid
            own = text_cost(t)
            if own + paid < best_cost:
                best, best_cost, raw = t, own + paid, own
            if paid + STEP_UTF8 <= MAX_SPENT:
                order += 1
                heapq.heappush(queue, (own + paid, order, paid, t))
    return best, raw, first


_LOST = re.compile("[�\u0080-\u0084\u0086-\u009f]")
_BEYOND = re.compile(r"[^\x00-\x7f]")


def repair_line(line: str) -> tuple[str, bool]:
    """The restored line and whether a part of it was decoded wrongly."""
    words = _PART.findall(line)
    if not any(word_cost(w) >= SUSPECT for w in words):
        return line, False
    best, cost, first = search(line)
    if best != line and cost <= 0.5 * first and first - cost >= 0.85:
        return best, True
    # Right and wrong parts side by side: each stretch beyond ASCII alone.
    hit = False

    def one(m: re.Match) -> str:
        nonlocal hit
        w = m.group()
        if word_cost(w) < SUSPECT:
            return w
        b, c, f = search(w)
        if b != w and c <= 0.5 * f and f - c >= 0.85:
            hit = True
            return b
        return w

    out = re.sub(r"\S*[^\x00-\x7f]\S*(?: [^\x00-\x7f]+(?=\s|$))*", one, line)
    return out, hit or bool(_LOST.search(line)) or first >= 6 and sum(word_cost(w) >= 2 for w in words) * 2 > len(words)


_ESCAPED = re.compile(rf"(?:{_ESCAPES.pattern})+")


def repair_escaped(line: str) -> tuple[str, bool]:
    """The line with garbled text restored that stands in it as escapes; escapes of right text stay."""
    hit = False

    def one(m: re.Match) -> str:
        nonlocal hit
        for t in _unescaped(m.group()):
            if len(_BEYOND.findall(t)) < 2 or _settled(t):
                continue
            b, c, f = search(t)
            if b != t and c <= 0.5 * f and f - c >= 0.85:
                hit = True
                return b
        return m.group()

    return _ESCAPED.sub(one, line), hit


def repair(text: str | None) -> tuple[str | None, bool]:
    """The restored text and whether it was a case."""
    if not text or not _BEYOND.search(text) and not _ESCAPES.search(text):
        return text, False
    hit, out = False, text.split("\n")
    for i, line in enumerate(out):
        if not line.isascii():
            out[i], h = repair_line(line)
            hit |= h
        if _ESCAPES.search(out[i]):
            out[i], h = repair_escaped(out[i])
            hit |= h
    return ("\n".join(out) if hit else text), hit


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(t, i, text, not _LOST.search(text) and _settled(text)) for t, i, s in zip(pdf["tab"], pdf["row_id"], pdf["body"], strict=True) for text, hit in [repair(s)] if hit]
        if rows:
            yield pd.DataFrame(rows, columns=["tab", "row_id", "restored", "settled"])


def repair_encoding(texts: DataFrame) -> DataFrame:
    """tab, row_id, restored, settled: the rows of ``texts`` (tab, row_id, body) with a wrongly decoded part.

    ``settled`` is false where implausible or lost characters are left: not all could be restored.
    """
    cand = texts.select("tab", F.col("row_id").cast("long"), "body").filter(F.col("body").rlike(r"[^\x00-\x7f]") | F.col("body").rlike(_ESCAPES.pattern))
    return cand.mapInPandas(_run, "tab string, row_id long, restored string, settled boolean")
