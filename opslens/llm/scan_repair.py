"""Text read from scanned pages: page furniture, split words and misread characters.

Furniture goes first. Running headers are runs of capitalised words that stand alone on a
line, are spaced out, or carry chapter and release marks, and the parts of such runs that
the corpus repeats: three words in a row are compared over the corpus with misread
characters alike, and those that repeat are united as far as they overlap. Page numbers are
lines made of a number in one of the usual dresses, and numbers behind leaders in a title.
Then words split at a line end are joined if the joined word is known to the corpus or the
break mark is one that only typesetting uses.

Then every word that a misread character could explain is looked up. ``alike`` writes a word
so that all words which misreadings turn into each other are written the same; words that
are written the same go to the same task, which builds a trie of the known ones and
intersects it with a Levenshtein automaton of the word in question. So every candidate that
misreadings can explain is found, and no task or driver holds the vocabulary. Candidates are
ranked by the number of misreadings (rn for m, 0 for o, ...), by the words they stand behind
and by frequency. A word with a sign or digit in it is no word, so any known candidate
repairs it; a word of letters is repaired if the candidate is ``RATIO`` times as frequent.
Last, lines are reflowed into paragraphs.

Defined results
  null or empty text            no damage, returned as it is
  words inside a header         count as header only
  lists of numbers              not page numbers
  compounds, ranges, prefixes   not split words
  letters with one closing digit   an identifier where the corpus closes them with several digits
  repeated rows                 each repaired; one row per id, field and damage
  very long texts and words     worked on whole
"""

from __future__ import annotations

import re as plain_re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.runtime import checkpointed

#: Occurrences that make a word known, the same for words with a sign in them, and how much more frequent than its misreading a word of letters must be.
KNOWN, KNOWN_SIGN, RATIO = 4, 2, 6
#: Least share of the second closing digit that makes letters an identifier.
ID_SHARE = 0.2
#: Entries in which a header without other marks must stand.
HEADER_ENTRIES = 2

#: Misreadings, read -> meant (fixed values).
MISREAD = (
    ("rn", "m"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("vv", "w"), ("c", "e"), ("f", "t"), ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"),
    ("|", "l"), ("5", "s"), ("$", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("@", "a"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("3", "e"), ("ii", "n"), ("nn", "m"),
)
# A homomorphism under which both sides of each misreading are equal: single characters, then those that stand for several.
_ALIKE = (("e3f0l1!|5$968@uhrﬁﬂ", "cctoiiiissgbbannn\x02\x02"), (("m", "nn"), ("d", "ci"), ("w", "vv"), ("\x02", "ti"), ("n", "ii")))
_SINGLE = str.maketrans(*_ALIKE[0])


def alike(text: str) -> str:
    """A text written so that misread and right characters are the same."""
    text = text.lower().translate(_SINGLE)
    for one, several in _ALIKE[1]:
        text = text.replace(one, several)
    return text


def _alike(word: Column) -> Column:
    out = F.translate(word, *_ALIKE[0])
    for one, several in _ALIKE[1]:
        out = F.replace(out, F.lit(one), F.lit(several))
    return out


# ---- page furniture

_CAP = r"(?!\S*\d\d)(?:\p{Lu}|[018@!$5])[\p{L}0-9@!$|'’-]+"
_LOUD = r"(?!\S*\d\d)[\p{Lu}0-9@!$|'’-]*\p{Lu}[\p{Lu}0-9@!$|'’-]*(?![\p{Ll}])"
_RUN = rf"(?:{_LOUD}(?:[ ]{_LOUD}){{2,}}|{_CAP}(?:[ ]{_CAP}){{2,}})"
_SPACED = r"\S(?:[ ]\S)+(?:[ ]{3}\S(?:[ ]\S)+)+"
_CHAPTER = r"(?:\p{L}[\p{L}0-9@!$|]{2,9}[ ]+\d{1,3}[ ]{2,})"
_EDITION = r"(?:[ ]{2,}[\p{L}0-9@!$|]{3,9}\.?[ ]?\d[\w.]*|[ ]+[—–][ ]+[A-Z]{3,5}\b)"
_HEADER = re.compile(rf"(?P<chapter>(?<!\S){_CHAPTER})?(?<!\S)(?P<core>(?P<spaced>{_SPACED})|{_RUN})(?P<edition>{_EDITION})?(?!\S)")
# Three words in a row that begin with no small Latin letter, or single characters in a row.
_MAY_HEAD = plain_re.compile(r"(?:(?<!\S)[^\sa-z]\S+ ){2}[^\sa-z]|(?<!\S)\S \S \S ")
_PAGE = re.compile(
    r"^\s*(?:[-–—~•*=]+\s*\d{1,4}\s*[-–—~•*=]+|[\[(<]\s*\d{1,4}\s*[\])>]|(?:page|seite|página|стр\.?|p\.|pag\.|s\.)\s*\d{1,4}(?:\s*(?:of|von|de|sur|из|/)\s*\d{1,4})?|\d{1,4}\s*[|/]\s*\d{1,4}|(?P<bare>\d{1,4})|(?P<roman>(?=[ivxlc]{2,7}\s*$)c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})))\s*$",
    re.I,
)
_TITLE_PAGE = re.compile(r"(?:\s*(?:\.{3,}|…+|(?:\s\.){3,}|·{3,})\s*|\s{2,})\d{1,4}\s*$")


def _whole_line(text: str, s: int, e: int) -> bool:
    return not text[text.rfind("\n", 0, s) + 1 : s].strip() and not text[e : (text.find("\n", e) + 1 or len(text) + 1) - 1].strip()


def header_runs(text: str) -> list[tuple[int, int, str, bool]]:
    """Possible headers: start, end, how its words are written alike, and whether chapter, release or spacing mark them.

    A run may have caught capitalised words of the text around it, so each three words in a
    row are proposed; which of them belong to a header, the corpus tells.
    """
    out = []
    if not _MAY_HEAD.search(text):
        return out
    for m in _HEADER.finditer(text):
        start, end = m.span()
        if m.group("spaced"):
            out.append((start, end, "", True))
            core = re.sub(r" {3}", "\x00", m.group("core")).replace(" ", "").split("\x00")
            out += [(start, end, alike(" ".join(core[i : i + 3])), False) for i in range(len(core) - 2)]
            continue
        words = [(m.start("core") + w.start(), m.start("core") + w.end(), w.group()) for w in plain_re.finditer(r"\S+", m.group("core"))]
        if m.group("chapter") and m.group("edition") or _whole_line(text, start, end) and (m.group("chapter") or m.group("edition") or m.group("core").upper() == m.group("core")):
            out.append((start, end, "", True))
        for i in range(len(words) - 2):
            s, e = words[i][0] if i else start, words[i + 2][1] if i + 3 < len(words) else end
            out.append((s, e, alike(" ".join(w for _, _, w in words[i : i + 3])), False))
    return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans with those that overlap made one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def longest_first(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that remain when longer ones win over those they overlap."""
    out: list[tuple[int, int]] = []  # in order of place
    for s, e in sorted(set(spans), key=lambda x: (x[0] - x[1], x[0])):
        i = bisect_left(out, (s, e))
        if (i == 0 or out[i - 1][1] <= s) and (i == len(out) or e <= out[i][0]):
            out.insert(i, (s, e))
    return out


def page_numbers(text: str) -> list[tuple[int, int]]:
    """Spans of the lines that are page numbers."""
    lines, at, out = text.split("\n"), 0, []
    hits = [_PAGE.match(x) for x in lines]
    filled = [i for i, x in enumerate(lines) if x.strip()]
    place = {i: k for k, i in enumerate(filled)}
    for i, (line, m) in enumerate(zip(lines, hits, strict=True)):
        if m:
            k = place[i]
            before = lines[filled[k - 1]].rstrip() if k else ""
            after = filled[k + 1] if k + 1 < len(filled) else None
            listed = before.endswith(":") or k and hits[filled[k - 1]] is not None and hits[filled[k - 1]].group("bare") or after is not None and hits[after] is not None and hits[after].group("bare")
            if not (m.group("bare") and listed):
                out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def clean(text: str, headers: list[tuple[int, int]], is_title: bool) -> tuple[str, bool, bool]:
    """The text without furniture; whether a header, whether a page number stood in it."""
    spans = list(headers)
    pages = [m.span()] if is_title and (m := _TITLE_PAGE.search(text)) else [] if is_title else page_numbers(text)
    spans += pages
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out.append(text[at:s])
            out.append("\x01")
            at = e
    text = "".join(out) + text[at:]
    # A line that held furniture only goes as a whole, with the blank lines set around it.
    text = re.sub(r"(?:[ \t]*\n)*[ \t]*\x01[ \t]*(?=\n|$)", lambda m: "" if "\n" in m.group() or m.start() == 0 or m.end() == len(text) else " ", text)
    text = re.sub(r"^\n+", "", text.replace(" \x01 ", " ").replace("\x01", "")) if spans else text
    text = text.rstrip() if spans else text
    return text, bool(headers), bool(pages)


# ---- words

_BREAK = re.compile(r"(?<![\w/.-])(?P<a>[\p{L}0-9@!$|ﬁﬂ]+(?:-[\p{L}]+)*)(?P<mark>[-¬­‐‑])(?P<gap>[ \t]*\n\s*|[ ]+)(?P<b>\p{Ll}[\p{L}0-9@!$|ﬁﬂ]*)")
_MAY_BREAK = re.compile(r"[-¬\u00ad‐‑][ \t\n]")
_TOKEN = re.compile(r"(?<![\w/.=@$-])[\p{L}0-9@!$|ﬁﬂ]+(?:['’-][\p{L}0-9@!$|ﬁﬂ]+)*(?![\w/=@$]|\.\w)")
_SIGNS = re.compile(r"[0-9@!$|ﬁﬂ]")
_ID = re.compile(r"^[a-z]+\d+$|^\p{Lu}+\d+\p{Lu}*$|^\d+$|\d{2,}|^[\W\d_]+$")


@lru_cache(maxsize=1 << 17)
def _words_of_chunk(chunk: str) -> tuple[str, ...]:
    out = []
    for m in _TOKEN.finditer(chunk):
        token = m.group().rstrip("!|")
        for w in re.split(r"['’-]", token):
            if (len(w) > 2 or len(w) == 2 and (w.isalpha() or re.search("[@!0]", w))) and not (_ID.search(w) and not _misread_end(w)):
                out.append(w.lower())
    return tuple(out)


def words_in(text: str) -> Iterator[str]:
    """Lower-case words; parts of compounds on their own; no identifiers.

    Where a word begins and ends depends on what stands next to it up to the next blank, so
    each stretch between blanks is taken apart once.
    """
    for chunk in text.split():
        bare = chunk[:-1] if chunk[-1] in ".,;:?)" else chunk
        if len(bare) > 2 and bare.isalpha():
            yield bare.lower()
        else:
            yield from _words_of_chunk(chunk)


def without_breaks(text: str) -> str:
    """The text with blanks in place of words that a line end splits."""
    return _BREAK.sub(" \n ", text) if _MAY_BREAK.search(text) else text


def _misread_end(w: str) -> bool:
    """Words such as minute5, tota1: letters and one closing digit that a misreading can explain; the corpus tells identifiers apart."""
    return len(w) >= 5 and bool(re.fullmatch(r"\p{L}{4,}[015]", w))


class Trie:
    """Vocabulary trie; each node is [children, count of the word that ends there]."""

    def __init__(self, words: dict[str, int]):
        self.root: list = [{}, 0]
        for w, n in words.items():
            node = self.root
            for c in w:
                node = node[0].setdefault(c, [{}, 0])
            node[1] = n

    def within(self, word: str, k: int) -> list[tuple[str, int]]:
        """All words within Levenshtein distance k: the automaton's states are rows of the edit table."""
        out: list[tuple[str, int]] = []
        n = len(word)
        stack = [(self.root, "", list(range(n + 1)))]
        while stack:
            (children, _), prefix, row = stack.pop()
            for c, child in children.items():
                nxt = [row[0] + 1]
                for i in range(n):
                    nxt.append(min(nxt[i] + 1, row[i + 1] + 1, row[i] + (word[i] != c)))
                if min(nxt) <= k:
                    if child[1] and nxt[n] <= k:
                        out.append((prefix + c, child[1]))
                    stack.append((child, prefix + c, nxt))
        return out


def channel_cost(read: str, meant: str) -> float | None:
    """Number of misreadings that turn ``meant`` into ``read``; None if there is anything else."""
    best = {(0, 0): 0.0}
    for i in range(len(read) + 1):
        for j in range(len(meant) + 1):
            c = best.get((i, j))
            if c is None:
                continue
            if i < len(read) and j < len(meant) and read[i] == meant[j]:
                best[i + 1, j + 1] = min(c, best.get((i + 1, j + 1), 99))
            for a, b in MISREAD:
                if read.startswith(a, i) and meant.startswith(b, j):
                    k = (i + len(a), j + len(b))
                    best[k] = min(c + 1, best.get(k, 99))
    return best.get((len(read), len(meant)))


def reach(word: str) -> int:
    """Edits within which every word lies that misreadings turn into ``word``: those of the most costly way to read it."""
    most = [0]
    for i in range(1, len(word) + 1):
        most.append(max([most[i - 1], *(most[i - len(a)] + max(len(a), len(b)) for a, b in MISREAD if word.endswith(a, 0, i))]))
    return most[-1]


_HINT = re.compile("|".join(sorted({re.escape(a) for a, _ in MISREAD}, key=len, reverse=True)))


# ---- the steps over DataFrames

_TEXTS = "rid long, entry_id long, fld string, text string"


def _texts(entries: DataFrame) -> DataFrame:
    """rid (row number), entry_id, fld, text of the non-empty bodies and titles."""
    rows = checkpointed(entries.select(F.col("entry_id").cast("long"), "title", "body").withColumn("rid", F.monotonically_increasing_id()))
    both = F.explode(F.array(F.struct(F.lit("body").alias("fld"), F.col("body").alias("text")), F.struct(F.lit("title").alias("fld"), F.col("title").alias("text")))).alias("x")
    return rows.select("rid", "entry_id", both).select("rid", "entry_id", "x.fld", "x.text").filter("text is not null and text != ''")


def _find_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(r, f, *h) for r, f, t in zip(pdf["rid"], pdf["fld"], pdf["text"], strict=True) for h in header_runs(t)]
        if rows:
            yield pd.DataFrame(rows, columns=["rid", "fld", "start", "stop", "core", "marked"])


def _clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r, i, f, t, hs in zip(pdf["rid"], pdf["entry_id"], pdf["fld"], pdf["text"], pdf["headers"], strict=True):
            hs = [] if hs is None else hs
            spans = longest_first([(h["start"], h["stop"]) for h in hs if h["marked"]] + united([(h["start"], h["stop"]) for h in hs if not h["marked"]]))
            rows.append((r, i, f, *clean(t, spans, f == "title")))
        out = pd.DataFrame(rows, columns=["rid", "entry_id", "fld", "text", "header", "page_no"])
        out["entry_id"] = out["entry_id"].astype("Int64")
        yield out


def without_furniture(entries: DataFrame) -> DataFrame:
    """rid, entry_id, fld, text, header, page_no: texts without running headers and page numbers."""
    texts = _texts(entries)
    runs = checkpointed(texts.mapInPandas(_find_headers, "rid long, fld string, start int, stop int, core string, marked boolean"))
    cores = runs.filter("not marked").groupBy("core").agg(F.count_distinct("rid").alias("n")).filter(F.col("n") >= HEADER_ENTRIES).select("core", F.lit(True).alias("common"))
    real = runs.join(cores, "core", "left").filter(F.col("marked") | F.col("common")).groupBy("rid", "fld").agg(F.collect_list(F.struct("start", "stop", "marked")).alias("headers"))
    joined = texts.join(real, ["rid", "fld"], "left").select("rid", "entry_id", "fld", "text", "headers")
    return checkpointed(joined.mapInPandas(_clean, "rid long, entry_id long, fld string, text string, header boolean, page_no boolean"))


def _take_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over the texts: words counted with their neighbours (count), and the words and breaks of each text to be looked up.

    A split word counts joined, apart from the words that are whole; neither of its halves is a word.
    """
    for pdf in batches:
        counts: Counter[tuple[str, str, bool]] = Counter()
        rows = []
        for r, f, text in zip(pdf["rid"], pdf["fld"], pdf["text"], strict=True):
            prev, asked = "", set()
            for w in words_in(without_breaks(text)):
                counts[w, prev, False] += 1
                prev = w
                if _may_be_misread(w):
                    asked.add(w)
            rows += [(r, f, "word", w, "", False, 0) for w in asked]
            for m in _BREAK.finditer(text) if _MAY_BREAK.search(text) else ():
                a, b = m.group("a").rsplit("-", 1)[-1], m.group("b")
                rows.append((r, f, "break", (a + b).lower(), a.lower(), m.group("mark") != "-", 0))
                for w in words_in(a + b):
                    counts[w, "", True] += 1
        rows += [(0, "", "count", w, p, s, n) for (w, p, s), n in counts.items()]
        if rows:
            yield pd.DataFrame(rows, columns=["rid", "fld", "kind", "word", "a", "sure", "n"])


@lru_cache(maxsize=1 << 17)
def _may_be_misread(word: str) -> bool:
    return bool(_HINT.search(word))


def taken_apart(cleaned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words with the words before them, words alone (n, n_whole: not joined at a line end), and what each text asks."""
    d = checkpointed(cleaned.select("rid", "fld", "text").mapInPandas(_take_apart, "rid long, fld string, kind string, word string, a string, sure boolean, n long"))
    pairs = d.filter("kind = 'count'").groupBy("word", F.col("a").alias("prev"), F.col("sure").alias("split")).agg(F.sum("n").alias("n"))
    words = pairs.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("split"), F.col("n")).otherwise(0)).alias("n_whole"))
    return pairs, checkpointed(words), d.filter("kind != 'count'").select("rid", "fld", "kind", "word", "a", "sure").distinct()


_CANDIDATE = "word string, n long, fix string, n_fix long, cost double"


def _look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates of the words that come written alike one after the other; one such group is held at a time."""

    def settle(known: dict[str, int], suspects: dict[str, int]) -> list[tuple]:
        if not known or not suspects or known.keys() == suspects.keys() and len(known) == 1:
            return []
        trie, out = Trie(known), []
        for w, n in suspects.items():
            sign = bool(_SIGNS.search(w))
            for u, m in trie.within(w, reach(w)):
                if u != w and (sign or m >= KNOWN and m >= RATIO * n) and (c := channel_cost(w, u)) is not None:
                    out.append((w, n, u, m, c))
        return out

    key, known, suspects = None, {}, {}
    for pdf in batches:
        rows = []
        for k, w, n, suspect in zip(pdf["key"], pdf["word"], pdf["n"], pdf["suspect"], strict=True):
            if k != key:
                rows += settle(known, suspects)
                key, known, suspects = k, {}, {}
            (suspects if suspect else known)[w] = n
        if rows:
            yield pd.DataFrame(rows, columns=["word", "n", "fix", "n_fix", "cost"])
    if rows := settle(known, suspects):
        yield pd.DataFrame(rows, columns=["word", "n", "fix", "n_fix", "cost"])


def identifiers(words: DataFrame) -> DataFrame:
    """stem: letters that the corpus closes with several of the digits that could be misread."""
    d = words.select(F.regexp_extract("word", r"^(\p{L}{4,})[015]$", 1).alias("stem"), "n").filter("stem != ''")
    d = d.groupBy("stem").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return d.filter(F.col("all") - F.col("most") >= ID_SHARE * F.col("most")).select("stem")


def word_repairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """word, fix: the words that misreadings alone explain, with the best known word for each."""
    known = words.filter((F.col("n_whole") >= KNOWN_SIGN) & ~F.col("word").rlike(_SIGNS.pattern))
    # Of two letters only those with a sign in them: to and fo, it and if are too near each other.
    suspects = words.filter(F.col("word").rlike(_HINT.pattern) & ((F.length("word") > 2) | F.col("word").rlike("[@!0]")))
    suspects = suspects.withColumn("stem", F.regexp_extract("word", r"^(\p{L}{4,})[015]$", 1)).join(identifiers(words), "stem", "left_anti")
    both = known.select("word", F.col("n_whole").alias("n"), F.lit(False).alias("suspect")).unionByName(suspects.select("word", "n", F.lit(True).alias("suspect")))
    grouped = both.select(_alike(F.col("word")).alias("key"), "word", "n", "suspect").repartition("key").sortWithinPartitions("key")
    found = checkpointed(grouped.mapInPandas(_look_up, _CANDIDATE))
    # Context: behind how many of the same words the candidate stands.
    left = pairs.filter("prev != ''").select("word", "prev", "n")
    behind = found.select("word", "fix").join(left.select("word", "prev"), "word").join(left.select(F.col("word").alias("fix"), "prev", F.col("n").alias("seen")), ["fix", "prev"])
    behind = behind.groupBy("word", "fix").agg(F.sum(F.log1p("seen")).alias("context"))
    ranked = found.join(behind, ["word", "fix"], "left").fillna(0.0, ["context"])
    order = [F.col("cost") - F.least(F.col("context"), F.lit(20.0)) / 10, F.col("n_fix").desc(), F.col("fix")]
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(*order))).filter("rank = 1").select("word", "fix")


def _verdicts(cleaned: DataFrame) -> DataFrame:
    """rid, fld, kind (word or break), word, fix, sure, known for what the corpus confirms."""
    pairs, counts, marks = taken_apart(cleaned)
    repairs = checkpointed(word_repairs(pairs, counts))
    broken = marks.filter("kind = 'break'")
    asked = broken.select("word").distinct().join(counts, "word").filter(f"n_whole >= 1 or n >= {KNOWN}").select("word", F.lit(True).alias("known"))
    marks = marks.join(repairs, "word", "left")
    words = marks.filter("kind = 'word' and fix is not null").withColumn("known", F.lit(True))
    broken = marks.filter("kind = 'break'").join(asked, "word", "left").filter("sure or known or fix is not null")
    return words.unionByName(broken.select(*words.columns))


def find_damage(entries: DataFrame) -> DataFrame:
    """entry_id, fld, damage (hyphen, glyph, header, page_no).

    ``entries``: entry_id, title, body; other columns are ignored.
    """
    cleaned = without_furniture(entries)
    told = _verdicts(cleaned)
    ids = cleaned.select("rid", "fld", "entry_id")
    damage = F.explode(F.array_compact(F.array(F.when(F.col("kind") == "break", "hyphen"), F.when(F.col("fix").isNotNull(), "glyph")))).alias("damage")
    of_words = told.select("rid", "fld", damage).distinct().join(ids, ["rid", "fld"]).select("entry_id", "fld", "damage")
    flags = F.explode(F.array_compact(F.array(F.when(F.col("header"), "header"), F.when(F.col("page_no"), "page_no")))).alias("damage")
    return of_words.unionByName(cleaned.select("entry_id", "fld", flags)).distinct()


_HEADING = re.compile(r"^(?:[\p{Lu}][\p{L}]+(?: \p{L}+)?:|[-*•]\s)")
_NUMBERED = re.compile(r"^\d{1,2}[.)]\s")


def reflow(text: str) -> str:
    """Lines into paragraphs: blank lines, labels and list items open a new one."""
    out: list[str] = []
    for block in re.split(r"\n\s*\n", text):
        lines: list[str] = []
        for line in block.split("\n"):
            line = line.strip()
            if not line:
                continue
            opens = _HEADING.match(line) or _NUMBERED.match(line) and lines and lines[-1][-1] in ".:;!?"
            if lines and not opens and not lines[-1].endswith(":"):
                lines[-1] += " " + line
            else:
                lines.append(line)
        # a paragraph that a page break cut in two
        if out and lines and re.search(r"[\p{Ll},]$", out[-1]) and re.match(r"\p{Ll}", lines[0]):
            out[-1] += " " + lines.pop(0)
        out += ["\n".join(lines)] if lines else []
    return "\n\n".join(out)


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        done = []
        for text, told in zip(pdf["text"], pdf["told"], strict=True):
            rows = told if told is not None else []
            fixes = {x["word"]: x["fix"] for x in rows if x["fix"] is not None}
            joins = {x["word"] for x in rows if x["kind"] == "break"}

            def close(m: re.Match, joins=joins) -> str:
                w = m.group("a").rsplit("-", 1)[-1] + m.group("b")
                return m.group("a") + m.group("b") + ("\n" if "\n" in m.group("gap") else "") if w.lower() in joins else m.group()

            def mend(m: re.Match, fixes=fixes) -> str:
                parts = re.split(r"(['’-])", m.group())
                for i, p in enumerate(parts):
                    tail = p[len(p.rstrip("!|")) :]
                    fix = fixes.get(p.rstrip("!|").lower())
                    if fix:
                        first = p[0].isupper() or not p[0].isalpha() and m.start() == 0
                        parts[i] = (fix.upper() if len(p) > 2 and p.isupper() else fix.capitalize() if first else fix) + tail
                return "".join(parts)

            # the rest of a joined word stays on its first line
            joined = re.sub(r"\n[ \t]*", "\n", _BREAK.sub(close, text)) if joins else text
            done.append(reflow(_TOKEN.sub(mend, joined) if fixes else joined))
        yield pd.DataFrame({"rid": pdf["rid"], "fld": pdf["fld"], "text": done})


def repair_scans(entries: DataFrame) -> DataFrame:
    """entry_id, title, body of every entry, repaired and reflowed."""
    cleaned = without_furniture(entries)
    told = _verdicts(cleaned).groupBy("rid", "fld").agg(F.collect_list(F.struct("kind", "word", "fix")).alias("told"))
    joined = cleaned.join(told, ["rid", "fld"], "left")
    fixed = joined.select("rid", "fld", "text", "told").mapInPandas(_repair, "rid long, fld string, text string")
    wide = cleaned.select("rid", "entry_id").distinct().join(fixed.groupBy("rid").agg(F.max(F.when(F.col("fld") == "title", F.col("text"))).alias("title"), F.max(F.when(F.col("fld") == "body", F.col("text"))).alias("body")), "rid")
    blank = entries.filter("(title is null or title = '') and (body is null or body = '')").select(F.col("entry_id").cast("long"), "title", "body")
    return wide.select("entry_id", "title", "body").unionByName(blank)
