"""Evaluation texts that leak into training text.

A generalised suffix automaton of the normalised test items is sent to the tasks. Each
document is streamed through it word by word; wherever the match is ``ANCHOR`` words or
longer, every item position that the match can stand for fixes an alignment of document
and item, and the words along each alignment are compared exactly: a leak is a stretch of
at least ``min_words`` words that starts and ends with equal words and of which at most
one in ten differs. Twenty words of which two differ hold an equal run of six, so no leak
is lost to the anchor length.

The test items are a stated, small set, held apart from the corpus and not growing with
it; they become automata of ``BLOCK_WORDS`` words each, so the driver holds one block at a
time, and all of them are asked in one pass over the documents.

Normalised: lower case, without punctuation and quote marks, split at white space.

Defined results
  null or empty text on either side   no leak; ``remove_leaks`` returns the text as it is
  items shorter than ``min_words``    a leak only if found whole (at least ``ANCHOR`` words)
  the same passage in two items       both are reported
  repeated rows                       one row per pair
  several stretches of an item        the longest is found, all are removed, until a scan
                                      of what is left finds nothing
  pieces of 12 to 19 words            removed where they cover ``coverage`` of an item
  texts that are leaks for the most   emptied beyond ``max_share``, the row stays
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
ANCHOR = 6
#: Words of a piece that counts towards the coverage of an item: with one word replaced it still holds ``ANCHOR`` equal ones.
PIECE = 12
#: Limits for removal: share of an item that its pieces must make up, and share of a text beyond which the text goes.
COVERAGE, MAX_SHARE = 0.5, 0.8
BLOCK_WORDS = 400_000

_MARKS = re.compile(r"[^\w\s]+|_+")


def words_of(text: str) -> list[str]:
    """The normalised words of a text."""
    return _MARKS.sub("", text.lower()).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with where each state's words end."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.ids: dict[str, int] = {}
        self.items = [(k, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for k, ws in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for no, (_, seq) in enumerate(self.items):
            last = 0
            for pos, c in enumerate(seq):
                last = self._extend(last, c, ends)
                ends[last].append((no, pos))
        # An occurrence of a state is one of each state on its chain of suffix links.
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        self.anchor: list[int] = [0] * len(self.len)
        for v in order:
            if self.len[self.link[v]] >= ANCHOR:
                ends[self.link[v]].extend(ends[v])
        for v in reversed(order):
            up = self.link[v]
            self.anchor[v] = self.anchor[up] if self.len[up] >= ANCHOR else v if self.len[v] >= ANCHOR else 0
        self.ends = {v: sorted(set(ends[v])) for v in set(self.anchor) if v}

    def _add(self, length: int, link: int, nxt: dict[int, int], ends: list) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        ends.append([])
        return len(self.len) - 1

    def _extend(self, last: int, c: int, ends: list) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q, ends)
        cur = self._add(self.len[last] + 1, 0, {}, ends)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q, ends)
        return cur

    def _clone(self, p: int, c: int, q: int, ends: list) -> int:
        new = self._add(self.len[p] + 1, self.link[q], dict(self.next[q]), ends)
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def alignments(self, seq: list[int]) -> set[tuple[int, int]]:
        """(item number, item position minus document position) of every match of ``ANCHOR`` words."""
        nxt, link, length, anchor, ends = self.next, self.link, self.len, self.anchor, self.ends
        found: set[tuple[int, int]] = set()
        v = n = 0
        for k, c in enumerate(seq):
            if c < 0:
                v = n = 0
                continue
            step = nxt[v].get(c)
            while step is None and v:
                v = link[v]
                n = length[v]
                step = nxt[v].get(c)
            if step is None:
                continue
            v = step
            n += 1
            if n >= ANCHOR:
                found.update([(no, pos - k) for no, pos in ends[anchor[v]]])
        return found


def stretches(doc: list[int], item: list[int], shift: int, least: int) -> list[tuple[int, int]]:
    """Every longest stretch of the alignment that is a leak and lies in no longer one: (start, end) in the document."""
    at = [k for k in range(max(0, -shift), min(len(doc), len(item) - shift)) if doc[k] == item[k + shift]]
    # From word a to word b of ``at`` at most one in ten differs if and only if score[b] >= score[a] - 1.
    score = [10 * i - 9 * k for i, k in enumerate(at)]
    ahead = score[:]  # the greatest score from here on; falls
    for i in range(len(at) - 2, -1, -1):
        ahead[i] = max(ahead[i], ahead[i + 1])
    out, last = [], -1
    for a, k in enumerate(at):
        b = bisect_left(ahead, True, key=lambda x, need=score[a] - 1: x < need) - 1
        if b > last and at[b] - k + 1 >= least:
            out.append((k, at[b] + 1))
            last = b
    return out


def pieces_of(words: list[str], sam: SuffixAutomaton, least: int) -> dict[int, list[tuple[int, int, int]]]:
    """Stretches (start, end, shift) of at least ``least`` words, or the whole of a shorter item, by item number."""
    get = sam.ids.get
    doc = [get(w, -1) for w in words]
    found: dict[int, list[tuple[int, int, int]]] = {}
    for no, shift in sam.alignments(doc):
        item = sam.items[no][1]
        if spans := stretches(doc, item, shift, min(least, len(item))):
            found.setdefault(no, []).extend((s, e, shift) for s, e in spans)
    return found


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans with those that overlap made one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def all_leaks_of(text: str | None, sam: SuffixAutomaton, min_words: int = MIN_WORDS, coverage: float | None = None) -> list[tuple[int, int, int]]:
    """(item id, first word, end) of every leaked stretch of each item; stretches that overlap are one.

    With ``coverage``, shorter pieces (``PIECE`` words or more) are leaks too if the pieces of
    the item in this text make up at least that share of the item.
    """
    if not text:
        return []
    out = []
    for no, pieces in pieces_of(words_of(text), sam, min_words if coverage is None else min(PIECE, min_words)).items():
        key, item = sam.items[no]
        if coverage is None or sum(e - s for s, e in _union([(s + h, e + h) for s, e, h in pieces])) < coverage * len(item):
            pieces = [p for p in pieces if p[1] - p[0] >= min(min_words, len(item))]
        out += [(key, s, e) for s, e in _union([(s, e) for s, e, _ in pieces])]
    return sorted(out)


def leaks_of(text: str | None, sam: SuffixAutomaton, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(item id, first word, end) of each leaked item, the longest stretch of each."""
    return _longest(words_of(text), sam, min_words) if text else []


def _longest(words: list[str], sam: SuffixAutomaton, min_words: int) -> list[tuple[int, int, int]]:
    best = {no: min(p, key=lambda x: (x[0] - x[1], x[0])) for no, p in pieces_of(words, sam, min_words).items()}
    return sorted((sam.items[no][0], s, e) for no, (s, e, _) in best.items())


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans of normalised words."""
    at = [m.span() for m in re.finditer(r"\S+", text) if _MARKS.sub("", m.group().lower())]
    out, pos = [], 0
    for s, e in sorted(spans):
        a, b = at[s][0], at[e - 1][1]
        if a >= pos:
            out.append(text[pos:a])
        pos = max(pos, b)
    return "".join(out) + text[pos:]


def without_leaks(text: str | None, blocks: Iterable[SuffixAutomaton], min_words: int, coverage: float | None, max_share: float | None) -> tuple[str | None, int, float]:
    """The text without its leaked stretches, their number item by item, and the share of its words that went.

    Cutting goes on until nothing is found, so words that meet only by a cut leak nothing either.
    A text that loses more than ``max_share`` of its words is emptied.
    """
    if not text:
        return text, 0, 0.0
    blocks, n, words = list(blocks), 0, len(words_of(text))
    left = text
    while spans := [(s, e) for sam in blocks for _, s, e in all_leaks_of(left, sam, min_words, coverage)]:
        n += len(spans)
        left = cut_spans(left, spans)
    share = 1 - len(words_of(left)) / words if n else 0.0
    return ("" if max_share is not None and share > max_share else left), n, share


def _blocks(items: DataFrame) -> list[Broadcast]:
    """Automata of the test items, block by block; the driver holds at most ``BLOCK_WORDS`` words (or one item) at once."""
    share, out = items.sparkSession.sparkContext.broadcast, []
    block, n = [], 0
    for r in items.select("item_id", "text").filter("text is not null").orderBy("item_id").toLocalIterator():
        ws = words_of(r["text"])
        if block and n + len(ws) > BLOCK_WORDS:
            out.append(share(SuffixAutomaton(block)))
            block, n = [], 0
        block.append((r["item_id"], ws))
        n += len(ws)
    return [*out, share(SuffixAutomaton(block))] if block else out


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, first_word, n_words: the longest leaked stretch of each pair.

    ``documents``: doc_id, text; ``items``: item_id, text; other columns are ignored.
    """
    texts = documents.select(F.col("doc_id").cast("long"), "text").filter("text is not null and text != ''")
    blocks = _blocks(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                words = words_of(t)  # once for all blocks
                rows += [(d, i, s, e - s) for b in blocks for i, s, e in _longest(words, b.value, min_words)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "n_words"])

    out = texts.mapInPandas(run, "doc_id long, item_id long, first_word int, n_words int")
    best = F.max(F.struct("n_words", (-F.col("first_word")).alias("first"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.first")).cast("int").alias("first_word"), "b.n_words")


def remove_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, coverage: float | None = None, max_share: float | None = None) -> DataFrame:
    """doc_id, text, n_removed, share_removed: every document, without its leaked stretches; n_removed counts them item by item.

    ``coverage`` and ``max_share``: see ``all_leaks_of`` and ``without_leaks``; None sets no limit.
    """
    blocks = _blocks(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [without_leaks(t, (b.value for b in blocks), min_words, coverage, max_share) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [x[0] for x in done], "n_removed": [x[1] for x in done], "share_removed": [x[2] for x in done]})

    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, text string, n_removed int, share_removed double")
