"""Texts that stop before their end.

Each text's end gets a score in bits, the sum of three kinds of evidence; above zero it is cut.

* The vocabulary of the whole corpus as a trie, kept as a table with one row per trie node
  (prefix, how often it is a word, whether words go on from it, how often it ends a
  sentence, list item or paragraph). A final token that is no known word but a proper
  prefix of known words was cut inside a word. Of a known word the counts tell how much
  likelier it is met by a cut anywhere in the corpus than at a complete end:
  log2 (share of all letters that stand behind it / share of all ends that it makes).
* The length of the text against its source: the greatest length of a source, if many of
  its texts have exactly that length, is the source's field limit.
* The form of the end, as prior: prose without an end mark speaks for a cut, list items,
  headings and labels against it; closed sentences, tables and code settle it.

Defined results
  null, empty or blank text    no case
  null source                  one more source
  very long texts and words    only the end of a text decides, the whole text feeds the
                               vocabulary; prefixes of over ``NODE_LETTERS`` letters are
                               compared with the words themselves
  repeated rows                each row decided alone (copies count in the vocabulary)
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.runtime import checkpointed

#: Letters of the longest prefix that is kept as a node.
NODE_LETTERS = 64
#: Occurrences that make a word known.
KNOWN = 2
#: Texts of the same, greatest length that make it a limit, and their excess over other lengths.
LIMIT_TEXTS, LIMIT_EXCESS = 4, 8
#: Bits: a half word, a token unknown even as a prefix, the bounds of a known word, a text as long as the limit.
HALF, UNKNOWN, WORD_LEAST, WORD_MOST, AT_LIMIT = 5.0, 1.0, -5.0, 4.0, 5.0
#: Letters behind which nothing is known of a word: so many are added to its own, with as many ends as the corpus has for them.
UNSEEN = 20.0
#: Bits of forms: settled either way; open prose; a mark set apart; list items, headings and labels; signatures.
SETTLED, OPEN, APART, LISTED, SIGNED = 20.0, 4.0, -1.0, -3.0, -4.5
#: Different words that a task counts before it hands them on.
FLUSH_WORDS = 400_000

_STRIP = "\"'`.,;:!?()[]{}<>|*#«»„“”‘’…¿¡-–—"
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_STOP = re.compile(r"[.!?…][\"'»”)]*$")
# A line before a blank one or a list item ends something.
_NEXT = re.compile(r"[ \t\r]*(?:(?:[-*•+]|\d+[.)])[ \t]|$)")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    raw: Counter[str] = Counter()
    line_ends: Counter[str] = Counter()

    def hand_on() -> pd.DataFrame:
        words: dict[str, list[int]] = {"": [1, 0]}  # a frame is never empty
        for chunk, n in raw.items():
            w = chunk.strip(_STRIP)
            if w and _WORD.fullmatch(w):
                counts = words.setdefault(w.lower(), [0, 0])
                counts[0] += n
                counts[1] += n if _STOP.search(chunk) else line_ends.get(chunk, 0)
        return pd.DataFrame({"word": list(words), "n": [c[0] for c in words.values()], "n_stop": [c[1] for c in words.values()]})

    for pdf in batches:
        for text in pdf["text"]:
            text = text.rstrip()
            raw.update(text.split()[:-1])  # the final token is what is judged
            lines = text.split("\n")
            line_ends.update(a.split()[-1] for a, b in zip(lines, lines[1:]) if _NEXT.match(b) and not a.isspace() and a)
            if len(raw) > FLUSH_WORDS:
                yield hand_on()
                raw.clear()
                line_ends.clear()
    if raw:
        yield hand_on()


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, n, n_stop (how often it ends something): words of the whole corpus, final tokens left out, known words only."""
    texts = documents.select("text").filter("text is not null and text != ''")
    counts = texts.mapInPandas(_count, "word string, n long, n_stop long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_stop").alias("n_stop"))
    return counts.filter((F.col("n") >= KNOWN) & (F.col("word") != ""))


def vocabulary_trie(words: DataFrame) -> DataFrame:
    """One row per node of up to ``NODE_LETTERS`` letters: prefix, n_word and n_stop (of the word itself), n_below (occurrences of longer words)."""
    cuts = F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(NODE_LETTERS)))).alias("k")
    at_end = F.col("k") == F.length("word")
    nodes = words.select("word", "n", "n_stop", cuts).select(F.expr("left(word, k)").alias("prefix"), *[F.when(at_end, F.col(c)).otherwise(0).alias(c) for c in ("n", "n_stop")], F.when(~at_end, F.col("n")).otherwise(0).alias("b"))
    return nodes.groupBy("prefix").agg(F.sum("n").alias("n_word"), F.sum("n_stop").alias("n_stop"), F.sum("b").alias("n_below"))


def look_up(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """word, n_word, n_stop, n_below of the tokens (word) that are a node of the trie; longer ones are compared word by word."""
    short = tokens.filter(F.length("word") <= NODE_LETTERS).join(vocabulary_trie(words), F.col("word") == F.col("prefix")).drop("prefix")
    head = F.left("word", F.lit(NODE_LETTERS)).alias("head")
    long = tokens.filter(F.length("word") > NODE_LETTERS).select("word", head)
    near = words.filter(F.length("word") > NODE_LETTERS).select(F.col("word").alias("known"), "n", "n_stop", head)
    own = F.col("known") == F.col("word")
    long = long.join(near, "head").filter(F.startswith("known", "word")).groupBy("word").agg(*[F.sum(F.when(own, F.col(c)).otherwise(0)).alias(a) for c, a in (("n", "n_word"), ("n_stop", "n_stop"))], F.sum(F.when(~own, F.col("n")).otherwise(0)).alias("n_below"))
    return short.unionByName(long)


def field_limits(documents: DataFrame) -> DataFrame:
    """source, limit_chars: sources whose greatest text length is shared by many texts."""
    sizes = documents.select("source", F.length("text").alias("n")).filter("n > 0").groupBy("source", "n").agg(F.count("*").alias("texts"))
    per = Window.partitionBy("source")
    top = sizes.select("source", "n", "texts", F.max("n").over(per).alias("longest"), F.sum("texts").over(per).alias("all"), F.count("*").over(per).alias("lengths"))
    others = (F.col("all") - F.col("texts")) / F.greatest(F.col("lengths") - 1, F.lit(1))
    return top.filter((F.col("n") == F.col("longest")) & (F.col("texts") >= LIMIT_TEXTS) & (F.col("texts") >= LIMIT_EXCESS * others)).select("source", F.col("n").alias("limit_chars"))


def ends(documents: DataFrame) -> DataFrame:
    """doc_id, source, n, word, form_bits of every text that is not blank; ``word`` is the final token if it is a word without an end mark."""
    # white space behind the text does not count
    blanks = F.lit(" \t\n\r\f\u000b\u0085\u00a0\u2028\u2029")
    d = documents.select("doc_id", "source", F.length("text").alias("n"), F.rtrim(F.col("text"), blanks).alias("body")).filter("body is not null and body != ''")
    fences = (F.length("body") - F.length(F.replace("body", F.lit("```"), F.lit("")))) / 3
    mark = r"(?i)(?:\.\.\.|…|\[(?:\.\.\.|…)\]|[\[(<](?:truncated|cut off|cut)[\])>])$"
    d = d.select("doc_id", "source", "n", "body", F.substring_index("body", "\n", -1).alias("line"), (fences % 2 == 1).alias("open_code"), F.regexp_extract(F.right("body", F.lit(20)), mark, 0).alias("mark"))
    bare = F.when(F.col("mark") != "", F.left("body", F.length("body") - F.length("mark"))).otherwise(F.col("body"))
    d = d.withColumn("bare", bare).withColumn("mark_apart", F.right("bare", F.lit(1)).rlike(r"\s"))
    last = F.substring_index(F.rtrim(F.col("bare"), blanks), "\n", -1)
    d = d.withColumn("token", F.substring_index(F.translate(last, "\t\r", "  "), " ", -1))
    word = F.regexp_extract("token", r"(?U)^[\"'`(\[«„“‘¿¡*#|-]*([^\W\d_]+(?:[-'’][^\W\d_]+)*)$", 1)
    return d.select("doc_id", "source", "n", F.lower(word).alias("word"), _form_bits().alias("form_bits"), _half_name().alias("half_name"))


def _half_name() -> Column:
    """An end mark that belongs to a file name: at the limit it closes nothing."""
    return F.coalesce(F.col("token").rlike(r"(?:\w_\w+|/[\w-]+)\.$"), F.lit(False))


def _form_bits() -> Column:
    """What the form of the end says for itself."""
    line, token = F.col("line"), F.col("token")
    # a date, time or path that is not complete
    half_form = token.rlike(r"^\d{4}-(?:\d{1,2}(?:-\d?)?)?$") | token.rlike(r"^\d{1,2}:\d?$") | token.rlike(r"^/(?:[\w-]+/)*[\w-]*$") & line.rlike(r"(?i)^(?:[-*•] |\d+[.)] |see also:)")
    listed = line.rlike(r"^\s*(?:[-*•+]|\d+[.)])\s") | line.rlike(r"^#{1,6} ") | line.rlike(r"(?U)^\p{Lu}\p{L}+(?: \p{L}+)?: \S+(?: \S+){0,5}$") & ~line.rlike(r"(?U)\w[.!?;] +\p{L}")
    end = F.right("body", F.lit(1))
    return (
        F.when(end == "\ufffd", SETTLED)
        .when((F.col("mark") != "") & ~F.col("mark").isin("...", "…"), SETTLED)
        .when(F.col("mark") != "", F.when(F.col("mark_apart"), APART).otherwise(OPEN))
        .when(F.col("open_code"), SETTLED)
        .when(line.rlike(r"^```"), -SETTLED)
        .when(line.rlike(r"^\s*\|"), F.when(end == "|", -SETTLED).otherwise(SETTLED))
        .when(line.rlike(r"^[-=_*~]{3,}$"), -SETTLED)  # a rule, or filling up to the limit
        .when(end.rlike(r"[.!?»”\")'’]"), -SETTLED)
        .when(line.rlike(r"^-- "), SIGNED)
        .when(listed, F.when(half_form, OPEN).otherwise(LISTED))
        .otherwise(OPEN)
    )


def judge(documents: DataFrame) -> DataFrame:
    """doc_id, source, cut, at_limit, form_bits, word_bits, limit_bits for every text that is not blank.

    ``documents``: doc_id, text, source; other columns are ignored.
    """
    found = checkpointed(ends(documents))  # small rows; the texts are read once for them and once for the words
    limits = field_limits(documents)
    # Ends that their form settles need not ask the vocabulary.
    open_end = (F.abs("form_bits") < SETTLED) & (F.col("word") != "")
    asking = found.filter(open_end)
    words = checkpointed(vocabulary(documents))
    nodes = look_up(asking.select("word").distinct(), words)
    # one row: all letters behind which a cut may fall, and all ends
    sums = words.agg(F.coalesce(F.sum(F.col("n") * F.length("word")), F.lit(1)).alias("letters"), (F.coalesce(F.sum("n_stop"), F.lit(0)) + 1).alias("stops")).first()
    ends_of = F.lit(sums["stops"] / sums["letters"])
    likelier = F.log2((F.col("n_below") + F.col("n_word") + UNSEEN) * ends_of / (F.col("n_stop") + UNSEEN * ends_of))
    bits = F.when(F.col("n_word") > 0, F.least(F.greatest(likelier, F.lit(WORD_LEAST)), F.lit(WORD_MOST))).otherwise(F.lit(HALF))
    told = asking.join(nodes.select("word", bits.alias("bits")), "word", "left").select(*found.columns, F.coalesce("bits", F.lit(UNKNOWN)).alias("word_bits"))
    all_ends = told.unionByName(found.filter(~open_end).withColumn("word_bits", F.lit(0.0)))
    all_ends = all_ends.join(limits.select(F.col("source").alias("lim_source"), "limit_chars"), F.col("source").eqNullSafe(F.col("lim_source")), "left")
    at_limit = F.coalesce(F.col("n") == F.col("limit_chars"), F.lit(False))
    d = all_ends.select("doc_id", "source", at_limit.alias("at_limit"), F.when(at_limit & F.col("half_name"), OPEN).otherwise(F.col("form_bits")).alias("form_bits"), "word_bits", F.when(at_limit, AT_LIMIT).otherwise(0.0).alias("limit_bits"))
    return d.select("doc_id", "source", (F.col("form_bits") + F.col("word_bits") + F.col("limit_bits") > 0).alias("cut"), "at_limit", "form_bits", "word_bits", "limit_bits")


def find_cut(documents: DataFrame) -> DataFrame:
    """doc_id of every text that breaks off."""
    return judge(documents).filter("cut").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def cut_share(documents: DataFrame) -> DataFrame:
    """source, n_docs, n_cut, cut_share, n_at_limit, n_by_words per source; blank texts count as documents.

    ``n_by_words``: cut texts for which vocabulary and length speak, whatever their form.
    """
    by_words = F.col("cut") & (F.col("word_bits") + F.col("limit_bits") > 0)
    names = ("n_cut", "n_at_limit", "n_by_words")
    verdicts = judge(documents).groupBy("source").agg(F.count_if("cut").alias("n_cut"), F.count_if("at_limit").alias("n_at_limit"), F.count_if(by_words).alias("n_by_words"))
    total = documents.groupBy("source").agg(F.count("*").alias("n_docs")).withColumnRenamed("source", "src")
    joined = total.join(verdicts, F.col("src").eqNullSafe(F.col("source")), "left").select(F.col("src").alias("source"), "n_docs", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return joined.select("source", "n_docs", "n_cut", (F.col("n_cut") / F.col("n_docs")).alias("cut_share"), "n_at_limit", "n_by_words")
