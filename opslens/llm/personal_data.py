"""Personal data in free text: typed placeholders for what reveals a person.

E-mail addresses, identity numbers, postal addresses and phone numbers in their usual dress
have forms of their own and are found by them. Names and bare runs of digits have none, so
they are judged by what the corpus says: every run of capitalised words and every number is
a term with its context. Terms that are sure to reveal a person (names with a title or an
initial, dressed phone numbers) are the protected entities. Over the whole corpus it is
counted how often each context and each word goes together with them, and the pointwise
mutual information

    log2 P(protected | context or word) / P(protected),

estimates how strongly it discloses a person. It is smoothed: ``DISCOUNT`` is taken off the
co-occurrences, so one alone says next to nothing, and ``SUPPORT`` occurrences that say
nothing are added. What the context before a term, the one behind it and its most telling
word disclose adds up; a word that is never met with protected entities says nothing. A term of at least ``DISCLOSURE`` bits becomes its
placeholder ([NAME], [PHONE]); one of at least ``PARTIAL`` bits discloses a person only in
part and is generalised to its class ([TERM], [NUMBER]); product names, stages, counts and
the like never go together with protected entities and stay.

Defined results
  null or empty text, empty list   nothing found, returned as it is
  null id                          reported as null
  placeholders such as [EMAIL]     no case
  repeated cards                   one row per id, field and type; every copy is sanitised
  very long texts                  searched whole; the context of a term is what stands
                                   within ``NEAR_CHARS`` characters of it, two words a side
"""

from __future__ import annotations

import re as plain_re
from collections.abc import Iterator

import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.runtime import checkpointed

#: Bits of disclosure from which a term is removed, and from which it is generalised.
DISCLOSURE, PARTIAL = 0.25, -1.0
#: Occurrences without any evidence that are added to those seen, and what is taken off those beside protected entities.
SUPPORT, DISCOUNT = 4.0, 0.75
#: Characters around a term in which its context is looked for.
NEAR_CHARS = 60

FIELDS = ("root_cause", "fix_summary", "verify_commands")

_AT = r"(?:@|\s?[\[({<]\s?at\s?[\])}>]\s?)"
_DOT = r"(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?)"
EMAIL = re.compile(rf"(?<![\w.+%-])(?:mailto:)?(?P<local>[\p{{L}}0-9][\p{{L}}0-9._%+'-]*){_AT}[\p{{L}}0-9-]+(?:{_DOT}[\p{{L}}0-9-]+)*{_DOT}[\p{{L}}]{{2,}}(?![\w@])", re.I)
_EXT = r"(?:\s?(?:ext\.?|x|Durchwahl)\s?\d{1,5})?"
PHONE = re.compile(
    rf"""(?<![\w.+/-])(?:
      (?<=\b(?:call|tel|phone|fax|mobile|dial|on-call\ at|caller\ id)[:.]?\s)\d{{10,12}}
    | \+\d{{1,3}}[ .-]?(?:\(0\)[ .-]?)?\(?\d{{1,4}}\)?(?:[ ./-]?\d{{2,7}}){{1,5}}{_EXT}       # +44 20 7946 0174
    | \(\d{{2,5}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}{_EXT}                                  # (868) 555-0156
    | \d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}{_EXT}                                              # 468 555 0101
    | \(0\)\d{{2,5}}[ ./-]?\d{{3,8}}(?:[ .-]\d{{1,6}})?{_EXT}                                # (0)30 23125-166
    | 0\d(?:[ .-]\d\d){{4}}                                                            # 01 99 00 16 36
    | 0\d{{2,4}}[ ./-]\d{{3,8}}(?:[ .-]\d{{2,6}})?{_EXT}                                 # 020 7946 0184
    )(?![\w]|[.-]\d)""",
    re.X | re.I,
)
_ID_WORD = r"passport|(?:driver'?s?|driving)\s+licen[cs]e|licen[cs]e\s+no|national\s+(?:id|identity)(?:\s+card)?|identity\s+card|social\s+security|SSN|tax\s+(?:id|number)|NINO|national\s+insurance|Personalausweis|Ausweis|Reisepass|Steuer-?ID|DNI|NIE|NIF|CURP|INSEE"
ID_NUMBER = re.compile(
    rf"(?<![\w.-])(?<!\w/)(?:(?:(?i:{_ID_WORD}))(?:\s*(?:no\.?|number|nr\.?|\#|:))*\s+(?=[A-Z0-9 -]*\d{{3}})[A-Z0-9]+(?:[ -][A-Z]?\d+)*|\d{{3}}-\d{{2}}-\d{{4}}|(?<!\d )(?:\d{{3}} \d{{2}} \d{{4}})(?! \d))(?![\w]|-\d)"
)
_TOWN = r"(?:\d{4,5}\s)?\p{Lu}\p{Ll}+(?:[\ -]\p{Lu}\p{Ll}+)*(?:\s\d{4,5})?"
_ROOM = r"(?:Unit|Apt|Suite|Flat|Room|No)\b\.?\s?\w+"
_STREET = r"St|Street|Rd|Road|Ave|Avenue|Blvd|Boulevard|Lane|Ln|Drive|Dr|Way|Court|Ct|Place|Pl|Square|Sq|Terrace|Close|Crescent|Parkway|Highway|Hwy"
ADDRESS = re.compile(
    rf"""(?<![\w.-])(?<!\w/)(?:
      \d{{1,5}}[A-Za-z]?\s(?:\p{{Lu}}[\p{{Ll}}'’]+\s){{1,4}}(?:{_STREET})\b\.?
    | \d{{1,4}},?\s(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\s(?:(?:de|des|du|la|le|les|l')\s?)*\p{{Lu}}[\p{{L}}'’-]+(?:\s\p{{Lu}}[\p{{L}}'’-]+)*
    | (?:calle|avenida|avda\.?|plaza|paseo|via|rua)\s(?:(?:de|del|la|las|los|el)\s)*\p{{Lu}}[\p{{L}}'’-]+(?:\s\p{{Lu}}[\p{{L}}'’-]+)*,?\s\d{{1,4}}
    | \p{{Lu}}\p{{L}}+(?:str\.|straße|strasse|weg|gasse|platz|allee|ufer|ring|damm)\s\d{{1,4}}[a-z]?
    | (?:P\.?\s?O\.?\s?Box|Postfach|Apartado|B\.?P\.?)\s\d{{1,6}}
    )(?:,\s{_ROOM}(?=[^\w]|$))?(?:,\s{_TOWN})?""",
    re.X,
)
_WORD = r"\p{Lu}\p{Ll}+(?:['’-]\p{Lu}\p{Ll}+)*|\p{Lu}{3,}(?:-\p{Lu}{2,})*|\p{Lu}['’]\p{Lu}\p{Ll}+"
TITLE = r"(?:Mrs?|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sra?|Srta)\.?"
TERM = re.compile(rf"(?<![\w.@/$\[{{-])(?P<title>{TITLE}\s)?(?:(?P<init>\p{{Lu}}\.)\s|(?:{_WORD})\s(?=\p{{Lu}}))*(?:{_WORD})(?:,\s(?:{_WORD}))?(?![\w@/\]}}]|-\w|\.\w)")
#: A long number; one of ``PHONE_DIGITS`` digits may be a phone number without its dress, the others show where numbers stand.
NUMBER = plain_re.compile(r"(?<![\w.+/-])\d{5,}(?![\w]|[.-]\d)")
PHONE_DIGITS = (10, 12)
# What a kind cannot do without, cheap to look for.
_KINDS = (
    ("email", EMAIL, plain_re.compile(r"@|[\[({<]\s?at\s?[\])}>]", plain_re.I)), ("id_number", ID_NUMBER, plain_re.compile(r"\d{3}")),
    ("address", ADDRESS, plain_re.compile(r"\d[A-Za-z]?,?\s\w|[^\W\d_][.,]?\s\d")), ("phone", PHONE, plain_re.compile(r"\+\d|\(0\)|\d\)?[ ./-]\d\d|\d{10}")),
)


def forms(text: str) -> list[tuple[int, int, str]]:
    """Spans of the kinds that have a form; earlier kinds win where two overlap."""
    out: list[tuple[int, int, str]] = []
    for kind, pattern, guard in _KINDS:
        if not guard.search(text):
            continue
        for m in pattern.finditer(text):
            if not any(s < m.end() and m.start() < e for s, e, _ in out):
                out.append((*m.span(), kind))
    return out


_CLAUSE_START, _CLAUSE_END = plain_re.compile(r"[;,()]\s|[;,(]"), plain_re.compile(r"[;,]\s|[;,)]")
_DIGITS = plain_re.compile(r"\d+")


def _near(text: str, start: int, end: int) -> tuple[str, str]:
    """Up to two tokens before and behind a term, within its clause; '' where there are none."""
    before = text[max(0, start - NEAR_CHARS) : start]
    left = _CLAUSE_START.split(before)[-1]
    if not left and before.endswith(", "):  # an apposition: what stands before the comma
        left = plain_re.split(r"[;,()]", before[:-2])[-1] + ","
    right = _CLAUSE_END.split(text[end : end + NEAR_CHARS], maxsplit=1)[0]
    shape = lambda s: _DIGITS.sub("9", s.lower())
    return " ".join(shape(left).split()[-2:]), " ".join(shape(right).split()[:2])


def terms(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, list[str], bool, str, str]]:
    """Capitalised terms outside the given spans: start, end, words, protected, left and right context."""
    for m in TERM.finditer(text):
        s, e = m.span()
        if any(a < e and s < b for a, b, _ in taken):
            continue
        words = [w.lower() for w in re.findall(r"\p{L}{2,}", re.sub(rf"^{TITLE}\s", "", m.group()))]
        protected = bool(m.group("title") or m.group("init"))
        left, right = _near(text, s, e)
        yield s, e, words, protected, left, right


_FOUND = "id long, fld string, th long, start int, stop int, pii_type string, words array<string>, protected boolean, lft string, rgt string"
_CAPITAL = plain_re.compile(r"[^\W\d_a-z]")


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Formed spans, and the terms that the corpus judges: capitalised ones (term) and numbers (number)."""
    for pdf in batches:
        rows = []
        for i, fld, th, text in zip(pdf["id"], pdf["fld"], pdf["th"], pdf["text"], strict=True):
            i = None if pd.isna(i) else int(i)
            spans = forms(text)
            for s, e, kind in spans:
                words, left, right = [], "", ""
                if kind == "email":
                    words = re.findall(r"\p{L}{3,}", EMAIL.match(text, s).group("local").lower())
                elif kind == "phone":
                    words, (left, right) = ["".join(_DIGITS.findall(text[s:e]))], _near(text, s, e)
                rows.append((i, fld, th, s, e, kind, words, True, left, right))
            if _CAPITAL.search(text):
                rows += [(i, fld, th, s, e, "term", w, p, le, r) for s, e, w, p, le, r in terms(text, spans)]
            for m in NUMBER.finditer(text):
                if not any(a < m.end() and m.start() < b for a, b, _ in spans):
                    rows.append((i, fld, th, *m.span(), "number", [m.group()], False, *_near(text, *m.span())))
        if rows:
            pdf = pd.DataFrame(rows, columns=["id", "fld", "th", "start", "stop", "pii_type", "words", "protected", "lft", "rgt"])
            pdf["id"] = pdf["id"].astype("Int64")
            yield pdf


def field_texts(cards: DataFrame) -> DataFrame:
    """id, fld, th (hash of the text), text: the non-empty texts of the three fields, a row per command."""
    whole = [cards.select(F.col("id").cast("long"), F.lit(f).alias("fld"), F.col(f).alias("text")) for f in FIELDS[:2]]
    lines = cards.select(F.col("id").cast("long"), F.lit(FIELDS[2]).alias("fld"), F.explode(FIELDS[2]).alias("text"))
    return whole[0].unionByName(whole[1]).unionByName(lines).filter("text is not null and text != ''").select("id", "fld", F.xxhash64("text").alias("th"), "text")


def _bits(n: Column, s: Column, base: Column) -> Column:
    """Disclosure in bits of something seen n times, s of them with a protected entity."""
    return F.log2((F.greatest(s - DISCOUNT, F.lit(0.0)) + SUPPORT * base) / (n + SUPPORT) / base)


def disclosure(cards: DataFrame) -> DataFrame:
    """id, fld, th, start, stop, pii_type, bits: every formed span (bits null) and every term with the bits that it discloses.

    ``cards``: id, root_cause, fix_summary, verify_commands; other columns are ignored.
    pii_type of a term is name or phone.
    """
    found = checkpointed(field_texts(cards).mapInPandas(_find, _FOUND))
    kind = F.when(F.col("pii_type").isin("term", "email"), "name").when(F.col("pii_type").isin("number", "phone"), "phone").alias("kind")
    seen = found.select("*", kind).filter("kind is not null")
    # one row a kind
    counts = {r["kind"]: (r["s"] + 1) / (r["n"] + 2) for r in seen.filter("pii_type != 'email'").groupBy("kind").agg(F.count("*").alias("n"), F.count_if("protected").alias("s")).collect()}
    base = F.when(F.col("kind") == "name", counts.get("name", 0.5)).otherwise(counts.get("phone", 0.5))
    # Disclosure of contexts, by side
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("lft").alias("near")), F.struct(F.lit("r").alias("side"), F.col("rgt").alias("near"))))
    near = seen.filter("pii_type != 'email'").select("kind", "protected", sides.alias("c")).select("kind", "protected", "c.side", "c.near").filter("near != ''")
    near = near.groupBy("kind", "side", "near").agg(F.count("*").alias("n"), F.count_if("protected").alias("s"))
    bits = _bits(F.col("n"), F.col("s"), base)
    # An apposition says less about what follows.
    near = near.select("kind", "side", "near", F.when(F.col("near").endswith(","), bits / 2).otherwise(bits).alias("bits"))
    # Disclosure of the terms' words; a word of an e-mail address counts as beside a protected entity.
    words = seen.select("kind", F.explode("words").alias("word"), "protected").groupBy("kind", "word").agg(F.count("*").alias("n"), F.count_if("protected").alias("s"))
    words = words.select("kind", "word", _bits(F.col("n"), F.col("s"), base).alias("bits")).filter("bits > 0")

    key = ["id", "fld", "th", "start", "stop", "kind"]
    digits = F.col("stop") - F.col("start")
    ask = seen.filter(~F.col("protected") & ((F.col("pii_type") == "term") | (F.col("pii_type") == "number") & digits.between(*PHONE_DIGITS)))
    by_side = [ask.filter(f"{c} != ''").select(*key, F.col(c).alias("near")).join(near.filter(F.col("side") == side), ["kind", "near"]).select(*key, "bits") for c, side in (("lft", "l"), ("rgt", "r"))]
    by_word = ask.select(*key, F.explode("words").alias("word")).join(words, ["kind", "word"]).groupBy(*key).agg(F.max("bits").alias("bits"))
    told = by_side[0].unionByName(by_side[1]).unionByName(by_word).groupBy(*key).agg(F.sum("bits").alias("bits"))
    sure = found.filter("protected").withColumn("kind", F.when(F.col("pii_type") == "term", "name").otherwise(F.col("pii_type"))).select(*key, F.lit(None).cast("double").alias("bits")).distinct()
    return told.unionByName(sure).withColumnRenamed("kind", "pii_type")


def find_personal_data(cards: DataFrame, least: float = DISCLOSURE) -> DataFrame:
    """id, fld, th, start, stop, pii_type: every span that reveals a person."""
    return disclosure(cards).filter((F.col("bits") >= least) | F.col("bits").isNull()).drop("bits")


def _replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, spans in zip(pdf["text"], pdf["spans"], strict=True):
            at, parts = 0, []
            for sp in sorted(spans if spans is not None else [], key=lambda x: x["start"]):
                if sp["start"] >= at:
                    parts += [text[at : sp["start"]], f"[{sp['pii_type'].upper()}]"]
                    at = sp["stop"]
            out.append("".join(parts) + text[at:])
        yield pd.DataFrame({"row": pdf["row"], "fld": pdf["fld"], "pos": pdf["pos"], "text": out})


def sanitise(cards: DataFrame) -> DataFrame:
    """Every card with the three fields sanitised; all other columns stay as they are."""
    kept = checkpointed(cards.withColumn("__row", F.monotonically_increasing_id()))
    judged = disclosure(kept).filter((F.col("bits") >= PARTIAL) | F.col("bits").isNull())
    general = F.when(F.col("pii_type") == "phone", "number").otherwise("term")
    judged = judged.withColumn("pii_type", F.when(F.col("bits") < DISCLOSURE, general).otherwise(F.col("pii_type")))
    spans = judged.groupBy("fld", "th").agg(F.collect_set(F.struct("start", "stop", "pii_type")).alias("spans"))  # the spans of a text follow from the text
    whole = [kept.select(F.col("__row").alias("row"), F.lit(f).alias("fld"), F.lit(0).alias("pos"), F.col(f).alias("text")) for f in FIELDS[:2]]
    lines = kept.select(F.col("__row").alias("row"), F.lit(FIELDS[2]).alias("fld"), F.posexplode(FIELDS[2]).alias("pos", "text"))
    texts = whole[0].unionByName(whole[1]).unionByName(lines).withColumn("th", F.xxhash64("text"))
    hit = texts.join(spans, ["fld", "th"]).select("row", "fld", "pos", "text", "spans").mapInPandas(_replace, "row long, fld string, pos int, text string")
    clean = texts.join(spans, ["fld", "th"], "left_anti").select("row", "fld", "pos", "text").unionByName(hit)
    pick = [F.max(F.when(F.col("fld") == f, F.col("text"))).alias(f"__{f}") for f in FIELDS[:2]]
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("fld") == FIELDS[2], F.struct("pos", "text")))), lambda x: x["text"]).alias(f"__{FIELDS[2]}")
    per_row = clean.groupBy(F.col("row").alias("__row")).agg(*pick, listed)
    back = kept.join(per_row, "__row", "left")
    for f in FIELDS[:2]:
        back = back.withColumn(f, F.col(f"__{f}"))
    commands = F.when(F.size(FIELDS[2]) > 0, F.col(f"__{FIELDS[2]}")).otherwise(F.col(FIELDS[2]))
    return back.withColumn(FIELDS[2], commands).select(*cards.columns)
