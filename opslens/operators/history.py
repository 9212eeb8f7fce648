"""Case cards from histories of past work: chunks, signals, commands, files, cause and fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.textexpr import cut, found, found_all, matches, redact
from opslens.operators.log_signals import ERROR_SIGNATURES
from opslens.operators.procs import clean_paths

# Where chunks begin and what is taken from them.
SESSION = r"^</?\d{4}-\d{2}-\d{2}_\d{2}-\d{2}Z-[^>]+\.md>$"
TURN = r"^_\*\*(?:User|Assistant)\*\*_$"
SHELL = r"(?m)^\s*(?:grep|cat|find|ls|cd|sqlplus|perl|bash|sh|wc|head|tail|awk|sed)\s+.+$"
FILE_PATH = r"(/[a-zA-Z0-9_/\-\.]+\.(?:pl|sh|procs|dfa|control|ins|csv|txt|sql|py))"
CAUSE = (r"(?iu)(?:root cause|причина|problem|проблема)[:\s]+(.+?)(?:\n|$)", r"(?iu)(?:because|потому что)[:\s]+(.+?)(?:\n|$)")
FIX = (r"(?iu)(?:fix|решение|solution)[:\s]+(.+?)(?:\n|$)", r"(?iu)(?:changed|изменил|added|добавил)[:\s]+(.+?)(?:\n|$)")
CAUSE_SECTION = r"(?isu)##\s*(?:root cause|причина|problem|причина ошибки)[:\s]+(.+?)(?=\n##|\z)"
FIX_SECTION = r"(?isu)##\s*(?:fix|решение|solution|исправление)[:\s]+(.+?)(?=\n##|\z)"
BLANKS = 3


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_id (0-based first line), chunk of each text (docs: doc_id, text).

    Outside code fences a session tag, a turn marker, a heading of level one or two, or the
    third blank line in a row begins a chunk. The state runs through a text's lines as a
    fold, so the rules about resets hold exactly.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    state = F.struct(
        F.lit(False).alias("code"), F.lit(0).alias("blank"), F.lit(0).alias("n"), F.lit(False).alias("filled"), F.lit(0).alias("start"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(s: Column, line: Column) -> Column:
        code = F.when(F.ltrim(line).startswith("```"), ~s["code"]).otherwise(s["code"])
        empty = F.trim(F.translate(line, "\t\r", "  ")) == ""
        named = line.rlike(SESSION) | line.rlike(TURN) | line.startswith("# ") | line.startswith("## ")
        blank = F.when(code | named, s["blank"]).when(empty, s["blank"] + 1).otherwise(F.lit(0))
        boundary = ~code & (named | (empty & (blank >= BLANKS)))
        cuts = boundary & s["filled"]
        return F.struct(code.alias("code"), F.when(cuts, 0).otherwise(blank).alias("blank"), (s["n"] + 1).alias("n"), F.lit(True).alias("filled"), F.when(cuts, s["n"]).otherwise(s["start"]).alias("start"), F.when(cuts, F.array_append(s["starts"], s["n"])).otherwise(s["starts"]).alias("starts"))

    folded = F.aggregate(lines, state, step)
    d = docs.select("doc_id", lines.alias("lines"), F.concat(F.array(F.lit(0)), folded["starts"]).alias("starts"))
    d = d.select("doc_id", "lines", "starts", F.posexplode("starts").alias("i", "chunk_id"))
    stop = F.coalesce(F.get("starts", F.col("i") + 1), F.size("lines"))
    d = d.select("doc_id", F.col("chunk_id").cast("long"), F.array_join(F.slice("lines", F.col("chunk_id") + 1, stop - F.col("chunk_id")), "\n").alias("chunk"))
    return d.filter(F.col("chunk").rlike(r"\S"))


def signatures(text: Column, low: Column | None = None) -> Column:
    """The distinct error signatures of a text; ``low`` is the text in lower case, as a column of its own."""
    low = F.lower(text) if low is None else low
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.when(matches(text, low, p), found_all(text, p, 0)).otherwise(none) for p in ERROR_SIGNATURES]))


def commands(text: Column) -> Column:
    each = F.transform(found_all(text, SHELL, 0), lambda c: cut(F.regexp_replace(c, r"^\s+|\s+$", ""), 200))
    return F.slice(F.array_distinct(each), 1, 10)


def title_of(text: Column) -> Column:
    """The first heading within five lines, else the first of three lines that reads as a title; 100 characters at most."""
    lines = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n")
    heading = F.filter(F.transform(F.filter(F.slice(lines, 1, 5), lambda x: x.startswith("#")), lambda x: F.trim(F.ltrim(x, F.lit("#")))), lambda x: x != "")
    plain = F.filter(F.transform(F.slice(lines, 1, 3), lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) < 100) & ~x.startswith("```") & ~x.startswith("---") & ~x.startswith("_**"))
    return F.coalesce(F.substring(F.get(heading, F.lit(0)), 1, 100), F.get(plain, F.lit(0)))


def _first(text: Column, patterns: tuple[str, ...], n: int) -> Column:
    return F.substring(F.coalesce(*[F.trim(found(text, p)) for p in patterns]), 1, n)


def case_cards(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """doc_id, chunk_id, content_hash, title, signals, verify_commands, related_files, root_cause, fix_summary, tags.

    Chunks without signals, commands and files give no card. A card with signals but without
    cause or fix takes it from the section of that name in its whole text.
    """
    d = chunks(docs)
    text = redact("chunk") if redacted else F.col("chunk")
    t = F.col("t")
    parts = F.struct(t, signatures(t, F.col("low")).alias("signals"), commands(t).alias("verify_commands"), F.slice(clean_paths(found_all(t, FILE_PATH)), 1, 20).alias("related_files"))
    # the one-row explode keeps the optimizer from computing the lists again in the filter and behind it
    cards = d.select("doc_id", "chunk_id", text.alias("t")).withColumn("low", F.lower("t")).select("doc_id", "chunk_id", F.explode(F.array(parts)).alias("p")).select("doc_id", "chunk_id", "p.*")
    cards = cards.filter((F.size("signals") > 0) | (F.size("verify_commands") > 0) | (F.size("related_files") > 0))
    sections = docs.select("doc_id", F.substring(F.trim(found(F.coalesce("text", F.lit("")), CAUSE_SECTION)), 1, 300).alias("file_cause"), F.substring(F.trim(found(F.coalesce("text", F.lit("")), FIX_SECTION)), 1, 300).alias("file_fix")).filter("file_cause is not null or file_fix is not null")
    cards = cards.join(sections, "doc_id", "left")
    has = F.size("signals") > 0
    tag = lambda name, col, part: F.when(F.exists(col, lambda x: F.contains(F.lower(x) if name == "csv" else x, F.lit(part))), name)
    tags = F.array_compact(F.array(tag("oracle", "signals", "ORA-"), tag("perl", "related_files", ".pl"), tag("shell", "related_files", ".sh"), tag("docdef", "related_files", ".dfa"), tag("csv", "signals", "csv")))
    cause, fix = _first(t, CAUSE, 200), _first(t, FIX, 200)
    return cards.select(
        "doc_id", "chunk_id", F.substring(F.sha2(t.cast("binary"), 256), 1, 16).alias("content_hash"), title_of(t).alias("title"), "signals", "verify_commands", "related_files",
        F.coalesce(cause, F.when(has, F.col("file_cause"))).alias("root_cause"), F.coalesce(fix, F.when(has, F.col("file_fix"))).alias("fix_summary"), tags.alias("tags"),
    )
