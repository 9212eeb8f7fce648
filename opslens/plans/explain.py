"""What a log says, put together: the rows of a context pack, and its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.textexpr import cut
from opslens.operators.external_signals import external_signals, missing_ids, services_seen
from opslens.operators.graph import neighbours, related_files
from opslens.operators.hypotheses import hypotheses
from opslens.operators.log_signals import line_signals, log_tokens
from opslens.operators.matching import match_logs
from opslens.operators.similarity import case_report, similar_cases
from opslens.operators.store import decode_log_codes
from opslens.runtime import checkpointed

#: Evidence lines and their length, and lines of a pack.
MAX_EVIDENCE, MAX_CHARS, MAX_LINES = 8, 120, 200
SECTIONS = {1: "MATCHED PROC", 2: "EVIDENCE", 3: "DECODED CODES", 4: "HYPOTHESES", 5: "NEIGHBOURS", 6: "SIMILAR CASES", 7: "FILES IN THE LOG", 8: "EXTERNAL SIGNALS", 9: "FILES TO OPEN"}
#: Files of each kind in a log, external signals and files to open that a pack shows.
LOG_FILES, LOG_SIGNALS, OPEN_FILES = 5, 5, 8
#: Where scripts that a log names lie in a snapshot.
SCRIPT_ROOTS = ("/home/master/", "/home/test/master/")


def evidence(lines: DataFrame, top: int = MAX_EVIDENCE) -> DataFrame:
    """log_path, ord, text: the first error lines of each log, fatal ones first."""
    s = line_signals(lines).filter("severity in ('F', 'E')").select("log_path", "line_no", "severity", cut(F.col("message"), MAX_CHARS).alias("m")).distinct()
    place = F.row_number().over(Window.partitionBy("log_path").orderBy(F.when(F.col("severity") == "F", 0).otherwise(1), "line_no", "m")).cast("int")
    return s.withColumn("ord", place).filter(F.col("ord") <= top).select("log_path", "ord", F.concat(F.lit("L"), F.col("line_no"), F.lit(" "), F.col("severity"), F.lit(" "), F.col("m")).alias("text"))


def log_queries(tokens: DataFrame) -> DataFrame:
    """query_id (the log), signals and files: what a log is compared to past cases by (tokens of the logs)."""
    codes = tokens.filter("kind = 'error_code'").groupBy("log_path").agg(F.array_sort(F.collect_set("token")).alias("signals"))
    return codes.select(F.col("log_path").alias("query_id"), "signals", F.array().cast("array<string>").alias("files"))


def log_files(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """log_path, ord, text: document definitions, scripts and other paths that a log names, and where they are in the snapshot (files: path)."""
    kinds = ("docdef_token", "script_path", "io_path")
    kind = F.lit(None).cast("int")
    for i, k in enumerate(kinds):
        kind = F.when(F.col("kind") == k, i).otherwise(kind)
    shown = tokens.withColumn("k", kind).filter("k is not null")
    n = F.row_number().over(Window.partitionBy("log_path", "k").orderBy("token"))
    shown = shown.withColumn("n", n).filter(F.col("n") <= LOG_FILES)
    place = F.when(F.col("k") == 0, F.concat(F.lit("docdef/"), F.lower("token"), F.lit(".dfa")))
    for root in SCRIPT_ROOTS:
        place = place.when((F.col("k") == 1) & F.startswith("token", F.lit(root)), F.concat(F.lit("master/"), F.substring("token", len(root) + 1, 1 << 20)))
    have = files.select(F.col("path").alias("place")).distinct().withColumn("there", F.lit(True))
    d = shown.withColumn("place", place).join(have, "place", "left")
    where = F.when(F.col("k") == 2, "").when(F.col("there"), F.concat(F.lit(" -> "), F.col("place"))).otherwise(" (not in the snapshot)")
    return d.select("log_path", (F.col("k") * LOG_FILES + F.col("n")).cast("int").alias("ord"), F.concat("token", where).alias("text"))


def explain_rows(lines: DataFrame, nodes: DataFrame, edges: DataFrame, codes: DataFrame, cards: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """log_path, section, ord, text: the lines of each log's context pack (files: path, those of the snapshot).

    Tokens, external signals and matches are found once and kept; the sections are made of them.
    """
    tokens = checkpointed(log_tokens(lines))  # four sections read them
    signals = checkpointed(external_signals(lines))
    best = checkpointed(match_logs(lines, nodes, edges, tokens=tokens))
    files = nodes.select(F.col("canonical_path").alias("path")).filter("path is not null") if files is None else files

    def section(no: int, rows: DataFrame, ord_: Column, text: Column, log: str = "log_path") -> DataFrame:
        return rows.select(F.col(log).alias("log_path"), F.lit(no).alias("section"), ord_.cast("int").alias("ord"), text.alias("text"))

    one = section(1, best, F.lit(1), F.concat("key", F.lit(" ("), F.format_string("%.2f", "confidence"), F.lit(")")))
    two = section(2, evidence(lines), F.col("ord"), F.col("text"))
    three = section(3, decode_log_codes(lines, codes, tokens=tokens), F.col("place"), F.concat_ws(" ", "code", "title"))
    steps = F.when(F.col("confirm") != "", F.concat(F.lit(" | "), F.replace("confirm", F.lit("|"), F.lit("; ")))).otherwise("")
    four = section(4, checkpointed(hypotheses(lines, signals=signals)), F.col("place"), F.concat("hypothesis", F.lit(" | "), "evidence", steps))
    near = neighbours(nodes, edges).join(best.select("log_path", "node_id"), "node_id").groupBy("log_path", "direction").agg(F.count("*").alias("n"))
    five = section(5, near, F.when(F.col("direction") == "upstream", 1).otherwise(2), F.concat("direction", F.lit(": "), F.col("n")))
    told = case_report(checkpointed(similar_cases(checkpointed(log_queries(tokens)), cards)), cards)  # joins of its own: the driver holds one plan at a time
    commands = F.when(F.size("verify_commands") > 0, F.concat(F.lit(" | "), F.array_join("verify_commands", "; "))).otherwise("")
    six = section(6, told, F.col("place"), F.concat(F.lit("case "), F.col("case_id"), F.lit(" score "), F.format_string("%.3f", "score"), commands), "query_id")
    seven = section(7, log_files(tokens, files), F.col("ord"), F.col("text"))
    first = signals.filter(F.col("place") <= LOG_SIGNALS)
    captured = F.when(F.col("captures") != "", F.concat(F.lit(" "), F.col("captures"))).otherwise("")
    eight = section(8, first, F.col("place"), F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("rule_id"), F.lit(" ("), F.col("category"), F.lit(")"), captured, F.lit(" | L"), F.col("first_line"), F.lit(": "), F.col("evidence")))
    firing = signals.select("log_path").distinct()
    for i, (rows, col, name) in enumerate(((services_seen(lines), "service", "services: "), (missing_ids(lines), "message_id", "missing ids: ")), 1):
        listed = rows.join(firing, "log_path", "left_semi").groupBy("log_path").agg(F.array_join(F.array_sort(F.collect_set(col)), ", ").alias("all"))
        eight = eight.unionByName(section(8, listed, F.lit(LOG_SIGNALS + i), F.concat(F.lit(name), F.col("all"))))
    opened = best.select("log_path", "node_id").join(related_files(nodes, edges, files, OPEN_FILES), "node_id")
    nine = section(9, lines.select("log_path").distinct(), F.lit(0), F.col("log_path")).unionByName(section(9, opened, F.col("place"), F.col("path")))
    out = one
    for part in (two, three, four, five, six, seven, eight, nine):
        out = out.unionByName(part)
    return out


def render_pack(rows: DataFrame, log_path: str) -> str:
    """The context pack of one log as text; at most ``MAX_LINES`` lines are gathered."""
    got = rows.filter(F.col("log_path") == log_path).orderBy("section", "ord").limit(MAX_LINES + 1).collect()
    out, last = [f"# {log_path}"], None
    for r in got:
        if r["section"] != last:
            last = r["section"]
            out += ["", f"## {SECTIONS[last]}"]
        out.append(f"- {r['text']}")
    return "\n".join(out if len(out) <= MAX_LINES else [*out[: MAX_LINES - 1], "... the rest is left out"])
