"""Ranked root-cause hypotheses of each log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.textexpr import cut, matches
from opslens.operators.external_signals import external_signals, services_seen
from opslens.operators.log_signals import STRONG_FAILURE, any_of, line_signals
from opslens.rules import RULES, Rule
from opslens.runtime import checkpointed

#: (name, pattern, hypothesis, confidence); patterns, order and confidences are fixed values, texts are worded here.
LINE_RULES = (
    ("oracle", r"ORA-\d{5}", "The database refused a connection or a statement", 0.9),
    ("docexec", r"PPDE\d{4}E", "The document could not be generated", 0.85),
    ("converter", r"PPCS\d{4}E", "The converter failed", 0.85),
    ("no_file", r"failed to open|cannot open|No such file", "An input file is missing or may not be read", 0.9),
    ("permission", r"Permission denied", "A file or folder may not be used", 0.95),
    ("mismatch", r"mismatch|do not match", "Counts or data do not match", 0.8),
    ("timeout", r"timeout|timed out", "An operation took too long", 0.85),
    ("missing", r"missing file_id|missing operand", "A required parameter or input is missing", 0.85),
    ("bad_line", r"Error line \d+ has", "An input line could not be parsed", 0.9),
    ("return_code", r"RC=\d+[^0]|status \[-\d+\]", "A called program returned an error", 0.75),
    ("wrapper", r"Generator returns a non-zero|Generator.*non-zero", "The wrapper repeats that something failed", 0.4),
    ("error", r"^ERROR:|ERROR\s*:", "The program reports an error of its own", 0.7),
    ("bad_csv", r"CSV file.*is bad|CSV.*bad", "A CSV input is malformed", 0.9),
    ("failed_in", r"Failed in \w+", "A script failed while it ran", 0.85),
)
#: How each line rule is confirmed; rules of the pack bring their hints.
CONFIRM = {
    "oracle": ("See that the listener answers", "Compare the connection's name with the network configuration", "Read the database's own log"),
    "docexec": ("Check the document definition's syntax", "Compare the input with the format it expects", "Look at the variables it declares"),
    "converter": ("Check the converter's configuration and profile", "Look at the format of the input"),
    "no_file": ("See that the file is where the log says", "List its permissions", "Check the path in the insert file"),
    "permission": ("List the permissions of the path", "See which user the job runs as", "See whether another process holds the file"),
    "mismatch": ("Compare the record counts of input and output", "Look for repeated records", "Check the input against its layout"),
    "timeout": ("Check the network", "See that the database answers", "Look at the load of the host"),
    "missing": ("See that the insert file sets every parameter", "Check the fields of the input", "Look at what the calling script passes on"),
    "bad_line": ("Open the input at the line named", "Check quotes and separators", "Count the columns"),
    "return_code": ("Read the log of the program called", "See that its inputs exist", "Check its configuration"),
    "wrapper": ("Look for other codes in the same log", "Read the lines before it", "Without any other failure it may be a false alarm"),
    "error": ("Read the message itself", "Read the lines before it", "Check input and configuration"),
    "bad_csv": ("Check the file's encoding", "Check quotes and separators", "Count the columns"),
    "failed_in": ("Open the script named", "Read its log", "Check the parameters it was given"),
}
SEVERITY_CONFIDENCE = {"F": 0.95, "E": 0.85, "W": 0.70, "I": 0.50}
WRAPPER_ONLY = "Only the wrapper's message was found and no failure behind it"
DEFAULT = "No known pattern was found; read the log"
#: Characters of evidence kept from a line and from a rule's evidence.
LINE_EVIDENCE, RULE_EVIDENCE = 100, 120


def _from_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hypotheses of the line rules, and strong per log; one pass over the lines.

    Each rule fires once per log, on fatal lines before errors; where a log has neither, on all lines.
    """
    s = line_signals(lines).withColumn("low", F.lower("message"))
    level = F.when(F.col("severity") == "F", 0).when(F.col("severity") == "E", 1).otherwise(2)
    wrapper = matches("message", "low", LINE_RULES[10][1], "(?i)")
    fired = []
    for no, (name, pattern, _, _) in enumerate(LINE_RULES):
        # a wrapper line fires its own rule only
        test = wrapper if name == "wrapper" else matches("message", "low", pattern, "(?i)") & ~wrapper
        fired.append(F.when(test, no))
    # -1 and -2 stand for the log itself: its best level, and a strong failure
    per_line = F.array_compact(F.array(F.lit(-1), F.when(any_of("message", STRONG_FAILURE, "low"), -2), *fired))
    hits = s.select("log_path", "line_no", "message", level.alias("level"), F.explode(per_line).alias("no"))
    first = hits.groupBy("log_path", "no").agg(F.min(F.struct("level", "line_no", F.when(F.col("no") >= 0, F.col("message")).alias("message"))).alias("f"))
    first = checkpointed(first)
    logs = first.filter("no < 0").groupBy("log_path").agg(F.min(F.when(F.col("no") == -1, F.col("f.level"))).alias("best"), F.max(F.col("no") == -2).alias("strong"))
    one = first.filter("no >= 0").join(logs, "log_path").filter("f.level < 2 or best = 2")
    pick = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in LINE_RULES]), F.col("no") + 1)
    rows = one.select("log_path", pick(0).alias("rule"), (F.col("no") + 100).alias("ord"), pick(2).alias("hypothesis"), pick(3).alias("confidence"), F.col("f.line_no").alias("line_no"), cut(F.col("f.message"), LINE_EVIDENCE).alias("evidence"))
    return rows, logs.select("log_path", "strong")


def _from_rules(lines: DataFrame, rules: tuple[Rule, ...], signals: DataFrame | None) -> DataFrame:
    """One hypothesis per rule of the pack, from its best signal; placeholders filled from captures and the first service."""
    signals = external_signals(lines, rules) if signals is None else signals
    first = signals.groupBy("log_path", "rule_id", "severity", "category").agg(F.min(F.struct("place", "captures", "first_line", "evidence")).alias("f"))
    service = services_seen(lines).groupBy("log_path").agg(F.min("service").alias("service"))
    d = first.join(service, "log_path", "left")
    text, confidence = F.lit(None).cast("string"), F.lit(None).cast("double")
    for r in rules:
        names = {n for _, ns in r.groups() for n in ns}
        if r.template:
            filled, have = F.lit(r.template), F.lit(True)
            for n in sorted(names):
                if "{" + n + "}" in r.template:
                    value = F.regexp_extract(F.concat(F.lit(";"), F.col("f.captures")), rf";{n}=(.*)$", 1)
                    have = have & (value != "")
                    filled = F.replace(filled, F.lit("{" + n + "}"), value)
            filled = F.replace(filled, F.lit("{service}"), F.coalesce("service", F.lit("UNKNOWN")))
            rule_text = F.when(have, filled).otherwise(r.template)
            rule_confidence = F.lit(r.confidence if r.confidence is not None else SEVERITY_CONFIDENCE.get(r.severity, 0.7))
        else:
            rule_text, rule_confidence = F.lit(r.hints[0] if r.hints else f"External signal: {r.id} ({r.category})"), F.lit(0.75)
        text = F.when(F.col("rule_id") == r.id, rule_text).otherwise(text)
        confidence = F.when(F.col("rule_id") == r.id, rule_confidence).otherwise(confidence)
    evidence = cut(F.concat(F.lit("L"), F.col("f.first_line"), F.lit(": "), F.col("f.evidence")), RULE_EVIDENCE)
    return d.select("log_path", F.col("rule_id").alias("rule"), F.col("f.place").alias("ord"), text.alias("hypothesis"), confidence.alias("confidence"), F.col("f.first_line").alias("line_no"), evidence.alias("evidence"))


def hypotheses(lines: DataFrame, top: int = 3, rules: tuple[Rule, ...] = RULES, signals: DataFrame | None = None) -> DataFrame:
    """log_path, place, rule, hypothesis, confidence, line_no, evidence, confirm (steps joined by '|'): the best ``top`` of each log.

    ``signals`` are the external signals of the lines if they are at hand.
    A log whose only hypothesis is the wrapper's message and that shows no strong failure
    keeps it at low confidence; a log without any gets the default.
    """
    by_line, strong = _from_lines(lines)
    ours = checkpointed(_from_rules(lines, rules, signals).unionByName(by_line))
    logs = lines.select("log_path").distinct().join(strong, "log_path", "left")
    n_rows = ours.groupBy("log_path").agg(F.count("*").alias("n_rows"))
    d = logs.join(ours, "log_path", "left").join(n_rows, "log_path", "left")
    alone = (F.col("rule") == "wrapper") & (F.col("n_rows") == 1) & ~F.coalesce("strong", F.lit(False))
    none = F.col("rule").isNull()
    d = d.select(
        "log_path", F.when(none, "default").otherwise(F.col("rule")).alias("rule"), F.coalesce("ord", F.lit(0)).alias("ord"),
        F.when(none, DEFAULT).when(alone, WRAPPER_ONLY).otherwise(F.col("hypothesis")).alias("hypothesis"),
        F.when(none, 0.5).when(alone, 0.2).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce("line_no", F.lit(0)).alias("line_no"), F.coalesce("evidence", F.lit("")).alias("evidence"),
    )
    order = Window.partitionBy("log_path").orderBy(F.desc("confidence"), "ord", "rule")  # at most one row per rule
    return d.withColumn("place", F.row_number().over(order).cast("int")).filter(F.col("place") <= top).drop("ord").withColumn("confirm", confirm_steps(F.col("rule"), rules))


def confirm_steps(rule: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The steps that confirm a rule's hypothesis, joined by '|'; '' where there are none."""
    steps = {**{r.id: r.hints for r in rules}, **CONFIRM}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in steps.items() for x in (k, "|".join(v))]), rule), F.lit(""))
