"""Rules over log lines: signals with captures and evidence, and services named in logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.textexpr import cut, found_all, matches, strip
from opslens.rules import CATEGORY_BONUS, OTHER_BONUS, RULES, Rule
from opslens.runtime import checkpointed

# How services are named.
SERVICE_PATTERNS = (r"(?i)services?=([\w|]+)", r"(?i)/services?/(\w+)", r"(?i)[\"']service(?:_type)?[\"']\s*:\s*[\"'](\w+)[\"']", r"(?i)service\s*[=:]\s*[\"']?(\w+)[\"']?")
MAX_EVIDENCE, MAX_LINE = 5, 200


#: Lines of a log whose signals one task puts in order.
BLOCK_LINES = 10_000


def _hit(line: Column, low: Column, rule: Rule, no: int) -> Column:
    """Struct of the rule's first matching pattern on a line, null if none matches."""
    out = F.lit(None)
    for pattern, names in reversed(rule.groups()):
        p = "(?i)" + pattern
        pairs = [F.struct(F.lit(n).alias("name"), F.regexp_extract(line, p, i).alias("value")) for i, n in sorted(enumerate(names, 1), key=lambda x: x[1])]
        captures = F.filter(F.array(*pairs), lambda x: x["value"] != "") if pairs else F.array().cast("array<struct<name:string,value:string>>")
        shown = F.array_join(F.transform(captures, lambda x: F.concat(x["name"], F.lit("="), x["value"])), ";")
        score = rule.rank * 10 + CATEGORY_BONUS.get(rule.category, OTHER_BONUS) + 2 * F.size(captures)
        out = F.when(matches(line, low, pattern, "(?i)"), F.struct(F.lit(rule.id).alias("rule_id"), F.lit(no).alias("rule_no"), F.lit(rule.severity).alias("severity"), F.lit(rule.rank).alias("rank"), F.lit(rule.category).alias("category"), shown.alias("captures"), score.cast("int").alias("score"))).otherwise(out)
    return out


def rule_hits(lines: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per line and rule that fires on it."""
    d = lines.select("log_path", "line_no", strip("line").alias("message")).filter("message != ''").withColumn("low", F.lower("message"))
    hits = F.array_compact(F.array(*[_hit(F.col("message"), F.col("low"), r, i) for i, r in enumerate(rules)]))
    return d.select("log_path", "line_no", cut(F.col("message"), MAX_LINE).alias("evidence"), F.explode(hits).alias("h")).select("log_path", "line_no", "evidence", "h.*")


def external_signals(lines: DataFrame, rules: tuple[Rule, ...] = RULES, max_evidence: int = MAX_EVIDENCE) -> DataFrame:
    """A row per log, rule and captures: score, place in the log's ranking, number of evidence lines kept, and the first of them.

    Ranked by severity, score, first line and order of the rules.
    """
    key = ["log_path", "rule_id", "captures"]
    # Partial aggregation first: the count and the first line do not need the group in one place.
    first = F.min(F.struct("line_no", "evidence")).alias("f")
    signals = rule_hits(lines, rules).groupBy(*key, "rule_no", "severity", "rank", "category", "score").agg(F.count("*").alias("n"), first)
    signals = signals.select(*key, "rule_no", "severity", "rank", "category", "score", F.least(F.col("n"), F.lit(max_evidence)).cast("int").alias("n_evidence"), F.col("f.line_no").alias("first_line"), F.col("f.evidence").alias("evidence"))
    # A log may hold any number of captures: places are counted by cells of rank, score and block of lines.
    cell = ["log_path", "rank", "score", "block"]
    signals = checkpointed(signals.withColumn("block", F.floor(F.col("first_line") / BLOCK_LINES)))  # read twice; a row per signal
    before = Window.partitionBy("log_path").orderBy(F.desc("rank"), F.desc("score"), "block").rowsBetween(Window.unboundedPreceding, -1)
    cells = signals.groupBy(*cell).agg(F.count("*").alias("k")).select(*cell, F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("first_line", "rule_no", "captures"))
    same = F.col("s.block").eqNullSafe(F.col("c.block")) & F.col("s.log_path").eqNullSafe(F.col("c.log_path")) & (F.col("s.rank") == F.col("c.rank")) & (F.col("s.score") == F.col("c.score"))
    placed = signals.withColumn("i", inside).alias("s").join(cells.alias("c"), same).select("s.*", (F.col("c.before") + F.col("i")).cast("int").alias("place"))
    return placed.drop("rank", "rule_no", "block", "i")


def evidence_lines(lines: DataFrame, rules: tuple[Rule, ...] = RULES, max_evidence: int = MAX_EVIDENCE) -> DataFrame:
    """log_path, rule_id, captures, ord, line_no, evidence: the first lines of each signal, ``max_evidence`` at most."""
    order = Window.partitionBy("log_path", "rule_id", "captures").orderBy("line_no", "evidence")
    d = rule_hits(lines, rules).withColumn("ord", F.row_number().over(order).cast("int")).filter(F.col("ord") <= max_evidence)
    return d.select("log_path", "rule_id", "captures", "ord", "line_no", "evidence")


def services_seen(lines: DataFrame) -> DataFrame:
    """log_path, service: the distinct services that a log's lines name, in lower case."""
    line = F.coalesce(F.col("line"), F.lit(""))
    names = F.flatten(F.array(*[found_all(line, p) for p in SERVICE_PATTERNS]))
    single = F.filter(F.flatten(F.transform(names, lambda s: F.split(F.lower(s), r"\|"))), lambda s: F.length(s) > 1)
    return lines.select("log_path", F.explode(single).alias("service")).distinct()


def missing_ids(lines: DataFrame) -> DataFrame:
    """log_path, message_id, first_line: ids that a log says have no mapping."""
    hits = rule_hits(lines, RULES[:1]).filter("captures != ''")
    return hits.groupBy("log_path", F.substring_index("captures", "=", -1).alias("message_id")).agg(F.min("line_no").alias("first_line"))
