"""Similar past cases by overlap of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.runtime import checkpointed

#: Least score, points per shared file (tenths of a point are exact as decimals).
THRESHOLD, FILE_BONUS = 0.3, 0.2


#: Scores are rounded to six digits before they are compared, so a score may be short of its threshold by this much.
ROUNDING = 5e-7
#: What names a pair of sets: a digest and a size for each.
PAIR = ["qkey", "ckey", "n_query", "n_case"]


def _sets(rows: DataFrame, id_col: str, key: str, n: str) -> DataFrame:
    """id, key (a digest of 128 bits), n, set: the distinct signals in lower case, sorted; ids without any are left out."""
    each = F.array_sort(F.array_distinct(F.transform(F.filter("signals", lambda s: s.isNotNull()), F.lower)))
    sets = rows.select(F.col(id_col), each.alias("set")).filter("size(set) > 0")
    return sets.select(id_col, F.unhex(F.md5(F.to_json("set"))).alias(key), F.size("set").alias(n), "set")


def _members(sets: DataFrame, key: str, n: str) -> DataFrame:
    """key, n, signal: a row per signal of each distinct set."""
    return sets.dropDuplicates([key]).select(key, n, F.explode("set").alias("signal"))


def _shared(pairs: DataFrame, q: DataFrame, c: DataFrame) -> DataFrame:
    """The distinct ``pairs`` that share signals, with their number (q, c: members); the smaller set of a pair is looked up in the other."""
    by_case = pairs.filter("n_case <= n_query").join(c.drop("n_case"), "ckey").join(q.drop("n_query"), ["qkey", "signal"])
    by_query = pairs.filter("n_case > n_query").join(q.drop("n_query"), "qkey").join(c.drop("n_case"), ["ckey", "signal"])
    return by_case.select(PAIR).unionByName(by_query.select(PAIR)).groupBy(PAIR).agg(F.count("*").alias("shared"))


def overlaps(q: DataFrame, c: DataFrame, threshold: float = 0.0) -> DataFrame:
    """qkey, ckey, n_query, n_case, shared of the distinct sets (q, c: members) that share a signal and can reach the threshold.

    A set may hold as many signals as a log has lines, so no row carries a whole set: sets are
    told by their keys and what they share is counted over rows of single signals. Sets are
    joined on the rarest signals of each (a prefix in the order of rarity): two sets whose
    overlap is at least ``threshold`` of the larger one share a signal of both prefixes, so
    frequent signals join only where a set has no rarer ones.
    """
    least = threshold - ROUNDING
    if least <= 0:
        return q.join(c, "signal").groupBy(PAIR).agg(F.count("*").alias("shared"))
    seen = q.select("signal").unionByName(c.select("signal")).groupBy("signal").agg(F.count("*").alias("seen"))

    def rarest(members: DataFrame, key: str, n: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy("seen", "signal"))
        need = F.greatest(F.ceil(F.col(n) * least - 1e-9), F.lit(1))
        return members.join(seen, "signal").withColumn("place", place).filter(F.col("place") <= F.col(n) - need + 1).select(key, n, "signal")

    near = F.least("n_query", "n_case") >= F.greatest("n_query", "n_case") * least - 1e-9
    pairs = rarest(q, "qkey", "n_query").join(rarest(c, "ckey", "n_case"), "signal").filter(near).select(PAIR).distinct()
    return _shared(pairs, q, c)


def similar_cases(queries: DataFrame, cards: DataFrame, top: int = 3, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, place, case_id, score, root_cause, fix_summary: the best cases of each query.

    Score: shared signals over the larger set, plus a bonus per shared file, 1 at most. A case
    without cause and fix takes them from the first chunk of its source that has one.
    ``queries``: query_id, signals, files; ``cards``: id, source_path, chunk_id, signals,
    root_cause, fix_summary, related_files.

    Equal sets are compared once; of cards with equal sets the first ``top`` by id stand for
    all, except that cards with a shared file are scored one by one.
    """
    cards = cards.withColumnRenamed("id", "case_id")
    qs, cs = _sets(queries, "query_id", "qkey", "n_query"), _sets(cards, "case_id", "ckey", "n_case")
    q, c = checkpointed(_members(qs, "qkey", "n_query")), checkpointed(_members(cs, "ckey", "n_case"))  # six branches read them
    qs, cs = checkpointed(qs.drop("set")), checkpointed(cs.drop("set"))
    base = (F.col("shared") / F.greatest("n_query", "n_case")).alias("base")
    by_set = overlaps(q, c, threshold).select("qkey", "ckey", base).filter(F.round("base", 6) >= threshold)
    first = cs.withColumn("n", F.row_number().over(Window.partitionBy("ckey").orderBy("case_id"))).filter(F.col("n") <= top).select("ckey", "case_id")
    plain = by_set.join(first, "ckey").withColumn("p", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("base"), "case_id"))).filter(F.col("p") <= top)
    plain = plain.join(qs.select("query_id", "qkey"), "qkey").select("query_id", "case_id", "base", F.lit(0).cast("long").alias("n_files"))
    qf = queries.select("query_id", F.explode(F.array_distinct(F.transform("files", F.lower))).alias("file"))
    cf = cards.select("case_id", F.explode(F.array_distinct(F.transform("related_files", F.lower))).alias("file"))
    filed = qf.join(cf, "file").groupBy("query_id", "case_id").agg(F.count("*").alias("n_files"))
    filed = filed.join(qs, "query_id").join(cs, "case_id")
    filed = filed.join(_shared(filed.select(PAIR).distinct(), q, c), PAIR).select("query_id", "case_id", base, "n_files")
    both = plain.unionByName(filed).groupBy("query_id", "case_id").agg(F.max("base").alias("base"), F.max("n_files").alias("n_files"))
    d = both.withColumn("score", F.round(F.least(F.lit(1.0), F.col("base") + FILE_BONUS * F.col("n_files")), 6)).filter(F.col("score") >= threshold)
    best = d.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "case_id")).cast("int")).filter(F.col("place") <= top)
    told = F.col("root_cause").isNotNull() | F.col("fix_summary").isNotNull()
    sibling = cards.filter(told & F.col("source_path").isNotNull()).groupBy("source_path").agg(F.min(F.struct("chunk_id", "case_id", "root_cause", "fix_summary")).alias("sib"))
    texts = best.join(cards.select("case_id", "source_path", "root_cause", "fix_summary"), "case_id").join(sibling, "source_path", "left")
    return texts.select("query_id", "place", "case_id", "score", F.when(told, F.col("root_cause")).otherwise(F.col("sib.root_cause")).alias("root_cause"), F.when(told, F.col("fix_summary")).otherwise(F.col("sib.fix_summary")).alias("fix_summary"))


#: Fixed value: commands that a report shows of a case.
COMMANDS = 3


def case_report(similar: DataFrame, cards: DataFrame) -> DataFrame:
    """query_id, place, case_id, score, title, root_cause, fix_summary, verify_commands: similar cases that say something, the best of each source.

    ``similar`` is of ``similar_cases``; a case whose texts came from a sibling shows that one's commands.
    """
    told = F.col("root_cause").isNotNull() | F.col("fix_summary").isNotNull()
    c = cards.select(F.col("id").alias("case_id"), "source_path", "title", "verify_commands", told.alias("own"))
    sibling = cards.filter(told & F.col("source_path").isNotNull()).groupBy("source_path").agg(F.min(F.struct("chunk_id", "id", "verify_commands")).alias("sib"))
    d = similar.filter(told).join(c, "case_id").join(sibling, "source_path", "left")
    commands = F.slice(F.coalesce(F.when(F.col("own"), F.col("verify_commands")).otherwise(F.col("sib.verify_commands")), F.array().cast("array<string>")), 1, COMMANDS)
    source = F.coalesce("source_path", F.concat(F.lit("\x00"), F.col("case_id").cast("string")))
    first = F.row_number().over(Window.partitionBy("query_id", source).orderBy("place"))
    d = d.withColumn("n", first).filter("n = 1")
    return d.select("query_id", "place", "case_id", "score", "title", "root_cause", "fix_summary", commands.alias("verify_commands"))


def jaccard(queries: DataFrame, cards: DataFrame, threshold: float = 0.0) -> DataFrame:
    """query_id, case_set (smallest case id of the cards with the same signals), n_cases, jaccard: sets that share a signal and reach the threshold."""
    qs, cs = _sets(queries, "query_id", "qkey", "n_query"), _sets(cards.withColumnRenamed("id", "case_id"), "case_id", "ckey", "n_case")
    classes = cs.groupBy("ckey").agg(F.min("case_id").alias("case_set"), F.count("*").alias("n_cases"))
    # what two sets share is at least as large a part of the larger one as of both together
    d = overlaps(_members(qs, "qkey", "n_query"), _members(cs, "ckey", "n_case"), threshold).join(classes, "ckey").join(qs.select("query_id", "qkey"), "qkey")
    return d.select("query_id", "case_set", "n_cases", F.round(F.col("shared") / (F.col("n_query") + F.col("n_case") - F.col("shared")), 6).alias("jaccard")).filter(F.col("jaccard") >= threshold)
