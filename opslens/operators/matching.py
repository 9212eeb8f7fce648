"""Logs matched to the procs that wrote them.

Prefix and substring tests are equi-joins: a key is cut into the prefixes and substrings
of the lengths that the tokens really have, so no pair of log and node is compared in vain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.textexpr import base_name
from opslens.operators.graph import scripts_run_by
from opslens.operators.log_signals import log_tokens, path_features
from opslens.runtime import checkpointed

# Points of each strategy in tenths, and the points of a full match.
PREFIX_EXACT, PREFIX_PARTIAL, SCRIPT, PATH_EXACT, PATH_BASE, PATH_PARTIAL, JID, CID = 20, 15, 12, 10, 9, 7, 5, 3
FULL = 42


def _procs(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type = 'proc'").select(F.col("id").alias("node_id"), "key", F.substring_index("key", ":", -1).alias("name"), F.lower("key").alias("low"))


def _by_prefix(tokens: DataFrame, procs: DataFrame) -> DataFrame:
    """tokens (log_path, token, ...) joined to the procs whose name begins with the token."""
    cuts = procs.select("node_id", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("k"), F.lower("name").alias("name")).select("node_id", F.expr("left(name, k)").alias("token"))
    wanted = tokens.select("token").distinct()
    return tokens.join(cuts.join(wanted, "token"), "token")


def _by_part(tokens: DataFrame, procs: DataFrame) -> DataFrame:
    """tokens joined to the procs whose key contains the token."""
    # Keys are names of jobs: a dozen characters, so few parts each.
    every = "flatten(transform(sequence(1, length(low)), i -> transform(sequence(1, length(low) - i + 1), n -> substring(low, i, n))))"
    cuts = procs.filter("low != ''").select("node_id", F.explode(F.array_distinct(F.expr(every))).alias("token"))
    wanted = tokens.select("token").distinct()
    return tokens.join(cuts.join(wanted, "token"), "token")


def _names(tokens: DataFrame, kind: str) -> DataFrame:
    return tokens.filter(F.col("kind") == kind).select("log_path", "token")


def script_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """token, node_id: the names under which a log may mean a script, each with the procs that run it.

    A script is meant by its name and by any text that its original path ends with; such a text
    has no slash, so it ends the path's last part.
    """
    runs = scripts_run_by(nodes, edges).select("script", F.col("proc_id").alias("node_id")).distinct()
    if "original_path" not in nodes.columns:
        return runs.select(F.col("script").alias("token"), "node_id")
    paths = nodes.filter("type = 'script' and original_path is not null").select(F.col("display_name").alias("script"), base_name("original_path").alias("name")).filter("name != ''")
    ends = paths.select("script", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", i, F.length("name")))).alias("token"))
    names = ends.unionByName(runs.select("script", F.col("script").alias("token"))).distinct()
    return runs.join(names, "script").select("token", "node_id").distinct()


def match_scores(lines: DataFrame, nodes: DataFrame, edges: DataFrame, tokens: DataFrame | None = None, alone: int | None = None) -> DataFrame:
    """log_path, node_id, strategy, token, points (tenths): everything that speaks for a node.

    ``tokens`` are those of the lines if they are at hand; the lines are then read for their
    paths only. ``alone``: of the procs for which nothing but the client speaks, all alike,
    only so many are listed, by node id (None: all).
    """
    tokens = checkpointed(log_tokens(lines)) if tokens is None else tokens
    procs = _procs(nodes)

    # All names that a proc may begin with are looked up in one join; the paths are read once.
    each = [("path", F.col("proc_name")), ("base", F.nullif("base_proc", "proc_name")), ("cid", F.col("cid"))]
    own_names = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("token")) for k, c in each])).alias("t")
    names = path_features(lines).select("log_path", own_names).select("log_path", "t.kind", "t.token").filter("token is not null")
    names = names.unionByName(_names(tokens, "prefix").select("log_path", F.lit("prefix").alias("kind"), "token"))
    cuts = procs.select("node_id", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("k"), F.lower("name").alias("name")).select("node_id", F.expr("left(name, k)").alias("token"), (F.col("k") == F.length("name")).alias("whole"))
    by_client = names.filter("kind = 'cid'").select("log_path", "token")
    if alone is not None:
        names = names.filter("kind != 'cid'")
    hits = checkpointed(names.join(cuts, "token"))
    # Whether a token is a whole name, and which of a log's own names is one, decides what counts.
    whole = hits.filter("kind = 'prefix' and whole").select("token").distinct().withColumn("is_name", F.lit(True))
    own = hits.filter("whole and kind in ('path', 'base')").groupBy("log_path").agg(F.max(F.col("kind") == "path").alias("by_path"))
    d = hits.join(whole, "token", "left").join(own, "log_path", "left")
    kind, full = F.col("kind"), F.col("whole")
    strategy = (
        F.when((kind == "prefix") & full, "prefix_exact").when((kind == "prefix") & F.col("is_name").isNull(), "prefix_partial").when((kind == "path") & full, "path_exact")
        .when((kind == "base") & full & ~F.col("by_path"), "path_base").when((kind == "path") & F.col("by_path").isNull(), "path_partial").when(kind == "cid", "cid")
    )
    points = F.lit(None).cast("int")
    for name, n in (("prefix_exact", PREFIX_EXACT), ("prefix_partial", PREFIX_PARTIAL), ("path_exact", PATH_EXACT), ("path_base", PATH_BASE), ("path_partial", PATH_PARTIAL), ("cid", CID)):
        points = F.when(F.col("strategy") == name, n).otherwise(points)
    named = d.withColumn("strategy", strategy).filter("strategy is not null").select("log_path", "node_id", "strategy", "token", points.alias("points"))
    scripts = _names(tokens, "script_path").select("log_path", base_name("token").alias("token")).distinct()
    by_script = scripts.join(script_names(nodes, edges), "token")
    by_jid = _by_part(_names(tokens, "jid"), procs)
    for part, name, n in ((by_script, "script", SCRIPT), (by_jid, "jid", JID)):
        named = named.unionByName(part.select("log_path", "node_id", F.lit(name).alias("strategy"), "token", F.lit(n).alias("points")))
    if alone is None:
        return named
    some = named.select("log_path", "node_id").distinct().join(by_client, "log_path").join(procs.select("node_id", F.lower("name").alias("name")), "node_id").filter(F.startswith("name", "token"))
    first = cuts.join(by_client.select("token").distinct(), "token").withColumn("n", F.row_number().over(Window.partitionBy("token").orderBy("node_id"))).filter(F.col("n") <= alone)
    client = some.select("log_path", "node_id", "token").unionByName(by_client.join(first, "token").select("log_path", "node_id", "token")).distinct()
    return named.unionByName(client.select("log_path", "node_id", F.lit("cid").alias("strategy"), "token", F.lit(CID).alias("points")))


def match_logs(lines: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 1, tokens: DataFrame | None = None) -> DataFrame:
    """log_path, place, node_id, key, points (tenths), confidence: the best ``top`` procs of each log, ties by node id."""
    total = match_scores(lines, nodes, edges, tokens, alone=top).groupBy("log_path", "node_id").agg(F.sum("points").alias("points"))
    order = Window.partitionBy("log_path").orderBy(F.desc("points"), "node_id")
    best = total.withColumn("place", F.row_number().over(order).cast("int")).filter(F.col("place") <= top)
    confidence = F.round(F.least(F.lit(1.0), F.col("points") / FULL), 4)
    return best.join(nodes.select(F.col("id").alias("node_id"), "key"), "node_id").select("log_path", "place", "node_id", "key", "points", confidence.alias("confidence"))


def forced_matches(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """proc, node_id, key, confidence for given names: equal 1.0, else beginning 1.0, else containing 0.9; least key first."""
    procs = _procs(nodes)
    w = wanted.select(F.lower("proc").alias("token")).distinct().withColumn("log_path", F.col("token"))
    tiers = [
        (w.join(procs.select("node_id", F.lower("name").alias("token")), "token"), 0, 1.0),
        (_by_prefix(w, procs), 1, 1.0),
        (_by_part(w, procs), 2, 0.9),
    ]
    out = None
    for d, tier, confidence in tiers:
        part = d.select("token", "node_id", F.lit(tier).alias("tier"), F.lit(confidence).alias("confidence"))
        out = part if out is None else out.unionByName(part)
    out = out.join(procs.select("node_id", "key"), "node_id")
    best = out.withColumn("n", F.row_number().over(Window.partitionBy("token").orderBy("tier", "key", "node_id"))).filter("n = 1")
    return best.select(F.col("token").alias("proc"), "node_id", "key", "confidence")
