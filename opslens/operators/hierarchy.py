"""Parent-child links to full hierarchies.

Each node has at most one parent, so the links form trees and loops. They are solved in
rounds. A round puts a node beside its parent where the parent's hash is a local minimum
(at least a third of the links of any shape come to lie within one partition), follows
the chains inside each partition to the first node outside (the exit of the fragment),
and keeps only exits as the next, smaller problem. The links themselves are always
contracted; only a quotient of at most ``base_rows`` links that came out of a round is
followed in one task. The answers are then expanded round by round: a node's root is its
exit's root and its depth the exit's depth plus the steps to the exit. Loops inside a
partition are found there, loops over several partitions in a later round.

Defined results
  null src, dst or rel_type   the row is no link
  repeated links              count once
  several parents             the smallest counts (the data promise one)
  own parent                  a loop of one
  nodes on or below a loop    root is the smallest id on the loop, depth -1, path null
  empty table                 empty result
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.runtime import checkpointed

#: Links of a contracted forest that one task follows in memory.
BASE_ROWS = 2_000
#: Links of a round that one task gets, about; at a quarter of it a parent keeps its own place.
TASK_ROWS = 100_000

_FRAGMENT = "rel string, node long, exit long, steps int, low long, looped boolean, way array<long>"


def parent_links(edges: DataFrame, rel_types: list[str] | None = None) -> DataFrame:
    """(rel, node, parent) of the edges' src -> dst, rel_type in capitals without outer blanks."""
    rel = F.upper(F.trim("rel_type"))
    links = edges.select(rel.alias("rel"), F.col("src").cast("long").alias("parent"), F.col("dst").cast("long").alias("node")).filter("rel is not null and parent is not null and node is not null")
    if rel_types:
        links = links.filter(F.col("rel").isin([r.upper() for r in rel_types]))
    return links.groupBy("rel", "node").agg(F.min("parent").alias("parent"))


def _follow(with_way: bool):
    """Follows the chains of one partition; a link is (rel, node, exit, steps, low, way) of the round before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        for rel, own in pdf.groupby("rel", sort=False):
            nodes, exits = own["node"].tolist(), own["exit"].tolist()
            steps, lows = own["steps"].tolist(), own["low"].tolist()
            ways = own["way"].tolist() if with_way else None
            at = {n: i for i, n in enumerate(nodes)}
            done: dict[int, tuple] = {}
            for start in range(len(nodes)):
                chain, i, on = [], start, set()
                while i is not None and i not in done and i not in on:
                    on.add(i)
                    chain.append(i)
                    i = at.get(exits[i])
                if i is not None and i in on:  # a loop within this partition
                    k = chain.index(i)
                    low = min(lows[j] for j in chain[k:])
                    for j in chain[k:]:
                        done[j] = (low, 0, low, True, None)
                    chain = chain[:k]
                for j in reversed(chain):
                    nxt = at.get(exits[j])
                    if nxt is None:
                        done[j] = (exits[j], steps[j], lows[j], False, ways[j] if with_way else None)
                        continue
                    out, n, low, looped, way = done[nxt]
                    if looped:
                        done[j] = (out, 0, low, True, None)
                    else:
                        done[j] = (out, n + steps[j], min(low, lows[j]), False, [*way, *ways[j]] if with_way else None)
            res = [done[i] for i in range(len(nodes))]
            yield pd.DataFrame({"rel": rel, "node": nodes, "exit": [r[0] for r in res], "steps": [r[1] for r in res], "low": [r[2] for r in res], "looped": [r[3] for r in res], "way": [r[4] for r in res]})

    return run


def _place(links: DataFrame, parts: int, task_rows: int, round_no: int) -> DataFrame:
    """Partitions links so that local minima of the round's hash attract their children."""
    # Nodes with too many children for one task keep their own place and are left as exits.
    hot = links.groupBy("rel", "exit").count().filter(F.col("count") > task_rows // 4).select("rel", "exit", F.lit(True).alias("hot"))

    def mix(c: str) -> Column:
        return F.xxhash64(F.lit(round_no), F.col("rel"), F.col(c))

    attracted = (mix("exit") < mix("node")) & F.col("hot").isNull()
    return links.join(hot, ["rel", "exit"], "left").withColumn("spot", F.when(attracted, mix("exit")).otherwise(mix("node"))).repartition(parts, "spot").drop("hot", "spot")


def _solve(links: DataFrame, n: int, base_rows: int, task_rows: int, with_way: bool, round_no: int) -> DataFrame:
    """(rel, node, root, depth, way) of links (rel, node, exit, steps, low, way)."""
    base = round_no > 0 and n <= base_rows
    cores = links.sparkSession.sparkContext.defaultParallelism
    parts = max(2, min(-(-n * 2 // base_rows), cores), -(-n // task_rows))
    placed = links.coalesce(1) if base else _place(links, parts, task_rows, round_no)
    fragments = placed.mapInPandas(_follow(with_way), _FRAGMENT)
    looped = F.col("looped")
    if base:
        return fragments.select("rel", "node", F.col("exit").alias("root"), F.when(looped, -1).otherwise(F.col("steps")).alias("depth"), "way")
    fragments = checkpointed(fragments)
    exits = fragments.filter(~looped).select("rel", F.col("exit").alias("node")).distinct()
    rest = checkpointed(fragments.join(exits, ["rel", "node"], "left_semi"))
    # Loops closed inside a partition are solved; their nodes answer for the chains that end in them.
    closed = rest.filter(looped).select("rel", "node", F.col("exit").alias("root"), F.lit(-1).alias("depth"), "way")
    open_links = rest.filter(~looped).drop("looped")
    left = open_links.count()
    above = closed
    if left:
        # A closed node is an exit without a link of its own in the next round: a root there.
        above = _solve(open_links, left, base_rows, task_rows, with_way, round_no + 1).unionByName(closed)
        via = closed.select("rel", F.col("node").alias("root"), F.col("root").alias("loop_root"))
        above = above.join(via, ["rel", "root"], "left").select(
            "rel", "node", F.coalesce("loop_root", "root").alias("root"), F.when(F.col("loop_root").isNotNull(), -1).otherwise(F.col("depth")).alias("depth"), F.when(F.col("loop_root").isNull(), F.col("way")).alias("way")
        )
    up = above.select("rel", F.col("node").alias("exit"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"), F.col("way").alias("up_way"))
    ends = fragments.filter(~looped).join(up, ["rel", "exit"], "left")
    in_loop = F.col("up_depth") < 0
    way = F.when(in_loop, None).when(F.col("up_root").isNull(), F.col("way")).otherwise(F.concat("up_way", "way")) if with_way else F.col("way")
    expanded = ends.select("rel", "node", F.coalesce("up_root", "exit").alias("root"), F.when(in_loop, -1).otherwise(F.col("steps") + F.coalesce("up_depth", F.lit(0))).alias("depth"), way.alias("way"))
    return expanded.unionByName(fragments.filter(looped).select("rel", "node", F.col("exit").alias("root"), F.lit(-1).alias("depth"), "way"))


def hierarchy(edges: DataFrame, rel_types: list[str] | None = None, with_path: bool = False, base_rows: int = BASE_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """rel_type, node_id, root_id, depth[, path] of every node that is src or dst of a link.

    ``edges``: src, dst, rel_type; other columns are ignored. ``path`` is the array of ids
    from the root to the node, null on and below loops.
    """
    links = checkpointed(parent_links(edges, rel_types))
    way = F.array("node") if with_path else F.lit(None).cast("array<long>")
    start = links.select("rel", "node", F.col("parent").alias("exit"), F.lit(1).alias("steps"), F.col("node").alias("low"), way.alias("way"))
    solved = _solve(start, links.count(), base_rows, task_rows, with_path, 0)
    tops = links.select("rel", F.col("parent").alias("node")).distinct().join(links, ["rel", "node"], "left_anti")
    tops = tops.select("rel", "node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.lit(None).cast("array<long>").alias("way"))
    out = solved.unionByName(tops)
    cols = [F.col("rel").alias("rel_type"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth")]
    if with_path:
        cols.append(F.when(F.col("depth") >= 0, F.concat(F.array("root"), F.coalesce("way", F.array().cast("array<long>")))).alias("path"))
    return out.select(*cols)


def descendants(paths: DataFrame) -> DataFrame:
    """rel_type, ancestor_id, node_id, distance for every node and each node above it, from ``hierarchy(with_path=True)``."""
    return paths.filter("depth > 0").select("rel_type", "node_id", "depth", F.posexplode(F.slice("path", 1, F.col("depth"))).alias("pos", "ancestor_id")).select("rel_type", "ancestor_id", "node_id", (F.col("depth") - F.col("pos")).alias("distance"))
