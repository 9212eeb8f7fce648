"""Sources mixed to target shares of all tokens.

The size of a document is its number of tokens of a public tokenizer. The mix is as large
as the scarcest source allows: with ``total`` left open, total = min over the sources of
max_repeats * tokens / share, so that every source present reaches its share. Each
document of a source then has the same expected number of copies, share * total / tokens.
Systematic sampling turns that into whole copies: within a source the expected copies are
summed up along a fixed order, one random offset is added, and a copy is emitted for each
whole number that the sum passes. The order runs by size class and then by hash, so every
size is thinned or repeated alike. A few long documents more or less still move a small
source, so the offset is drawn as one of ``OFFSETS`` evenly spaced ones from a random start,
that which brings the source's tokens closest to their goal.

No source is sorted in one task: cells of (source, size class, hash slot) are counted, the
positions of the cells are summed over that small table, and documents are numbered within
their cell.

Defined results
  source without target, null source   not in the mix
  target without documents             reported with zero tokens; the shares of the others
                                       are scaled to what is present
  null or empty text                   no tokens: never emitted, never counted
  share 0 or null, max_repeats < 1     the source gives nothing
  repeated target rows of a source     the first by (share, repeats) counts
  repeated rows                        documents of their own
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.runtime import checkpointed

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are split before merging (fixed value of that tokenizer).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Offsets of a source that are compared.
OFFSETS = 32
#: Documents of a cell that one task numbers, about.
CELL_ROWS = 100_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens: every document, 0 for null texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": n})

    return documents.select(F.col("doc_id").cast("long"), "source", "text").mapInPandas(run, "doc_id long, source string, n_tokens long")


def plan_mix(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row per target source: share, max_repeats, n_docs, tokens, goal_share (of what is present), copies (expected per document), binds (repeated as often as allowed, so the mix grows no further)."""
    have = sized.filter("n_tokens > 0").groupBy(F.col("source").alias("src")).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    wanted = targets.filter("source is not null").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("source", F.coalesce("t.target_share", F.lit(0.0)).alias("target_share"), F.coalesce("t.max_repeats", F.lit(0)).alias("max_repeats"))
    plan = wanted.join(have, F.col("source") == F.col("src"), "left").drop("src").fillna(0, ["n_docs", "tokens"])
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1)
    every = Window.partitionBy()  # one row per target source
    plan = plan.withColumn("present", F.sum(F.when(usable, F.col("target_share"))).over(every))
    plan = plan.withColumn("goal_share", F.when(usable, F.col("target_share") / F.col("present")).otherwise(0.0))
    bound = F.min(F.when(usable, F.col("max_repeats") * F.col("tokens") / F.col("goal_share"))).over(every)
    size: Column = bound if total is None else F.lit(float(total))
    plan = plan.withColumn("total", size).withColumn("binds", F.coalesce(usable & (F.col("max_repeats") * F.col("tokens") / F.col("goal_share") <= F.col("total") * (1 + 1e-9)), F.lit(False)))
    copies = F.least(F.col("goal_share") * F.col("total") / F.col("tokens"), F.col("max_repeats").cast("double"))
    return plan.withColumn("copies", F.when(usable, copies).otherwise(0.0)).drop("present")


def sample_copies(sized: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, n_tokens, n_copies of every document of which the mix holds a copy."""
    rates = plan.filter("copies > 0").select("source", "copies", (F.col("copies") * F.col("tokens")).alias("goal"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / CELL_ROWS)).alias("slots"))
    d = sized.filter("n_tokens > 0").join(rates, "source")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    size_class = F.floor(F.log2(F.col("n_tokens").cast("double")) * 8).cast("int")
    d = d.select("doc_id", "source", "n_tokens", "copies", "goal", size_class.alias("size_class"), F.pmod(h, F.col("slots")).alias("slot"), h.alias("h"))
    cell = ["source", "size_class", "slot"]
    before = Window.partitionBy("source").orderBy("size_class", "slot").rowsBetween(Window.unboundedPreceding, -1)
    cells = d.groupBy(*cell).agg(F.count("*").alias("k")).select(*cell, F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    d = d.withColumn("i", F.row_number().over(Window.partitionBy(*cell).orderBy("h", "doc_id", "n_tokens"))).join(cells, cell)
    d = checkpointed(d.select("doc_id", "source", "n_tokens", "copies", "goal", (F.col("first") + F.col("i")).alias("place")))

    def passed(offset: Column) -> Column:
        return F.floor(F.col("copies") * F.col("place") + offset) - F.floor(F.col("copies") * (F.col("place") - 1) + offset)

    # evenly spaced offsets in [0, 1) from a random start; the sums of all of them take one partial aggregation
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    offsets = [F.pmod(start + j / OFFSETS, F.lit(1.0)) for j in range(OFFSETS)]
    sums = d.groupBy("source").agg(F.first("goal").alias("goal"), *[F.sum(passed(o) * F.col("n_tokens")).alias(f"t{j}") for j, o in enumerate(offsets)])
    nearest = F.least(*[F.struct(F.abs(F.col(f"t{j}") - F.col("goal")).alias("miss"), o.alias("offset")) for j, o in enumerate(offsets)])
    chosen = sums.select("source", nearest["offset"].alias("offset"))  # one row per source
    d = d.join(chosen, "source")
    return d.select("doc_id", "source", "n_tokens", passed(F.col("offset")).cast("int").alias("n_copies")).filter("n_copies > 0")


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, copy_no) and its report by source.

    The report has target_share, goal_share, real_share, max_repeats, most_copies, binds and
    the documents and tokens there are and in the mix.
    """
    sized = checkpointed(count_tokens(documents, tokenizer))
    plan = plan_mix(sized, targets, total)
    taken = checkpointed(sample_copies(sized, plan, seed))
    rows = taken.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))
    used = taken.groupBy(F.col("source").alias("src")).agg(F.sum("n_copies").alias("copies_in"), F.sum(F.col("n_copies") * F.col("n_tokens")).alias("tokens_in"), F.max("n_copies").alias("most_copies"))
    report = plan.join(used, F.col("source") == F.col("src"), "left").fillna(0, ["copies_in", "tokens_in", "most_copies"])
    all_in = F.sum("tokens_in").over(Window.partitionBy())  # one row per target source
    report = report.select("source", "target_share", "goal_share", F.when(all_in > 0, F.col("tokens_in") / all_in).otherwise(0.0).alias("real_share"), "max_repeats", "most_copies", "binds", "n_docs", "tokens", "copies_in", "tokens_in")
    return rows, report
