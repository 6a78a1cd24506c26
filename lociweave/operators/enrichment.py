"""Ranked gene lists and the running-sum enrichment of gene sets in them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.lineage import cut


def ranked_list(scores: DataFrame) -> DataFrame:
    """(mode, gene_id, score): means of repeated genes, without mitochondrial and ribosomal ones; null scores drop out."""
    drop = F.col("gene_id").startswith("MT-") | F.col("gene_id").startswith("RPL") | F.col("gene_id").startswith("RPS")
    return scores.where(F.col("score").isNotNull() & ~drop).groupBy("mode", "gene_id").agg(F.avg("score").alias("score"))


def _hits(ranked: DataFrame, sets: DataFrame, min_size: int, max_size: int) -> DataFrame:
    """The genes of each set along each ranking, with the running sum at each (``at``) and right before it (``before``)."""
    inside = ranked.join(sets, "gene_id")
    sizes = inside.groupBy("mode", "set_name").agg(F.count("*").alias("size"), F.sum(F.abs("score")).alias("weight")).where(F.col("size").between(min_size, max_size))
    totals = ranked.groupBy("mode").agg(F.count("*").alias("n"))
    # ranks once for each mode; hits only are enough, as the sum falls by equal steps between them
    order = W.partitionBy("mode").orderBy(F.desc("score"), "gene_id")
    hits = ranked.withColumn("rank", F.row_number().over(order)).join(sets, "gene_id").join(sizes, ["mode", "set_name"]).join(totals, "mode")
    along = W.partitionBy("mode", "set_name").orderBy("rank")
    hits = hits.withColumn("k", F.row_number().over(along))
    # scores of zero weigh alike; a set of all genes has no misses
    step = F.coalesce(F.try_divide(F.abs("score"), "weight"), F.lit(1.0) / F.col("size"))
    hits = hits.withColumn("step", step).withColumn("hit", F.sum("step").over(along.rowsBetween(W.unboundedPreceding, 0)))
    miss = (F.col("rank") - F.col("k")) / F.greatest(F.col("n") - F.col("size"), F.lit(1))
    return hits.select("mode", "set_name", "size", "gene_id", "rank", (F.col("hit") - miss).alias("at"), (F.col("hit") - F.col("step") - miss).alias("before"))


def _enrichment() -> Column:
    return F.when(F.col("top") >= -F.col("bottom"), F.col("top")).otherwise(F.col("bottom"))


def running_enrichment(ranked: DataFrame, sets: DataFrame, min_size: int = 15, max_size: int = 500) -> DataFrame:
    """(mode, set_name, size, enrichment): the largest deviation of the weighted running sum along each ranking."""
    ends = _hits(ranked, sets, min_size, max_size).groupBy("mode", "set_name", "size").agg(F.max("at").alias("top"), F.min("before").alias("bottom"))
    return ends.select("mode", "set_name", "size", _enrichment().alias("enrichment"))


def leading_edges(ranked: DataFrame, sets: DataFrame, min_size: int = 15, max_size: int = 500) -> DataFrame:
    """(mode, set_name, enrichment, leading): a set's genes up to the first peak of its running sum, or from its first lowest point on, in ranking order."""
    hit = F.struct("rank", "at", "before", "gene_id")
    rows = _hits(ranked, sets, min_size, max_size).groupBy("mode", "set_name").agg(F.max("at").alias("top"), F.min("before").alias("bottom"), F.sort_array(F.collect_list(hit)).alias("hits"))  # max_size at most
    first = lambda test: F.filter("hits", test)[0]["rank"]
    up, peak, trough = F.col("top") >= -F.col("bottom"), first(lambda x: x["at"] == F.col("top")), first(lambda x: x["before"] == F.col("bottom"))
    own = F.when(up, F.filter("hits", lambda x: x["rank"] <= peak)).otherwise(F.filter("hits", lambda x: x["rank"] >= trough))
    return rows.select("mode", "set_name", _enrichment().alias("enrichment"), F.transform(own, lambda x: x["gene_id"]).alias("leading"))


def permutation_scores(ranked: DataFrame, sets: DataFrame, permutations: int = 1000, seed: int = 42, min_size: int = 15, max_size: int = 500) -> DataFrame:
    """``running_enrichment`` with ``normalised`` (over the mean of random sets of its size and sign) ``p`` and ``q``.

    A random set of a size is drawn from the mode's ranking; (mode, size) groups are independent tasks, each
    with one ranking of genes, whatever the number of spots or sets.
    """
    found = running_enrichment(ranked, sets, min_size, max_size)
    jobs = found.select("mode", "size").distinct().join(ranked, "mode")
    kind = found.schema["mode"].dataType.simpleString()

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "gene_id"], ascending=[False, True])
        size, weight = int(pdf["size"].iloc[0]), np.abs(pdf["score"].to_numpy(float))
        n, rng, out = len(weight), np.random.default_rng(seed), []
        for _ in range(permutations):
            at = np.sort(rng.choice(n, size, replace=False))
            own = weight[at] if weight[at].sum() > 0 else np.ones(size)
            hit = np.cumsum(own) / own.sum()
            miss = (at - np.arange(size)) / max(n - size, 1)
            top, bottom = (hit - miss).max(), (np.concatenate([[0], hit[:-1]]) - miss).min()
            out.append(top if top >= -bottom else bottom)
        return pd.DataFrame({"mode": pdf["mode"].iloc[0], "size": size, "null": [out]})

    nulls = jobs.groupBy("mode", "size").applyInPandas(draw, f"mode {kind}, size long, null array<double>")
    of = lambda side: F.filter("null", lambda x: x >= 0 if side > 0 else x < 0)
    mean = lambda side: F.greatest(F.abs(F.aggregate(of(side), F.lit(0.0), lambda a, x: a + x)) / F.greatest(F.size(of(side)), F.lit(1)), F.lit(1e-12))
    nulls = cut(nulls.withColumn("up", mean(1)).withColumn("down", mean(-1)))
    rows = found.join(nulls, ["mode", "size"]).withColumn("_same", F.when(F.col("enrichment") >= 0, of(1)).otherwise(of(-1)))
    beyond = F.size(F.filter("_same", lambda x: F.abs(x) >= F.abs("enrichment")))
    normalised = F.col("enrichment") / F.when(F.col("enrichment") >= 0, F.col("up")).otherwise(F.col("down"))
    scored = cut(rows.select("mode", "set_name", "size", "enrichment", normalised.alias("normalised"), (beyond / F.greatest(F.size("_same"), F.lit(1))).alias("p")))
    return scored.join(false_discovery(scored, nulls), ["mode", "set_name"])


def false_discovery(scored: DataFrame, nulls: DataFrame) -> DataFrame:
    """(mode, set_name, q): among the mode's normalised scores of a sign, the share of random ones at least as large over the share of observed ones, 1 at most.

    Random scores are counted between neighbouring observed ones where they lie, a few numbers for each set; sums of these
    counts over the mode's sets give every set's share. No list of all random scores is made.
    """
    @F.pandas_udf("array<long>")
    def counts(null: pd.Series, scale: pd.Series, at: pd.Series) -> pd.Series:
        """For each row how many of its random scores, over their mean, reach at least the 1st, 2nd, ... of ``at`` but not the next; those below all first."""
        return pd.Series([np.bincount(np.searchsorted(a, np.asarray(x) / s, side="right"), minlength=len(a) + 1) for x, s, a in zip(null, scale, at, strict=True)])

    signed = scored.select("mode", "set_name", "size", F.abs("normalised").alias("x"), (F.col("enrichment") >= 0).alias("up"))
    levels = signed.groupBy("mode", "up").agg(F.array_sort(F.collect_set("x")).alias("at"))  # a number for each set
    side = lambda up: F.transform(F.filter("null", lambda x: x >= 0 if up else x < 0), F.abs)
    both = nulls.select("mode", "size", F.explode(F.array(*[F.struct(F.lit(u).alias("up"), side(u).alias("null"), F.col("up" if u else "down").alias("scale")) for u in (True, False)])).alias("z"))
    sets = scored.select("mode", "size", "set_name").join(both, ["mode", "size"]).select("mode", "z.up", "z.null", "z.scale")
    binned = sets.join(levels, ["mode", "up"]).select("mode", "up", F.posexplode(counts("null", "scale", "at")).alias("bin", "n")).where("n > 0")
    binned = binned.groupBy("mode", "up", "bin").agg(F.sum("n").alias("n"))
    level = levels.select("mode", "up", F.posexplode("at").alias("bin", "x")).withColumn("bin", F.col("bin") + 1)
    mine = signed.join(level, ["mode", "up", "x"]).groupBy("mode", "up", "bin").agg(F.count("*").alias("own"))
    steps = binned.join(mine, ["mode", "up", "bin"], "full").fillna(0, ["n", "own"])  # a row for each observed score of a mode at most
    above, all_ = W.partitionBy("mode", "up").orderBy(F.desc("bin")), W.partitionBy("mode", "up")
    random = F.sum("n").over(above) / F.greatest(F.sum("n").over(all_), F.lit(1))
    observed = F.sum("own").over(above) / F.sum("own").over(all_)
    shares = steps.select("mode", "up", "bin", F.least(F.lit(1.0), random / observed).alias("q"))
    return signed.join(level, ["mode", "up", "x"]).join(shares, ["mode", "up", "bin"]).select("mode", "set_name", "q")
