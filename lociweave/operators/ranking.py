"""Rankings, contributions and comparisons of programs as windows and joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_genes(scores: DataFrame, n: int = 8, kind: str = "pos", by: list[str] | None = None) -> DataFrame:
    """The ``n`` first genes of (gene_id, score) in each ``by``: by size, from the top or from the bottom; ties by gene."""
    orders = {"abs": F.desc(F.abs("score")), "pos": F.desc("score"), "neg": F.asc("score")}
    if kind not in orders:
        raise ValueError(f"unknown kind {kind!r}")
    rank = F.row_number().over(W.partitionBy(*(by or [])).orderBy(orders[kind], "gene_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)


def cumulative_contribution(loadings: DataFrame) -> DataFrame:
    """(mode, gene_id, rank, share): running share of squared loadings, largest first; zero throughout for a mode of zeros."""
    square = F.col("v") * F.col("v")
    along = W.partitionBy("mode").orderBy(F.desc(square), "gene_id")
    total = F.sum(square).over(W.partitionBy("mode"))
    share = F.try_divide(F.sum(square).over(along.rowsBetween(W.unboundedPreceding, 0)), total)
    return loadings.select("mode", "gene_id", F.row_number().over(along).alias("rank"), F.coalesce(share, F.lit(0.0)).alias("share"))


def fractional_energy(modes: DataFrame) -> DataFrame:
    """(spot_id, mode, energy): squared mode values over their sum for the spot."""
    square = F.col("value") * F.col("value")
    return modes.select("spot_id", "mode", (square / (F.sum(square).over(W.partitionBy("spot_id")) + 1e-12)).alias("energy"))


def gene_loading_mass(loadings: DataFrame, eigenvalues: DataFrame | None = None) -> DataFrame:
    """(gene_id, mass): squared loadings summed over modes, weighted by eigenvalue if given."""
    if eigenvalues is None:
        return loadings.groupBy("gene_id").agg(F.sum(F.col("v") * F.col("v")).alias("mass"))
    rows = loadings.join(F.broadcast(eigenvalues), "mode")  # a row for each mode
    return rows.groupBy("gene_id").agg(F.sum(F.col("eigenvalue") * F.col("v") * F.col("v")).alias("mass"))


def choose_k_energy(eigenvalues: DataFrame, energy: float = 0.9) -> DataFrame:
    """(k): the first k whose share of the total reaches ``energy``; one more than all if none does, 0 without any weight."""
    along = W.orderBy("mode").rowsBetween(W.unboundedPreceding, 0)
    rows = eigenvalues.select("mode", F.sum("eigenvalue").over(along).alias("run"), F.sum("eigenvalue").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    reached = F.min(F.when(F.try_divide("run", "total") >= energy, F.col("mode") + 1))
    return rows.agg(F.when((F.count("*") == 0) | (F.max("total") <= 0), F.lit(0)).otherwise(F.coalesce(reached, F.count("*") + 1)).cast("long").alias("k"))


def choose_k_elbow(eigenvalues: DataFrame, k_max: int = 50) -> DataFrame:
    """(k): two more than the place of the sharpest bend of the log spectrum, within 2..k_max; the size if under 3."""
    w = W.orderBy("mode")
    log = F.ln(F.greatest(F.col("eigenvalue"), F.lit(1e-30)))
    used = eigenvalues.where(F.col("mode") < k_max).withColumn("l", log)
    bends = used.select("mode", (F.lead("l", 2).over(w) - 2 * F.lead("l", 1).over(w) + F.col("l")).alias("bend"))
    best = F.min_by("mode", F.when(F.col("bend").isNotNull(), F.struct("bend", "mode")))
    n = F.count("*")
    return bends.agg(F.when(n < 3, n).otherwise(F.greatest(F.lit(2), F.least(F.lit(k_max), best + 2))).cast("long").alias("k"))


def choose_k(eigenvalues: DataFrame, energy: float = 0.9, k_max: int = 50) -> DataFrame:
    """(k): at least 2, else the least of both choices and the size."""
    both = choose_k_energy(eigenvalues, energy).select(F.col("k").alias("a")).join(choose_k_elbow(eigenvalues, k_max).select(F.col("k").alias("b")), how="cross")
    size = eigenvalues.agg(F.count("*").alias("n"))
    return both.join(size, how="cross").select(F.greatest(F.lit(2), F.least("a", "b", "n")).cast("long").alias("k"))  # one row each


#: Values of a mode that one task's buffer holds at most, and cells that a step of ``quantiles`` cuts a range into.
HELD, GRID = 100_000, 256


def quantiles(rows: DataFrame, shares: tuple[float, ...], held: int = HELD) -> DataFrame:
    """(mode, p0, p1, ..): exact quantiles of (mode, value), interpolated between neighbours in rank; no buffer holds more than ``held`` values.

    For modes of more values each quantile's range is narrowed: a sketch of the range cuts it into cells, those about the
    wanted rank become the range, and exact counts of what lies below and inside say whether the rank is in it. What
    reaches the driver is a row for each mode and quantile.
    """
    spark, kind = rows.sparkSession, rows.schema["mode"].dataType.simpleString()
    sizes = {r["mode"]: r["n"] for r in rows.groupBy("mode").agg(F.count("*").alias("n")).collect()}
    ranks = {(m, k): p * (n - 1) for m, n in sizes.items() for k, p in enumerate(shares)}
    # of each mode and quantile the range that has the values of both ranks about it, and how many values lie below
    ranges = {t: (float("-inf"), float("inf"), 0, sizes[t[0]]) for t in ranks}
    grid = F.array(*[F.lit(x / GRID) for x in range(GRID + 1)])

    def inside() -> DataFrame:
        table = spark.createDataFrame([(m, k, lo, hi) for (m, k), (lo, hi, *_) in ranges.items()], f"mode {kind}, k int, lo double, hi double")
        return rows.join(F.broadcast(table), "mode").where("value BETWEEN lo AND hi")  # a row for each mode and quantile

    wide = {t for t, x in ranges.items() if x[3] > held}
    while wide:
        cells = {(r["mode"], r["k"]): r["c"] for r in inside().groupBy("mode", "k").agg(F.percentile_approx("value", grid, F.lit(100 * GRID)).alias("c")).collect()}
        reach, left = 2, set(wide)
        tried: dict = {}
        while left:
            for t in left:
                lo, hi, below, n = ranges[t]
                at = int((ranks[t] - below) / n * GRID)
                tried[t] = (cells[t][max(at - reach, 0)] if at > reach else lo, cells[t][min(at + 1 + reach, GRID)] if at + 1 + reach < GRID else hi)
            table = spark.createDataFrame([(*t, *tried[t]) for t in left], f"mode {kind}, k int, a double, b double")
            found = rows.join(F.broadcast(table), "mode").groupBy("mode", "k").agg(F.count_if(F.col("value") < F.col("a")).alias("below"), F.count_if(F.col("value").between(F.col("a"), F.col("b"))).alias("n")).collect()
            for r in found:
                t = (r["mode"], r["k"])
                if r["below"] <= int(ranks[t]) and r["below"] + r["n"] >= min(int(ranks[t]) + 2, sizes[t[0]]):
                    # one value, however often, takes one place; a range that does not get narrower is such values
                    if tried[t][0] == tried[t][1] or r["n"] <= held or r["n"] >= ranges[t][3]:
                        wide.discard(t)
                    ranges[t] = (*tried[t], r["below"], r["n"])
                    left.discard(t)
            reach *= 4
    table = spark.createDataFrame([(m, k, int(ranks[m, k]) - x[2], ranks[m, k] - int(ranks[m, k])) for (m, k), x in ranges.items()], f"mode {kind}, k int, at long, part double")
    # equal values are one row with their number, so ranks are sums over few rows
    counted = inside().groupBy("mode", "k", "value").agg(F.count("*").alias("n")).withColumn("end", F.sum("n").over(W.partitionBy("mode", "k").orderBy("value")))
    ends = counted.join(F.broadcast(table), ["mode", "k"]).groupBy("mode", "k", "part").agg(
        F.min(F.when(F.col("end") > F.col("at"), F.col("value"))).alias("x"), F.min(F.when(F.col("end") > F.col("at") + 1, F.col("value"))).alias("y"),
    )
    value = F.col("x") + F.when(F.col("part") > 0, F.col("part") * (F.col("y") - F.col("x"))).otherwise(F.lit(0.0))
    return ends.groupBy("mode").agg(*[F.max(F.when(F.col("k") == k, value)).alias(f"p{k}") for k in range(len(shares))])


def mode_clip_limits(modes: DataFrame, held: int = HELD) -> DataFrame:
    """(mode, low, high): 1st and 99th percentile of the values that are numbers, on either side of zero."""
    found = quantiles(modes.where(F.col("value").isNotNull() & ~F.isnan("value")).select("mode", "value"), (0.01, 0.99), held)
    return found.select("mode", F.least(F.col("p0"), F.lit(-1e-12)).alias("low"), F.greatest(F.col("p1"), F.lit(1e-12)).alias("high"))


def match_labels(spots: DataFrame, label: str, reference: str) -> DataFrame:
    """(label, reference, name): each label's most frequent reference, numbered where several labels share one."""
    counts = spots.groupBy(F.col(label).alias("label"), F.col(reference).alias("reference")).agg(F.count("*").alias("n"))
    best = counts.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), "reference"))).where("r = 1")
    same = W.partitionBy("reference")
    name = F.when(F.count("*").over(same) == 1, F.col("reference").cast("string")).otherwise(F.concat_ws(" ", F.col("reference").cast("string"), F.row_number().over(same.orderBy("label")).cast("string")))
    return best.select("label", "reference", name.alias("name"))


def gene_cluster_sums(expression: DataFrame, clusters: DataFrame) -> DataFrame:
    """(spot_id, cluster, total) of the genes' values in each cluster."""
    return expression.join(clusters, "gene_id").groupBy("spot_id", "cluster").agg(F.sum("value").alias("total"))


def compare_components(a: DataFrame, b: DataFrame) -> DataFrame:
    """(mode_a, mode_b, cosine, best) of loadings (gene_id, mode, v): all modes against all, on the genes of both.

    A mode that is zero on those genes has no direction: reading the result then fails with an error that says so.
    """
    shared = a.select("gene_id").distinct().join(b.select("gene_id").distinct(), "gene_id", "left_semi")
    size = lambda m: F.when(F.col(f"n_{m}") > 0, F.col(f"n_{m}")).otherwise(F.raise_error(F.concat(F.lit(f"no comparison: zero norm of {m} "), F.col(m).cast("string"))))
    norm = lambda df, m: df.join(shared, "gene_id", "left_semi").groupBy(F.col("mode").alias(m)).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias(f"n_{m}"))
    left, right = a.select("gene_id", F.col("mode").alias("mode_a"), F.col("v").alias("x")), b.select("gene_id", F.col("mode").alias("mode_b"), F.col("v").alias("y"))
    dots = left.join(right, "gene_id").groupBy("mode_a", "mode_b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    rows = dots.join(norm(a, "mode_a"), "mode_a").join(norm(b, "mode_b"), "mode_b").withColumn("cosine", F.col("dot") / (size("mode_a") * size("mode_b")))
    best = F.row_number().over(W.partitionBy("mode_a").orderBy(F.desc(F.abs("cosine")), "mode_b")) == 1
    return rows.select("mode_a", "mode_b", "cosine", best.alias("best"))


def subspace_overlap(pairs: DataFrame, within_b: DataFrame) -> DataFrame:
    """(mode_a, overlap): the share of each mode of A, squared, that lies in the span of B's modes, between 0 and 1.

    ``pairs`` are A's cosines with B's modes, ``within_b`` those of B's modes with each other, which need not be
    orthogonal: the inverse of that table, a number for each two modes, is taken on the driver.
    """
    rows = within_b.select("mode_a", "mode_b", "cosine").collect()
    modes = sorted({r["mode_a"] for r in rows})
    gram = np.zeros((len(modes), len(modes)))
    for r in rows:
        gram[modes.index(r["mode_a"]), modes.index(r["mode_b"])] = r["cosine"]
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    table = within_b.sparkSession.createDataFrame([(i, j, float(inverse[x, y])) for x, i in enumerate(modes) for y, j in enumerate(modes)], "mode_b int, mode_c int, inverse double")
    first = pairs.select("mode_a", "mode_b", F.col("cosine").alias("cb"))
    second = pairs.select("mode_a", F.col("mode_b").alias("mode_c"), F.col("cosine").alias("cc"))
    both = first.join(F.broadcast(table), "mode_b").join(second, ["mode_a", "mode_c"])
    share = F.sum(F.col("cb") * F.col("inverse") * F.col("cc"))
    return both.groupBy("mode_a").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)).alias("overlap"))


def spectral_comparison(pairs: DataFrame, eigen_a: DataFrame, eigen_b: DataFrame, overlap: DataFrame, key: str = "program") -> DataFrame:
    """One row for each mode of A: its best match, its overlap with B's span, and B's eigenvalues weighted by squared cosines."""
    square = F.col("cosine") * F.col("cosine")
    scores = pairs.join(F.broadcast(eigen_b.select(F.col("mode").alias("mode_b"), F.col("eigenvalue").alias("lb"))), "mode_b")
    sums = scores.groupBy("mode_a").agg(
        F.max(F.when(F.col("best"), F.col("mode_b"))).alias("best_b"), F.max(F.when(F.col("best"), F.col("cosine"))).alias("signed_cosine"),
        F.max(F.when(F.col("best"), F.abs("cosine"))).alias("absolute_cosine"), F.max(F.when(F.col("best"), F.col("lb"))).alias("eigenvalue_b"),
        F.sum(square * F.col("lb")).alias("signed_spectral_score_b"), F.sum(square * F.abs("lb")).alias("absolute_spectral_score_b"),
    )
    share = lambda df: F.coalesce(F.try_divide(F.abs("eigenvalue"), F.sum(F.abs("eigenvalue")).over(W.partitionBy())), F.lit(0.0))
    a = eigen_a.select(F.col("mode").alias("mode_a"), F.col("eigenvalue").alias("eigenvalue_a"), share(eigen_a).alias("spectral_fraction_a"))
    b = eigen_b.select(F.col("mode").alias("best_b"), share(eigen_b).alias("spectral_fraction_b"))
    found = sums.join(a, "mode_a").join(b, "best_b").join(overlap, "mode_a")
    return found.select(
        F.col("mode_a").alias(f"{key}_a"), F.col("best_b").alias(f"best_{key}_b"), "signed_cosine", "absolute_cosine", F.col("overlap").alias("subspace_overlap_b"),
        "eigenvalue_a", "eigenvalue_b", "spectral_fraction_a", "spectral_fraction_b", "signed_spectral_score_b", "absolute_spectral_score_b",
    )


def gene_report(scores: DataFrame, n: int = 8) -> DataFrame:
    """(mode, rank, abs_gene, abs_score, pos_gene, ...): each mode's first genes by size, from the top and from the bottom, side by side."""
    out = None
    for kind in ("abs", "pos", "neg"):
        part = top_genes(scores, n, kind, ["mode"]).select("mode", "rank", F.col("gene_id").alias(f"{kind}_gene"), F.col("score").alias(f"{kind}_score"))
        out = part if out is None else out.join(part, ["mode", "rank"])
    return out
