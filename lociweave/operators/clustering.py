"""Communities of a nearest-neighbour graph by the Leiden method's local moves, refinement and aggregation: as joins while it is large, then in one task."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.lineage import cut
from .neighbours import nearest

#: Vertices that the one-task community step takes; rows up to which neighbours are exact.
LARGEST, EXACT = 100_000, 20_000


def _move(heads: np.ndarray, edges: np.ndarray, weights: np.ndarray, degree: np.ndarray, resolution: float, rng: np.random.Generator, bound: np.ndarray | None) -> np.ndarray:
    """Local moves to the neighbouring community of the largest modularity gain; ``bound``: stay inside this partition, and move only while alone."""
    n, total = len(degree), degree.sum()
    label, mass, size = np.arange(n), degree.copy(), np.ones(n, int)
    queue, waiting = deque(rng.permutation(n)), np.ones(n, bool)
    while queue:
        v = int(queue.pop())
        waiting[v] = False
        if bound is not None and size[label[v]] > 1:
            continue
        gain: dict[int, float] = {}
        for e in range(heads[v], heads[v + 1]):
            u = int(edges[e])
            if u != v and (bound is None or bound[u] == bound[v]):
                gain[int(label[u])] = gain.get(int(label[u]), 0.0) + weights[e]
        old = int(label[v])
        mass[old] -= degree[v]
        size[old] -= 1
        worth = lambda c, v=v: gain.get(c, 0.0) - resolution * degree[v] * mass[c] / total
        best = max([old, *sorted(gain)], key=lambda c: (worth(c), c == old))
        best = best if worth(best) > worth(old) + 1e-12 else old
        label[v] = best
        mass[best] += degree[v]
        size[best] += 1
        if best != old:
            for e in range(heads[v], heads[v + 1]):
                u = int(edges[e])
                if not waiting[u] and label[u] != best:
                    waiting[u] = True
                    queue.appendleft(u)
    return np.unique(label, return_inverse=True)[1]


def _rows(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((j, i))
    i, j, w = i[order], j[order], w[order]
    return np.searchsorted(i, np.arange(n + 1)), j, w


def leiden(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 0) -> np.ndarray:
    """Community of each of ``n`` vertices for symmetric edges (both directions), the largest first."""
    rng, member = np.random.default_rng(seed), np.arange(n)
    for _ in range(20):
        size = int(member.max()) + 1 if n else 0
        a, b = member[i], member[j]
        key, inverse = np.unique(a * size + b, return_inverse=True)
        heads, edges, weights = _rows(size, key // size, key % size, np.bincount(inverse, w))
        degree = np.zeros(size)
        np.add.at(degree, key // size, np.bincount(inverse, w))
        coarse = _move(heads, edges, weights, degree, resolution, rng, None)
        if coarse.max(initial=0) + 1 == size:
            break
        fine = _move(heads, edges, weights, degree, resolution, rng, coarse)  # parts of communities that hang together
        member = (fine if fine.max() + 1 < size else coarse)[member]
    counts = np.bincount(member, minlength=1)
    rank = np.empty(len(counts), int)
    rank[np.lexsort((np.arange(len(counts)), -counts))] = np.arange(len(counts))
    return rank[member]


def moved(edges: DataFrame, labels: DataFrame, degrees: DataFrame, total: float, resolution: float, turn: int, alone: bool = False, thin: int = 1) -> tuple[DataFrame, int, int]:
    """(v, c) after one turn of local moves, as joins, and how many vertices wished to move and did; modularity never falls.

    A turn's communities are by chance ones that vertices may leave or ones that they may join, and a vertex goes where its
    gain is largest. It is let go only if it gains even when all others go that want to: what it joins then weighs
    more, what it leaves weighs less. Gains so counted are at most the moves' true ones, together too. ``thin``: only
    one vertex in so many may move. ``alone``: only vertices that are communities of their own move.
    """
    joins = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 0
    placed = labels.join(degrees, "v")
    mass = placed.groupBy("c").agg(F.sum("degree").alias("mass"), F.count("*").alias("size"))
    may = ~joins("c") & (F.pmod(F.xxhash64("v", F.lit(-1 - turn)), F.lit(thin)) == 0)
    movers = placed.where(may).join(mass, "c").where("size = 1" if alone else "size > 0")
    movers = movers.select("v", F.col("c").alias("old"), "degree", F.col("mass").alias("old_mass"))
    toward = edges.where("i <> j").withColumnRenamed("i", "v").join(movers, "v").join(labels.select(F.col("v").alias("j"), "c"), "j")
    toward = toward.where((F.col("c") == F.col("old")) | joins("c")).groupBy("v", "old", "degree", "old_mass", "c").agg(F.sum("s").alias("s")).join(mass.select("c", "mass"), "c")
    heavy = lambda m: resolution / total * F.col("degree") * m
    here = F.col("c") == F.col("old")
    worth = F.round(F.col("s") - heavy(F.col("mass")), 9)
    best = toward.groupBy("v", "old", "degree", "old_mass").agg(F.sum(F.when(here, F.col("s")).otherwise(0.0)).alias("near"), F.max(F.when(~here, F.struct(worth.alias("worth"), "c", "s", "mass"))).alias("to"))
    gain = lambda joined, left: F.col("to.s") - F.col("near") - heavy(F.col("to.mass") + joined) + heavy(F.col("old_mass") - left)
    wish = cut(best.where("to IS NOT NULL").where(gain(F.lit(0.0), F.col("degree")) > 1e-9).withColumn("c", F.col("to.c")))
    joined = wish.groupBy("c").agg(F.sum("degree").alias("joined"))
    left = wish.groupBy("old").agg(F.sum("degree").alias("left"))
    go = wish.join(joined, "c").join(left, "old").where(gain(F.col("joined") - F.col("degree"), F.col("left")) > 1e-9).select("v", F.col("c").alias("new"))
    after = cut(labels.join(go, "v", "left").select("v", F.coalesce("new", "c").alias("c"), F.col("new").isNotNull().alias("went")))
    return after.select("v", "c"), wish.count(), after.where("went").count()


def _turns(edges: DataFrame, labels: DataFrame, degrees: DataFrame, total: float, resolution: float, alone: bool = False, most: int = 24) -> DataFrame:
    """Turns of moves until in three running under one in a thousand vertices wish to move; where most wishes are refused, fewer may move at once."""
    n, thin, quiet = degrees.count(), 1, 0
    for turn in range(most):
        labels, wished, went = moved(edges, labels, degrees, total, resolution, turn, alone, thin)
        quiet = quiet + 1 if 1000 * wished * thin <= n else 0
        if quiet == 3:
            break
        thin = min(64, thin * 2) if 2 * went < wished else max(1, thin // 2)
    return labels


def connected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(v, c): the connected parts of each community of ``labels``, each named by its smallest vertex. Such a cut never lowers modularity."""
    own, other = labels, labels.select(F.col("v").alias("j"), F.col("c").alias("d"))
    inner = cut(edges.where("i <> j").join(own.withColumnRenamed("v", "i"), "i").join(other, "j").where("c = d").select("i", "j"))
    part = labels.select("v", F.col("v").alias("c"))
    while True:
        near = inner.join(part.select(F.col("v").alias("j"), "c"), "j").groupBy(F.col("i").alias("v")).agg(F.min("c").alias("m"))
        low = part.join(near, "v", "left").select("v", "c", F.least("c", "m").alias("m"))
        ahead = part.select(F.col("v").alias("m"), F.col("c").alias("n"))  # whom the new name's vertex names: paths get shorter by half
        after = cut(low.join(ahead, "m").select("v", F.least("m", "n").alias("to"), "c"))
        part = after.select("v", F.col("to").alias("c"))
        if after.where("to <> c").isEmpty():
            return part


def _at(labels: DataFrame, v: str) -> DataFrame:
    return labels.select(F.col("v").alias(v), F.col("c").alias(f"c_{v}"))


def _contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(i, j, s) between the groups of ``labels``, inner weights as loops."""
    both = edges.join(_at(labels, "i"), "i").join(_at(labels, "j"), "j")
    return cut(both.groupBy(F.col("c_i").alias("i"), F.col("c_j").alias("j")).agg(F.sum("s").alias("s")))


def coarsened(edges: DataFrame, largest: int, resolution: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graph, membership, communities): (i, j, s) of parts of communities, (v, c) of all vertices' parts and (v, c) of the parts' communities.

    A level moves vertices, refines, and contracts, all by joins and sums; each is written to the shared folder. Refinement starts
    again from single vertices and joins them inside their communities only, along edges, so a part hangs together; parts
    are the next level's vertices, which begin in the communities found. Levels end where at most ``largest`` vertices are left, each
    community is one part, or parts are no longer fewer by a twentieth.
    """
    total = edges.agg(F.sum("s")).first()[0] or 1.0
    member = labels = None
    while True:
        degrees = cut(edges.groupBy(F.col("i").alias("v")).agg(F.sum("s").alias("degree")))
        n = degrees.count()
        alone = degrees.select("v", F.col("v").alias("c"))
        labels = alone if labels is None else labels
        if n <= largest:
            break
        labels = _turns(edges, labels, degrees, total, resolution)
        inner = cut(edges.join(_at(labels, "i"), "i").join(_at(labels, "j"), "j").where("c_i = c_j").select("i", "j", "s"))
        parts = _turns(inner, alone, degrees, total, resolution, alone=True, most=6)
        labels = cut(parts.join(labels.withColumnRenamed("c", "into"), "v").groupBy(F.col("c").alias("v")).agg(F.first("into").alias("c")))
        edges = _contracted(edges, parts)
        member = parts if member is None else cut(member.withColumnRenamed("c", "m").join(parts.withColumnRenamed("v", "m"), "m").select("v", "c"))
        left = labels.count()
        if left > 0.95 * n or left == labels.select("c").distinct().count():
            break
    return edges, member if member is not None else alone, labels


def _ranked(found: DataFrame) -> DataFrame:
    """(id, cluster) of (id, label), the largest first; the window holds a row for each cluster."""
    sizes = found.groupBy("label").agg(F.count("*").alias("n"))
    ranks = sizes.select("label", (F.row_number().over(W.orderBy(F.desc("n"), "label")) - 1).cast("long").alias("cluster"))
    return found.join(ranks, "label").select("id", "cluster")


def cluster(vectors: DataFrame, neighbours: int = 15, resolution: float = 1.0, seed: int = 0, metric: str = "cosine", largest: int = LARGEST, exact: int = EXACT) -> DataFrame:
    """(id, cluster) of (id, v), the largest cluster first.

    Up to ``exact`` rows neighbours are exact; beyond, they come from inverted lists. The graph is moved and contracted by joins
    until it has ``largest`` vertices at most; one task ends it. Where it is not contracted so far, the joins' own communities,
    cut where they do not hang together, are the clusters.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    n = vectors.count()
    lists = 1 if n <= exact else min(2048, max(2, round(math.sqrt(n))))
    near = nearest(vectors, neighbours, metric, lists=lists, probes=max(8, lists // 16))
    weight = F.greatest(F.col("similarity"), F.lit(0.0)) if metric == "cosine" else 1 / (1 - F.col("similarity"))
    both = near.select("i", "j", weight.alias("s"))
    both = cut(both.union(both.select(F.col("j").alias("i"), F.col("i").alias("j"), "s")).groupBy("i", "j").agg(F.max("s").alias("s")))
    graph, member, communities = coarsened(both, largest, resolution)
    if communities.count() > largest:
        found = cut(member.join(connected(graph, communities).select(F.col("v").alias("c"), F.col("c").alias("label")), "c").select(F.col("v").alias("id"), "label"))
        return _ranked(found)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf["i"].to_numpy())
        at = lambda c: np.searchsorted(ids, pdf[c].to_numpy())
        return pd.DataFrame({"c": ids, "label": leiden(len(ids), at("i"), at("j"), pdf["s"].to_numpy(float), resolution, seed)})

    ended = graph.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, f"c {kind}, label long")
    found = cut(member.join(ended, "c").select(F.col("v").alias("id"), "label"))
    return _ranked(found)
