"""Nearest neighbours of vectors: exact by blocks, or by inverted lists of an index.

Rows meet in blocks of at most about ``BLOCK_ROWS`` queries and as many candidates, whatever
the size of the table or of a list; a block is one matrix product that keeps its best ``k``
for each query, and the blocks' bests are merged. With one list every query meets every row:
exact, at the price of all pairs. With more, a row lies in the list of its nearest centre and a
query meets the lists of its ``probes`` nearest centres only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.lineage import cut

BLOCK_ROWS = 4096
#: Rows that the centres are fitted on at most, and rounds of the fit.
SAMPLE_ROWS, ROUNDS = 20_000, 8
METRICS = ("cosine", "euclidean")


def _unit(v: np.ndarray, metric: str) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if metric == "cosine" else v


def _similarity(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Cosines of unit rows, or distances with a minus."""
    dots = a @ b.T
    if metric == "cosine":
        return dots
    return -np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] - 2 * dots + (b * b).sum(axis=1)[None], 0))


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(float)


def fitted_centres(vectors: DataFrame, lists: int, metric: str, seed: int = 0) -> np.ndarray:
    """Centres of ``lists`` groups of at most ``SAMPLE_ROWS`` rows, chosen by a hash of the id, which alone reach the driver."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
    rows = _unit(_stacked(sample["v"]), metric)
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:lists]]
    for _ in range(ROUNDS):
        own = np.concatenate([np.argmax(_similarity(rows[k : k + 2048], centres, metric), axis=1) for k in range(0, len(rows), 2048)])
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, rows)
        centres = np.where(counts[:, None] > 0, _unit(sums / np.maximum(counts, 1)[:, None], metric), centres)
    return centres


def _listed(rows: DataFrame, centres: np.ndarray, probes: int, metric: str, kind: str) -> DataFrame:
    """(id, v, lists): each row's ``probes`` nearest centres, nearest first."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            near = np.argsort(-_similarity(_unit(_stacked(pdf["v"]), metric), centres, metric), axis=1, kind="stable")[:, :probes] if len(pdf) else []
            yield pdf.assign(lists=list(near))

    return rows.select("id", "v").mapInPandas(run, f"id {kind}, v array<double>, lists array<int>")


def _met(asked: DataFrame, against: DataFrame, k: int, metric: str, kind: str, block_rows: int) -> DataFrame:
    """(i, j, similarity): for each asked(id, v, bound, list) the ``k`` most similar rows of against(id, v, list) in each block of its list that are at or above its bound."""
    n_blocks = F.ceil(F.count("*") / block_rows).cast("int")
    left = asked.groupBy("list").agg(n_blocks.alias("q_blocks"))
    sizes = F.broadcast(left.join(against.groupBy("list").agg(n_blocks.alias("c_blocks")), "list"))  # a row for each list
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(sizes, "list").select("list", own("q_blocks").alias("q"), each("c_blocks").alias("c"), "id", "v", "bound")
    against = against.join(sizes, "list").select("list", each("q_blocks").alias("q"), own("c_blocks").alias("c"), "id", "v").toDF("list", "q", "c", "id", "v")  # columns of its own

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"i": a["id"][:0], "j": b["id"][:0], "similarity": np.zeros(0)})
        a, b = a.drop_duplicates("id"), b.drop_duplicates("id").sort_values("id")
        s, bound = _similarity(_unit(_stacked(a["v"]), metric), _unit(_stacked(b["v"]), metric), metric), a["bound"].to_numpy()
        s[a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None]] = -np.inf
        kept = s >= bound[:, None] - 1e-9  # rounding moves half of that
        many = np.flatnonzero(kept.sum(axis=1) > k)
        order = np.argsort(-np.round(s[many], 9), axis=1, kind="stable")[:, :k]  # candidates are by id: so are ties
        kept[many] = False
        kept[many[:, None], order] = True
        x, y = np.nonzero(kept)
        similarity = np.round(s[x, y], 9)
        found = pd.DataFrame({"i": a["id"].to_numpy()[x], "j": b["id"].to_numpy()[y], "similarity": similarity})
        return found[np.isfinite(similarity) & (similarity >= bound[x])]

    group = ["list", "q", "c"]
    return asked.groupBy(*group).cogroup(against.groupBy(*group)).applyInPandas(best, f"i {kind}, j {kind}, similarity double")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("i").orderBy(F.desc("similarity"), "j"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("i", "j", "rank", "similarity")


def nearest(vectors: DataFrame, k: int, metric: str = "cosine", queries: DataFrame | None = None, lists: int = 1, probes: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(i, j, rank, similarity): the ``k`` most similar other rows of (id, v ARRAY<DOUBLE>), ties by id. ``queries``: only theirs.

    ``similarity`` is the cosine, or the distance with a minus. ``lists`` of 1 is exact. With more, a query's nearest list
    is looked at first: of the others only what is as similar as the ``k``-th there, or more so, is kept.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    kind = vectors.schema["id"].dataType.simpleString()
    asked, none = vectors if queries is None else queries, F.lit(float("-inf"))
    if lists == 1:
        return _ranked(_met(asked.select("id", "v", none.alias("bound"), F.lit(0).alias("list")), vectors.select("id", "v", F.lit(0).alias("list")), k, metric, kind, block_rows), k)
    centres = fitted_centres(vectors, lists, metric)
    against = cut(_listed(vectors, centres, 1, metric, kind).select("id", "v", F.col("lists")[0].alias("list")))
    asked = cut(_listed(asked, centres, probes, metric, kind))
    first = cut(_ranked(_met(asked.select("id", "v", none.alias("bound"), F.col("lists")[0].alias("list")), against, k, metric, kind, block_rows), k))
    bounds = first.where(F.col("rank") == k).select(F.col("i").alias("id"), F.col("similarity").alias("bound"))
    others = asked.join(bounds, "id", "left").select("id", "v", F.coalesce("bound", none).alias("bound"), F.explode(F.slice("lists", 2, probes)).alias("list"))
    return _ranked(first.drop("rank").unionByName(_met(others, against, k, metric, kind, block_rows)), k)
