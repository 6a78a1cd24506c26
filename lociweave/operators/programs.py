"""Leading modes of a gene-by-gene table, and their gene loadings and spot modes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import Prepared

MODES = "scope string, mode int, eigenvalue double, mode_sign int, g string, eigenvector double, gene_score double"
#: Genes of which the dense solver takes one table; it needs the cube of them in time. More go to ``krylov``.
DENSE_GENES = 2000


def oriented(v: np.ndarray) -> np.ndarray:
    """Columns with at least as much weight on positive as on negative entries."""
    positive, negative = (np.where(v > 0, v, 0) ** 2).sum(axis=0), (np.where(v < 0, v, 0) ** 2).sum(axis=0)
    return v * np.where(positive >= negative, 1.0, -1.0)


def leading_modes(g: DataFrame, k: int = 8, signed: bool = False, scope: str = "all", genes: DataFrame | None = None) -> DataFrame:
    """Top ``k`` eigenpairs of (g, h, v), or of each scope's (scope, g, h, v): largest values first, or with ``signed`` the largest by size.

    A table is genes by genes, whatever the number of spots; one task solves each scope's, of ``DENSE_GENES`` genes at most.
    ``krylov.leading_modes`` solves what is larger. ``genes`` (g): all genes, where the caller knows them.
    """
    known = genes if genes is not None else g
    names = np.array([r["g"] for r in known.select("g").distinct().orderBy("g").limit(DENSE_GENES + 1).collect()], str)
    if len(names) > DENSE_GENES:
        raise ValueError(f"more than {DENSE_GENES} genes: krylov.leading_modes takes them")
    spark = g.sparkSession
    if not len(names):
        return spark.createDataFrame([], MODES)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        own = np.unique(np.concatenate([x, y]))
        m = np.zeros((len(own), len(own)))
        m[np.searchsorted(own, x), np.searchsorted(own, y)] = pdf["v"]
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        order = np.argsort(-(np.abs(values) if signed else values), kind="stable")[: min(k, len(own))]
        values, vectors = values[order], oriented(vectors[:, order])
        if not signed:
            values = np.maximum(values, 0)
        scores = vectors * np.sqrt(np.abs(values))
        n = len(order)
        return pd.DataFrame({
            "scope": key[0], "mode": np.tile(np.arange(n), len(own)), "eigenvalue": np.tile(values, len(own)), "mode_sign": np.tile(np.sign(values).astype(int), len(own)),
            "g": np.repeat(names[own], n), "eigenvector": vectors.ravel(), "gene_score": scores.ravel(),
        })

    rows = g if "scope" in g.columns else g.withColumn("scope", F.lit(scope))
    numbered = spark.createDataFrame([(i, str(n)) for i, n in enumerate(names)], "x int, g string")
    rows = rows.join(numbered, "g").join(numbered.select(F.col("x").alias("y"), F.col("g").alias("h")), "h")
    return rows.select("scope", "x", "y", "v").groupBy("scope").applyInPandas(solve, MODES)


def gene_loadings(modes: DataFrame, scale: DataFrame, center: DataFrame | None = None) -> DataFrame:
    """([scope,] [part,] g, mode, loading): D H v / sqrt|eigenvalue|, with ``center`` (all genes) for H. ``scale`` may be of scopes, of parts, of both or one for all."""
    v = F.col("eigenvector")
    rows = modes
    if center is not None:
        means = modes.groupBy("scope", "mode").agg((F.sum("eigenvector") / center.count()).alias("mean"))
        rows, v = modes.join(F.broadcast(means), ["scope", "mode"]), F.col("eigenvector") - F.col("mean")  # a row for each mode
    on = ["part"] if "part" in scale.columns else []
    lifted = rows.join(scale, [*(["scope"] if "scope" in scale.columns else []), "g"]).withColumn("loading", v * F.col("d") / F.sqrt(F.greatest(F.abs("eigenvalue"), F.lit(1e-12))))
    return lifted.select("scope", *on, "g", "mode", "loading")


def spot_modes(p: Prepared, loadings: DataFrame) -> DataFrame:
    """(scope, part, i, mode, value): W times the loadings (scope, part, g, mode, loading), on the raw values; zero for a spot of the part without expression."""
    found = p.w.join(loadings, ["part", "g"]).groupBy("scope", "part", "i", "mode").agg(F.sum(F.col("value") * F.col("loading")).alias("value"))
    every = p.spots.join(loadings.select("scope", "part", "mode").distinct(), "part")  # a few modes for each part
    return every.join(found, ["scope", "part", "i", "mode"], "left").select("scope", "part", "i", "mode", F.coalesce("value", F.lit(0.0)).alias("value"))


def full_modes(modes: DataFrame, spots: DataFrame) -> DataFrame:
    """Modes for every spot: null where a spot was not in the scope."""
    frame = spots.select(F.col("spot_id").alias("i")).join(modes.select("scope", "mode").distinct(), how="cross")  # modes are a few rows
    return frame.join(modes, ["scope", "mode", "i"], "left")
