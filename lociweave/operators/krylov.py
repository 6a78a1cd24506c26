"""Leading modes of gene operators that are never stored: a block Krylov method over joins.

A step multiplies a block of vectors, a few numbers for each gene, through H D W' P K P W D H
as joins and sums; the block is then made orthogonal to the earlier ones, two passes over the
rows of genes. What reaches the driver are the blocks' inner products, a few hundred numbers
on a side whatever the number of genes or spots. Steps end when the residuals of the wanted
modes are below a tolerance. When the basis has ``WIDTH`` blocks it is drawn together to the best
vectors in it, as many as a block has, and goes on from there with the block at hand (a thick
restart), so a gene never carries more numbers than that. Where the basis spans all that a start
leads to, another start goes on, so modes of value zero are found too. Each step's basis is
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import cut
from .programs import MODES
from .spatial import Prepared

#: Vectors of a block beyond the modes that are asked for, most steps, and residuals in shares of the largest value.
EXTRA, STEPS, TOLERANCE = 8, 200, 1e-9
#: Blocks in the basis at most.
WIDTH = 5


@dataclass(frozen=True)
class Term:
    """One summand: prepared spots and their ``spatial.factors``, scale (g, d) for all parts or (part, g, d), and weights (part, weight)."""

    p: Prepared
    wide: DataFrame
    lift: DataFrame
    scale: DataFrame
    weights: DataFrame


def _names(b: int, tag: str = "v") -> list[str]:
    return [f"{tag}{x}" for x in range(b)]


def multiplied(t: Term, block: DataFrame, b: int) -> DataFrame:
    """(g, v0..): the weighted sum over parts of D W' P K P W D times the columns of ``block`` (g, v0..).

    P W is the product of two stored tables, so no table of the step is read twice and the plan has each join once.
    """
    v, on = _names(b), ["part", "g"] if "part" in t.scale.columns else ["g"]
    total = lambda df, by, times: df.groupBy(*by).agg(*[F.sum(times * F.col(x)).alias(x) for x in v])
    entries = lambda df, *kept: df.withColumn("e", F.explode("e")).select("part", F.col("e.key").alias("key"), F.col("e.value").alias("value"), *kept)
    scaled = block.join(t.scale, "g").select(*on, *[(F.col("d") * F.col(x)).alias(x) for x in v])
    given = total(t.lift.join(scaled, on), ["part", "key"], F.col("share"))
    near = total(entries(t.wide, "i").join(given, ["part", "key"]), ["part", "i"], F.col("value"))
    smooth = t.p.smoothed(near, b)
    sums = total(entries(t.wide.join(smooth, ["part", "i"]), *v), ["part", "key"], F.col("value"))
    back = total(t.lift.join(sums, ["part", "key"]), ["part", "g"], F.col("share"))
    return total(back.join(t.scale, on).join(t.weights, "part"), ["g"], F.col("weight") * F.col("d"))


def _centred(block: DataFrame, genes: DataFrame, n: int, b: int) -> DataFrame:
    """Columns over all ``n`` genes less their means."""
    v = _names(b)
    means = block.agg(*[(F.coalesce(F.sum(x), F.lit(0.0)) / n).alias(x) for x in v]).first()  # b numbers
    return genes.join(block, "g", "left").select("g", *[(F.coalesce(x, F.lit(0.0)) - F.lit(means[x])).alias(x) for x in v])


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            q, y = _matrix(batch.column(0), batch.num_rows), _matrix(batch.column(1), batch.num_rows)
            own = np.concatenate([q, y], axis=1).T @ y
            total = own if total is None else total + own
    if total is not None:
        a, b = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel(), pa.int32()), pa.array(b.ravel(), pa.int32()), pa.array(total.ravel())], names=["a", "b", "s"])


def products(rows: DataFrame) -> np.ndarray:
    """[q y]' y of (q, y arrays) over all rows: partial sums in the tasks, then a row for each pair of columns."""
    sums = rows.select("q", "y").mapInArrow(_products, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect()
    out = np.zeros((1 + max(r["a"] for r in sums), 1 + max(r["b"] for r in sums)))
    for r in sums:
        out[r["a"], r["b"]] = r["s"]
    return out


def _mapped(rows: DataFrame, change, columns: tuple[str, ...]) -> DataFrame:
    """(g, columns): arrays made of each row's q and y by ``change``, which gets and gives matrices with a row for each gene."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                found = change(_matrix(batch.column(1), n), _matrix(batch.column(2), n))
                lists = [pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * m.shape[1], np.ascontiguousarray(m).ravel()) for m in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["g", *columns])

    return rows.select("g", "q", "y").mapInArrow(run, ", ".join(["g string", *[f"{c} array<double>" for c in columns]]))


def leading_modes(terms: list[Term], genes: DataFrame, k: int = 8, signed: bool = False, scope: str = "all", gene_center: bool = False, tolerance: float = TOLERANCE, steps: int = STEPS) -> DataFrame:
    """Top ``k`` eigenpairs of the sum of ``terms`` over ``genes`` (g): as ``programs.leading_modes``, without the table of genes by genes.

    Ends with an error if ``steps`` do not bring the residuals of all ``k`` modes below ``tolerance``.
    """
    n = genes.count()
    if not n:
        return genes.sparkSession.createDataFrame([], MODES)
    k = min(k, n)
    b = min(k + EXTRA, n)
    start = lambda x: F.xxhash64("g", F.lit(x)) / F.lit(2.0**63)
    rows = genes.select("g", F.array().cast("array<double>").alias("q"), F.array(*[start(x) for x in range(b)]).alias("y"))
    if gene_center:
        first = _centred(rows.select("g", *[F.col("y")[x].alias(f"v{x}") for x in range(b)]), genes, n, b)
        rows = first.select("g", F.array().cast("array<double>").alias("q"), F.array(*_names(b)).alias("y"))
    small, last, width, scale, starts = np.zeros((0, 0)), 0, 0, 1.0, b
    for _ in range(steps):
        # the new block, orthogonal to the basis and within itself: twice, for accuracy
        factor = None
        for _ in range(2):
            s = products(rows)
            own, inner = s[:width], s[width:]
            inner = inner - own.T @ own
            values, vectors = np.linalg.eigh((inner + inner.T) / 2)
            # what is left of a direction that the basis holds already is rounding
            keep = values > (1e-22 * scale * scale if factor is None else 0.25)
            turn = vectors[:, keep] / np.sqrt(values[keep])
            step = np.sqrt(values[keep])[:, None] * vectors[:, keep].T
            factor = step if factor is None else step @ factor
            rows = cut(_mapped(rows, lambda q, y, own=own, turn=turn: (q, (y - q @ own) @ turn), ("q", "y")))
            if not keep.any():
                break
        # Ritz values of the basis so far; ``factor`` carries the residuals
        if width:
            values, vectors = np.linalg.eigh((small + small.T) / 2)
            order = np.argsort(-(np.abs(values) if signed else values), kind="stable")
            left = np.linalg.norm(factor @ vectors[-last:, order[:k]], axis=0) if last else np.zeros(k)
            if width >= k and (not factor.size or left.max() <= tolerance * np.abs(values).max()):
                return _modes(rows, values[order[:k]], vectors[:, order[:k]], signed, scope)
            if not factor.size:  # all that the starts lead to is there, and it is not enough
                fresh = F.array(*[start(starts + x) for x in range(b)])
                rows, last, scale, starts = cut(rows.select("g", "q", fresh.alias("y"))), 0, 1.0, starts + b
                continue
            if width + factor.shape[0] > WIDTH * b:
                best = order[:b]
                rows = cut(_mapped(rows, lambda q, y, best=vectors[:, best]: (q @ best, y), ("q", "y")))
                small, width = np.diag(values[best]), len(best)
        size = factor.shape[0]
        block = rows.select("g", *[F.col("y")[x].alias(f"v{x}") for x in range(size)])
        inside = _centred(block, genes, n, size) if gene_center else block
        parts = [multiplied(t, inside, size) for t in terms]
        out = parts[0]
        for other in parts[1:]:
            out = out.unionByName(other)
        out = out.groupBy("g").agg(*[F.sum(x).alias(x) for x in _names(size)]) if len(parts) > 1 else out
        out = _centred(out, genes, n, size) if gene_center else out
        basis = rows.select("g", F.concat("q", "y").alias("q"))
        rows = cut(basis.join(out, "g", "left").select("g", "q", F.array(*[F.coalesce(x, F.lit(0.0)) for x in _names(size)]).alias("y")))
        s = products(rows)
        column = s[: width + size]
        grown = np.zeros((width + size, width + size))
        grown[:width, :width] = small
        grown[:, width:] = column
        grown[width:, :width] = column[:width].T
        small, last, width = grown, size, width + size
        scale = max(np.abs(grown).max(), 1e-300)
    raise RuntimeError(f"no convergence to {tolerance} in {steps} steps")


def _modes(rows: DataFrame, values: np.ndarray, vectors: np.ndarray, signed: bool, scope: str) -> DataFrame:
    """The table of modes from basis rows: eigenvectors with at least as much weight on positive as on negative entries."""
    own = cut(_mapped(rows, lambda q, y: (q[:, : vectors.shape[0]] @ vectors,), ("v",)))
    k = len(values)
    positive = own.agg(*[F.sum(F.when(F.col("v")[x] > 0, 1.0).otherwise(-1.0) * F.col("v")[x] * F.col("v")[x]).alias(f"v{x}") for x in range(k)]).first()  # k numbers
    sign = [1.0 if positive[f"v{x}"] >= 0 else -1.0 for x in range(k)]
    kept = values if signed else np.maximum(values, 0)
    known = [F.struct(F.lit(float(kept[x])).alias("e"), F.lit(int(np.sign(kept[x]))).alias("s"), F.lit(sign[x]).alias("o")) for x in range(k)]
    long = own.select("g", F.posexplode("v").alias("mode", "raw")).withColumn("known", F.array(*known)[F.col("mode")])
    vector = F.col("raw") * F.col("known.o")
    return long.select(
        F.lit(scope).alias("scope"), "mode", F.col("known.e").alias("eigenvalue"), F.col("known.s").alias("mode_sign"), "g",
        vector.alias("eigenvector"), (vector * F.sqrt(F.abs("known.e"))).alias("gene_score"),
    )
