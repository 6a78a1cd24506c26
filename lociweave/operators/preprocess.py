"""Filters, covariates and transforms of a bundle, in the order: labels, counts, shared genes, covariates, transform."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.bundle import SPOT, Bundle


def subset_by_labels(bundle: Bundle, labels: list, exclude: bool = False, label: str = "label") -> Bundle:
    """Spots with one of ``labels``, or all others; a spot without a label is none of them."""
    if label not in bundle.spots.columns:
        raise ValueError(f"spots have no column {label!r}")
    inside = F.coalesce(F.col(label).isin(labels), F.lit(False))
    return bundle.keep_spots(bundle.spots.where(~inside if exclude else inside))


def genes_by_counts(bundle: Bundle, min_counts: float) -> DataFrame:
    """Genes whose total count is at least ``min_counts``."""
    return bundle.expression.groupBy("gene_id").agg(F.sum("value").alias("total")).where(F.col("total") >= min_counts)


def genes_by_spots(bundle: Bundle, fraction: float) -> DataFrame:
    """Genes found in at least the whole part of ``fraction`` of all spots."""
    least = bundle.spots.agg(F.floor(F.count("*") * F.lit(fraction)).alias("least"))
    found = bundle.expression.where("value > 0").groupBy("gene_id").agg(F.count("*").alias("n_spots"))
    counted = bundle.genes.join(found, "gene_id", "left").fillna(0, ["n_spots"])
    return counted.join(F.broadcast(least), F.col("n_spots") >= F.col("least")).select("gene_id", "n_spots")  # one row


def filter_genes(bundle: Bundle, min_counts: float | None = 10, min_spot_fraction: float | None = None) -> Bundle:
    if min_counts:
        bundle = bundle.keep_genes(genes_by_counts(bundle, min_counts))
    if min_spot_fraction:
        bundle = bundle.keep_genes(genes_by_spots(bundle, min_spot_fraction))
    return bundle


def shared_genes(bundle: Bundle, min_counts: float = 10) -> DataFrame:
    """Genes that pass ``min_counts`` in each sample."""
    samples = bundle.spots.agg(F.count_distinct("sample_id").alias("samples"))
    passing = bundle.expression.groupBy("sample_id", "gene_id").agg(F.sum("value").alias("total")).where(F.col("total") >= min_counts)
    counted = passing.groupBy("gene_id").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(samples), F.col("n") == F.col("samples")).select("gene_id")


_upper = lambda: F.upper("gene_id")
MITO = ("MT-",)
RIBO = ("RPS", "RPL")


def _share(prefixes: tuple[str, ...]) -> Column:
    mine = F.lit(False)
    for p in prefixes:
        mine = mine | _upper().startswith(p)
    return F.coalesce(F.sum(F.when(mine, F.col("value"))), F.lit(0.0)) / (F.coalesce(F.sum("value"), F.lit(0.0)) + 1e-12)


COVARIATES: dict[str, tuple] = {
    "log_total_counts": (lambda: F.log1p(F.coalesce(F.sum("value"), F.lit(0.0))), None),
    "log_detected_genes": (lambda: F.log1p(F.coalesce(F.sum((F.col("value") > 0).cast("double")), F.lit(0.0))), None),
    "mito_fraction": (lambda: _share(MITO), MITO),
    "ribo_fraction": (lambda: _share(RIBO), RIBO),
}


def covariates(bundle: Bundle, names: list[str], layer: str | None = None) -> DataFrame:
    """(sample_id, spot_id, one column for each name), for every spot, in one aggregation."""
    if unknown := [n for n in names if n not in COVARIATES]:
        raise ValueError(f"unknown covariates: {unknown}")
    for n in names:
        if prefixes := COVARIATES[n][1]:
            match = F.lit(False)
            for p in prefixes:
                match = match | _upper().startswith(p)
            if bundle.genes.where(match).isEmpty():
                raise ValueError(f"{n}: no gene begins with {' or '.join(prefixes)}")
    rows = bundle.spots.select(*SPOT).join(bundle.matrix(layer), SPOT, "left")
    return rows.groupBy(*SPOT).agg(*[COVARIATES[n][0]().alias(n) for n in names])


def normalise(expression: DataFrame, target: float | None = 1e4) -> DataFrame:
    """Counts scaled so that each spot's total is ``target``."""
    if not target:
        return expression
    totals = expression.groupBy(*SPOT).agg(F.sum("value").alias("total"))
    return expression.join(totals, SPOT).withColumn("value", F.col("value") * target / F.col("total")).drop("total")


def transform(expression: DataFrame, kind: str | None) -> DataFrame:
    """``log1p`` or ``sqrt`` of the values; zeros stay zero, so missing rows do too."""
    if kind is None:
        return expression
    if kind not in ("log1p", "sqrt"):
        raise ValueError(f"unknown transform {kind!r}")
    return expression.withColumn("value", (F.log1p if kind == "log1p" else F.sqrt)("value"))


def filtered(bundle: Bundle, include: list | None = None, exclude: list | None = None, min_counts: float | None = 10, min_spot_fraction: float | None = None, shared: bool = False, label: str = "label") -> Bundle:
    """Spots by label, exclude only where include is not given, and then genes by their counts, with ``shared`` in each sample."""
    if include or exclude:
        bundle = subset_by_labels(bundle, include or exclude, exclude=not include, label=label)
    if shared and min_counts:
        return filter_genes(bundle.keep_genes(shared_genes(bundle, min_counts)), None, min_spot_fraction)
    return filter_genes(bundle, min_counts, min_spot_fraction)


def transformed(bundle: Bundle, target: float | None = 1e4, kind: str | None = None) -> Bundle:
    """The expression scaled to a total for each spot, and transformed; layers stay."""
    return replace(bundle, expression=transform(normalise(bundle.expression, target), kind))


#: What a command takes for its preprocessing: by ``filtered`` before covariates are found, by ``transformed`` after.
BEFORE, AFTER = ("include", "exclude", "min_counts", "min_spot_fraction", "shared", "label"), ("target", "kind")


def preprocess(bundle: Bundle, names: list[str] | None = None, layer: str | None = None, **options) -> tuple[Bundle, DataFrame | None]:
    """The bundle filtered and transformed, and the covariates ``names`` of the counts between the two steps."""
    if unknown := set(options) - {*BEFORE, *AFTER}:
        raise ValueError(f"unknown preprocessing: {sorted(unknown)}")
    bundle = filtered(bundle, **{k: v for k, v in options.items() if k in BEFORE})
    found = covariates(bundle, names, layer) if names else None
    return transformed(bundle, **{k: v for k, v in options.items() if k in AFTER}), found
