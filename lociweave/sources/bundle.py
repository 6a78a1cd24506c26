"""The canonical tables of spatial expression data, and adapters that make them from other tables.

spots(sample_id, spot_id, label), coords(sample_id, spot_id, x, y), genes(gene_id) and
expression(sample_id, spot_id, gene_id, value > 0). A missing expression row is a zero, so
counts of genes and spots always come from ``genes`` and ``spots``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPOT = ["sample_id", "spot_id"]


@dataclass(frozen=True)
class Bundle:
    """One or many samples; ``layers`` holds named alternatives to ``expression``."""

    spots: DataFrame
    coords: DataFrame
    genes: DataFrame
    expression: DataFrame
    layers: DataFrame | None = None

    def matrix(self, layer: str | None = None) -> DataFrame:
        """The expression table, or one named layer of it."""
        if layer is None:
            return self.expression
        if self.layers is None:
            raise ValueError(f"no layer {layer!r}")
        return self.layers.where(F.col("layer") == layer).drop("layer")

    def keep_spots(self, spots: DataFrame) -> Bundle:
        """The bundle of these spots only; genes stay."""
        key = spots.select(*SPOT)
        only = lambda df: df.join(key, SPOT, "left_semi")
        return replace(self, spots=spots, coords=only(self.coords), expression=only(self.expression), layers=only(self.layers) if self.layers is not None else None)

    def keep_genes(self, genes: DataFrame) -> Bundle:
        key = genes.select("gene_id")
        only = lambda df: df.join(key, "gene_id", "left_semi")
        return replace(self, genes=key, expression=only(self.expression), layers=only(self.layers) if self.layers is not None else None)


def read_bundle(spark: SparkSession, path: str) -> Bundle:
    """A bundle from Parquet folders spots, coords, genes, expression and, where there are any, layers."""
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/layers")
    has_layers = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return Bundle(table("spots"), table("coords"), table("genes"), table("expression"), table("layers") if has_layers else None)


def write_bundle(bundle: Bundle, path: str) -> None:
    for name in ("spots", "coords", "genes", "expression", "layers"):
        if (df := getattr(bundle, name)) is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def union_samples(bundles: dict[str, Bundle]) -> Bundle:
    """Samples side by side under their names; spot ids get the name as a suffix, genes and layers are those of all."""
    if len(bundles) < 2:
        raise ValueError("more than one sample is needed")

    def named(name: str, df: DataFrame) -> DataFrame:
        return df.withColumns({"spot_id": F.concat_ws("-", F.col("spot_id").cast("string"), F.lit(name)), "sample_id": F.lit(name)})

    both = lambda part: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [named(n, getattr(b, part)) for n, b in bundles.items()])
    genes = reduce(lambda a, b: a.join(b, "gene_id", "left_semi"), [b.genes for b in bundles.values()])
    layers = None
    if all(b.layers is not None for b in bundles.values()):
        shared = reduce(lambda a, b: a.join(b, "layer", "left_semi"), [b.layers.select("layer").distinct() for b in bundles.values()])
        layers = both("layers").join(shared, "layer", "left_semi").join(genes, "gene_id", "left_semi")
    return Bundle(both("spots"), both("coords"), genes, both("expression").join(genes, "gene_id", "left_semi"), layers)


def sample_names(paths: list[str], names: list[str] | None = None) -> list[str]:
    """A name for each bundle's path: the given ones, or the last part of the path without its ending; none twice."""
    found = names or [p.rstrip("/").rsplit("/", 1)[-1].split(".")[0] for p in paths]
    if len(found) != len(paths) or len(set(found)) != len(found):
        raise ValueError(f"{len(paths)} samples need as many different names: {found}")
    return found


def embeddings_bundle(spark: SparkSession, sf_dir: str) -> Bundle:
    """Rows of ``embeddings`` as spots at their first two dimensions; the other 62 are genes."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("sample_id", F.concat(F.lit("S"), (F.col("vec_id") % 3).cast("string")))
    base = rows.select("sample_id", F.col("vec_id").alias("spot_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"), "embedding")
    dims = base.select(*SPOT, F.posexplode("embedding").alias("d", "v")).where("d >= 2")
    value = F.round(F.col("v").cast("double") * 100)
    expression = dims.where((F.col("v") > 0) & (value > 0)).select(*SPOT, gene_name(F.col("d")).alias("gene_id"), value.alias("value"))
    genes = spark.range(2, 64).select(gene_name(F.col("id")).alias("gene_id"))
    coords = base.select(*SPOT, F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return Bundle(base.drop("embedding"), coords, genes, expression)


def gene_name(d):
    """Names that try the mitochondrial and ribosomal prefixes on a few dimensions."""
    text = d.cast("string")
    return F.when(d.isin(2, 3), F.concat(F.lit("MT-G"), text)).when(d == 4, F.lit("RPS4")).when(d == 5, F.lit("RPL5")).otherwise(F.concat(F.lit("G"), text))


def customers_bundle(spark: SparkSession, sf_dir: str) -> Bundle:
    """Customers as spots, part brands as genes, regions as samples."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation = F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")))  # 25 and 5 rows by definition
    base = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("r_name").alias("sample_id"), F.col("c_custkey").alias("spot_id"), F.col("c_mktsegment").alias("label"),
        (F.col("c_acctbal") / 1000.0).cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y"),
    )
    sums = (
        t("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        .join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").alias("spot_id"), F.col("p_brand").alias("gene_id")).agg(F.sum("l_quantity").cast("double").alias("value"))
    )
    expression = sums.join(base.select(*SPOT), "spot_id").select(*SPOT, "gene_id", "value")
    genes = t("part").select(F.col("p_brand").alias("gene_id")).distinct()
    return Bundle(base.select(*SPOT, "label"), base.select(*SPOT, "x", "y"), genes, expression)
