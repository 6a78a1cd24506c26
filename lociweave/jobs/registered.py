"""Registered queries over the given tables, each with the SQL that it must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrichment, kernel, neighbours, preprocess, ranking, spatial
from ..sources.bundle import customers_bundle, embeddings_bundle, union_samples
from ..sources.lineage import cut
from . import commands

EMB_RADIUS, CUST_RADIUS = 0.05, 0.5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_GENE = "CASE WHEN d IN (2, 3) THEN 'MT-G' || d WHEN d = 4 THEN 'RPS4' WHEN d = 5 THEN 'RPL5' ELSE 'G' || d END"
EMB = f"""
spots AS (SELECT 'S' || (vec_id % 3) AS sample_id, vec_id AS spot_id, 'L' || label AS label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
dims AS (SELECT 'S' || (vec_id % 3) AS sample_id, vec_id AS spot_id, unnest(embedding[3:64]) AS v, generate_subscripts(embedding[3:64], 1) + 1 AS d FROM embeddings),
w AS (SELECT sample_id, spot_id, {_GENE} AS gene_id, round(v::DOUBLE * 100) AS value FROM dims WHERE v > 0 AND round(v::DOUBLE * 100) > 0),
genes AS (SELECT {_GENE} AS gene_id FROM (SELECT unnest(range(2, 64)) AS d)),
pairs AS (
  SELECT a.sample_id, a.spot_id AS i, b.spot_id AS j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
  FROM spots a JOIN spots b ON a.sample_id = b.sample_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EMB_RADIUS} * {EMB_RADIUS}),
k AS (SELECT sample_id, i, j, pow(greatest(1 - sqrt(d2) / {EMB_RADIUS}, 0), 4) * (4 * sqrt(d2) / {EMB_RADIUS} + 1) AS k FROM pairs WHERE d2 < {EMB_RADIUS} * {EMB_RADIUS})"""
CUST = f"""
spots AS (SELECT r_name AS sample_id, c_custkey AS spot_id, c_mktsegment AS label, (c_acctbal / 1000.0)::DOUBLE AS x, c_nationkey::DOUBLE AS y
          FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
w AS (SELECT sample_id, spot_id, gene_id, value FROM (
        SELECT o_custkey AS spot_id, p_brand AS gene_id, sum(l_quantity)::DOUBLE AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) JOIN spots USING (spot_id)),
genes AS (SELECT DISTINCT p_brand AS gene_id FROM part),
pairs AS (
  SELECT a.sample_id, a.spot_id AS i, b.spot_id AS j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
  FROM spots a JOIN spots b ON a.sample_id = b.sample_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {CUST_RADIUS} * {CUST_RADIUS}),
k AS (SELECT sample_id, i, j, pow(greatest(1 - sqrt(d2) / {CUST_RADIUS}, 0), 4) * (4 * sqrt(d2) / {CUST_RADIUS} + 1) AS k FROM pairs WHERE d2 < {CUST_RADIUS} * {CUST_RADIUS})"""


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(c, n: int = 6):
    return F.round(c, n) + F.lit(0.0)


def _emb(f, name: str, sql: str | None, base: str = EMB, bundle=embeddings_bundle) -> None:
    register(name, f"WITH {base}\n{sql}" if sql else None)(lambda spark, d: f(bundle(spark, d)))


# Preprocessing.

for _name, _expr in {
    "log_total_counts": "ln(1 + coalesce(sum(value), 0))",
    "log_detected_genes": "ln(1 + count(value) FILTER (WHERE value > 0))",
    "mito_fraction": "coalesce(sum(value) FILTER (WHERE upper(gene_id) LIKE 'MT-%'), 0) / (coalesce(sum(value), 0) + 1e-12)",
    "ribo_fraction": "coalesce(sum(value) FILTER (WHERE upper(gene_id) LIKE 'RPS%' OR upper(gene_id) LIKE 'RPL%'), 0) / (coalesce(sum(value), 0) + 1e-12)",
}.items():
    _emb(
        lambda b, n=_name: preprocess.covariates(b, [n]).select("sample_id", "spot_id", _r(F.col(n)).alias("value")),
        f"covariate_{_name}",
        f"SELECT s.sample_id, s.spot_id, round({_expr}, 6) + 0.0 AS value FROM spots s LEFT JOIN w USING (sample_id, spot_id) GROUP BY 1, 2",
    )
_emb(lambda b: preprocess.genes_by_counts(b, 11000), "filter_genes_min_counts", "SELECT gene_id, sum(value) AS total FROM w GROUP BY 1 HAVING sum(value) >= 11000", CUST, customers_bundle)
_emb(
    lambda b: preprocess.genes_by_spots(b, 0.48), "filter_genes_min_spot_fraction",
    "SELECT gene_id, n_spots FROM (SELECT g.gene_id, count(w.value) AS n_spots FROM genes g LEFT JOIN w USING (gene_id) GROUP BY 1) WHERE n_spots >= floor(0.48 * (SELECT count(*) FROM spots))",
)
_emb(lambda b: preprocess.subset_by_labels(b, ["L1", "L3"]).spots, "include_labels", "SELECT sample_id, spot_id, label FROM spots WHERE label IN ('L1', 'L3')")
_emb(lambda b: preprocess.subset_by_labels(b, ["L1", "L3"], exclude=True).spots, "exclude_labels", "SELECT sample_id, spot_id, label FROM spots WHERE coalesce(label NOT IN ('L1', 'L3'), true)")
_emb(
    lambda b: preprocess.shared_genes(b, 2300), "shared_gene_intersection",
    "SELECT gene_id FROM (SELECT sample_id, gene_id FROM w GROUP BY 1, 2 HAVING sum(value) >= 2300) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sample_id) FROM spots)",
    CUST, customers_bundle,
)
for _kind, _sql in {None: "n", "log1p": "ln(1 + n)", "sqrt": "sqrt(n)"}.items():
    _emb(
        lambda b, k=_kind: preprocess.transform(preprocess.normalise(b.expression), k).withColumn("value", _r(F.col("value"), 5)),
        f"transform_{_kind}" if _kind else "normalize_total",
        f"SELECT sample_id, spot_id, gene_id, round({_sql}, 5) + 0.0 AS value FROM (SELECT *, value * 1e4 / sum(value) OVER (PARTITION BY sample_id, spot_id) AS n FROM w)",
    )

# Kernels and neighbours.

for _base, _bundle, _radius, _tag in ((EMB, embeddings_bundle, EMB_RADIUS, ""), (CUST, customers_bundle, CUST_RADIUS, "_customers")):
    _emb(
        lambda b, r=_radius: kernel.wendland_kernel(b.coords, r).withColumn("k", _r(F.col("k"))), f"wendland_kernel{_tag}",
        "SELECT sample_id, i, j, round(k, 6) + 0.0 AS k FROM k", _base, _bundle,
    )
    _emb(
        lambda b, r=_radius: kernel.isolated_fraction(b.coords, r).withColumn("isolated", _r(F.col("isolated"))), f"isolated_fraction{_tag}",
        "SELECT sample_id, round(avg((n = 1)::INT), 6) + 0.0 AS isolated FROM (SELECT sample_id, i, count(*) AS n FROM pairs GROUP BY 1, 2) GROUP BY 1", _base, _bundle,
    )
_emb(
    lambda b: kernel.gaussian_kernel(b.coords, EMB_RADIUS / 6, digits=6), "gaussian_kernel",
    f"""SELECT sample_id, i, j, k FROM (
      SELECT a.sample_id, a.spot_id AS i, b.spot_id AS j, round(exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / (4.0 * ({EMB_RADIUS} / 6) * ({EMB_RADIUS} / 6))), 6) + 0.0 AS k
      FROM spots a JOIN spots b ON a.sample_id = b.sample_id) WHERE k > 0""",
)


@register(
    "wendland_kernel_3d",
    """WITH spots AS (SELECT 'S' || (vec_id % 3) AS sample_id, vec_id AS spot_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
    pairs AS (
      SELECT a.sample_id, a.spot_id AS i, b.spot_id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) / 0.1 AS r
      FROM spots a JOIN spots b ON a.sample_id = b.sample_id)
    SELECT sample_id, i, j, round(pow(1 - r, 4) * (4 * r + 1), 6) + 0.0 AS k FROM pairs WHERE r < 1""",
)
def wendland_kernel_3d(spark: SparkSession, d: str) -> DataFrame:
    third = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("spot_id"), F.col("embedding")[2].cast("double").alias("z"))
    coords = embeddings_bundle(spark, d).coords.join(third, "spot_id")
    return kernel.wendland_kernel(coords, 2 * EMB_RADIUS).select("sample_id", "i", "j", _r(F.col("k")).alias("k"))


_emb(
    lambda b: kernel.mean_spacing(b.coords, EMB_RADIUS).withColumn("spacing", _r(F.col("spacing"))), "mean_spacing",
    "SELECT sample_id, round(avg(d), 6) + 0.0 AS spacing FROM (SELECT a.sample_id, a.spot_id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM spots a JOIN spots b ON a.sample_id = b.sample_id AND a.spot_id <> b.spot_id GROUP BY 1, 2) GROUP BY 1",
)


@register(
    "knn_cosine",
    """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[64] AS e FROM embeddings),
    s AS (SELECT a.id AS i, b.id AS j, round(array_cosine_similarity(a.e, b.e), 9) + 0.0 AS similarity FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0)
    SELECT i, j, rank, round(similarity, 6) + 0.0 AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY similarity DESC, j) AS rank FROM s) WHERE rank <= 5""",
)
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return neighbours.nearest(rows, 5, queries=rows.where("id % 20 = 0")).select("i", "j", F.col("rank").cast("long"), _r(F.col("similarity")).alias("similarity"))


# Spatial variance. ``part`` is a sample where parts are solved alone.

_KW = "kw AS (SELECT k.sample_id, i, gene_id, sum(k * value) AS kw FROM k JOIN w ON w.spot_id = k.j AND w.sample_id = k.sample_id GROUP BY 1, 2, 3)"


def _groups(center: str) -> str:
    name = {"sample": "sample_id", "label": "sample_id || '|' || label"}[center]
    return f"grp AS (SELECT sample_id, spot_id, {name} AS c, count(*) OVER (PARTITION BY {name}) AS n_c FROM spots)"


def _gram_terms(center: str, part: str) -> str:
    """CTEs up to gram(part, g, h, v)."""
    p = "w.sample_id" if part == "sample" else "'all'"
    none = f"wtkw AS (SELECT {p} AS part, w.gene_id AS g, kw.gene_id AS h, sum(value * kw) AS v FROM w JOIN kw ON kw.i = w.spot_id GROUP BY 1, 2, 3)"
    if center == "none":
        return f"{_KW}, {none}, gram AS (SELECT * FROM wtkw)"
    q = "sample_id" if part == "sample" else "'all'"
    return f"""{_KW}, {_groups(center)}, {none},
    m AS (SELECT {q.replace("sample_id", "grp.sample_id")} AS part, c, gene_id AS g, sum(value) / any_value(n_c) AS m FROM w JOIN grp USING (spot_id) GROUP BY 1, 2, 3),
    cc AS (SELECT {q.replace("sample_id", "grp.sample_id")} AS part, c, gene_id AS g, sum(kw) AS cc FROM kw JOIN grp ON grp.spot_id = kw.i GROUP BY 1, 2, 3),
    a AS (SELECT {q.replace("sample_id", "gi.sample_id")} AS part, gi.c AS c1, gj.c AS c2, sum(k) AS a FROM k JOIN grp gi ON gi.spot_id = k.i JOIN grp gj ON gj.spot_id = k.j GROUP BY 1, 2, 3),
    mtc AS (SELECT m.part, m.g, cc.g AS h, sum(m * cc) AS v FROM m JOIN cc ON m.c = cc.c AND m.part = cc.part GROUP BY 1, 2, 3),
    am AS (SELECT a.part, c1 AS c, g, sum(a * m) AS am FROM a JOIN m ON m.c = a.c2 AND m.part = a.part GROUP BY 1, 2, 3),
    mtam AS (SELECT m.part, m.g, am.g AS h, sum(m * am) AS v FROM m JOIN am ON m.c = am.c AND m.part = am.part GROUP BY 1, 2, 3),
    gram AS (SELECT part, g, h, sum(v) AS v FROM (SELECT * FROM wtkw UNION ALL SELECT part, g, h, -v FROM mtc UNION ALL SELECT part, h, g, -v FROM mtc UNION ALL SELECT * FROM mtam) GROUP BY 1, 2, 3)"""


_DIAGONAL = "diag AS (SELECT part, g, v AS variance FROM gram WHERE g = h)"

for _center in ("none", "sample", "label"):
    _emb(
        lambda b, c=_center: spatial.spatial_variance(spatial.prepare(b, EMB_RADIUS, c)).select("g", _r(F.col("variance"), 2).alias("variance")),
        f"gene_spatial_variance_{_center}", f", {_gram_terms(_center, 'all')}, {_DIAGONAL} SELECT g, round(variance, 2) + 0.0 AS variance FROM diag".lstrip(), EMB,
    )
    SQL[f"gene_spatial_variance_{_center}"] = f"WITH {EMB}, {_gram_terms(_center, 'all')}, {_DIAGONAL} SELECT g, round(variance, 2) + 0.0 AS variance FROM diag"
for _center in ("sample", "label"):
    register(
        f"group_centering_{_center}",
        f"WITH {EMB}, {_groups(_center)} SELECT c, gene_id AS g, round(sum(value) / any_value(n_c), 6) + 0.0 AS m FROM w JOIN grp USING (spot_id) GROUP BY 1, 2",
    )(lambda spark, d, c=_center: spatial.group_means(spatial.prepare(embeddings_bundle(spark, d), EMB_RADIUS, c)).select("c", "g", _r(F.col("m")).alias("m")))


@register(
    "gene_spatial_variance_covariate",
    f"""WITH {EMB}, {_gram_terms("label", "all")},
    x AS (SELECT s.spot_id, ln(1 + coalesce(sum(value), 0)) AS x FROM spots s LEFT JOIN w USING (sample_id, spot_id) GROUP BY 1),
    xc AS (SELECT grp.spot_id, c, x - avg(x) OVER (PARTITION BY c) AS x FROM x JOIN grp USING (spot_id)),
    q AS (SELECT spot_id, c, x / sqrt(sum(x * x) OVER ()) AS q FROM xc),
    kq AS (SELECT k.i AS spot_id, sum(k * q) AS kq FROM k JOIN q ON q.spot_id = k.j GROUP BY 1),
    ckq AS (SELECT spot_id, kq - avg(kq) OVER (PARTITION BY c) AS z FROM kq JOIN grp USING (spot_id)),
    t AS (SELECT gene_id AS g, sum(value * q) AS t, sum(value * z) AS z FROM w JOIN q USING (spot_id) JOIN ckq USING (spot_id) GROUP BY 1),
    mq AS (SELECT sum(q * kq) AS mq FROM q JOIN kq USING (spot_id))
    SELECT g, round(v - 2 * t * z + t * t * (SELECT mq FROM mq), 2) + 0.0 AS variance FROM gram JOIN t USING (g) WHERE g = h""",
)
def gene_spatial_variance_covariate(spark: SparkSession, d: str) -> DataFrame:
    b = embeddings_bundle(spark, d)
    p = spatial.prepare(b, EMB_RADIUS, "label", covariates=preprocess.covariates(b, ["log_total_counts"]))
    return spatial.spatial_variance(p).select("g", _r(F.col("variance"), 2).alias("variance"))


def _by_sample(spark: SparkSession, d: str, center: str = "sample"):
    b = embeddings_bundle(spark, d)
    p = spatial.prepare(b, EMB_RADIUS, center, per_sample=True)
    return b, p


_SAMPLES = f"WITH {EMB}, {_gram_terms('sample', 'sample')}, {_DIAGONAL}"


@register("gene_scale", f"{_SAMPLES} SELECT part, g, round(pow(greatest(variance, 1e-12), -0.5), 8) + 0.0 AS d FROM diag")
def gene_scale(spark: SparkSession, d: str) -> DataFrame:
    return spatial.gene_scale(spatial.spatial_variance(_by_sample(spark, d)[1])).withColumn("d", _r(F.col("d"), 8))


@register("sample_weights_trace", f"{_SAMPLES} SELECT part, round(1e6 / greatest(sum(variance), 1e-12), 6) + 0.0 AS weight FROM diag GROUP BY 1")
def sample_weights_trace(spark: SparkSession, d: str) -> DataFrame:
    b, p = _by_sample(spark, d)
    return spatial.sample_weights(spatial.spatial_variance(p), b.spots).withColumn("weight", _r(F.col("weight") * 1e6))


@register("sample_weights_n_spots", f"WITH {EMB} SELECT sample_id AS part, round(1.0::DOUBLE / count(*), 9) + 0.0 AS weight FROM spots GROUP BY 1")
def sample_weights_n_spots(spark: SparkSession, d: str) -> DataFrame:
    b, _ = _by_sample(spark, d)
    return spatial.sample_weights(None, b.spots, "n_spots").withColumn("weight", _r(F.col("weight"), 9))


_COEFFICIENTS = "coef AS (SELECT * FROM (VALUES ('S0', 1.0::DOUBLE), ('S1', -0.5::DOUBLE), ('S2', -0.5::DOUBLE)) AS t(part, coefficient))"


def _coefficients(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("S0", 1.0), ("S1", -0.5), ("S2", -0.5)], "part string, coefficient double")


@register("pooled_scale", f"{_SAMPLES}, {_COEFFICIENTS} SELECT g, round(pow(greatest(sum(abs(coefficient) * variance), 1e-12), -0.5), 8) + 0.0 AS d FROM diag JOIN coef USING (part) GROUP BY 1")
def pooled_scale(spark: SparkSession, d: str) -> DataFrame:
    pooled = spatial.pooled_variance(spatial.spatial_variance(_by_sample(spark, d)[1]), _coefficients(spark))
    return spatial.gene_scale(pooled.withColumn("part", F.lit("all"))).select("g", _r(F.col("d"), 8).alias("d"))


@register("contrast_scores_samples", f"{_SAMPLES}, {_COEFFICIENTS} SELECT g, round(sum(coefficient * variance), 2) + 0.0 AS score FROM diag JOIN coef USING (part) GROUP BY 1")
def contrast_scores_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = spatial.spatial_variance(_by_sample(spark, d)[1]).join(_coefficients(spark), "part")
    return rows.groupBy("g").agg(_r(F.sum(F.col("coefficient") * F.col("variance")), 2).alias("score"))


@register(
    "contrast_scores_label",
    f"""WITH {EMB}, {_gram_terms("sample", "all")}, one AS (SELECT g, v FROM gram WHERE g = h),
    {_gram_terms("label", "all").replace("grp", "grp2").replace(_KW + ",", "").replace("wtkw", "wtkw2").replace("mtam", "mtam2").replace("mtc", "mtc2").replace("gram AS", "gram2 AS").replace(" m AS", " m2 AS").replace(" cc AS", " cc2 AS").replace(" a AS", " a2 AS").replace(" am AS", " am2 AS").replace("FROM m JOIN cc ON", "FROM m2 m JOIN cc2 cc ON").replace("FROM a JOIN m ON", "FROM a2 a JOIN m2 m ON").replace("FROM m JOIN am ON", "FROM m2 m JOIN am2 am ON")}
    SELECT one.g, round(one.v - t.v, 2) + 0.0 AS score FROM one JOIN (SELECT g, v FROM gram2 WHERE g = h) t USING (g)""",
)
def contrast_scores_label(spark: SparkSession, d: str) -> DataFrame:
    b = embeddings_bundle(spark, d)
    left, right = (spatial.spatial_variance(spatial.prepare(b, EMB_RADIUS, c)).select("g", F.col("variance").alias(c)) for c in ("sample", "label"))
    return left.join(right, "g").select("g", _r(F.col("sample") - F.col("label"), 2).alias("score"))


_SCALED = "sc AS (SELECT part, g, pow(greatest(variance, 1e-12), -0.5) AS d FROM diag), scaled AS (SELECT gram.part, gram.g, gram.h, v * a.d * b.d AS v FROM gram JOIN sc a ON a.part = gram.part AND a.g = gram.g JOIN sc b ON b.part = gram.part AND b.g = gram.h)"


@register("gram_sample", f"WITH {EMB}, {_gram_terms('sample', 'all')}, {_DIAGONAL}, {_SCALED} SELECT g, h, round(v, 6) + 0.0 AS v FROM scaled")
def gram_sample(spark: SparkSession, d: str) -> DataFrame:
    p = spatial.prepare(embeddings_bundle(spark, d), EMB_RADIUS, "sample")
    return commands.scaled(p)[0].select("g", "h", _r(F.col("v")).alias("v"))


@register(
    "gram_centered",
    f"""WITH {EMB}, {_gram_terms('none', 'all')}, {_DIAGONAL}, {_SCALED}, n AS (SELECT count(*) AS n FROM genes), rm AS (SELECT g, sum(v) / (SELECT n FROM n) AS rm FROM scaled GROUP BY 1), mm AS (SELECT sum(rm) / (SELECT n FROM n) AS mm FROM rm)
    SELECT a.g, b.g AS h, round(coalesce(v, 0) - a.rm - b.rm + (SELECT mm FROM mm), 6) + 0.0 AS v FROM rm a CROSS JOIN rm b LEFT JOIN scaled s ON s.g = a.g AND s.h = b.g""",
)
def gram_centered(spark: SparkSession, d: str) -> DataFrame:
    p = spatial.prepare(embeddings_bundle(spark, d), EMB_RADIUS, "none")
    return commands.scaled(p, gene_center=True)[0].select("g", "h", _r(F.col("v")).alias("v"))


@register("gram_shared", f"{_SAMPLES}, {_SCALED}, wt AS (SELECT part, 1 / greatest(sum(variance), 1e-12) AS weight FROM diag GROUP BY 1) SELECT g, h, round(sum(1e6 * weight * v), 5) + 0.0 AS v FROM scaled JOIN wt USING (part) GROUP BY 1, 2")
def gram_shared(spark: SparkSession, d: str) -> DataFrame:
    b, p = _by_sample(spark, d)
    g, variance, _ = commands.scaled(p)
    total = spatial.weighted_sum(g, spatial.sample_weights(variance, b.spots))
    return total.select("g", "h", _r(F.col("v") * 1e6, 5).alias("v"))


@register("gram_contrast", f"{_SAMPLES}, {_SCALED}, {_COEFFICIENTS} SELECT g, h, round(sum(coefficient * v), 6) + 0.0 AS v FROM scaled JOIN coef USING (part) GROUP BY 1, 2")
def gram_contrast(spark: SparkSession, d: str) -> DataFrame:
    g, _, _ = commands.scaled(_by_sample(spark, d)[1])
    return spatial.weighted_sum(g, _coefficients(spark).withColumnRenamed("coefficient", "weight")).withColumn("v", _r(F.col("v")))


@register("gram_trace", f"{_SAMPLES}, {_SCALED} SELECT part, round(sum(v), 6) + 0.0 AS trace FROM scaled WHERE g = h GROUP BY 1")
def gram_trace(spark: SparkSession, d: str) -> DataFrame:
    g, _, _ = commands.scaled(_by_sample(spark, d)[1])
    return g.where("g = h").groupBy("part").agg(_r(F.sum("v")).alias("trace"))


# Rankings over stored values: dimensions of the embeddings stand for modes, rows for genes or spots.

_LOAD = "load AS (SELECT 'V' || vec_id AS gene_id, vec_id AS spot_id, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::INT AS mode, label FROM embeddings)"
_EIGEN = f"{_LOAD}, eig AS (SELECT mode, sum(v * v) AS eigenvalue FROM load GROUP BY 1), ordered AS (SELECT (row_number() OVER (ORDER BY eigenvalue DESC, mode) - 1)::INT AS mode, eigenvalue FROM eig)"


def _loadings(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.select(F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("gene_id"), F.col("vec_id").alias("spot_id"), F.posexplode("embedding").alias("mode", "v"), "label").withColumn("v", F.col("v").cast("double"))


def _eigenvalues(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    sums = _loadings(spark, d).groupBy("mode").agg(F.sum(F.col("v") * F.col("v")).alias("eigenvalue"))
    return sums.select((F.row_number().over(W.orderBy(F.desc("eigenvalue"), "mode")) - 1).alias("mode"), "eigenvalue")


for _kind, _order in {"abs": "abs(v) DESC", "pos": "v DESC", "neg": "v ASC"}.items():
    register(
        f"top_genes_{_kind}",
        f"WITH {_LOAD} SELECT mode, gene_id, rank, round(v, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY {_order}, gene_id) AS rank FROM load) WHERE rank <= 8",
    )(lambda spark, d, k=_kind: ranking.top_genes(_loadings(spark, d).withColumnRenamed("v", "score"), 8, k, ["mode"]).select("mode", "gene_id", F.col("rank").cast("long").alias("rank"), _r(F.col("score")).alias("score")))
register(
    "cumulative_contribution",
    f"WITH {_LOAD} SELECT mode, gene_id, row_number() OVER o AS rank, round(sum(v * v) OVER (o ROWS UNBOUNDED PRECEDING) / sum(v * v) OVER (PARTITION BY mode), 6) + 0.0 AS share FROM load WINDOW o AS (PARTITION BY mode ORDER BY v * v DESC, gene_id)",
)(lambda spark, d: ranking.cumulative_contribution(_loadings(spark, d)).select("mode", "gene_id", F.col("rank").cast("long").alias("rank"), _r(F.col("share")).alias("share")))
register("fractional_energy", f"WITH {_LOAD} SELECT spot_id, mode, round(v * v / (sum(v * v) OVER (PARTITION BY spot_id) + 1e-12), 6) + 0.0 AS energy FROM load")(
    lambda spark, d: ranking.fractional_energy(_loadings(spark, d).withColumnRenamed("v", "value")).withColumn("energy", _r(F.col("energy")))
)
register("gene_loading_mass", f"WITH {_LOAD} SELECT gene_id, round(sum(v * v), 6) + 0.0 AS mass FROM load GROUP BY 1")(
    lambda spark, d: ranking.gene_loading_mass(_loadings(spark, d)).withColumn("mass", _r(F.col("mass")))
)
_RUN = "run AS (SELECT mode, sum(eigenvalue) OVER (ORDER BY mode) / sum(eigenvalue) OVER () AS s FROM ordered)"
_BEND = "logs AS (SELECT mode, ln(greatest(eigenvalue, 1e-30)) AS l FROM ordered WHERE mode < 50), bend AS (SELECT mode, lead(l, 2) OVER (ORDER BY mode) - 2 * lead(l, 1) OVER (ORDER BY mode) + l AS b FROM logs)"
_K1, _K2 = "(SELECT min(mode) + 1 FROM run WHERE s >= 0.9)", "(SELECT greatest(2, least(50, mode + 2)) FROM bend WHERE b IS NOT NULL ORDER BY b, mode LIMIT 1)"
register("choose_k_energy", f"WITH {_EIGEN}, {_RUN} SELECT {_K1}::BIGINT AS k")(lambda spark, d: ranking.choose_k_energy(_eigenvalues(spark, d)))
register("choose_k_elbow", f"WITH {_EIGEN}, {_BEND} SELECT {_K2}::BIGINT AS k")(lambda spark, d: ranking.choose_k_elbow(_eigenvalues(spark, d)))
register("choose_k_auto", f"WITH {_EIGEN}, {_RUN}, {_BEND} SELECT greatest(2, least({_K1}, {_K2}, (SELECT count(*) FROM ordered)))::BIGINT AS k")(lambda spark, d: ranking.choose_k(_eigenvalues(spark, d)))


@register(
    "compare_components",
    f"""WITH {_LOAD}, a AS (SELECT gene_id, mode AS mode_a, v AS x FROM load WHERE mode < 8), b AS (SELECT gene_id, mode - 8 AS mode_b, v AS y FROM load WHERE mode BETWEEN 8 AND 15),
    c AS (SELECT mode_a, mode_b, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS cosine FROM a JOIN b USING (gene_id) GROUP BY 1, 2)
    SELECT mode_a, mode_b, round(cosine, 6) + 0.0 AS cosine, row_number() OVER (PARTITION BY mode_a ORDER BY abs(cosine) DESC, mode_b) = 1 AS best FROM c""",
)
def compare_components(spark: SparkSession, d: str) -> DataFrame:
    rows = _loadings(spark, d).select("gene_id", "mode", "v")
    found = ranking.compare_components(rows.where("mode < 8"), rows.where("mode BETWEEN 8 AND 15").withColumn("mode", F.col("mode") - 8))
    return found.withColumn("cosine", _r(F.col("cosine")))


@register(
    "compare_components_halves",
    f"""WITH {_LOAD}, a AS (SELECT gene_id, mode AS mode_a, v AS x FROM load WHERE mode < 32), b AS (SELECT gene_id, mode - 32 AS mode_b, v AS y FROM load WHERE mode >= 32),
    c AS (SELECT mode_a, mode_b, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS cosine FROM a JOIN b USING (gene_id) GROUP BY 1, 2)
    SELECT mode_a, mode_b, round(cosine, 6) + 0.0 AS cosine, row_number() OVER (PARTITION BY mode_a ORDER BY abs(cosine) DESC, mode_b) = 1 AS best FROM c""",
)
def compare_components_halves(spark: SparkSession, d: str) -> DataFrame:
    """All stored dimensions: the first half against the second."""
    rows = _loadings(spark, d).select("gene_id", "mode", "v")
    found = ranking.compare_components(rows.where("mode < 32"), rows.where("mode >= 32").withColumn("mode", F.col("mode") - 32))
    return found.withColumn("cosine", _r(F.col("cosine")))


@register(
    "label_reference_match",
    f"""WITH {EMB}, n AS (SELECT label, sample_id AS reference, count(*) AS n FROM spots GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, reference) AS r FROM n)
    SELECT label, reference, CASE WHEN count(*) OVER (PARTITION BY reference) = 1 THEN reference ELSE reference || ' ' || row_number() OVER (PARTITION BY reference ORDER BY label) END AS name FROM b WHERE r = 1""",
)
def label_reference_match(spark: SparkSession, d: str) -> DataFrame:
    return ranking.match_labels(embeddings_bundle(spark, d).spots, "label", "sample_id")


@register("gene_cluster_sums", f"WITH {EMB}, cl AS (SELECT gene_id, length(gene_id) AS cluster FROM genes) SELECT spot_id, cluster, sum(value) AS total FROM w JOIN cl USING (gene_id) GROUP BY 1, 2")
def gene_cluster_sums(spark: SparkSession, d: str) -> DataFrame:
    b = embeddings_bundle(spark, d)
    return ranking.gene_cluster_sums(b.expression, b.genes.withColumn("cluster", F.length("gene_id").cast("long")))


register("mode_clip_limits", f"WITH {_LOAD} SELECT mode, round(least(quantile_cont(v, 0.01), -1e-12), 6) + 0.0 AS low, round(greatest(quantile_cont(v, 0.99), 1e-12), 6) + 0.0 AS high FROM load GROUP BY 1")(
    lambda spark, d: ranking.mode_clip_limits(_loadings(spark, d).withColumnRenamed("v", "value")).select("mode", _r(F.col("low")).alias("low"), _r(F.col("high")).alias("high"))
)

# Enrichment over genes: a gene's score in a sample stands for a mode.

_RANKED = "ranked AS (SELECT sample_id AS mode, gene_id, avg(value) AS score FROM w WHERE NOT (gene_id LIKE 'MT-%' OR gene_id LIKE 'RPL%' OR gene_id LIKE 'RPS%') GROUP BY 1, 2)"


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = embeddings_bundle(spark, d)
    sets = b.genes.where("gene_id LIKE 'G%'").select(F.concat(F.lit("set"), (F.substring("gene_id", 2, 9).cast("int") % 3).cast("string")).alias("set_name"), "gene_id")
    return enrichment.ranked_list(b.expression.select(F.col("sample_id").alias("mode"), "gene_id", F.col("value").alias("score"))), sets


register("gsea_ranking", f"WITH {EMB}, {_RANKED} SELECT mode, gene_id, round(score, 6) + 0.0 AS score FROM ranked")(lambda spark, d: _ranked(spark, d)[0].withColumn("score", _r(F.col("score"))))


@register(
    "gsea_running_sum",
    f"""WITH {EMB}, {_RANKED}, sets AS (SELECT 'set' || (substr(gene_id, 2)::INT % 3) AS set_name, gene_id FROM genes WHERE gene_id LIKE 'G%'),
    names AS (SELECT DISTINCT set_name FROM sets),
    rows AS (SELECT mode, set_name, gene_id, score, row_number() OVER (PARTITION BY mode, set_name ORDER BY score DESC, gene_id) AS rank, (SELECT count(*) FROM sets s WHERE s.set_name = names.set_name AND s.gene_id = ranked.gene_id) AS inside FROM ranked, names),
    tot AS (SELECT mode, set_name, count(*) AS n, sum(inside) AS size, sum(inside * abs(score)) AS weight FROM rows GROUP BY 1, 2),
    run AS (SELECT r.mode, r.set_name, size, sum(inside * abs(score) / weight - (1 - inside) / (n - size)::DOUBLE) OVER (PARTITION BY r.mode, r.set_name ORDER BY rank) AS s FROM rows r JOIN tot USING (mode, set_name))
    SELECT mode, set_name, size::BIGINT AS size, round(CASE WHEN max(s) >= -min(s) THEN max(s) ELSE min(s) END, 6) + 0.0 AS enrichment FROM run WHERE size BETWEEN 15 AND 500 GROUP BY 1, 2, 3""",
)
def gsea_running_sum(spark: SparkSession, d: str) -> DataFrame:
    ranked, sets = _ranked(spark, d)
    return enrichment.running_enrichment(ranked, sets).withColumn("enrichment", _r(F.col("enrichment")))


@register(
    "gsea_leading_edge",
    f"""WITH {EMB}, {_RANKED}, sets AS (SELECT 'set' || (substr(gene_id, 2)::INT % 3) AS set_name, gene_id FROM genes WHERE gene_id LIKE 'G%'),
    names AS (SELECT DISTINCT set_name FROM sets),
    rows AS (SELECT mode, set_name, gene_id, score, row_number() OVER (PARTITION BY mode, set_name ORDER BY score DESC, gene_id) AS rank, (SELECT count(*) FROM sets s WHERE s.set_name = names.set_name AND s.gene_id = ranked.gene_id) AS inside FROM ranked, names),
    tot AS (SELECT mode, set_name, count(*) AS n, sum(inside) AS size, sum(inside * abs(score)) AS weight FROM rows GROUP BY 1, 2),
    run AS (SELECT r.*, size, sum(inside * abs(score) / weight - (1 - inside) / (n - size)::DOUBLE) OVER (PARTITION BY r.mode, r.set_name ORDER BY rank) AS s, inside * abs(score) / weight AS step FROM rows r JOIN tot USING (mode, set_name)),
    hits AS (SELECT *, s - step AS before FROM run WHERE inside = 1 AND size BETWEEN 15 AND 500),
    ends AS (SELECT mode, set_name, max(s) AS top, min(before) AS bottom, arg_max(rank, s) AS peak, arg_min(rank, before) AS trough FROM hits GROUP BY 1, 2)
    SELECT mode, set_name, string_agg(gene_id, ',' ORDER BY rank) AS leading FROM hits JOIN ends USING (mode, set_name) WHERE CASE WHEN top >= -bottom THEN rank <= peak ELSE rank >= trough END GROUP BY 1, 2""",
)
def gsea_leading_edge(spark: SparkSession, d: str) -> DataFrame:
    ranked, sets = _ranked(spark, d)
    return enrichment.leading_edges(ranked, sets).select("mode", "set_name", F.array_join("leading", ",").alias("leading"))


# What whole commands must give whatever the eigenvectors' signs: traces, residuals, scores.

_WT = "wt AS (SELECT part, 1 / greatest(sum(variance), 1e-12) AS weight FROM diag GROUP BY 1)"


@register("gene_scores", f"WITH {EMB}, {_gram_terms('sample', 'all')}, {_DIAGONAL} SELECT 'all' AS scope, g AS gene_id, round(variance, 2) + 0.0 AS score, row_number() OVER (ORDER BY variance DESC, g)::BIGINT AS rank FROM diag QUALIFY rank <= 20")
def gene_scores(spark: SparkSession, d: str) -> DataFrame:
    return commands.gene_scores(embeddings_bundle(spark, d), EMB_RADIUS).select("scope", "gene_id", _r(F.col("score"), 2).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("weighted_gene_scores", f"{_SAMPLES}, {_WT} SELECT g, round(1e6 * sum(weight * variance), 5) + 0.0 AS score FROM diag JOIN wt USING (part) GROUP BY 1")
def weighted_gene_scores(spark: SparkSession, d: str) -> DataFrame:
    found = commands.shared_programs(embeddings_bundle(spark, d), EMB_RADIUS)
    return found.scores.where("part = 'weighted'").select("g", _r(F.col("score") * 1e6, 5).alias("score"))


@register("shared_program_trace", f"{_SAMPLES}, {_SCALED}, {_WT} SELECT count(DISTINCT g)::BIGINT AS modes, round(1e6 * sum(weight * v), 4) + 0.0 AS trace FROM scaled JOIN wt USING (part) WHERE g = h")
def shared_program_trace(spark: SparkSession, d: str) -> DataFrame:
    """All eigenvalues of the shared operator, which add up to its trace."""
    found = commands.shared_programs(embeddings_bundle(spark, d), EMB_RADIUS, k=62)
    return found.programs.agg(F.count("*").alias("modes"), _r(F.sum("eigenvalue") * 1e6, 4).alias("trace"))


@register("contrast_program_trace", f"{_SAMPLES}, {_SCALED}, {_WT}, {_COEFFICIENTS} SELECT count(DISTINCT g)::BIGINT AS modes, round(1e6 * sum(coefficient * weight * v), 4) + 0.0 AS trace FROM scaled JOIN wt USING (part) JOIN coef USING (part) WHERE g = h")
def contrast_program_trace(spark: SparkSession, d: str) -> DataFrame:
    found = commands.differential_sample_programs(embeddings_bundle(spark, d), ["S0"], ["S1", "S2"], EMB_RADIUS, k=62)
    return found.programs.agg(F.count("*").alias("modes"), _r(F.sum("eigenvalue") * 1e6, 4).alias("trace"))


@register("program_residuals", f"WITH {EMB} SELECT m::INT AS mode, 1.0::DOUBLE AS norm, 0.0::DOUBLE AS residual FROM (SELECT unnest(range(0, least(8, count(DISTINCT gene_id)))) AS m FROM w)")
def program_residuals(spark: SparkSession, d: str, **options) -> DataFrame:
    """The length of each eigenvector, and of G v less its eigenvalue times v."""
    b = embeddings_bundle(spark, d)
    g = commands.scaled(spatial.prepare(b, EMB_RADIUS, "sample"))[0]
    found = commands.spatial_programs(b, EMB_RADIUS, **options)
    v = found.gene_programs.select("mode", "g", "eigenvector")
    gv = g.join(v.withColumnRenamed("g", "h"), "h").groupBy("mode", "g").agg(F.sum(F.col("v") * F.col("eigenvector")).alias("gv"))
    rows = v.join(gv, ["mode", "g"]).join(found.programs.select("mode", "eigenvalue"), "mode")
    off = F.col("gv") - F.col("eigenvalue") * F.col("eigenvector")
    return rows.groupBy("mode").agg(_r(F.sqrt(F.sum(F.col("eigenvector") * F.col("eigenvector")))).alias("norm"), _r(F.sqrt(F.sum(off * off))).alias("residual"))


_FREE = {"solver": "free", "tolerance": 1e-10}


@register("program_residuals_free", SQL["program_residuals"])
def program_residuals_free(spark: SparkSession, d: str) -> DataFrame:
    """As ``program_residuals``, by the solver that makes no table of genes by genes."""
    return program_residuals(spark, d, **_FREE)


@register("shared_program_trace_free", SQL["shared_program_trace"])
def shared_program_trace_free(spark: SparkSession, d: str) -> DataFrame:
    found = commands.shared_programs(embeddings_bundle(spark, d), EMB_RADIUS, k=62, **_FREE)
    return found.programs.agg(F.count("*").alias("modes"), _r(F.sum("eigenvalue") * 1e6, 4).alias("trace"))


def _label_variance(side: str) -> str:
    """CTEs up to {side}_v(scope, v): the sum over genes of the spatial variance of a label's spots, or of all others, centred by sample."""
    inside = "l.scope = s.label" if side == "own" else "l.scope <> s.label"
    return f"""{side}_s AS (SELECT l.scope, s.sample_id, s.spot_id, count(*) OVER (PARTITION BY l.scope, s.sample_id) AS n FROM spots s JOIN labels l ON {inside}),
    {side}_k AS (SELECT a.scope, k.sample_id, i, j, k FROM k JOIN {side}_s a ON a.spot_id = k.i JOIN {side}_s b ON b.spot_id = k.j AND b.scope = a.scope),
    {side}_w AS (SELECT scope, w.sample_id, spot_id, gene_id, value, n FROM w JOIN {side}_s USING (sample_id, spot_id)),
    {side}_m AS (SELECT scope, sample_id, gene_id, sum(value) / any_value(n) AS m FROM {side}_w GROUP BY 1, 2, 3),
    {side}_kw AS (SELECT k.scope, k.sample_id, i, gene_id, sum(k * value) AS kw FROM {side}_k k JOIN {side}_w w ON w.scope = k.scope AND w.spot_id = k.j GROUP BY 1, 2, 3, 4),
    {side}_a AS (SELECT scope, sample_id, sum(k) AS a FROM {side}_k GROUP BY 1, 2),
    {side}_v AS (SELECT scope, sum(v) AS v FROM (
        SELECT w.scope, sum(value * kw) AS v FROM {side}_w w JOIN {side}_kw q ON q.scope = w.scope AND q.i = w.spot_id AND q.gene_id = w.gene_id GROUP BY 1 UNION ALL
        SELECT m.scope, -2 * sum(m * kw) FROM {side}_m m JOIN {side}_kw q USING (scope, sample_id, gene_id) GROUP BY 1 UNION ALL
        SELECT scope, sum(a * m * m) FROM {side}_m JOIN {side}_a USING (scope, sample_id) GROUP BY 1) GROUP BY 1)"""


_LABELS = f"WITH {EMB}, labels AS (SELECT DISTINCT label AS scope FROM spots), {_label_variance('own')}"
_TRACE = {"k": 62, "alpha": 0.0}


def _traces(found: commands.Programs) -> DataFrame:
    return found.programs.groupBy("scope").agg(_r(F.sum("eigenvalue"), 1).alias("trace"))


@register("label_program_traces", f"{_LABELS} SELECT scope, round(v, 1) + 0.0 AS trace FROM own_v")
def label_program_traces(spark: SparkSession, d: str) -> DataFrame:
    """All eigenvalues of each label's operator, which add up to its trace: all labels in one plan."""
    return _traces(commands.programs_by_label(embeddings_bundle(spark, d), EMB_RADIUS, **_TRACE))


@register("label_contrast_traces", f"{_LABELS}, {_label_variance('rest')} SELECT scope, round(o.v - r.v, 1) + 0.0 AS trace FROM own_v o JOIN rest_v r USING (scope)")
def label_contrast_traces(spark: SparkSession, d: str) -> DataFrame:
    """The same of each label against all others, whose neighbours are spots of the same sample and side."""
    return _traces(commands.label_contrasts(embeddings_bundle(spark, d), EMB_RADIUS, weighting="none", **_TRACE))


@register("label_gene_scores", f"""WITH {EMB}, labels AS (SELECT 'L1' AS scope UNION ALL SELECT 'L2'), {_label_variance('own').replace("SELECT scope, sum(v) AS v FROM (", "SELECT scope, gene_id, sum(v) AS v FROM (").replace("SELECT w.scope, sum(value * kw)", "SELECT w.scope, w.gene_id, sum(value * kw)").replace("SELECT m.scope, -2", "SELECT m.scope, gene_id, -2").replace("SELECT scope, sum(a * m * m)", "SELECT scope, gene_id, sum(a * m * m)").replace("GROUP BY 1 UNION ALL", "GROUP BY 1, 2 UNION ALL").replace("USING (scope, sample_id) GROUP BY 1) GROUP BY 1)", "USING (scope, sample_id) GROUP BY 1, 2) GROUP BY 1, 2)")}
    SELECT scope, gene_id, round(v, 2) + 0.0 AS score, row_number() OVER (PARTITION BY scope ORDER BY v DESC, gene_id)::BIGINT AS rank FROM own_v QUALIFY rank <= 20""")
def label_gene_scores(spark: SparkSession, d: str) -> DataFrame:
    found = commands.gene_scores(embeddings_bundle(spark, d), EMB_RADIUS, labels="L1, L2")
    return found.select("scope", "gene_id", _r(F.col("score"), 2).alias("score"), F.col("rank").cast("long").alias("rank"))


@register(
    "preprocessed_gene_scores",
    f"""WITH {EMB.replace("w AS (", "w0 AS (")}, w AS (SELECT sample_id, spot_id, gene_id, ln(1 + value * 1e4 / sum(value) OVER (PARTITION BY sample_id, spot_id)) AS value FROM w0
        WHERE gene_id IN (SELECT gene_id FROM w0 JOIN spots USING (spot_id) WHERE label <> 'L3' GROUP BY 1 HAVING sum(value) >= 2100) AND spot_id IN (SELECT spot_id FROM spots WHERE label <> 'L3')),
    labels AS (SELECT 'all' AS scope), {_label_variance('own').replace("l.scope = s.label", "s.label <> 'L3'").replace("SELECT scope, sum(v) AS v FROM (", "SELECT scope, gene_id, sum(v) AS v FROM (").replace("SELECT w.scope, sum(value * kw)", "SELECT w.scope, w.gene_id, sum(value * kw)").replace("SELECT m.scope, -2", "SELECT m.scope, gene_id, -2").replace("SELECT scope, sum(a * m * m)", "SELECT scope, gene_id, sum(a * m * m)").replace("GROUP BY 1 UNION ALL", "GROUP BY 1, 2 UNION ALL").replace("USING (scope, sample_id) GROUP BY 1) GROUP BY 1)", "USING (scope, sample_id) GROUP BY 1, 2) GROUP BY 1, 2)")}
    SELECT scope, gene_id, round(v, 4) + 0.0 AS score, row_number() OVER (ORDER BY v DESC, gene_id)::BIGINT AS rank FROM own_v QUALIFY rank <= 20""",
)
def preprocessed_gene_scores(spark: SparkSession, d: str) -> DataFrame:
    """The chain of a command: spots by label, genes by counts, totals, transform."""
    found = commands.gene_scores(embeddings_bundle(spark, d), EMB_RADIUS, preprocessing={"exclude": ["L3"], "min_counts": 2100, "kind": "log1p"})
    return found.select("scope", "gene_id", _r(F.col("score"), 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@register(
    "spectral_comparison",
    f"""WITH {_LOAD}, a AS (SELECT gene_id, mode AS mode_a, v AS x FROM load WHERE mode < 32), b AS (SELECT gene_id, mode - 32 AS mode_b, v AS y FROM load WHERE mode >= 32),
    ea AS (SELECT mode_a, sum(x * x) AS la FROM a GROUP BY 1), eb AS (SELECT mode_b, sum(y * y) AS lb FROM b GROUP BY 1),
    c AS (SELECT mode_a, mode_b, sum(x * y) / (sqrt(any_value(la)) * sqrt(any_value(lb))) AS cosine FROM a JOIN b USING (gene_id) JOIN ea USING (mode_a) JOIN eb USING (mode_b) GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY mode_a ORDER BY abs(cosine) DESC, mode_b) AS r FROM c),
    sums AS (SELECT mode_a, sum(cosine * cosine * lb) AS s FROM c JOIN eb USING (mode_b) GROUP BY 1)
    SELECT mode_a AS program_a, mode_b AS best_program_b, round(cosine, 6) + 0.0 AS signed_cosine, round(abs(cosine), 6) + 0.0 AS absolute_cosine, round(la, 5) + 0.0 AS eigenvalue_a, round(lb, 5) + 0.0 AS eigenvalue_b,
           round(la / (SELECT sum(la) FROM ea), 6) + 0.0 AS spectral_fraction_a, round(lb / (SELECT sum(lb) FROM eb), 6) + 0.0 AS spectral_fraction_b,
           round(s, 5) + 0.0 AS signed_spectral_score_b, round(s, 5) + 0.0 AS absolute_spectral_score_b
    FROM best JOIN ea USING (mode_a) JOIN eb USING (mode_b) JOIN sums USING (mode_a) WHERE r = 1""",
)
def spectral_comparison(spark: SparkSession, d: str) -> DataFrame:
    """All columns of a comparison but the overlap of subspaces, which needs an inverse."""
    rows = _loadings(spark, d).select("gene_id", "mode", "v")
    a, b = rows.where("mode < 32"), rows.where("mode >= 32").withColumn("mode", F.col("mode") - 32)
    eigen = lambda df: df.groupBy("mode").agg(F.sum(F.col("v") * F.col("v")).alias("eigenvalue"))
    pairs = cut(ranking.compare_components(a, b))
    found = ranking.spectral_comparison(pairs, eigen(a), eigen(b), ranking.subspace_overlap(pairs, ranking.compare_components(b, b))).drop("subspace_overlap_b")
    digits = {"eigenvalue_a": 5, "eigenvalue_b": 5, "signed_spectral_score_b": 5, "absolute_spectral_score_b": 5}
    return found.select(*[F.col(c) if c.endswith("program_a") or c.endswith("program_b") else _r(F.col(c), digits.get(c, 6)).alias(c) for c in found.columns])


_TOP = "SELECT mode, gene_id, round(v, 6) + 0.0 AS score, row_number() OVER (PARTITION BY mode ORDER BY {}, gene_id) AS rank FROM load QUALIFY rank <= 8"


@register(
    "gene_report",
    f"""WITH {_LOAD}, x AS ({_TOP.format("abs(v) DESC")}), p AS ({_TOP.format("v DESC")}), n AS ({_TOP.format("v ASC")})
    SELECT mode, rank::BIGINT AS rank, x.gene_id AS abs_gene, x.score AS abs_score, p.gene_id AS pos_gene, p.score AS pos_score, n.gene_id AS neg_gene, n.score AS neg_score
    FROM x JOIN p USING (mode, rank) JOIN n USING (mode, rank)""",
)
def gene_report(spark: SparkSession, d: str) -> DataFrame:
    found = ranking.gene_report(_loadings(spark, d).select("mode", "gene_id", F.col("v").alias("score")))
    return found.withColumns({"rank": F.col("rank").cast("long"), **{f"{k}_score": _r(F.col(f"{k}_score")) for k in ("abs", "pos", "neg")}})


@register("union_samples", f"WITH {EMB} SELECT substr(sample_id, 2, 1) AS sample_id, spot_id || '-' || substr(sample_id, 2, 1) AS spot_id, gene_id, value FROM w WHERE gene_id IN (SELECT gene_id FROM genes)")
def union_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """The samples of a bundle taken apart and put side by side again."""
    b = embeddings_bundle(spark, d)
    return union_samples({s: b.keep_spots(b.spots.where(F.col("sample_id") == f"S{s}")) for s in "012"}).expression.select("sample_id", "spot_id", "gene_id", "value")


# Whole commands: eigenvectors and clusters have no SQL.

register("spatial_programs")(lambda spark, d: commands.spatial_programs(embeddings_bundle(spark, d), EMB_RADIUS).gene_programs)
register("spot_modes")(lambda spark, d: commands.spatial_programs(embeddings_bundle(spark, d), EMB_RADIUS).spot_modes)
register("shared_programs")(lambda spark, d: commands.shared_programs(embeddings_bundle(spark, d), EMB_RADIUS).gene_programs)
register("differential_sample_programs")(lambda spark, d: commands.differential_sample_programs(embeddings_bundle(spark, d), ["S0"], ["S1", "S2"], EMB_RADIUS).gene_programs)
register("differential_label_programs")(lambda spark, d: commands.label_contrasts(embeddings_bundle(spark, d), EMB_RADIUS).gene_programs)
register("marker_programs")(lambda spark, d: commands.marker_programs(embeddings_bundle(spark, d), EMB_RADIUS).gene_programs)
register("cluster_genes")(lambda spark, d: commands.cluster_genes(commands.spatial_programs(embeddings_bundle(spark, d), EMB_RADIUS)))
register("cluster_spots")(lambda spark, d: commands.cluster_spots(commands.spatial_programs(embeddings_bundle(spark, d), EMB_RADIUS)))
register("label_programs")(lambda spark, d: commands.programs_by_label(embeddings_bundle(spark, d), EMB_RADIUS).gene_programs)
register("marker_programs_between_samples")(lambda spark, d: commands.marker_programs(embeddings_bundle(spark, d), EMB_RADIUS, "samples", covariates=["log_total_counts"]).gene_programs)


def _two(spark: SparkSession, d: str) -> tuple[commands.Programs, commands.Programs]:
    b = embeddings_bundle(spark, d)
    return commands.spatial_programs(b, EMB_RADIUS), commands.shared_programs(b, EMB_RADIUS)


register("compare_programs")(lambda spark, d: commands.compare_programs(*_two(spark, d)))
register("compare_spot_modes")(lambda spark, d: commands.compare_spot_modes(*_two(spark, d)))


@register("gsea")
def gsea(spark: SparkSession, d: str) -> DataFrame:
    return commands.gsea(commands.spatial_programs(embeddings_bundle(spark, d), EMB_RADIUS), _ranked(spark, d)[1])
