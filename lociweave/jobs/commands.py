"""The commands: whole analyses of a bundle, and their result tables."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, enrichment, kernel, krylov, preprocess, programs, ranking, spatial
from ..operators.products import class_count
from ..sources.bundle import Bundle
from ..sources.lineage import cut

TABLES = ("programs", "gene_programs", "scores", "spot_modes")
COMMITS = "experiment_id string, scope string, version string, turn long, settings string, recorded string"


@dataclass(frozen=True)
class Programs:
    """programs(scope, mode, eigenvalue, mode_sign), gene_programs(scope, mode, [part,] g, eigenvector, gene_score, loading), scores(scope, part, g, score), spot_modes(scope, part, i, mode, value), and the settings that they were made with."""

    programs: DataFrame
    gene_programs: DataFrame
    scores: DataFrame
    spot_modes: DataFrame
    settings: dict = field(default_factory=dict)

    def of(self, scope: str) -> Programs:
        """The tables of one scope."""
        return replace(self, **{t: getattr(self, t).where(F.col("scope") == scope) for t in TABLES})

    def write(self, path: str, experiment: str, settings: dict | None = None, spots: DataFrame | None = None) -> None:
        """Store the tables under an experiment's name, in place of what it has of the same scopes, with what the command records of itself and the given settings.

        All tables of a write are partitions of a version of its own. One file of ``experiments``, written last, names the
        version of each scope: until it is there readers see the scopes as they were. Versions that no scope has any more
        are deleted then. ``spots``: all spots, for a null mode where one is out of scope.
        """
        spark, version = self.programs.sparkSession, f"v{uuid.uuid4().hex}"
        modes = programs.full_modes(self.spot_modes, spots) if spots is not None else self.spot_modes
        for name, df in zip(TABLES, (self.programs, self.gene_programs, self.scores, modes), strict=True):
            df.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{path}/{name}")
        scopes = [r["scope"] for r in self.programs.select("scope").distinct().collect()]  # one for each label at most
        before = _commits(spark, path)
        given, own = (json.dumps(x, sort_keys=True, default=str) for x in (settings or {}, self.settings))
        turn = 1 + max((r["turn"] for r in before), default=0)
        spark.createDataFrame([(experiment, s, version, turn, given, own) for s in scopes or ["all"]], COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/experiments")
        live = {r["version"] for r in _latest(_commits(spark, path))}
        for old in {r["version"] for r in before} - live:
            for name in TABLES:
                place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/version={old}")
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _commits(spark: SparkSession, path: str) -> list:
    """All commits; a few rows for each write."""
    return spark.read.schema(COMMITS).parquet(f"{path}/experiments").collect() if _exists(spark, f"{path}/experiments") else []


def _latest(commits: list) -> list:
    """Of each experiment and scope the last commit."""
    found = {}
    for r in sorted(commits, key=lambda r: r["turn"]):
        found[r["experiment_id"], r["scope"]] = r
    return list(found.values())


def _stored(spark: SparkSession, path: str, experiment: str, scope: str | None) -> list:
    found = [r for r in _latest(_commits(spark, path)) if r["experiment_id"] == experiment and scope in (None, r["scope"])]
    if not found:
        raise ValueError(f"no experiment {experiment!r}" + (f" of {scope!r}" if scope is not None else ""))
    return found


def read_programs(spark: SparkSession, path: str, experiment: str, first: int | None = None, scope: str | None = None) -> Programs:
    """The stored tables of an experiment, or of one of its scopes: their partitions only, and of the modes the ``first`` ones."""
    stored = _stored(spark, path, experiment, scope)
    versions = sorted({r["version"] for r in stored})
    named = spark.createDataFrame([(r["version"], r["scope"]) for r in stored], "version string, scope string")

    def table(name: str) -> DataFrame:
        # other experiments may have other columns
        df = spark.read.option("basePath", f"{path}/{name}").option("mergeSchema", True).parquet(*[f"{path}/{name}/version={v}" for v in versions])
        df = df.join(F.broadcast(named), ["version", "scope"], "left_semi").drop("version")  # a row for each scope
        return df.where(F.col("mode") < first) if first is not None and "mode" in df.columns else df

    return Programs(*map(table, TABLES), json.loads(max(stored, key=lambda r: r["turn"])["recorded"]))


def read_settings(spark: SparkSession, path: str, experiment: str, scope: str | None = None, recorded: bool = False) -> dict:
    """The settings that an experiment, or one of its scopes, was stored with last, or with ``recorded`` those that its command took."""
    return json.loads(max(_stored(spark, path, experiment, scope), key=lambda r: r["turn"])["recorded" if recorded else "settings"])


def mode_slice(text: str, count: int) -> list[int]:
    """Modes of ``count`` by a selection such as ``3``, ``1,4`` or ``first:end:step``."""
    try:
        if ":" in text:
            return list(range(count))[slice(*[int(x) if x.strip() else None for x in text.split(":")])]
        chosen = [int(x) for x in text.split(",")]
    except ValueError as e:
        raise ValueError(f"no selection of modes: {text!r}") from e
    if outside := [m for m in chosen if not -count <= m < count]:
        raise ValueError(f"there are {count} modes, not {outside}")
    return [m % count for m in chosen]


def scaled(p: spatial.Prepared, alpha: float = 1.0, gene_center: bool = False, scale: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scaled Gram of each part, its variances and the scale."""
    g = cut(spatial.gram(p))  # genes by genes: read by the variances, the scaling and each result table
    variance = g.where("g = h").select("part", "g", F.col("v").alias("variance"))
    scale = spatial.gene_scale(variance, alpha) if scale is None else scale
    return spatial.scaled_gram(g, scale, p.genes if gene_center else None), variance, scale


@dataclass(frozen=True)
class Scopes:
    """What is solved in one plan: members(sample_id, spot_id, part), or None for all spots or samples as parts, parts(part, scope, coefficient, name), and the classes that overlapping parts consist of."""

    members: DataFrame | None
    parts: DataFrame
    classes: spatial.Classes | None = None


def _solve(
    bundle: Bundle, radius: float, sides: list[tuple[str, float]], per_sample: bool = False, k: int = 8, alpha: float = 1.0, gene_center: bool = False,
    covariates: list[str] | None = None, layer: str | None = None, scope: str = "all", weighting: str = "none", coefficients: DataFrame | None = None,
    normalise_by: str = "sample", solver: str = "auto", tolerance: float = krylov.TOLERANCE, preprocessing: dict | None = None, scopes=None, command: str = "",
) -> Programs:
    """Modes of the weighted sum over ``sides`` (centring, sign) and parts; of each scope, where ``scopes`` (of a bundle) gives several.

    ``preprocessing``: options of ``preprocess.preprocess``, which then filters and transforms the bundle; else it is
    taken as it is. Scales come from each part's own variances, from all parts' of the scope (``normalise_by="pooled"``), or, with
    two sides, from the first or, ``"right"``, the second. Up to ``programs.DENSE_GENES`` genes the tables of genes by genes are
    made, and a task solves each scope's; for more, or with ``solver="free"``, they are never made.
    """
    if solver not in ("auto", "dense", "free"):
        raise ValueError(f"unknown solver {solver!r}")
    settings = {
        "command": command, "preprocessing": preprocessing, "covariates": covariates, "layer": layer,
        "model": {"kernel": "wendland_c2", "radius": radius, "k": k, "alpha": alpha, "gene_center": gene_center, "sides": sides, "per_sample": per_sample, "weighting": weighting, "normalise_by": normalise_by, "solver": solver},
    }
    if preprocessing is not None:
        bundle, found = preprocess.preprocess(bundle, covariates, layer, **({"shared": per_sample and scopes is None} | preprocessing))
        bundle = replace(bundle, genes=cut(bundle.genes), expression=cut(bundle.expression))
    else:
        found = preprocess.covariates(bundle, covariates, layer) if covariates else None
    found = cut(found) if found is not None else None
    spark = bundle.spots.sparkSession
    if scopes is not None:
        several = scopes(bundle)
    elif per_sample:
        each = bundle.spots.select(F.col("sample_id").alias("part")).distinct()
        each = each.join(coefficients, "part") if coefficients is not None else each.withColumn("coefficient", F.lit(1.0))
        several = Scopes(None, each.select("part", F.lit(scope).alias("scope"), "coefficient", F.col("part").alias("name")))
    else:
        several = Scopes(None, spark.createDataFrame([("all", scope, 1.0, "all")], "part string, scope string, coefficient double, name string"))
    parts = cut(several.parts)
    one = scopes is None and not per_sample  # a single part
    prepared = [spatial.prepare(bundle, radius, center, per_sample, layer, found, several.members, several.classes) for center, _ in sides]
    genes = prepared[0].genes
    free = solver == "free" or (solver == "auto" and genes.count() > programs.DENSE_GENES)
    if free:  # the steps and what they begin with read these tables again
        prepared = [replace(p, rows=cut(p.rows), near=cut(p.near), at=cut(p.at), groups=cut(p.groups) if p.groups is not None else None, basis=cut(p.basis) if p.basis is not None else None) for p in prepared]
    grams = [] if free else [cut(spatial.gram(p)) for p in prepared]
    variances = [cut(spatial.spatial_variance(p)) for p in prepared] if free else [g.where("g = h").select("part", "g", F.col("v").alias("variance")) for g in grams]
    weights = parts.withColumn("weight", F.col("coefficient"))
    if not one:
        own = spatial.sample_weights(variances[0], prepared[0].spots.withColumnRenamed("part", "sample_id"), weighting)
        weights = parts.join(own, "part").withColumn("weight", F.col("weight") * F.col("coefficient"))
    weights = cut(weights.select("part", "scope", "weight"))
    if normalise_by == "pooled":
        pooled = variances[0].join(parts, "part").groupBy("scope", "g").agg(F.sum(F.abs("coefficient") * F.col("variance")).alias("variance"))
        scale = spatial.gene_scale(pooled.join(parts.select("scope", "part"), "scope").select("part", "g", "variance"), alpha)
    else:
        scale = spatial.gene_scale(variances[-1 if normalise_by == "right" else 0], alpha)
    scale = cut(scale.join(parts.select("part", "scope"), "part"))
    signed = len(sides) > 1 or coefficients is not None or scopes is not None and not parts.where("coefficient < 0").isEmpty()
    of = [weights.withColumn("weight", F.col("weight") * sign) for _, sign in sides]
    center = genes if gene_center else None
    if free:
        modes, made = None, [[cut(x) for x in spatial.factors(p)] for p in prepared]
        for s in [r["scope"] for r in parts.select("scope").distinct().collect()]:  # labels; the tables are made already
            mine = lambda df, s=s: df.where(F.col("scope") == s).drop("scope")
            terms = [krylov.Term(p, *x, mine(scale), mine(w)) for p, x, w in zip(prepared, made, of, strict=True)]
            present = genes if gene_center else mine(scale).select("g").distinct()
            found = krylov.leading_modes(terms, cut(present), k, signed, s, gene_center, tolerance)
            modes = found if modes is None else modes.unionByName(found)
    else:
        total = None
        for g, w in zip(grams, of, strict=True):
            rows = spatial.scaled_gram(g, scale.drop("scope"), center).join(w.where("weight <> 0"), "part")
            rows = rows.select("scope", "g", "h", (F.col("weight") * F.col("v")).alias("v"))
            total = rows if total is None else total.unionByName(rows)
        modes = programs.leading_modes(total.groupBy("scope", "g", "h").agg(F.sum("v").alias("v")), k, signed, genes=genes)
    modes = cut(modes)  # genes by modes, for each scope
    loadings = cut(programs.gene_loadings(modes, scale, center))
    rows = None
    for v, w in zip(variances, of, strict=True):
        mine = v.join(w, "part").select("scope", "g", (F.col("weight") * F.col("variance")).alias("score"))
        rows = mine if rows is None else rows.unionByName(mine)
    scores = rows.groupBy("scope", "g").agg(F.sum("score").alias("score"))
    alone = not per_sample and not signed  # each scope is one part
    scores = scores.select("scope", F.lit("all" if one or alone else "weighted").alias("part"), "g", "score")
    if len(sides) > 1 or not (one or alone):  # beside the sum, what it is made of
        names = ["left", "right"] if len(sides) > 1 else [None]
        for name, v in zip(names, variances, strict=True):
            scores = scores.unionByName(v.join(parts, "part").select("scope", F.lit(name).alias("part") if name else F.col("name").alias("part"), "g", F.col("variance").alias("score")))
    kinds = modes.select("scope", "mode", "eigenvalue", "mode_sign").distinct()
    at_spots = programs.spot_modes(prepared[0], loadings)
    named = parts.select("scope", "part", "name")
    if one or alone or normalise_by == "pooled":
        lifted = loadings.drop("part").distinct()
    else:
        lifted = loadings.join(named, ["scope", "part"]).drop("part").withColumnRenamed("name", "part")
    if not one:
        at_spots = at_spots.join(named, ["scope", "part"]).select("scope", (F.lit("all") if alone else F.col("name")).alias("part"), "i", "mode", "value")
    table = modes.join(lifted, ["scope", "g", "mode"]).drop("eigenvalue", "mode_sign")
    return Programs(kinds, table, scores, at_spots, settings)


def spatial_programs(bundle: Bundle, radius: float, center: str = "sample", **options) -> Programs:
    """Programs of all samples of a bundle taken together. ``options`` of this and the other commands: see ``_solve``."""
    return _solve(bundle, radius, [(center, 1.0)], **{"command": "spatial_programs"} | options)


def _labels(bundle: Bundle, labels: list | str | None) -> list:
    """Labels of the data: all of them for None or ``all``, or those of a list, or of a text with commas, read as the column's type; in ascending order where all are meant."""
    known = [r["label"] for r in bundle.spots.select("label").where("label IS NOT NULL").distinct().orderBy("label").collect()]  # labels are categories
    if isinstance(labels, str):
        kind = type(known[0]) if known else str
        try:
            labels = None if labels == "all" else [kind(x.strip()) for x in labels.split(",")]
        except ValueError as e:
            raise ValueError(f"labels not in the data: {labels}") from e
    if missing := set(labels or []) - set(known):
        raise ValueError(f"labels not in the data: {sorted(missing)}")
    return labels or known


def _label_parts(labels: list):
    """Scopes of a bundle: each label's spots alone."""

    def scopes(b: Bundle) -> Scopes:
        members = b.spots.where(F.col("label").isin(labels)).select("sample_id", "spot_id", F.col("label").cast("string").alias("part"))
        rows = [(str(x), str(x), 1.0, "all") for x in labels]
        return Scopes(members, b.spots.sparkSession.createDataFrame(rows, "part string, scope string, coefficient double, name string"))

    return scopes


def programs_by_label(bundle: Bundle, radius: float, labels: list | str | None = None, center: str = "sample", **options) -> Programs:
    """Programs of the spots of each label by themselves, all in one plan; a scope is a label."""
    return _solve(bundle, radius, [(center, 1.0)], **{"command": "programs_by_label", "scopes": _label_parts(_labels(bundle, labels))} | options)


def label_programs(bundle: Bundle, radius: float, labels: list | str | None = None, **options) -> dict[str, Programs]:
    """``programs_by_label``, the tables of each label by themselves."""
    chosen = _labels(bundle, labels)
    found = programs_by_label(bundle, radius, chosen, **options)
    return {x: found.of(str(x)) for x in chosen}


def shared_programs(bundle: Bundle, radius: float, center: str = "sample", weighting: str = "trace", **options) -> Programs:
    """Programs that two or more samples share."""
    if bundle.spots.select("sample_id").distinct().limit(2).count() < 2:
        raise ValueError("more than one sample is needed")
    return _solve(bundle, radius, [(center, 1.0)], **{"command": "shared_programs", "per_sample": True, "weighting": weighting} | options)


def differential_sample_programs(bundle: Bundle, a: list[str], b: list[str], radius: float, center: str = "sample", weighting: str = "trace", **options) -> Programs:
    """Programs of samples ``a`` against samples ``b``."""
    if not a or not b:
        raise ValueError("each side needs a sample")
    rows = [(s, 1.0 / len(a)) for s in a] + [(s, -1.0 / len(b)) for s in b]
    coefficients = bundle.spots.sparkSession.createDataFrame(rows, "part string, coefficient double")
    found = _solve(bundle, radius, [(center, 1.0)], **{"command": "differential_sample_programs", "per_sample": True, "weighting": weighting, "coefficients": coefficients} | options)
    return replace(found, settings=found.settings | {"sample_coefficients": dict(rows)})


def paired_programs(bundle: Bundle, a: str, b: str, radius: float, **options) -> Programs:
    """Programs of one sample against another."""
    return differential_sample_programs(bundle, [a], [b], radius, **options)


def condition_programs(bundle: Bundle, conditions: dict[str, str], positive: str, negative: str, radius: float, **options) -> Programs:
    """Programs of the samples of one condition against those of another; ``conditions`` has each sample's."""
    of = lambda c: sorted(s for s, x in conditions.items() if x == c)
    return differential_sample_programs(bundle, of(positive), of(negative), radius, **options)


def _label_classes(b: Bundle, labels: list) -> spatial.Classes:
    """Each label and all others as unions of classes: the labels of a chunk, as many as a task keeps apart, and the spots of none of these."""
    labels, size = list(dict.fromkeys(labels)), class_count(b.genes.select("gene_id").distinct().count()) - 1
    text = b.spots.sparkSession.range(1).select(*[F.lit(x).cast("string") for x in labels]).first()  # as Spark writes labels
    names, unions = [], {}
    for a in range(0, len(labels), size):
        chunk, of = str(a), {x: f"{a} {n}" for n, x in enumerate(text[a : a + size])}
        others = f"{chunk} others"
        name = F.lit(others)
        for label, known in zip(labels[a : a + size], of.values(), strict=True):
            name = F.when(F.col("label") == F.lit(label), known).otherwise(name)
        names.append(name)
        unions[chunk] = {f"label {x}": [own] for x, own in of.items()} | {f"rest {x}": [*[y for y in of.values() if y != own], others] for x, own in of.items()}
    return spatial.Classes(b.spots.select("sample_id", "spot_id", F.explode(F.array(*names)).alias("part")), unions)


def _against_the_rest(labels: list):
    """Scopes of a bundle: each label's spots, and all others, which may be of any label or of none. Spots stay in their samples."""

    def scopes(b: Bundle) -> Scopes:
        known = F.explode(F.array(*[F.lit(x) for x in labels])).alias("_of")
        rows = b.spots.select("sample_id", "spot_id", "label", known)
        name = F.when(F.coalesce(F.col("label") == F.col("_of"), F.lit(False)), "label").otherwise("rest")
        scope = F.col("_of").cast("string")
        rows = rows.select("sample_id", "spot_id", scope.alias("scope"), name.alias("name")).withColumn("part", F.concat("name", F.lit(" "), "scope"))
        sides = rows.select("part", "scope", "name").distinct().collect()  # two for each label at most
        if lacking := sorted({str(x) for x in labels} - {r["scope"] for r in sides if r["name"] == "label"} | {r["scope"] for r in sides} - {r["scope"] for r in sides if r["name"] == "rest"}):
            raise ValueError(f"labels {lacking} have no spots, or no others")
        parts = [(r["part"], r["scope"], 1.0 if r["name"] == "label" else -1.0, r["name"]) for r in sides]
        known = b.spots.sparkSession.createDataFrame(parts, "part string, scope string, coefficient double, name string")
        return Scopes(rows.select("sample_id", "spot_id", "part"), known, _label_classes(b, labels))

    return scopes


def label_contrasts(bundle: Bundle, radius: float, labels: list | str | None = None, center: str = "sample", weighting: str = "trace", **options) -> Programs:
    """Programs of each label's spots against all others, all in one plan; a scope is a label, its parts are ``label`` and ``rest``."""
    return _solve(bundle, radius, [(center, 1.0)], **{"command": "label_contrasts", "weighting": weighting, "scopes": _against_the_rest(_labels(bundle, labels))} | options)


def differential_label_programs(bundle: Bundle, label, radius: float, **options) -> Programs:
    """Programs of one label's spots against all others."""
    return label_contrasts(bundle, radius, [label], **options)


def differential_programs_by_label(bundle: Bundle, radius: float, labels: list | str | None = None, **options) -> dict[str, Programs]:
    """``label_contrasts``, the tables of each label by themselves."""
    chosen = _labels(bundle, labels)
    found = label_contrasts(bundle, radius, chosen, **options)
    return {x: found.of(str(x)) for x in chosen}


def marker_programs(bundle: Bundle, radius: float, between: str = "labels", **options) -> Programs:
    """What one centring keeps and a finer one removes: by sample less by label, or, ``between="samples"``, none less by sample."""
    if between not in ("labels", "samples"):
        raise ValueError(f"unknown contrast {between!r}")
    left, right = ("sample", "label") if between == "labels" else ("none", "sample")
    return _solve(bundle, radius, [(left, 1.0), (right, -1.0)], **{"command": "marker_programs"} | options)


def gene_scores(
    bundle: Bundle, radius: float, n: int = 20, center: str = "sample", covariates: list[str] | None = None, layer: str | None = None, labels: list | str | None = None, preprocessing: dict | None = None,
) -> DataFrame:
    """(scope, gene_id, score, rank): the ``n`` genes of the largest spatial variance, of all spots or, in one plan, of each of ``labels``."""
    if preprocessing is not None:
        bundle, found = preprocess.preprocess(bundle, covariates, layer, **preprocessing)
    else:
        found = preprocess.covariates(bundle, covariates, layer) if covariates else None
    members = _label_parts(_labels(bundle, labels))(bundle).members if labels is not None else None
    variance = spatial.spatial_variance(spatial.prepare(bundle, radius, center, layer=layer, covariates=found, members=members))
    rows = ranking.top_genes(variance.select(F.col("part").alias("scope"), F.col("g").alias("gene_id"), F.col("variance").alias("score")), n, by=["scope"])
    return rows.select("scope", "gene_id", "score", "rank")


def _compared(a: DataFrame, b: DataFrame, eigen_a: DataFrame, eigen_b: DataFrame, key: str) -> DataFrame:
    if a.select("gene_id").join(b.select("gene_id"), "gene_id", "left_semi").isEmpty():
        raise ValueError("the two analyses share nothing to compare on")
    shared = a.select("gene_id").distinct().join(b.select("gene_id").distinct(), "gene_id", "left_semi")
    own = b.join(shared, "gene_id", "left_semi")
    pairs, within = cut(ranking.compare_components(a, b)), ranking.compare_components(own, own)  # a number for each two modes
    return ranking.spectral_comparison(pairs, eigen_a, eigen_b, ranking.subspace_overlap(pairs, within), key)


def compare_programs(a: Programs, b: Programs) -> DataFrame:
    """Each mode of A with its best match in B, by their eigenvectors over the genes of both."""
    vectors = lambda p: p.gene_programs.select(F.col("g").alias("gene_id"), "mode", F.col("eigenvector").alias("v")).distinct()  # noqa: E731  # one for all parts
    return _compared(vectors(a), vectors(b), a.programs, b.programs, "program")


def compare_spot_modes(a: Programs, b: Programs) -> DataFrame:
    """Best matches over the spots that have finite values in both, centred."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    modes = [cut(p.spot_modes.select("i", "mode", "value")) for p in (a, b)]  # spots by modes: read by every step
    ok = lambda m: m.groupBy("i").agg(F.bool_and(finite).alias("ok")).where("ok").select("i")
    both = cut(ok(modes[0]).join(ok(modes[1]), "i", "left_semi"))

    def centred(m: DataFrame) -> DataFrame:
        rows = m.join(both, "i", "left_semi")
        means = rows.groupBy("mode").agg(F.avg("value").alias("mean"))
        return cut(rows.join(F.broadcast(means), "mode").select(F.col("i").alias("gene_id"), "mode", (F.col("value") - F.col("mean")).alias("v")))  # a row for each mode

    return _compared(*map(centred, modes), a.programs, b.programs, "spot_mode")


def compare_stored(spark: SparkSession, a: tuple[str, str], b: tuple[str, str], kind: str = "programs", components: int | None = None, output: str | None = None) -> DataFrame:
    """Compares two stored experiments (path, name), their first ``components`` modes; ``output``: a CSV folder of one file, as the result has a row for each mode."""
    found = {"programs": compare_programs, "spot_modes": compare_spot_modes}[kind](*[read_programs(spark, *x, first=components) for x in (a, b)])
    if output:
        found.coalesce(1).write.mode("overwrite").option("header", True).csv(output)
    return found


def gsea(found: Programs, sets: DataFrame, modes: list[int] | None = None, permutations: int = 1000) -> DataFrame:
    """Enrichment of gene sets in each mode's ranking by eigenvector, against random sets, with false discovery rates and the genes that lead it."""
    rows = found.gene_programs if modes is None else found.gene_programs.where(F.col("mode").isin(modes))
    ranked = enrichment.ranked_list(rows.select("mode", F.col("g").alias("gene_id"), F.col("eigenvector").alias("score")))
    ranked = cut(ranked)
    scores = enrichment.permutation_scores(ranked, sets, permutations)
    return scores.join(enrichment.leading_edges(ranked, sets).drop("enrichment"), ["mode", "set_name"])


def estimate_spacing(bundle: Bundle, first_radius: float) -> DataFrame:
    return kernel.mean_spacing(bundle.coords, first_radius)


def summary(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Columns of a bundle's spots, the experiments stored beside it, if any, and their scopes."""
    known = _latest(_commits(spark, path))
    scopes = sorted({f"{r['experiment_id']}: {r['scope']}" for r in known})
    return {"spots": spark.read.parquet(f"{path}/spots").columns, "experiments": sorted({r["experiment_id"] for r in known}), "scopes": scopes}


def _vectors(rows: DataFrame, key: str, value: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("mode", value)))  # a number for each mode
    return rows.groupBy(F.col(key).alias("id")).agg(F.transform(ordered, lambda x: x[value]).alias("v"))


def cluster_genes(found: Programs, neighbours: int = 15, resolution: float = 1.0, n_genes: int | None = None, metric: str = "cosine", **options) -> DataFrame:
    """(id, cluster) of genes by their scores. ``options``: ``exact`` neighbours and the ``largest`` graph of one task, see ``clustering.cluster``."""
    rows = found.gene_programs.select("mode", "g", "gene_score").distinct()
    if n_genes:
        total = found.scores.where(F.col("part").isin("all", "weighted")).select(F.col("g").alias("gene_id"), "score")
        rows = rows.join(ranking.top_genes(total, n_genes).select(F.col("gene_id").alias("g")), "g", "left_semi")
    return clustering.cluster(_vectors(rows, "g", "gene_score"), neighbours, resolution, metric=metric, **options)


def cluster_spots(found: Programs, neighbours: int = 15, resolution: float = 1.0, metric: str = "cosine", **options) -> DataFrame:
    """(id, cluster) of spots by their modes, with the ``options`` of ``cluster_genes``."""
    return clustering.cluster(_vectors(found.spot_modes, "i", "value"), neighbours, resolution, metric=metric, **options)
