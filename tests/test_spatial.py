"""Operators against dense numpy on small random data, and the identities of their definitions."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.jobs import commands
from lociweave.operators import clustering, enrichment, kernel, neighbours, preprocess, programs, ranking, spatial
from lociweave.sources.bundle import Bundle, read_bundle, sample_names, union_samples, write_bundle

RADIUS = 0.3


def make(spark, n=60, genes=12, samples=2, seed=0):
    rng = np.random.default_rng(seed)
    xy, w = rng.random((n, 2)), rng.poisson(1.0, (n, genes)).astype(float)
    sample, label = [f"S{i % samples}" for i in range(n)], [f"L{i % 3}" for i in range(n)]
    spots = spark.createDataFrame([(sample[i], i, label[i]) for i in range(n)], "sample_id string, spot_id long, label string")
    coords = spark.createDataFrame([(sample[i], i, float(xy[i, 0]), float(xy[i, 1])) for i in range(n)], "sample_id string, spot_id long, x double, y double")
    rows = [(sample[i], i, f"g{j:02d}", float(w[i, j])) for i in range(n) for j in range(genes) if w[i, j]]
    expression = spark.createDataFrame(rows, "sample_id string, spot_id long, gene_id string, value double")
    gene = spark.createDataFrame([(f"g{j:02d}",) for j in range(genes)], "gene_id string")
    return Bundle(spots, coords, gene, expression), xy, w, np.array(sample), np.array(label)


def dense_kernel(xy, sample):
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)) / RADIUS
    return np.where((d < 1) & (sample[:, None] == sample[None]), np.maximum(1 - d, 0) ** 4 * (4 * d + 1), 0)


def centring(groups):
    same = groups[:, None] == groups[None]
    return np.eye(len(groups)) - same / same.sum(1)


@pytest.fixture(scope="module")
def data(spark):
    return make(spark)


def matrix(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[int(r["g"][1:]), int(r["h"][1:])] = r["v"]
    return out


@pytest.mark.parametrize("center", ["none", "sample", "label"])
@pytest.mark.parametrize("covariates", [None, ["log_total_counts", "log_detected_genes"]])
def test_gram_is_the_dense_product(data, center, covariates):
    bundle, xy, w, sample, label = data
    groups = {"none": None, "sample": sample, "label": np.char.add(sample, label)}[center]
    p = np.eye(len(w)) if groups is None else centring(groups)
    if covariates:
        x = p @ np.stack([np.log1p(w.sum(1)), np.log1p((w > 0).sum(1))], 1)
        q = np.linalg.qr(x)[0]
        p = (np.eye(len(w)) - q @ q.T) @ p
    want = w.T @ p.T @ dense_kernel(xy, sample) @ p @ w
    made = spatial.prepare(bundle, RADIUS, center, covariates=preprocess.covariates(bundle, covariates) if covariates else None)
    np.testing.assert_allclose(matrix(spatial.gram(made).drop("part"), 12), want, atol=1e-8)
    got = {r["g"]: r["variance"] for r in spatial.spatial_variance(made).collect()}
    np.testing.assert_allclose([got[f"g{j:02d}"] for j in range(12)], np.diag(want), atol=1e-8)


def test_programs_whiten_and_lift(data):
    bundle, xy, w, sample, _ = data
    found = commands.spatial_programs(bundle, RADIUS, k=12)
    values = {r["mode"]: r["eigenvalue"] for r in found.programs.collect()}
    assert sum(values.values()) == pytest.approx(12)  # one for each gene, under the scale of each gene's own variance
    modes = np.zeros((len(w), 12))
    for r in found.spot_modes.collect():
        modes[r["i"], r["mode"]] = r["value"]
    c = centring(sample)
    s = modes.T @ c.T @ dense_kernel(xy, sample) @ c @ modes
    np.testing.assert_allclose(s, np.eye(12), atol=1e-6)


def test_contrasts_have_both_signs(data):
    bundle = data[0]
    found = commands.differential_sample_programs(bundle, ["S0"], ["S1"], RADIUS, k=6)
    signs = {r["mode_sign"] for r in found.programs.collect()}
    assert signs == {-1, 1}
    sizes = [abs(r["eigenvalue"]) for r in found.programs.orderBy("mode").collect()]
    assert sizes == sorted(sizes, reverse=True)
    with pytest.raises(ValueError):
        commands.differential_label_programs(bundle, "no such label", RADIUS)


def test_every_label_against_the_rest(data):
    bundle = data[0]
    labels = {r["label"] for r in bundle.spots.where("label IS NOT NULL").select("label").distinct().collect()}
    found = commands.differential_programs_by_label(bundle, RADIUS, k=2)
    assert set(found) == labels and len(labels) > 1
    for label, mine in found.items():
        assert {r["scope"] for r in mine.gene_programs.select("scope").distinct().collect()} == {str(label)}
    with pytest.raises(ValueError):
        commands.differential_programs_by_label(bundle, RADIUS, ["no such label"])


def test_kernel_edges(spark):
    coords = spark.createDataFrame([("S", i, float(i), 0.0) for i in range(4)] + [("S", 4, 3.0, 0.0)], "sample_id string, spot_id long, x double, y double")
    at_one = kernel.wendland_kernel(coords, 1.0)
    assert {(r["i"], r["j"]) for r in at_one.collect()} == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (3, 4), (4, 3)}  # a distance of the radius has no weight
    assert kernel.isolated_fraction(coords, 1.0).first()["isolated"] == 0.0
    assert kernel.mean_spacing(coords, 0.01).first()["spacing"] == pytest.approx((1 + 1 + 1 + 0 + 0) / 5)


def test_labels_without_value(spark):
    spots = spark.createDataFrame([("S", 1, "a"), ("S", 2, None)], "sample_id string, spot_id long, label string")
    empty = spark.createDataFrame([], "sample_id string, spot_id long, gene_id string, value double")
    bundle = Bundle(spots, spots.select("sample_id", "spot_id"), empty.select("gene_id"), empty)
    assert [r["spot_id"] for r in preprocess.subset_by_labels(bundle, ["a"], exclude=True).spots.collect()] == [2]
    assert [r["spot_id"] for r in preprocess.subset_by_labels(bundle, ["a"]).spots.collect()] == [1]
    with pytest.raises(ValueError):
        preprocess.covariates(bundle, ["mito_fraction"])


def test_constant_covariate_is_dropped(data, spark):
    bundle = data[0]
    constant = bundle.spots.select("sample_id", "spot_id", F.lit(0.1).alias("c"))
    p = spatial.prepare(bundle, RADIUS, "sample", covariates=constant)
    assert p.basis.count() == 0


def test_orientation_and_ranking(spark):
    v = programs.oriented(np.array([[-0.9, 0.6], [0.1, 0.5]]))
    assert v[0, 0] > 0 and v[0, 1] > 0
    eigen = spark.createDataFrame([(0, 8.0), (1, 1.0), (2, 1.0)], "mode int, eigenvalue double")
    assert ranking.choose_k_energy(eigen, 0.9).first()["k"] == 2
    assert ranking.choose_k_energy(eigen.where("mode > 5")).first()["k"] == 0


def test_leiden_finds_cliques():
    i, j = [], []
    for block in range(3):
        for a in range(6):
            for b in range(6):
                if a != b:
                    i.append(6 * block + a)
                    j.append(6 * block + b)
    i += [0, 6, 6, 12]
    j += [6, 0, 12, 6]
    labels = clustering.leiden(18, np.array(i), np.array(j), np.ones(len(i)))
    assert [len(set(labels[6 * b : 6 * b + 6])) for b in range(3)] == [1, 1, 1] and len(set(labels)) == 3


# Models against dense numpy, by both solvers.

def dense_sides(data, sides, covariates=True):
    """For each (groups, rows) the dense W'SW over those rows."""
    _, xy, w, sample, _ = data
    out = []
    for groups, rows in sides:
        c = np.eye(rows.sum()) if groups is None else centring(groups[rows])
        p = c
        if covariates:
            x = c @ np.log1p(w[rows].sum(1))[:, None]
            q = x / np.linalg.norm(x)
            p = c - q @ (q.T @ c)
        out.append(w[rows].T @ p.T @ dense_kernel(xy[rows], sample[rows]) @ p @ w[rows])
    return out


def check(found, g, k, signed, loose=1e-7):
    """Eigenvalues, and that G v = lambda v."""
    values = np.linalg.eigvalsh(g)
    values = sorted(values, key=lambda x: -abs(x) if signed else -x)[:k]
    got = {r["mode"]: r["eigenvalue"] for r in found.programs.collect()}
    np.testing.assert_allclose([got[m] for m in range(k)], values, rtol=1e-7, atol=1e-9)
    v = np.zeros((len(g), k))
    for r in found.gene_programs.select("g", "mode", "eigenvector").distinct().collect():
        v[int(r["g"][1:]), r["mode"]] = r["eigenvector"]
    np.testing.assert_allclose(g @ v, v * [got[m] for m in range(k)], atol=loose * max(abs(x) for x in values))
    np.testing.assert_allclose(v.T @ v, np.eye(k), atol=1e-7)
    assert all((v[:, m][v[:, m] > 0] ** 2).sum() >= (v[:, m][v[:, m] < 0] ** 2).sum() - 1e-12 for m in range(k))


def whiten(g, alpha=1.0):
    d = np.maximum(np.diag(g), 1e-12) ** (-alpha / 2)
    return d[:, None] * g * d[None]


OPTIONS = {"k": 3, "covariates": ["log_total_counts"]}


@pytest.mark.parametrize("solver", ["dense", "free"])
def test_models_are_the_dense_ones(data, solver):
    bundle, xy, w, sample, label = data
    every, h = np.ones(len(w), bool), np.eye(12) - 1 / 12
    both = np.char.add(sample, label)
    found = commands.spatial_programs(bundle, RADIUS, gene_center=True, solver=solver, **OPTIONS)
    check(found, h @ whiten(dense_sides(data, [(sample, every)])[0]) @ h, 3, False)
    left, right = dense_sides(data, [(sample, every), (both, every)])
    d = np.diag(left) ** -0.5
    check(commands.marker_programs(bundle, RADIUS, solver=solver, **OPTIONS), d[:, None] * (left - right) * d, 3, True)
    sides = dense_sides(data, [(sample, sample == s) for s in ("S0", "S1")])
    check(commands.shared_programs(bundle, RADIUS, solver=solver, **OPTIONS), sum(whiten(g) / np.trace(g) for g in sides), 3, False)
    pool = (np.diag(sides[0]) + np.diag(sides[1])) ** -0.5
    found = commands.paired_programs(bundle, "S0", "S1", RADIUS, weighting="none", normalise_by="pooled", solver=solver, **OPTIONS)
    check(found, pool[:, None] * (sides[0] - sides[1]) * pool, 3, True)


def test_other_contrasts_layers_and_labels(data, tmp_path, spark):
    bundle, xy, w, sample, label = data
    every = np.ones(len(w), bool)
    none, own = dense_sides(data, [(None, every), (sample, every)], covariates=False)
    d = np.diag(own) ** -0.5
    check(commands.marker_programs(bundle, RADIUS, "samples", k=2, normalise_by="right"), d[:, None] * (none - own) * d, 2, True)
    half = replace(bundle, expression=bundle.expression.withColumn("value", F.lit(1.0)), layers=bundle.expression.withColumn("layer", F.lit("raw")))
    found = commands.condition_programs(half, {"S0": "x", "S1": "y"}, "x", "y", RADIUS, k=2, layer="raw", weighting="n_spots")
    sides = dense_sides(data, [(sample, sample == s) for s in ("S0", "S1")], covariates=False)
    check(found, whiten(sides[0]) / 30 - whiten(sides[1]) / 30, 2, True)
    assert {r["part"] for r in found.scores.select("part").distinct().collect()} == {"weighted", "S0", "S1"}
    write_bundle(half, str(tmp_path / "b"))
    again = read_bundle(spark, str(tmp_path / "b"))
    assert again.layers.count() == bundle.expression.count() and read_bundle(spark, str(tmp_path / "b")).matrix("raw").columns
    write_bundle(bundle, str(tmp_path / "plain"))
    assert read_bundle(spark, str(tmp_path / "plain")).layers is None
    joined = union_samples({"a": half, "b": half})
    assert joined.layers.count() == 2 * bundle.expression.count() and joined.spots.select("sample_id").distinct().count() == 2
    by_label = commands.label_programs(bundle, RADIUS, ["L1"], k=2)["L1"]
    rows = label == "L1"
    check(by_label, whiten(dense_sides(data, [(sample, rows)], covariates=False)[0]), 2, False)
    assert {r["scope"] for r in commands.gene_scores(bundle, RADIUS, 3, labels=["L0", "L1"], covariates=["log_total_counts"]).collect()} == {"L0", "L1"}
    assert sample_names(["/x/a.b", "/y/c/"]) == ["a", "c"]
    with pytest.raises(ValueError):
        sample_names(["/x/a", "/y/a"])


def test_spots_without_expression_have_zero_modes(data):
    bundle = data[0]
    short = replace(bundle, expression=bundle.expression.where("spot_id <> 5"))
    found = commands.spatial_programs(short, RADIUS, k=2)
    assert {(r["mode"], r["value"]) for r in found.spot_modes.where("i = 5").collect()} == {(0, 0.0), (1, 0.0)}
    assert found.spot_modes.count() == 2 * 60


def test_stored_results_and_comparisons(data, tmp_path, spark):
    bundle = data[0]
    a, b = commands.spatial_programs(bundle, RADIUS, k=4), commands.shared_programs(bundle, RADIUS, k=3)
    path = str(tmp_path / "store")
    a.write(path, "one", {"radius": RADIUS}, bundle.spots)
    b.write(path, "two")
    assert commands.read_settings(spark, path, "one") == {"radius": RADIUS}
    read = commands.read_programs(spark, path, "one", first=2)
    assert {r["mode"] for r in read.gene_programs.select("mode").distinct().collect()} == {0, 1}
    assert "PartitionFilters" in read.gene_programs._jdf.queryExecution().toString()

    def dense(p, key, value, rows, k):
        out = np.zeros((rows, k))
        for r in p.select(key, "mode", value).distinct().collect():
            out[int(str(r[key]).lstrip("g")), r["mode"]] = r[value]
        return out

    for kind, (x, y) in {
        "program": (dense(a.gene_programs, "g", "eigenvector", 12, 4), dense(b.gene_programs, "g", "eigenvector", 12, 3)),
        "spot_mode": (dense(a.spot_modes, "i", "value", 60, 4), dense(b.spot_modes, "i", "value", 60, 3)),
    }.items():
        if kind == "spot_mode":
            x, y = x - x.mean(0), y - y.mean(0)
        u, v = x / np.linalg.norm(x, axis=0), y / np.linalg.norm(y, axis=0)
        cos = u.T @ v
        eb = np.array([r["eigenvalue"] for r in b.programs.orderBy("mode").collect()])
        overlap = ((np.linalg.qr(v)[0].T @ u) ** 2).sum(0)
        got = commands.compare_stored(spark, (path, "one"), (path, "two"), f"{kind}s", output=str(tmp_path / kind)).orderBy(f"{kind}_a").collect()
        best = np.abs(cos).argmax(1)
        assert [r[f"best_{kind}_b"] for r in got] == best.tolist()
        np.testing.assert_allclose([r["signed_cosine"] for r in got], cos[np.arange(4), best], atol=1e-9)
        np.testing.assert_allclose([r["subspace_overlap_b"] for r in got], overlap, atol=1e-9)
        np.testing.assert_allclose([r["signed_spectral_score_b"] for r in got], (cos**2) @ eb, atol=1e-9)
        assert spark.read.option("header", True).csv(str(tmp_path / kind)).count() == 4
    assert commands.summary(spark, path)["experiments"] == ["one", "two"] if (write_bundle(bundle, path) or True) else None
    with pytest.raises(Exception, match="zero norm"):
        zero = replace(b, gene_programs=b.gene_programs.withColumn("eigenvector", F.lit(0.0)))
        commands.compare_programs(a, zero).collect()
    with pytest.raises(ValueError):
        commands.compare_programs(a, replace(b, gene_programs=b.gene_programs.where("g = 'x'")))


def test_results_without_weight_do_not_fail(spark):
    zero = spark.createDataFrame([(0, 0.0), (1, 0.0)], "mode int, eigenvalue double")
    assert ranking.choose_k_energy(zero).first()["k"] == 0 and ranking.choose_k(zero).first()["k"] == 2
    loads = spark.createDataFrame([(0, "a", 0.0), (0, "b", 0.0)], "mode int, gene_id string, v double")
    assert {r["share"] for r in ranking.cumulative_contribution(loads).collect()} == {0.0}
    scores = spark.createDataFrame([(m, f"x{i:02d}", 0.0 if m else float(i)) for m in (0, 1) for i in range(20)], "mode int, gene_id string, score double")
    sets = spark.createDataFrame([("all", f"x{i:02d}") for i in range(20)] + [("some", f"x{i:02d}") for i in range(15)], "set_name string, gene_id string")
    got = enrichment.permutation_scores(scores, sets, 50).collect()
    assert len(got) == 4 and all(0 <= r["p"] <= 1 and abs(r["enrichment"]) <= 1 + 1e-9 for r in got)
    report = ranking.gene_report(scores, 3).where("mode = 0").orderBy("rank").collect()
    assert [(r["abs_gene"], r["pos_gene"], r["neg_gene"]) for r in report] == [("x19", "x19", "x00"), ("x18", "x18", "x01"), ("x17", "x17", "x02")]


def test_gsea_of_programs(data, spark):
    found = commands.spatial_programs(data[0], RADIUS, k=2)
    sets = spark.createDataFrame([("s", f"g{j:02d}") for j in range(6)], "set_name string, gene_id string")
    ranked = enrichment.ranked_list(found.gene_programs.select("mode", F.col("g").alias("gene_id"), F.col("eigenvector").alias("score")))
    first = {r["mode"]: r["enrichment"] for r in enrichment.running_enrichment(ranked, sets, min_size=5).collect()}
    for mode, enrichment_of in first.items():
        rows = sorted(((r["score"], r["gene_id"]) for r in ranked.where(F.col("mode") == mode).collect()), key=lambda x: (-x[0], x[1]))
        weight = np.array([abs(s) if int(g[1:]) < 6 else 0.0 for s, g in rows])
        run = np.cumsum(weight / weight.sum() - np.array([int(g[1:]) >= 6 for _, g in rows]) / 6)
        assert enrichment_of == pytest.approx(run.max() if run.max() >= -run.min() else run.min())
    assert commands.gsea(found, sets, [0], 20).count() == 0  # the set is too small
    assert commands.mode_slice("0:2", 4) == [0, 1] and commands.mode_slice("1,-1", 4) == [1, 3] and commands.mode_slice("::2", 4) == [0, 2] and commands.mode_slice("3", 4) == [3]
    for bad in ("x", "9", ""):
        with pytest.raises(ValueError):
            commands.mode_slice(bad, 4)


@pytest.mark.parametrize("metric", neighbours.METRICS)
def test_neighbours(spark, metric):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(c, 0.3, (60, 6)) for c in rng.normal(0, 2, (8, 6))])
    df = spark.createDataFrame([(int(i), [float(y) for y in x]) for i, x in enumerate(v)] + [(0, [float(y) for y in v[0]])], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T if metric == "cosine" else -np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(s, -np.inf)
    want = {i: set(np.argsort(-s[i], kind="stable")[:5].tolist()) for i in range(len(v))}
    got = {}
    for r in neighbours.nearest(df, 5, metric, block_rows=100).collect():
        got.setdefault(r["i"], set()).add(r["j"])
    assert got == want
    found = {}
    for r in neighbours.nearest(df, 5, metric, lists=12, probes=3, block_rows=50).collect():
        found.setdefault(r["i"], set()).add(r["j"])
    assert np.mean([len(found[i] & want[i]) / 5 for i in want]) >= 0.9


def test_clusters_by_joins_are_those_of_one_task(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 5, (4, 5))
    v = np.concatenate([rng.normal(c, 0.2, (40, 5)) for c in centres])
    df = spark.createDataFrame([(f"n{i:03d}", [float(y) for y in x]) for i, x in enumerate(v)], "id string, v array<double>")
    for options in ({}, {"largest": 20}):
        got = {r["id"]: r["cluster"] for r in clustering.cluster(df, 10, 0.3, **options).collect()}
        groups = [{got[f"n{i:03d}"] for i in range(40 * k, 40 * k + 40)} for k in range(4)]
        assert len(got) == 160 and not any(groups[a] & groups[b] for a in range(4) for b in range(a))
        assert sum(map(len, groups)) <= (4 if not options else 40)


def test_clusters_by_joins_alone_are_the_groups(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 5, (4, 5))
    v = np.concatenate([rng.normal(c, 0.2, (40, 5)) for c in centres])
    df = spark.createDataFrame([(f"n{i:03d}", [float(y) for y in x]) for i, x in enumerate(v)], "id string, v array<double>")
    for options in ({"largest": 0},):
        got = {r["id"]: r["cluster"] for r in clustering.cluster(df, 10, 0.1, **options).collect()}
        groups = [{got[f"n{i:03d}"] for i in range(40 * k, 40 * k + 40)} for k in range(4)]
        assert len(got) == 160 and all(len(g) == 1 for g in groups) and set().union(*groups) == {0, 1, 2, 3}


def test_communities_by_joins_come_near_the_modularity_of_one_task_and_hang_together(spark):
    rng, n = np.random.default_rng(9), 200
    group = rng.permutation(n) % 8
    inside = group[:, None] == group[None, :]
    a = np.triu(rng.random((n, n)) < np.where(inside, 0.35, 0.01), 1)
    a = a * np.round(rng.uniform(0.5, 1.5, (n, n)), 3)
    a = a + a.T
    i, j = np.nonzero(a)
    edges = spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)], "i long, j long, s double")
    degree, total = a.sum(1), a.sum()

    def modularity(label):
        same = label[:, None] == label[None, :]
        return ((a - np.outer(degree, degree) / total) * same).sum() / total

    def in_pieces(vertices):
        left, pieces = set(vertices), 0
        while left:
            pieces, queue = pieces + 1, [left.pop()]
            while queue:
                near = {int(y) for y in np.flatnonzero(a[queue.pop()]) if int(y) in left}
                left -= near
                queue += near
        return pieces

    graph, member, communities = clustering.coarsened(edges, 0, 1.0)
    part = {r["v"]: r["c"] for r in member.collect()}
    assert all(in_pieces([v for v in part if part[v] == c]) == 1 for c in set(part.values()))  # refined parts
    into = {r["v"]: r["c"] for r in clustering.connected(graph, communities).collect()}
    label = np.array([into[part[v]] for v in range(n)])
    assert all(in_pieces(np.flatnonzero(label == c).tolist()) == 1 for c in set(label.tolist()))
    assert modularity(label) >= 0.97 * modularity(clustering.leiden(n, i, j, a[i, j]))
    # a turn never lowers it
    degrees = spark.createDataFrame([(v, float(d)) for v, d in enumerate(degree)], "v long, degree double")
    labels, before = spark.range(n).selectExpr("id AS v", "id AS c"), modularity(np.arange(n))
    for turn in range(2):
        labels, *_ = clustering.moved(edges, labels, degrees, float(total), 1.0, turn)
        got = {r["v"]: r["c"] for r in labels.collect()}
        after = modularity(np.array([got[v] for v in range(n)]))
        assert after >= before - 1e-12
        before = after
