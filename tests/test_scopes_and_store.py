"""Labels in one plan, stored results, both solvers' edges, preprocessing inside commands and false discovery rates, against dense numpy."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_spatial import RADIUS, centring, check, dense_kernel, make, whiten

from lociweave.jobs import commands
from lociweave.operators import enrichment, kernel, krylov, preprocess, products, ranking


@pytest.fixture(scope="module")
def data(spark):
    """Two samples whose coordinates overlap, three labels, and spots without one."""
    bundle, xy, w, sample, label = make(spark, n=72, seed=9)
    label = np.where(np.arange(72) % 12 == 0, None, label)
    spots = spark.createDataFrame([(sample[i], i, label[i]) for i in range(72)], "sample_id string, spot_id long, label string")
    return replace(bundle, spots=spots), xy, w, sample, label


def side(data, rows, covariate=False):
    """The dense W'SW of some spots: pairs of one sample among them, centred by sample."""
    _, xy, w, sample, _ = data
    p = centring(sample[rows])
    if covariate:
        x = p @ np.log1p(w[rows].sum(1))[:, None]
        q = x / np.linalg.norm(x)
        p = p - q @ (q.T @ p)
    return w[rows].T @ p.T @ dense_kernel(xy[rows], sample[rows]) @ p @ w[rows]


@pytest.mark.parametrize("solver", ["dense", "free"])
def test_label_contrasts_stay_in_their_samples(data, solver):
    bundle, *_, label = data
    found = commands.label_contrasts(bundle, RADIUS, ["L0", "L2"], k=3, solver=solver, covariates=["log_total_counts"], tolerance=1e-6)
    for x in ("L0", "L2"):
        inside = label == x
        own, rest = side(data, inside, True), side(data, ~inside, True)
        check(found.of(x), whiten(own) / np.trace(own) - whiten(rest) / np.trace(rest), 3, True, 1e-5)
        parts = {(r["part"], r["g"]): r["score"] for r in found.of(x).scores.collect()}
        np.testing.assert_allclose([parts["label", f"g{j:02d}"] for j in range(12)], np.diag(own), atol=1e-8)
        np.testing.assert_allclose([parts["weighted", f"g{j:02d}"] for j in range(12)], np.diag(own) / np.trace(own) - np.diag(rest) / np.trace(rest), atol=1e-10)
        assert {(r["part"], r["i"]) for r in found.of(x).spot_modes.select("part", "i").distinct().collect()} == {("label" if inside[i] else "rest", i) for i in range(72)}
    assert {r["scope"] for r in found.programs.collect()} == {"L0", "L2"}


@pytest.mark.parametrize("solver", ["dense", "free"])
def test_all_labels_in_one_plan_are_each_by_itself(data, solver):
    bundle, *_, label = data
    found = commands.programs_by_label(bundle, RADIUS, "L1, L0", k=2, solver=solver, gene_center=True, tolerance=1e-6)
    h = np.eye(12) - 1 / 12
    for x in ("L0", "L1"):
        check(found.of(x), h @ whiten(side(data, label == x)) @ h, 2, False, 1e-5)
        assert {r["part"] for r in found.of(x).spot_modes.collect()} == {"all"} and "part" not in found.gene_programs.columns
        assert {r["i"] for r in found.of(x).spot_modes.collect()} == set(np.flatnonzero(label == x).tolist())
    assert {r["scope"] for r in commands.gene_scores(bundle, RADIUS, 2, labels="all").collect()} == {"L0", "L1", "L2"}
    with pytest.raises(ValueError, match="not in the data"):
        commands.programs_by_label(bundle, RADIUS, "L1,nothing")


def test_pooled_scales_are_each_scope_s_own(data):
    bundle, *_, label = data
    found = commands.label_contrasts(bundle, RADIUS, ["L0", "L1"], k=3, weighting="none", normalise_by="pooled")
    for x in ("L0", "L1"):
        own, rest = side(data, label == x), side(data, label != x)
        d = (np.diag(own) + np.diag(rest)) ** -0.5
        check(found.of(x), d[:, None] * (own - rest) * d, 3, True)


def test_one_label_only_has_no_rest(data, spark):
    bundle = data[0]
    alone = bundle.keep_spots(bundle.spots.where("label = 'L1'"))
    with pytest.raises(ValueError, match="no others"):
        commands.differential_label_programs(alone, "L1", RADIUS)


# Stored results


def rows(df):
    """Sums come in any order, so their last digits may differ."""
    return sorted(str([round(v, 9) + 0.0 if isinstance(v, float) else v for v in r]) for r in df.select(*sorted(df.columns)).collect())


def test_store_keeps_scopes_apart_and_writes_once(data, tmp_path, spark):
    bundle, path = data[0], str(tmp_path / "store")
    both = commands.programs_by_label(bundle, RADIUS, ["L0", "L1"], k=2)
    shared = commands.shared_programs(bundle, RADIUS, k=2)
    for _ in range(2):
        both.of("L0").write(path, "e", {"round": 1})
        both.of("L1").write(path, "e", {"round": 2})
        shared.write(path, "other")
    whole = commands.read_programs(spark, path, "e")
    for t in commands.TABLES:
        assert rows(getattr(whole, t)) == rows(getattr(both, t))
        assert rows(getattr(commands.read_programs(spark, path, "e", scope="L1"), t)) == rows(getattr(both.of("L1"), t))
        assert rows(getattr(commands.read_programs(spark, path, "other"), t)) == rows(getattr(shared, t))
    assert commands.read_settings(spark, path, "e", "L0") == {"round": 1} and commands.read_settings(spark, path, "e") == {"round": 2}
    recorded = commands.read_settings(spark, path, "other", recorded=True)
    assert recorded["command"] == "shared_programs" and recorded["model"]["radius"] == RADIUS and recorded["model"]["weighting"] == "trace"
    # a whole experiment takes the place of its scopes; versions that nothing has go
    both.write(path, "e")
    assert rows(commands.read_programs(spark, path, "e").scores) == rows(both.scores)
    assert spark.read.parquet(f"{path}/programs").select("version").distinct().count() == 2
    # what was written without its commit is not seen
    both.programs.withColumn("version", F.lit("vlost")).write.mode("append").partitionBy("version").parquet(f"{path}/programs")
    assert commands.read_programs(spark, path, "e").programs.count() == both.programs.count()
    with pytest.raises(ValueError):
        commands.read_programs(spark, path, "e", scope="L2")
    with pytest.raises(ValueError):
        commands.read_programs(spark, path, "none")


def test_summary_of_a_bundle_without_experiments(data, tmp_path, spark):
    from lociweave.sources.bundle import write_bundle

    write_bundle(data[0], str(tmp_path / "b"))
    assert commands.summary(spark, str(tmp_path / "b")) == {"spots": ["sample_id", "spot_id", "label"], "experiments": [], "scopes": []}


# Solvers


@pytest.mark.parametrize("solver", ["dense", "free"])
def test_solvers_on_nothing_and_on_zero_modes(data, spark, solver):
    bundle = data[0]
    empty = replace(bundle, **{t: getattr(bundle, t).where("1 = 0") for t in ("spots", "coords", "genes", "expression")})
    found = commands.spatial_programs(empty, RADIUS, solver=solver)
    assert [getattr(found, t).count() for t in commands.TABLES] == [0] * 4
    h = np.eye(12) - 1 / 12
    everywhere = np.ones(72, bool)
    check(commands.spatial_programs(bundle, RADIUS, k=12, gene_center=True, solver=solver), h @ whiten(side(data, everywhere)) @ h, 12, False)


def test_restarts_keep_the_basis_narrow(spark, monkeypatch):
    big = make(spark, n=150, genes=60, seed=3)
    g = whiten(side((big[0], *big[1:]), np.ones(150, bool)))
    monkeypatch.setattr(krylov, "EXTRA", 1)
    monkeypatch.setattr(krylov, "WIDTH", 4)
    widths = []
    plain = krylov.products
    monkeypatch.setattr(krylov, "products", lambda rows: (widths.append((s := plain(rows)).shape[0]), s)[1])
    check(commands.spatial_programs(big[0], RADIUS, k=2, solver="free", tolerance=1e-5), g, 2, False, 1e-3)
    assert max(widths) <= 5 * 3 and len(widths) > 18  # more steps than fit without a restart


def test_block_products_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(products, "CELLS", 40)
    monkeypatch.setattr(products, "ROWS", 7)
    rng = np.random.default_rng(2)
    entries = [(f"p{i % 3}", i, f"g{j}", float(v)) for i in range(60) for j in range(9) if (v := rng.integers(0, 3))]
    kernel = [(f"p{i % 3}", i, j, 1.0 if i == j else float((i * j) % 7) / 9) for i in range(60) for j in range(i % 3, 60, 3)]
    w, k = spark.createDataFrame(entries, "part string, i long, g string, value double"), spark.createDataFrame(kernel, "part string, i long, j long, k double")
    genes = spark.createDataFrame([(f"g{j}",) for j in range(10)], "g string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {(r["part"], r["g"], r["h"]): r["v"] for r in products.spot_products(w, k, genes).collect()}
        diagonal = {(r["part"], r["g"]): r["v"] for r in products.spot_products(w, k, genes, diagonal=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    by = {}
    for p, i, g, v in entries:
        by.setdefault((p, i), []).append((g, v))
    for p, i, j, x in kernel:
        for g, a in by.get((p, i), []):
            for h, b in by.get((p, j), []):
                want[p, g, h] = want.get((p, g, h), 0) + a * x * b
    assert got.keys() == {x for x, v in want.items() if v} and all(abs(got[x] - want[x]) < 1e-9 for x in got)
    assert diagonal.keys() == {(p, g) for p, g, h in want if g == h} and all(abs(diagonal[p, g] - want[p, g, g]) < 1e-9 for p, g in diagonal)


# Preprocessing inside commands


def test_commands_filter_and_transform_counts_themselves(data, spark):
    bundle, xy, w, sample, label = data
    keep = np.array([x != "L2" for x in label])
    genes = w[keep].sum(0) >= 45
    assert 2 < genes.sum() < 12
    options = {"exclude": ["L2"], "min_counts": 45, "target": 100.0, "kind": "sqrt"}
    found = commands.spatial_programs(bundle, RADIUS, k=2, covariates=["log_total_counts"], preprocessing=options)
    counts = w[keep][:, genes]
    x = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1e-300) * 100)
    c = centring(sample[keep])
    q = c @ np.log1p(counts.sum(1))[:, None]  # of the counts, before they are scaled
    p = c - (q / np.linalg.norm(q)) @ ((q / np.linalg.norm(q)).T @ c)
    g = whiten(x.T @ p.T @ dense_kernel(xy[keep], sample[keep]) @ p @ x)
    names = [f"g{j:02d}" for j in np.flatnonzero(genes)]
    v = np.zeros((len(names), 2))
    for r in found.gene_programs.collect():
        v[names.index(r["g"]), r["mode"]] = r["eigenvector"]
    values = [r["eigenvalue"] for r in found.programs.orderBy("mode").collect()]
    np.testing.assert_allclose(values, np.linalg.eigvalsh(g)[::-1][:2], rtol=1e-7)
    np.testing.assert_allclose(g @ v, v * values, atol=1e-7)
    assert found.settings["preprocessing"] == options
    shared = commands.shared_programs(bundle, RADIUS, k=1, preprocessing={"min_counts": 30})
    passing = np.all([w[sample == s].sum(0) >= 30 for s in ("S0", "S1")], axis=0)
    assert {r["g"] for r in shared.gene_programs.collect()} == {f"g{j:02d}" for j in np.flatnonzero(passing)}
    with pytest.raises(ValueError, match="unknown preprocessing"):
        preprocess.preprocess(bundle, minimum=3)


# Enrichment


def test_false_discovery_and_leading_edges_by_numpy(spark):
    rng = np.random.default_rng(8)
    score = {(m, f"x{i:02d}"): float(v) for m in (0, 1) for i, v in enumerate(rng.normal(0, 1, 60))}
    sets = {f"s{k}": sorted(rng.choice(60, 15 + k % 3, replace=False).tolist()) for k in range(9)} | {"top": sorted(range(60), key=lambda i: -score[0, f"x{i:02d}"])[:15]}
    ranked = spark.createDataFrame([(m, g, v) for (m, g), v in score.items()], "mode int, gene_id string, score double")
    table = spark.createDataFrame([(s, f"x{i:02d}") for s, own in sets.items() for i in own], "set_name string, gene_id string")
    got = {(r["mode"], r["set_name"]): r for r in enrichment.permutation_scores(ranked, table, 200, seed=3).collect()}
    edges = {(r["mode"], r["set_name"]): r["leading"] for r in enrichment.leading_edges(ranked, table).collect()}
    assert got.keys() == edges.keys() and len(got) == 20
    for m in (0, 1):
        order = sorted((g for k, g in score if k == m), key=lambda g: (-score[m, g], g))
        weight = np.abs([score[m, g] for g in order])
        nulls, observed = {}, {}

        def walk(at):
            own = weight[at] / weight[at].sum()
            run = np.full(60, -1 / (60 - len(at)))
            run[at] = own
            run = np.cumsum(run)
            return run, run.max() if run.max() >= -min(run.min(), 0) else run.min()

        for name, own in sets.items():
            at = np.array(sorted(order.index(f"x{i:02d}") for i in own))
            run, es = walk(at)
            want = [order[k] for k in at if (k <= run.argmax() if es > 0 else k > run.argmin())]
            assert edges[m, name] == want and got[m, name]["enrichment"] == pytest.approx(es)
            draw = np.random.default_rng(3)
            null = np.array([walk(np.sort(draw.choice(60, len(at), replace=False)))[1] for _ in range(200)])
            scale = {s: max(abs(null[null * s >= 0].mean()), 1e-12) for s in (1, -1)}
            nulls[name] = np.where(null >= 0, null / scale[1], null / scale[-1])
            observed[name] = es / scale[1 if es >= 0 else -1]
            assert got[m, name]["normalised"] == pytest.approx(observed[name])
        pool, seen = np.concatenate(list(nulls.values())), np.array(list(observed.values()))
        for name, x in observed.items():
            s = 1 if x >= 0 else -1
            random, own = pool[pool * s >= 0] * s, seen[seen * s >= 0] * s
            q = min(1.0, (random >= x * s - 1e-12).mean() / (own >= x * s - 1e-12).mean())
            assert got[m, name]["q"] == pytest.approx(q)
    assert got[0, "top"]["q"] < 0.05


# Quantiles


@pytest.mark.parametrize("held", [10, 300, 100_000])
def test_quantiles_by_narrowing(spark, held):
    rng = np.random.default_rng(5)
    values = {0: rng.normal(0, 1, 2000), 1: np.repeat([-1.0, 0.0, 2.0], [5, 900, 95]), 2: np.array([3.0]), 3: rng.standard_cauchy(1500) ** 3, 4: np.zeros(700), 5: np.array([1.0, 2.0]), 6: np.append(rng.random(800), [np.inf, -np.inf])}
    rows = spark.createDataFrame([(m, float(v)) for m, own in values.items() for v in own], "mode int, value double")
    got = {r["mode"]: (r["p0"], r["p1"], r["p2"]) for r in ranking.quantiles(rows, (0.01, 0.5, 0.99), held).collect()}
    for m, own in values.items():
        np.testing.assert_allclose(got[m], np.quantile(own, [0.01, 0.5, 0.99]), rtol=1e-12, atol=1e-12)
    assert ranking.quantiles(rows.where("mode > 9"), (0.5,), held).count() == 0


# Spacing


def test_spacing_by_a_radius_far_too_wide_joins_few_spots(spark, monkeypatch):
    rng = np.random.default_rng(1)
    xy = rng.random((3000, 2))
    coords = spark.createDataFrame([("S", i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "sample_id string, spot_id long, x double, y double")
    made = []
    plain = kernel.radius_pairs
    monkeypatch.setattr(kernel, "radius_pairs", lambda *a, **k: (made.append((df := plain(*a, **k)).count()), df)[1])
    got = kernel.mean_spacing(coords, 100.0).first()["spacing"]
    near = np.array([np.sort(((xy - p) ** 2).sum(1))[1] ** 0.5 for p in xy])
    assert got == pytest.approx(near.mean()) and sum(made) < 100 * len(xy)
