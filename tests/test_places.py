"""Spots at equal coordinates, and coordinates of three dimensions, against dense numpy."""

from dataclasses import replace

import numpy as np
import pytest
from test_spatial import RADIUS, centring, check, dense_kernel, make, matrix, whiten

from lociweave.jobs import commands
from lociweave.operators import kernel, preprocess, spatial


@pytest.fixture(scope="module")
def crowded(spark):
    """Two samples; a quarter of the spots at one place, whatever their label, some at a second one, the same in both samples, one of them -0.0."""
    bundle, xy, w, sample, label = make(spark, n=66, seed=4)
    xy = xy.copy()
    xy[np.arange(66) % 4 == 0] = [0.0, 0.5]
    xy[[1, 2, 4, 5]] = xy[1]
    rows = [(sample[i], i, -0.0 if i % 2 and xy[i, 0] == 0 else float(xy[i, 0]), float(xy[i, 1])) for i in range(66)]
    coords = spark.createDataFrame(rows, "sample_id string, spot_id long, x double, y double")
    return replace(bundle, coords=coords), xy, w, sample, label


def dense(data, rows, groups, covariate=None):
    _, xy, w, sample, _ = data
    p = centring(groups[rows]) if groups is not None else np.eye(rows.sum())
    if covariate is not None:
        x = p @ covariate[rows][:, None]
        q = x / np.linalg.norm(x)
        p = p - q @ (q.T @ p)
    return w[rows].T @ p.T @ dense_kernel(xy[rows], sample[rows]) @ p @ w[rows]


@pytest.mark.parametrize("center", ["none", "sample", "label"])
@pytest.mark.parametrize("covariate", [False, True])
def test_gram_with_a_crowd_at_one_place(crowded, center, covariate):
    bundle, _, w, sample, label = crowded
    groups = {"none": None, "sample": sample, "label": np.char.add(sample.astype(str), label.astype(str))}[center]
    found = preprocess.covariates(bundle, ["log_total_counts"]) if covariate else None
    p = spatial.prepare(bundle, RADIUS, center, covariates=found)
    want = dense(crowded, np.full(66, True), groups, np.log1p(w.sum(1)) if covariate else None)
    np.testing.assert_allclose(matrix(spatial.gram(p), 12), want, atol=1e-8)
    got = {r["g"]: r["variance"] for r in spatial.spatial_variance(p).collect()}
    np.testing.assert_allclose([got[f"g{j:02d}"] for j in range(12)], np.diag(want), atol=1e-8)


@pytest.mark.parametrize("solver", ["dense", "free"])
def test_contrasts_with_a_crowd_at_one_place(crowded, solver):
    bundle, _, _, sample, label = crowded
    found = commands.label_contrasts(bundle, RADIUS, ["L0"], k=3, solver=solver, tolerance=1e-6)
    own, rest = dense(crowded, label == "L0", sample), dense(crowded, label != "L0", sample)
    check(found.of("L0"), whiten(own) / np.trace(own) - whiten(rest) / np.trace(rest), 3, True, 1e-5)


def test_kernel_rows_do_not_grow_with_a_crowd(spark):
    """300 spots at a place, one beside it and one far off; the kernel has a row for each two places."""
    coords = spark.createDataFrame([("S", i, 0.0, 0.0) for i in range(300)] + [("S", 300, 0.5, 0.0), ("S", 301, 9.0, 0.0)], "sample_id string, spot_id long, x double, y double")
    where = kernel.places(coords)
    assert {(r["spot_id"], r["n"]) for r in where.collect()} == {(0, 300), (300, 1), (301, 1)}
    assert kernel.wendland_kernel(where, 1.0).count() == 5
    at = {r["spot_id"]: r["place"] for r in kernel.at_places(coords, where).collect()}
    assert at == {**dict.fromkeys(range(300), 0), 300: 300, 301: 301}
    assert kernel.isolated_fraction(coords, 1.0).first()["isolated"] == pytest.approx(1 / 302)
    assert kernel.mean_spacing(coords, 1.0).first()["spacing"] == pytest.approx((0.5 + 8.5) / 302)
    assert kernel.mean_spacing(coords.where("spot_id < 300"), 1.0).first()["spacing"] == 0.0
    assert kernel.mean_spacing(coords.limit(0), 1.0).count() == 0 and kernel.isolated_fraction(coords.limit(0), 1.0).count() == 0


def test_three_dimensions(spark):
    """Pairs, weights, spacing and isolated spots with a third axis, which is nought where it is null."""
    rng = np.random.default_rng(2)
    xyz = rng.random((200, 3)) * 2
    xyz[::10, 2] = 0
    rows = [("S", i, float(x), float(y), None if i % 10 == 0 else float(z)) for i, (x, y, z) in enumerate(xyz)]
    coords = spark.createDataFrame(rows, "sample_id string, spot_id long, x double, y double, z double")
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    got = {(r["i"], r["j"]): r["k"] for r in kernel.wendland_kernel(coords, 0.3).collect()}
    want = {(i, j): (1 - d[i, j] / 0.3) ** 4 * (4 * d[i, j] / 0.3 + 1) for i, j in zip(*np.nonzero(d < 0.3), strict=True)}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[p] for p in want], list(want.values()), atol=1e-12)
    nearest = np.where(np.eye(200) > 0, np.inf, d).min(1)
    for first in (0.01, 50.0):
        assert kernel.mean_spacing(coords, first).first()["spacing"] == pytest.approx(nearest.mean())
    assert kernel.isolated_fraction(coords, 0.3).first()["isolated"] == pytest.approx((nearest > 0.3).mean())
