"""Kernel products by blocks whose weights are made inside tasks, against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_places import dense
from test_spatial import RADIUS, dense_kernel, make, matrix

from lociweave.operators import kernel, preprocess, products, spatial


@pytest.mark.parametrize("center", ["none", "label"])
def test_small_blocks_and_tiles(spark, monkeypatch, center):
    """Cells dealt to blocks of a few places, tiles of a few places: sums, the free solver's products, and rows sent, which pairs do not multiply."""
    monkeypatch.setattr(products, "CELLS", 2 * 256 * 5)
    monkeypatch.setattr(products, "ROWS", 7)
    monkeypatch.setattr(products, "TILE", 4)
    bundle, xy, w, sample, label = make(spark, n=90, seed=7)
    groups = None if center == "none" else np.char.add(sample.astype(str), label.astype(str))
    p = spatial.prepare(bundle, RADIUS, center, covariates=preprocess.covariates(bundle, ["log_total_counts"]))
    want = dense((bundle, xy, w, sample, label), np.full(90, True), groups, np.log1p(w.sum(1)))
    np.testing.assert_allclose(matrix(spatial.gram(p), 12), want, atol=1e-8)
    got = {r["g"]: r["variance"] for r in spatial.spatial_variance(p).collect()}
    np.testing.assert_allclose([got[f"g{j:02d}"] for j in range(12)], np.diag(want), atol=1e-8)
    x = spark.createDataFrame([("all", i, float(i % 7), float(i)) for i in range(0, 90, 2)], "part string, i long, v0 double, v1 double")
    smooth = {r["i"]: (r["v0"], r["v1"]) for r in p.smoothed(x, 2).collect()}
    i = np.arange(90)
    columns = np.where(i[:, None] % 2 == 0, np.stack([i % 7, i], axis=1), 0.0)
    np.testing.assert_allclose([smooth[j] for j in range(90)], dense_kernel(xy, sample) @ columns, atol=1e-9)


def test_rows_sent_do_not_grow_with_the_pairs(spark):
    """800 places within a radius are 640,000 pairs; each is sent once to each block near it."""
    rng = np.random.default_rng(5)
    bundle, *_ = make(spark, n=20, seed=1)
    coords = spark.createDataFrame([("S0", i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((800, 2)) * RADIUS / 2)], "sample_id string, spot_id long, x double, y double")
    where = coords.select(F.lit("all").alias("part"), "sample_id", F.col("spot_id").alias("i"), "x", "y")
    sent = products.sent(where, RADIUS, 4096).select("i", F.explode("to").alias("to"))
    assert sent.count() == 800 and sent.where("to.own").count() == 800
    dealt = products.sent(where, RADIUS, 100).select("i", F.explode("to").alias("to"))
    assert dealt.select("to.b").distinct().count() == 8 and dealt.count() == 800 * 8 and dealt.where("to.own").count() == 800
    assert dealt.where("to.again").count() + dealt.where("NOT to.again AND NOT to.own").count() == 800 * 7


def test_isolated_spots_without_all_pairs(spark, monkeypatch):
    """1,500 spots close together and some far off: only spots that are alone in a small cell are joined with others."""
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.random((1500, 2)) * 0.5, rng.random((60, 2)) * 40])
    coords = spark.createDataFrame([("S", i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "sample_id string, spot_id long, x double, y double")
    joined, plain = [], kernel.radius_pairs
    monkeypatch.setattr(kernel, "radius_pairs", lambda *x, **o: (joined.append(plain(*x, **o)), joined[-1])[1])
    got = kernel.isolated_fraction(coords, 1.0).first()["isolated"]
    near = (((xy[:, None] - xy[None]) ** 2).sum(2) <= 1.0).sum(1)
    assert got == pytest.approx((near == 1).mean()) and 0 < got < 1
    assert joined[0].count() < 4 * len(xy)  # all pairs: over 1,500 x 1,500
