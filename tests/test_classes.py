"""Each label against all others from sums of classes, against dense numpy: rows that are sent do not grow with the labels."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_places import dense
from test_spatial import RADIUS, check, make, whiten

from lociweave.jobs import commands
from lociweave.operators import products, spatial


@pytest.fixture(scope="module")
def data(spark):
    """Two samples, four labels and none, spots of several labels at one place, a gene that only one label has and one that no other has."""
    n = 84
    bundle, xy, w, sample, _ = make(spark, n=n, seed=12)
    xy, w = xy.copy(), w.copy()
    label = np.where(np.arange(n) % 13 == 0, None, np.array([f"L{i * 7 % 4}" for i in range(n)]))
    xy[np.arange(n) % 5 == 0] = xy[0]
    w[label != "L1", 3] = 0
    w[label == "L2", 5] = 0
    spots = spark.createDataFrame([(sample[i], i, label[i]) for i in range(n)], "sample_id string, spot_id long, label string")
    coords = spark.createDataFrame([(sample[i], i, float(xy[i, 0]), float(xy[i, 1])) for i in range(n)], "sample_id string, spot_id long, x double, y double")
    rows = [(sample[i], i, f"g{g:02d}", float(w[i, g])) for i, g in np.argwhere(w).tolist()]
    return replace(bundle, spots=spots, coords=coords, expression=spark.createDataFrame(rows, "sample_id string, spot_id long, gene_id string, value double")), xy, w, sample, label


@pytest.mark.parametrize(("center", "classes"), [("sample", 2), ("label", 3), ("none", 9)])
def test_each_label_against_the_rest_from_classes(data, monkeypatch, center, classes):
    """In chunks of one, of two and of all labels, blocks and tiles of a few places."""
    monkeypatch.setattr(products, "CELLS", 2 * 256 * 6)
    monkeypatch.setattr(products, "TILE", 5)
    monkeypatch.setattr(commands, "class_count", lambda columns: classes)
    bundle, xy, w, sample, label = data
    labels = ["L0", "L1", "L2", "L3"]
    several = commands._against_the_rest(labels)(bundle)
    assert len(several.classes.unions) == -(-4 // (classes - 1))
    p = spatial.prepare(bundle, RADIUS, center, members=several.members, classes=several.classes)
    groups = {"none": None, "sample": sample, "label": np.char.add(sample.astype(str), label.astype(str))}[center]
    found, variance = {}, {}
    for r in spatial.gram(p).collect():
        found.setdefault(r["part"], np.zeros((12, 12)))[int(r["g"][1:]), int(r["h"][1:])] = r["v"]
    for r in spatial.spatial_variance(p).collect():
        variance.setdefault(r["part"], np.zeros(12))[int(r["g"][1:])] = r["variance"]
    assert set(found) == set(variance) == {f"{side} {x}" for side in ("label", "rest") for x in labels}
    for x in labels:
        for side, rows in (("label", label == x), ("rest", label != x)):
            want = dense(data, rows, groups)
            np.testing.assert_allclose(found[f"{side} {x}"], want, atol=1e-8)
            np.testing.assert_allclose(variance[f"{side} {x}"], np.diag(want), atol=1e-8)
    genes = {(r["part"], r["g"]) for r in spatial.gram(p).select("part", "g").distinct().collect()}
    assert ("rest L1", "g03") not in genes and ("label L2", "g05") not in genes  # nought by nought, not by a difference


def test_scales_of_classes(data):
    bundle, _, _, sample, label = data
    found = commands.label_contrasts(bundle, RADIUS, k=3)
    for x in ("L0", "L1", "L2", "L3"):
        own, rest = dense(data, label == x, sample), dense(data, label != x, sample)
        check(found.of(x), whiten(own) / np.trace(own) - whiten(rest) / np.trace(rest), 3, True, 1e-5)


def test_rows_sent_do_not_grow_with_the_labels(spark, monkeypatch):
    """20 labels: each spot is sent to the blocks near it as often as with none, not once for each label."""
    n = 120
    bundle, *_ = make(spark, n=n, seed=3)
    bundle = replace(bundle, spots=bundle.spots.withColumn("label", F.concat(F.lit("L"), (F.col("spot_id") % 20).cast("string"))))
    sent, plain = [], spatial.kernel_products
    monkeypatch.setattr(spatial, "kernel_products", lambda near, *x: (sent.append(near.select(F.explode("to")).count()), plain(near, *x))[1])
    spatial.gram(spatial.prepare(bundle, RADIUS))
    commands.label_contrasts(bundle, RADIUS, k=2)
    assert len(sent) == 2 and 0 < sent[1] <= 1.05 * sent[0]
    assert products.class_count(62) > 10 and products.class_count(2000) == 2
