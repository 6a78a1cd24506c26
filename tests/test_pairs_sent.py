"""Tables of pairs: what is sent to the tasks of a join, and which pairs are looked at."""

import numpy as np
from pyspark.sql import functions as F

from lociweave.operators import kernel


def test_rows_of_a_crowded_cell_are_not_sent_to_every_deal(spark, monkeypatch):
    monkeypatch.setattr(kernel, "PAIRS", 10_000)
    seen, plain = [], kernel._by_pairs

    def sides(left, right, key):
        seen.append(plain(left, right, key))
        return seen[-1]

    monkeypatch.setattr(kernel, "_by_pairs", sides)
    at = np.random.default_rng(8).uniform(0.1, 0.9, (2000, 2))
    coords = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(at)], "sample_id string, spot_id long, x double, y double")
    found = kernel.wendland_kernel(coords, 1.0).agg(F.count("*").alias("n"), F.countDistinct("i", "j").alias("pairs")).first()
    near = int((((at[:, None] - at[None]) ** 2).sum(axis=2) < 1).sum())
    assert (found["n"], found["pairs"]) == (near, near)
    assert sum(s.count() for s in seen[0]) <= 2.2 * 2000 * 2000 / 100  # two sides of 100 rows for each 10,000 pairs


def test_gaussian_by_digits_has_every_weight_that_is_not_nought(spark):
    sigma, digits = 0.5, 6
    edge = 2 * sigma * np.sqrt(np.log(2e6))  # where weights round to nought
    at = np.concatenate([[0.0], edge * np.array([0.1, 0.5, 0.9, 1 - 1e-6, 1 - 1e-9, 1 + 1e-9, 1 + 1e-6, 1.2])])
    coords = spark.createDataFrame([("s", i, float(x), 0.0) for i, x in enumerate(at)], "sample_id string, spot_id long, x double, y double")
    whole = kernel.gaussian_kernel(coords, sigma, reach=40.0).withColumn("k", F.round("k", digits) + F.lit(0.0)).where("k > 0").collect()
    found = kernel.gaussian_kernel(coords, sigma, digits=digits).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, whole)) and {r["j"] for r in found if r["i"] == 0} == {0, 1, 2, 3, 4, 5}


def test_gaussian_by_digits_looks_at_no_pairs_beyond(spark, monkeypatch):
    seen, plain = [], kernel.radius_pairs
    monkeypatch.setattr(kernel, "radius_pairs", lambda coords, radius, **options: seen.append(radius) or plain(coords, radius, **options))
    coords = spark.createDataFrame([("s", 0, 0.0, 0.0)], "sample_id string, spot_id long, x double, y double")
    assert kernel.gaussian_kernel(coords, 0.5, digits=6).count() == 1 and seen[0] < 0.5 * 7.62
