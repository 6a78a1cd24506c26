"""Tables of pairs: a crowded cell does not land in one task."""

import numpy as np
from pyspark.sql import functions as F

from lociweave.operators import kernel


def test_a_crowded_cell_is_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(kernel, "PAIRS", 5_000)
    at = np.random.default_rng(3).uniform(0.1, 0.9, (300, 2))
    coords = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(at)], "sample_id string, spot_id long, x double, y double")
    made = kernel.wendland_kernel(coords, 1.0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = made.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    assert {(r["i"], r["j"]) for r in rows} == {(int(i), int(j)) for i, j in zip(*np.nonzero(d < 1), strict=True)} and len(rows) == (d < 1).sum()
    tasks = [r["task"] for r in rows]
    assert max(map(tasks.count, set(tasks))) < len(rows) / 3
