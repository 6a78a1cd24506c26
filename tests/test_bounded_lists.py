"""Neighbours by inverted lists: of the further lists only rows are kept that may be among the nearest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.operators import neighbours


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_rows_kept_do_not_grow_with_the_lists(spark, monkeypatch, metric):
    """1,200 rows, 600 of them copies of one, in 10 lists that are all looked at: the exact neighbours, of far fewer rows than ``k`` for each list."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1200, 6))
    v[600:] = v[0]
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    exact = neighbours.nearest(rows, 5, metric).collect()
    merged, plain = [], neighbours._ranked
    monkeypatch.setattr(neighbours, "_ranked", lambda pairs, k: (merged.append(pairs), plain(pairs, k))[1])
    found = neighbours.nearest(rows, 5, metric, lists=10, probes=10, block_rows=200).collect()
    assert {(r["i"], r["j"], r["rank"], r["similarity"]) for r in found} == {(r["i"], r["j"], r["rank"], r["similarity"]) for r in exact}
    other = merged[-1].where(F.col("i") < 600)  # before: 5 for each of 10 lists and their blocks
    assert other.count() < 600 * 5 * 5
