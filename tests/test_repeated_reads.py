"""What is made too often where results are right all the same."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.jobs import commands


def test_compare_spot_modes_makes_the_modes_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        made.add(1)
        return v

    r = np.random.default_rng(2)
    x = r.normal(size=(40, 3))

    def programs(y):
        rows = [("all", "all", i, m, float(y[i, m])) for i in range(40) for m in range(3)]
        modes = spark.createDataFrame(rows, "scope string, part string, i long, mode int, value double").withColumn("value", counted("value"))
        kinds = spark.createDataFrame([("all", m, 3.0 - m, 1) for m in range(3)], "scope string, mode int, eigenvalue double, mode_sign int")
        return commands.Programs(kinds, None, None, modes)

    got = commands.compare_spot_modes(programs(x), programs(-x[:, [1, 2, 0]])).orderBy("spot_mode_a").collect()
    assert [g["best_spot_mode_b"] for g in got] == [2, 0, 1]
    assert [g["signed_cosine"] for g in got] == pytest.approx([-1, -1, -1])
    assert made.value == 2 * 40 * 3
