"""Operator 8 with more rules than a chain of sums has room for on the planner's stack."""

import numpy as np

from lociweave.llm import rule_ensemble


def test_score_of_many_rules_equals_numpy(spark):
    rng = np.random.default_rng(5)
    rules = tuple((rule_ensemble.Condition(int(f), bool(a), float(t)),) for f, a, t in zip(rng.integers(0, 12, 1000), rng.random(1000) < 0.5, rng.random(1000), strict=True))
    weights = tuple(rng.normal(size=len(rules)) / 20)
    x = rng.random((5, 12))
    rows = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], ["k", *rule_ensemble.NAMES])
    found = rows.select("k", rule_ensemble.Ensemble(rules, weights, 0.25).score().alias("score")).orderBy("k").collect()
    margin = rule_ensemble._matrix(x, list(rules)) @ np.array(weights) + 0.25
    assert np.allclose([r["score"] for r in found], 1 / (1 + np.exp(-margin)), rtol=1e-9)
