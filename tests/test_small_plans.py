"""The free solver's steps: stored tables are read once each, so plans stay small, and the driver's memory with them."""

from test_spatial import RADIUS, make

from lociweave.jobs import commands
from lociweave.operators import krylov


def test_a_step_of_the_free_solver_has_few_exchanges(spark, monkeypatch):
    bundle, *_ = make(spark, n=60, seed=4)
    seen, plain = [], krylov.cut

    def cut(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return plain(df)

    monkeypatch.setattr(krylov, "cut", cut)
    found = commands.spatial_programs(bundle, RADIUS, k=2, solver="free", tolerance=1e-4, covariates=["log_total_counts"])
    assert found.programs.count() == 2 and 0 < max(seen) <= 40
