"""The registered search over the prior scale runs to its own bounds."""
import inspect

from evisets.operators import nmf
from evisets.plans import factor
from evisets.queries import factors


def test_phi_search_query_does_the_whole_search(monkeypatch):
    seen = {}
    default = inspect.signature(factor.phi_search).parameters
    monkeypatch.setattr(factor, "phi_search", lambda cells, k, **options: seen.update(options) or (None, "all"))
    monkeypatch.setattr(factors, "cells", lambda spark, sf: None)
    assert factors.phi_search(None, None) == "all"
    assert seen.get("steps", default["steps"].default) >= 5
    assert (seen.get("fit_options") or {}).get("iterations", inspect.signature(nmf.ard_nmf).parameters["iterations"].default) >= 100


def test_grams_of_an_update_are_those_of_its_rows(spark):
    cells = spark.createDataFrame([(s, e, 1.0 + (s * e) % 3) for s in range(6) for e in range(9) if (s + e) % 4], "set_id long, entity_id long, value double")
    fit = nmf.ard_nmf(cells, 2, [nmf.Run(0, 1, 0.1), nmf.Run(1, 2, 0.2)], iterations=3, cap=None)
    V = {(r.set_id, r.entity_id): r.value for r in cells.collect()}
    for run in (0, 1):
        W, H = ({r[1]: r.w for r in side.where(f"run = {run}").collect()} for side in (fit.sets, fit.entities))
        error = sum((V.get((s, e), 0.0) - sum(a * b for a, b in zip(W[s], H[e], strict=True))) ** 2 for s in W for e in H)
        assert len(W) == 6 and len(H) == 9
        assert abs(error - next(r.error for r in fit.summary.collect() if r.run == run)) < 1e-9
