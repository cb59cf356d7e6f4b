"""Queries on tables that are larger, or of another shape, than the given ones."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortalign import registry
from compare import DATA, TABLES, duck_rows, spark_rows

Q, SQL = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def tables(folder, **made):
    """The given tables with some of them replaced by pandas tables."""
    for t in TABLES:
        if t in made:
            made[t].to_parquet(f"{folder}/{t}.parquet", index=False)
        else:
            os.symlink(f"{DATA}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def test_shots_of_over_a_thousand_rows(spark, tmp_path):
    import pandas as pd

    n = 6000
    d = tables(tmp_path, embeddings=pd.DataFrame({"vec_id": np.arange(n), "embedding": [np.float32([i % 7]) for i in range(n)], "label": np.arange(n, dtype=np.int32) % 10}))
    got = spark_rows(Q["SPL3_sample_shots"](spark, d))
    assert got == duck_rows(SQL["SPL3_sample_shots"], d)
    assert len(got[1]) == n * 9 // 10 - 5 * 25 + 5 * 10


@pytest.mark.parametrize("name", ["CON2_column_correlation", "CON3_parcel_connectivity", "CON6_voxel_profiles"])
def test_series_are_not_exchanged(spark, name):
    """Runs are dealt as events; no row of channels or of pairs of channels is exchanged, sorted or joined."""
    plan = Q[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Generate explode" not in plan.split("FlatMapGroupsInArrow")[-1]
    under = plan.split("FlatMapGroupsInArrow")[-1]
    assert under.count("Exchange hashpartitioning(user_id") == 1 and under.count("Exchange") == 1 and under.count("Sort [") == 1


def test_connectivity_writes_no_series(spark, monkeypatch):
    """Runs of channels that fit a block are correlated at once, so nothing of the series' size is staged."""
    from cohortalign.operators import connectivity as C
    from cohortalign.plans import models as P

    monkeypatch.setattr(C, "staged", lambda df, name: pytest.fail(f"{name} is staged"))
    assert P.s_voxel(spark, DATA).count() == 5 * 64


def test_fits_deal_events_and_not_values(spark):
    """The connectivity that the alignment and encoder queries share."""
    from cohortalign.operators import connectivity as C
    from cohortalign.plans import models as P

    c = C.rest_connectivity(P.series(spark, DATA), "parcellation", P.labels(spark, DATA), P.R, by=["run"])
    under = c._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[-1]
    assert under.count("Exchange hashpartitioning(user_id") == 1 and under.count("Exchange") == 1 and under.count("Sort [") == 1
