"""Every query with SQL gives the SQL's rows on the smallest tables; the others give rows of a fixed schema."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from aforetime.operators import kernels
from aforetime.plans.views import panel

DATA = "/root/testdata/sf0.001"
#: Its panels have more than 96 months.
LONGER = "/root/testdata/sf0.01"
SQL = {name: sql for name, sql in entry.oracle_sql().items() if not name.startswith(("p8", "p9", "p10"))}
PLAIN = [name for name in entry.queries() if name not in SQL and not name.startswith(("p8", "p9", "p10"))]


def clean(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return tuple(map(clean, value)) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    wanted = Counter(tuple(clean(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    found = Counter(tuple(clean(r[c]) for c in sorted(names)) for r in df.collect())
    assert found == wanted


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_gives_rows(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() >= 0


def test_geometry_takes_all_series_windows_and_variants(spark):
    wide = panel(spark, LONGER).toPandas().query("panel_id == panel_id.min()").assign(value=lambda d: d["value"].astype(float))
    wide = wide.pivot(index="month", columns="series_id", values="value").sort_index()
    z = ((wide - wide.mean()) / np.maximum(wide.std(ddof=0), 1e-8)).fillna(0.0)
    assert z.shape[1] > 4
    wanted = {}
    for months in (36, 96, 120, 144):
        for n in range(months + 1, len(z) + 1):
            for omitted in (None, *z.columns):
                x = z.drop(columns=omitted or []).to_numpy()
                spaces = [kernels.leading_space(y.T @ y / len(y), 2) for y in (x[:n], x[n - months : n])]
                wanted[z.index[n - 1], months, omitted] = kernels.subspace_distance(*spaces)
    found = entry.queries()["gram_geometry"](spark, LONGER).where(F.col("panel_id") == F.lit(panel_name(spark))).collect()
    assert {36, 96} <= {r["months"] for r in found}
    assert {(r["month"], r["months"], r["omitted"]): (r["smallest_cosine"], r["projector_distance"]) for r in found} == {
        k: pytest.approx(v, abs=1e-6) for k, v in wanted.items()
    }
    assert len(found) == len(wanted)


def panel_name(spark):
    return panel(spark, LONGER).agg(F.min("panel_id")).first()[0]


def test_bootstrap_has_all_draws_and_blocks(spark):
    found = entry.queries()["block_bootstrap_ci"](spark, DATA).groupBy("block").agg(F.min("n_draws"), F.max("n_draws"))
    assert sorted(tuple(r) for r in found.collect()) == [(b, 1999, 1999) for b in (12, 24, 36)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
