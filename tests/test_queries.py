"""Every query with SQL against DuckDB on the same tables; the others give rows with a stable schema."""

import numpy as np
import pytest

from quillon.plans import queries as plans
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    ours = plans.QUERIES[name](spark, sf_dir).toPandas()
    theirs = duck.execute(plans.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    assert rows_of(ours) == rows_of(theirs)


#: Queries that give no rows on the smallest tables, with the reason.
EMPTY = {
    "chi_square_features": "line items are dealt to parts at random, so no feature stands out",
    "pseudo_peaks": "the control is a share of the same random counts",
}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_rows_are_whole(spark, sf_dir, name):
    """Rows come out, keys are never null, numbers are finite or null, probabilities lie in 0..1."""
    got = plans.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got.columns) and (len(got) > 0 or name in EMPTY)
    for c in got.columns:
        if c in ("obs_id", "var_id", "id", "gene", "term_id", "src", "dst", "chrom"):
            assert got[c].notna().all()
        if c in ("pvalue", "padj", "fdr", "p"):
            assert got[c].dropna().between(0, 1).all()
        if got[c].dtype.kind == "f":
            assert np.isfinite(got[c].dropna()).all()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
