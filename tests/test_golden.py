"""Published tables that rows made from counts must give: trusted rates, and the points of the intervals.

The ends of the published intervals and the pair table rest on labelled rows that are not
published; the bootstrap is tested on rows made for it instead.
"""

import pytest
from golden import COUNTS, INTERVALS, LABELS, TRUSTED, labelled_rows

from condeval.operators import bootstrap as B
from condeval.operators.rates import trusted_rates


def test_trusted_rates(spark):
    rows = [
        (coefficient, label, True)
        for coefficient, *rates, _ in TRUSTED
        for label, rate in zip(LABELS, rates)
        for _ in range(round(rate * 100))
    ]
    rows += [(c, label, trusted) for c, *_ in TRUSTED for label in (*LABELS, None) for trusted in (False, None)]
    table = spark.createDataFrame(rows, "alpha_factor double, label string, gold boolean")
    found = trusted_rates(table, "alpha_factor").orderBy("alpha_factor")
    got = [tuple(r[c] for c in ("alpha_factor", *LABELS, "coherence_rate")) for r in found.collect()]
    assert got == list(TRUSTED)


def test_points_and_clusters_of_the_intervals(spark):
    """Each series' rows over as many clusters as published: the points don't depend on how they are dealt."""
    clusters = {name: n for name, n, *_ in INTERVALS}
    rows = [
        (name, f"{name} {place % clusters[name]}", coefficient, label)
        for place, (name, coefficient, label) in enumerate(labelled_rows(COUNTS))
    ]
    table = spark.createDataFrame(rows, "category string, expression string, alpha_factor double, label string")
    counts = B.cluster_counts(table, "category", "expression", "alpha_factor", -4.78)
    found = {r["name"]: r for r in B.confidence_intervals(counts, B.bootstrap_deltas(counts, 200)).collect()}
    for name, n, delta, low, high in INTERVALS:
        row = found[name]
        assert row["n_groups"] == n and row["delta"] == pytest.approx(delta, abs=1e-12)
        assert row["ci_lo"] < row["delta"] < row["ci_hi"] and low < delta < high
