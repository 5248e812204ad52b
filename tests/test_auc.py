"""The area under the curve where pairs of a positive and a negative are more than a 64-bit integer holds."""

from __future__ import annotations

import pytest

from peerlens.operators import relational as R


def test_counts_beyond_a_bigint_product(spark):
    rows = [(True, 0.5, 4_000_000_000), (False, 0.5, 4_000_000_000), (True, 0.7, 1_000_000_000), (False, 0.2, 6_000_000_000)]
    got = R.auc(spark.createDataFrame(rows, "same boolean, sim double, n bigint"), "same", "sim", "n").first()
    assert (got.n_pos, got.n_neg) == (5_000_000_000, 10_000_000_000)
    assert got.auc == pytest.approx((4e9 * (6e9 + 2e9) + 1e9 * 1e10) / (5e9 * 1e10))
