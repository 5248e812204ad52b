"""Lookup of hashes in a shard's arrays, and orders of rows, against plain ways."""

from __future__ import annotations

import numpy as np
import pytest

from peerlens.llm import lm_score


@pytest.mark.parametrize("together", [1, 7, 1 << 16])
@pytest.mark.parametrize("shards", [1, 5])
def test_buckets_are_looked_through_whole(together, shards):
    rng = np.random.default_rng(shards)
    # Hashes of the first shard; a few hundred stand close together, so in one bucket.
    top = (1 << 64) // shards
    hashes = np.unique(np.r_[rng.integers(0, top, 900, np.uint64, endpoint=False), np.uint64(top // 3) + np.arange(300, dtype=np.uint64) * np.uint64(3)])
    a = lm_score._keys("keys", hashes, shards)
    asked = rng.permutation(np.r_[hashes, hashes[::5], hashes[:-1] + np.uint64(1), rng.integers(0, top, 500, np.uint64)])
    at = {int(h): i for i, h in enumerate(hashes)}
    want = [at.get(int(h), -1) for h in asked]
    assert lm_score._find(a, "keys", asked, shards, together).tolist() == want
    assert lm_score._find(a, "keys", asked[:0], shards, together).tolist() == []
    none = lm_score._keys("keys", hashes[:0], shards)
    assert set(lm_score._find(none, "keys", asked, shards, together)) == {-1}


def test_the_first_of_equal_bits_counts():
    """Two hashes of one bucket whose 40 bits are equal, as they are among very many."""
    a = {"keys_low": np.array([7, 7], np.uint32), "keys_high": np.array([1, 1], np.uint8), "keys_at": np.array([0, 2], np.uint8)}
    assert lm_score._find(a, "keys", np.array([(1 << 32) + 7, 7, 8], np.uint64), 1, 2).tolist() == [0, -1, -1]


@pytest.mark.parametrize("tops", [[50], [9, 9], [3, 1 << 40, 3], [1 << 64, 1 << 64], [1 << 63, 4, 1 << 63], [1, 1, 1]])
@pytest.mark.parametrize("n", [0, 1, 400])
def test_rows_ascend(tops, n):
    rng = np.random.default_rng(n)
    columns = [rng.integers(0, t - 1, n, np.uint64, endpoint=True) for t in tops]
    columns = [np.r_[c, c[: n // 2]] for c in columns]
    order = lm_score._ascending(columns)
    assert sorted(order.tolist()) == list(range(len(columns[0])))
    rows = list(zip(*[c[order].tolist() for c in columns], strict=True))
    assert rows == sorted(rows)


@pytest.mark.parametrize("top", [1, 300, 1 << 16, 1 << 40])
def test_shards_keep_the_order_within(top):
    shard = np.random.default_rng(top % 97).integers(0, top, 2000)
    assert lm_score._by_shard(shard).tolist() == sorted(range(2000), key=lambda i: shard[i])
