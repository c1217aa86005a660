"""Parts of the maximum-entropy model against plain versions."""

import numpy as np
import pytest

from tidemark.llm import maxent_lm


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_look(n):
    """Hashes spread over all values, and others whose leading bits are all equal."""
    rng = np.random.default_rng(n)
    for top in (1 << 63, 1 << 20):
        hashes = np.unique(rng.integers(0, top, n).astype(np.uint64))
        words = maxent_lm.Words(rng.permutation(hashes), np.arange(len(hashes)))
        asked = np.concatenate([hashes, rng.integers(0, top, 100).astype(np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        known = {int(h): i for i, h in enumerate(words.hashes)}
        assert words.look(asked).tolist() == [known.get(int(h), -1) for h in asked]


def test_exps_beyond_the_range_of_floats():
    x = np.array([[500, 499, maxent_lm.EMPTY], [-500, -501, maxent_lm.EMPTY], [0, -1, maxent_lm.EMPTY]], np.float32)
    exps, sums = maxent_lm._exps(x)
    p = 1 / (1 + np.exp(-1))
    assert np.allclose(exps / sums[:, None], [[p, 1 - p, 0]] * 3, rtol=1e-5)
    assert np.allclose(x[:, 0] - np.log(sums), np.log(p), rtol=1e-5)


def test_by_row_sums_repeats():
    """Rows met once, a few times and very often."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 5)).astype(np.float32)
    rows = np.stack([rng.integers(0, 600, 900), np.where(rng.random(900) < 0.5, 7, rng.integers(600, 1200, 900))]).astype(np.uint64)
    ids, times, sums = maxent_lm._by_row(x, rows)
    want = np.zeros((1200, 5))
    for r in rows:
        np.add.at(want, r.astype(int), x)
    assert dict(zip(ids.tolist(), times.tolist(), strict=True)) == {int(i): int(n) for i, n in zip(*np.unique(rows, return_counts=True), strict=True)}
    assert np.allclose(sums, want[ids], atol=1e-3)
