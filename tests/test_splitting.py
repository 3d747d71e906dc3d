import math
from collections import Counter

import numpy as np
import pytest

from condeval.operators import splitting as S


def _shares(draws, things):
    if things == 1:
        yield (draws,)
        return
    for first in range(draws + 1):
        for rest in _shares(draws - first, things - 1):
            yield (first, *rest)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_counts_are_multinomial(n):
    """Chi-square over every way that n draws can fall on n things; the bound is four deviations."""
    replicates = 40_000
    found = Counter(map(tuple, S.multiplicities(S.series_state(0, "x"), n, 0, 8, np.arange(replicates)).tolist()))
    assert all(sum(shares) == n for shares in found)
    chi, ways = 0.0, 0
    for shares in _shares(n, n):
        expected = replicates * math.factorial(n) / math.prod(map(math.factorial, shares)) / n**n
        chi += (found[shares] - expected) ** 2 / expected
        ways += 1
    assert chi <= ways - 1 + 4 * math.sqrt(2 * ways)


@pytest.mark.parametrize("n", [7, 64, 1000, 9_999])
def test_ranges_are_worked_out_apart(n):
    replicates = np.array([0, 3, 17])
    state = S.series_state(5, "x")
    whole = S.multiplicities(state, n, 0, 1 << 14, replicates)
    assert whole.sum(axis=1).tolist() == [n] * 3
    for size in (1, 8, 256) if n < 2000 else (1024,):
        parts = [S.multiplicities(state, n, first, size, replicates) for first in range(0, n, size)]
        assert (np.concatenate(parts, axis=1) == whole).all()
    alone = S.multiplicities(state, n, 0, 1 << 14, np.array([17]))
    assert (alone == whole[2]).all()


@pytest.mark.parametrize("draws", [1, 63, 64, 65, 4095, 4096, 8192 + 4096 + 100, 3 * 10**6])
def test_halves_are_binomial(draws):
    """Mean, variance and quartiles, over bits alone, tables alone, and both."""
    many = 20_000
    state = S.step(S.series_state(0, "halves"), np.arange(many))
    left = S.left_of(state, np.full(many, draws))
    assert left.min() >= 0 and left.max() <= draws
    spread = math.sqrt(draws) / 2
    assert left.mean() == pytest.approx(draws / 2, abs=4 * spread / math.sqrt(many))
    assert left.std() == pytest.approx(spread, rel=0.03)
    if draws > 1000:
        assert np.percentile(left, [25, 75]) == pytest.approx([draws / 2 - 0.6745 * spread, draws / 2 + 0.6745 * spread], abs=0.04 * spread + 1)


def test_tables_agree_with_exact_odds():
    least, odds = S._table(S.COUNTED)
    exact = sum(math.comb(S.COUNTED, k) for k in range(2040 + 1)) / 2**S.COUNTED
    assert odds[2040 - least] == pytest.approx(exact, rel=1e-12) and odds[-1] == pytest.approx(1, abs=1e-12)


def test_series_and_replicates_are_independent():
    a, b = (S.multiplicities(S.series_state(0, s), 50, 0, 64, np.arange(2000)).astype(float) for s in "ab")
    assert abs(np.corrcoef(a[:, 0], b[:, 0])[0, 1]) < 0.1 and abs(np.corrcoef(a[:-1, 0], a[1:, 0])[0, 1]) < 0.1
