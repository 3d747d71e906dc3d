"""How often each of n things is drawn in n uniform draws, without making the draws.

The draws of a round start at the root of a binary tree over 2**levels leaves, the least
power of two that is at least n. A node sends each of its draws left or right with equal
odds, so the number that goes left is binomial: it is the number of ones among as many
hash bits. Draws that end at a leaf from n on are those of the next round, until none is
left, which is rejection sampling, so the counts are multinomial exactly.

A node's bits are a function of (series, replicate, round, node) alone. Whoever wants the
counts of a range of leaves walks from the root to that range and splits there; how many
draws a round rejects follows from the one path to leaf n. So ranges are worked out apart
from each other, in any number of tasks, and always agree.

Bits are counted one by one below ``COUNTED`` draws. Of more, each power of two is drawn
from its table of the binomial distribution, to the precision of doubles.
"""

from __future__ import annotations

import math
from functools import lru_cache
from hashlib import md5

import numpy as np

GAMMA, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
WORD = 64
# A node counts bits for up to this many draws, a power of two.
COUNTED = 1 << 12
# Standard deviations that a table covers on each side; what lies beyond is below 1e-20.
REACH = 9.5


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers, mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FIRST)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(SECOND)
    return x ^ (x >> np.uint64(31))


def step(state: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """The state that follows a state and a number."""
    number = np.atleast_1d(number).astype(np.uint64)
    return mixed(state + np.uint64(GAMMA) * (number + np.uint64(1)))


def series_state(seed: int, series: str) -> np.ndarray:
    return np.array([int(md5(f"{seed}|{series}".encode()).hexdigest()[:16], 16)], np.uint64)


@lru_cache(maxsize=64)
def _table(draws: int) -> tuple[int, np.ndarray]:
    """The least outcome that counts, and cumulated odds from there on, of ``draws`` fair coins."""
    centre = draws // 2
    reach = min(centre, int(REACH * math.sqrt(draws) / 2) + 1)
    above = np.arange(centre, centre + reach, dtype=np.float64)
    side = np.cumprod((draws - above) / (above + 1))
    odds = np.concatenate([side[::-1], [1.0], side])
    return centre - reach, np.cumsum(odds / odds.sum())


def left_of(state: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """How many of each node's draws go left."""
    few = draws % COUNTED
    left = np.zeros(len(draws), np.int64)
    for word in range(-(-int(few.max(initial=0)) // WORD)):
        here = np.flatnonzero(few > word * WORD)
        bits = np.minimum(few[here] - word * WORD, WORD).astype(np.uint64)
        left[here] += np.bitwise_count(step(state[here], word) >> (np.uint64(WORD) - bits))
    many = draws // COUNTED
    for power in range(int(many.max(initial=0)).bit_length()):
        here = np.flatnonzero(many >> power & 1)
        if len(here):
            least, odds = _table(COUNTED << power)
            even = (step(state[here], COUNTED // WORD + power) >> np.uint64(11)) * 2.0**-53
            left[here] += least + np.minimum(np.searchsorted(odds, even, side="right"), len(odds) - 1)
    return left


def _down(states: np.ndarray, draws: np.ndarray, leaf: int, levels: int, until: int):
    """Walk towards a leaf: yields the draws at each node on the way and those of its sibling, with the turn taken."""
    node = 1
    for level in range(until):
        right = leaf >> (levels - 1 - level) & 1
        left = left_of(step(states, node), draws)
        draws, beside = (draws - left, left) if right else (left, draws - left)
        node = 2 * node + right
        yield node, draws, beside, right


def multiplicities(series: np.ndarray, n: int, first: int, size: int, replicates: np.ndarray) -> np.ndarray:
    """[replicate, leaf]: how often the leaves from ``first`` on, up to ``size`` of them, are drawn.

    ``size`` is a power of two and ``first`` a multiple of it.
    """
    levels = (n - 1).bit_length()
    inner = min(levels, size.bit_length() - 1)
    found = np.zeros((len(replicates), 1 << inner), np.int64)
    states = step(np.broadcast_to(series, len(replicates)), replicates)
    draws = np.full(len(replicates), n, np.int64)
    number = 0
    while draws.any():
        of_round = step(states, number)
        node, here = 1, draws
        for node, here, _, _ in _down(of_round, draws, first, levels, levels - inner):
            pass
        rows = np.flatnonzero(here)
        here, nodes = here[rows], np.full(len(rows), node, np.int64)
        for _ in range(inner):
            left = left_of(step(of_round[rows], nodes), here)
            here = np.concatenate([left, here - left])
            nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
            rows = np.concatenate([rows, rows])
            kept = here > 0
            rows, nodes, here = rows[kept], nodes[kept], here[kept]
        found[rows, nodes - (1 << levels) - first] += here
        rejected = np.zeros_like(draws)
        if n < 1 << levels:
            for _, draws, beside, right in _down(of_round, draws, n, levels, levels):
                if not right:
                    rejected += beside
            rejected += draws
        draws, number = rejected, number + 1
    return found[:, : n - first]
