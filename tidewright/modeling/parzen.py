"""Search by Parzen estimates: where good trials are dense and the others are not, the next one is drawn.

Each parameter is treated by itself. The best tenth of the trials and the rest give two densities; of some candidates drawn
from the first, the one with the largest ratio of the two is taken.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

GOOD_SHARE = 0.1
MOST_GOOD = 25
CANDIDATES = 24


def _below(z: float) -> float:
    """The standard normal distribution function."""
    return math.erfc(-z / math.sqrt(2)) / 2


@dataclass(frozen=True)
class Range:
    """What a parameter can be: a list of choices, or all numbers between two; `log` spaces them by their logarithm."""

    choices: tuple[Any, ...] = ()
    low: float = 0.0
    high: float = 0.0
    whole: bool = False
    log: bool = False

    @staticmethod
    def of(values: Sequence[Any]) -> Range:
        """The range that listed values span; a list with anything but numbers is a list of choices."""
        if not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            return Range(choices=tuple(values))
        whole = all(isinstance(v, int) for v in values)
        return Range(low=min(values), high=max(values), whole=whole, log=not whole and min(values) > 0)

    def scaled(self, value: float) -> float:
        return math.log(value) if self.log else float(value)

    @property
    def ends(self) -> tuple[float, float]:
        """Ends on the scale; whole numbers own half a step to either side."""
        if self.whole:
            return self.low - 0.5, self.high + 0.5
        return self.scaled(self.low), self.scaled(self.high)

    def value(self, at: float) -> float | int:
        if self.whole:
            return int(min(self.high, max(self.low, math.floor(at + 0.5))))
        return min(self.high, max(self.low, math.exp(at) if self.log else at))

    def uniform(self, rng: random.Random) -> Any:
        if self.choices:
            return rng.choice(self.choices)
        if self.whole:
            return rng.randint(int(self.low), int(self.high))
        low, high = self.ends
        return self.value(rng.uniform(low, high))


class Density:
    """Mixture of normal curves cut at the ends of the range: one around each value, and a wide one over the whole range.

    A curve is as wide as the larger gap to its neighbours, but no wider than the range and no narrower than a
    share of it that falls with the number of values.
    """

    def __init__(self, range_: Range, values: Sequence[Any]):
        self.range = range_
        if range_.choices:
            counts = [1 / len(range_.choices) + sum(v == c for v in values) for c in range_.choices]
            self.shares = [c / sum(counts) for c in counts]
            return
        low, high = range_.ends
        width = (high - low) or 1.0
        middle = (low + high) / 2
        centres = sorted([*[range_.scaled(v) for v in values], middle])
        wide = centres.index(middle)
        marks = [low, *centres, high]
        least = width / min(100, len(centres) + 1)
        self.curves = []
        for i, c in enumerate(centres):
            gap = width if i == wide else max(c - marks[i], marks[i + 2] - c)
            self.curves.append((c, min(width, max(least, gap))))

    def _mass(self, low: float, high: float) -> float:
        """Share of the mixture between two places of the scale."""
        first, last = self.range.ends
        found = 0.0
        for c, s in self.curves:
            held = _below((last - c) / s) - _below((first - c) / s)
            found += (_below((high - c) / s) - _below((low - c) / s)) / held
        return found / len(self.curves)

    def log(self, value: Any) -> float:
        if self.range.choices:
            return math.log(self.shares[self.range.choices.index(value)])
        at = self.range.scaled(value)
        if self.range.whole:
            return math.log(max(self._mass(at - 0.5, at + 0.5), 1e-300))
        first, last = self.range.ends
        total = 0.0
        for c, s in self.curves:
            held = _below((last - c) / s) - _below((first - c) / s)
            total += math.exp(-(((at - c) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi) * held)
        return math.log(max(total / len(self.curves), 1e-300))

    def draw(self, rng: random.Random) -> Any:
        if self.range.choices:
            return rng.choices(self.range.choices, self.shares)[0]
        first, last = self.range.ends
        if first == last:
            return self.range.value(first)
        c, s = rng.choice(self.curves)
        while True:  # a curve has its centre within the ends, so half of the draws or a good part of them stay
            at = rng.gauss(c, s)
            if first <= at <= last:
                return self.range.value(at)


def split_trials(done: Sequence[tuple[dict[str, Any], float]]) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
    """The best tenth, at least one and at most `MOST_GOOD`, and the rest; among equals the earlier are better."""
    order = sorted(range(len(done)), key=lambda i: (-done[i][1], i))
    good = min(MOST_GOOD, math.ceil(GOOD_SHARE * len(done)))
    return [done[i][0] for i in order[:good]], [done[i][0] for i in order[good:]]


def suggest(
    ranges: dict[str, Range], done: Sequence[tuple[dict[str, Any], float]], rng: random.Random, startup: int = 10, candidates: int = CANDIDATES
) -> dict[str, Any]:
    """The next parameter set after the trials `(parameters, score)`; higher scores are better."""
    if len(done) < max(2, startup):
        return {name: r.uniform(rng) for name, r in ranges.items()}
    good, rest = split_trials(done)
    out = {}
    for name, r in ranges.items():
        near, far = Density(r, [p[name] for p in good]), Density(r, [p[name] for p in rest])
        out[name] = max((near.draw(rng) for _ in range(candidates)), key=lambda v: near.log(v) - far.log(v))
    return out
