"""Configuration linear program over a length histogram, by multiplicative weights, and its rounding to runs of sequences.

The program: use configurations (multisets of lengths that fit the capacity) as
few times as can be, so that each length is covered as often as it is there. A
length has a price; a configuration is worth its items' prices. At first a price
is the length's share of the capacity. Again and again

- a knapsack dynamic program prices the best configuration around the dearest
  length still uncovered, out of a short list of what is left: the lengths of
  the highest price a token, and others spread over all sizes;
- the configuration is used a whole number of times, as often as its lengths'
  quotas for this phase allow (rounding on the way, so nothing is left to round);
- each of its lengths' prices falls by exp(-RATE * the share of it now covered).

A pass ends when no configuration is worth using: it would leave more than
SLACK of the capacity empty. Best fit, longest first, places what is left.
Prices scaled by their dearest configuration, an exact knapsack over all
lengths, are dual solutions: their worth is a lower bound of the program. While
the sequences exceed the bound by more than TOLERANCE, another pass starts from
the prices that the last one ended with, until a pass is no better.

Everything here works on the histogram, which has at most `capacity` lengths
whatever the number of documents, and each use of a configuration exhausts a
length's quota, so the work is bounded. Its result is a bounded list of runs:
`count` items of one length, of consecutive ranks among that length's items,
that go to consecutive sequences at one offset.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np

#: How strongly a covered length's price falls; quotas in so many phases; the short list's size.
RATE, PHASES, SHORT = 0.5, 2, 24
#: A pass is good enough at this share above the lower bound; a configuration may leave this share of the capacity empty.
TOLERANCE, SLACK = 0.002, 0.004


def best_configuration(prices: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """Knapsack by dynamic programming: the (length index, copies) of the highest total price that fit."""
    items = []  # copies in powers of two, so that each item is taken at most once
    for i, (size, n) in enumerate(zip(lengths.tolist(), most.tolist(), strict=True)):
        left, part = min(n, capacity // size), 1
        while left > 0:
            take = min(part, left)
            items.append((i, take, size * take, prices[i] * take))
            left, part = left - take, part * 2
    value = np.zeros((len(items) + 1, capacity + 1))
    for k, (_, _, size, price) in enumerate(items):
        value[k + 1, :size] = value[k, :size]
        np.add(value[k, : capacity + 1 - size], price, out=value[k + 1, size:])
        np.maximum(value[k, size:], value[k + 1, size:], out=value[k + 1, size:])
    at, chosen = capacity, {}
    for k in range(len(items) - 1, -1, -1):
        if value[k + 1, at] > value[k, at]:
            i, n, size, _ = items[k]
            chosen[i] = chosen.get(i, 0) + n
            at -= size
    return sorted(chosen.items())


def dearest(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    """The highest worth of any configuration, however often it takes a length: an exact knapsack."""
    by_size = np.full(capacity + 1, -np.inf)
    by_size[lengths] = prices
    value = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        value[c] = max(value[c - 1], (by_size[1 : c + 1] + value[c - 1 :: -1]).max() if c > 1 else by_size[1])
    return float(value[capacity])


@dataclass
class Plan:
    capacity: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first rank, count, first sequence, offset
    sequences: int = 0
    configurations: int = 0  # used, each as one or more sequences
    by_program: int = 0  # items placed by configurations
    bound: float = 0.0  # no fewer sequences can do

    def arrays(self) -> np.ndarray:
        return np.array(sorted(self.runs), np.int64).reshape(-1, 5)


class Packing:
    """One pass over the items of a histogram."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> None:
        self.lengths, self.counts, self.plan = lengths, counts, Plan(capacity)
        self.used = np.zeros(len(lengths), np.int64)
        self.spaces: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def leave(self, space: int, first: int, n: int) -> None:
        if space > 0 and n > 0:
            if space not in self.spaces:
                bisect.insort(self.sizes, space)
                self.spaces[space] = []
            self.spaces[space].append((first, n))

    def put(self, i: int, n: int, first: int, offset: int) -> None:
        self.plan.runs.append((int(self.lengths[i]), int(self.used[i]), int(n), int(first), int(offset)))
        self.used[i] += n

    def use(self, config: list[tuple[int, int]], n: int) -> None:
        offset, out = 0, self.plan
        for i, k in config:
            for _ in range(k):
                self.put(i, n, out.sequences, offset)
                offset += int(self.lengths[i])
        self.leave(out.capacity - offset, out.sequences, n)
        out.sequences += n
        out.configurations += 1
        out.by_program += n * sum(k for _, k in config)

    def by_prices(self, prices: np.ndarray) -> None:
        """Configurations by multiplicative weights; prices are changed in place."""
        lengths, counts, capacity = self.lengths, self.counts, self.plan.capacity
        for phase in range(1, PHASES + 1):
            quota = -(-counts * phase // PHASES)
            shut = np.zeros(len(lengths), bool)  # lengths that no configuration worth using holds
            while True:
                left = np.where(shut, 0, quota - self.used)
                open_ = np.flatnonzero(left > 0)
                if not len(open_):
                    break
                seed = int(open_[prices[open_].argmax()])
                room = capacity - int(lengths[seed])
                fits = np.flatnonzero((quota - self.used > (np.arange(len(lengths)) == seed)) & (lengths <= room))
                config = {seed: 1}
                if len(fits):
                    if len(fits) > SHORT:
                        dear = np.argpartition(-prices[fits] / lengths[fits], SHORT // 2)[: SHORT // 2]
                        fits = fits[np.unique(np.concatenate([dear, np.linspace(0, len(fits) - 1, SHORT // 2).astype(np.int64)]))]
                    most = (quota - self.used)[fits] - (fits == seed)
                    for j, k in best_configuration(prices[fits], lengths[fits], most, room):
                        i = int(fits[j])
                        config[i] = config.get(i, 0) + k
                if capacity - sum(int(lengths[i]) * k for i, k in config.items()) > SLACK * capacity:
                    shut[seed] = True
                    continue
                n = min(int(quota[i] - self.used[i]) // k for i, k in config.items())
                self.use(sorted(config.items()), n)
                for i, k in config.items():
                    prices[i] *= np.exp(-RATE * n * k / counts[i])

    def by_best_fit(self) -> None:
        """What is left, longest first, into the smallest space that takes it."""
        lengths, counts, capacity, out = self.lengths, self.counts, self.plan.capacity, self.plan
        for i in range(len(lengths) - 1, -1, -1):
            length = int(lengths[i])
            while left := int(counts[i] - self.used[i]):
                at = bisect.bisect_left(self.sizes, length)
                if at < len(self.sizes):
                    space = self.sizes[at]
                    first, n = self.spaces[space].pop()
                    if not self.spaces[space]:
                        del self.spaces[space], self.sizes[at]
                    take = min(n, left)
                    self.put(i, take, first, capacity - space)
                    self.leave(space - length, first, take)
                    self.leave(space, first + take, n - take)
                    continue
                each = capacity // length
                for k, n in ((each, left // each), (left % each, int(left % each > 0))):
                    for j in range(k if n else 0):
                        self.put(i, n, out.sequences, j * length)
                    self.leave(capacity - k * length, out.sequences, n)
                    out.sequences += n


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    if not len(lengths):
        return Plan(capacity)
    prices = lengths / capacity
    best, bound = None, float(counts @ prices)  # as no configuration is worth more than 1 at these prices
    while True:
        packing = Packing(lengths, counts, capacity)
        packing.by_prices(prices)
        packing.by_best_fit()
        prices /= dearest(prices, lengths, capacity)
        bound = max(bound, float(counts @ prices))
        better = best is None or packing.plan.sequences < best.sequences
        best = packing.plan if better else best
        best.bound = bound
        if not better or best.sequences <= np.ceil(bound) * (1 + TOLERANCE):
            return best
