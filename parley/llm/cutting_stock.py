"""The cutting-stock program over a histogram of piece sizes, by column generation.

Everything here is bounded by the number of sizes, never by the number of pieces.
"""

from __future__ import annotations

import numpy as np

#: Share of sequences that the linear program may have above its optimum.
GAP = 1e-3


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size, sequences) patterns that hold ``demand`` pieces in few sequences.

    ``sizes`` are multiples of their greatest common divisor, which is the unit of the knapsack.
    The linear program's solution is rounded down; what is left over is placed first-fit.
    """
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    unit = int(np.gcd.reduce(np.append(sizes, capacity)))
    small, left = sizes[used] // unit, demand[used].astype(np.int64)
    room = capacity // unit
    patterns: list[tuple[np.ndarray, int]] = []
    for column, amount in _relaxed(small, left.astype(float), room):
        times = int(amount + 1e-9)
        while times > 0 and (left > 0).any():
            # A column may hold more pieces of a size than are left: those sequences get fewer.
            held = np.minimum(column, left)
            if not held.any():
                break
            full = held > 0
            count = min(times, int((left[full] // held[full]).min()))
            patterns.append((held, count))
            left = left - held * count
            times -= count
    patterns += _first_fit(small, left, room)
    # A program that ran out of turns can be worse than no program.
    plain = _first_fit(small, demand[used].astype(np.int64), room)
    patterns = min(patterns, plain, key=lambda some: sum(count for _, count in some))
    out = []
    for held, count in patterns:
        whole = np.zeros(len(sizes), np.int64)
        whole[used] = held
        out.append((whole, count))
    return out


def _relaxed(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Columns of the linear program's optimal basis and their amounts."""
    count = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    # Slightly uneven demand keeps equal ratios, and so cycles of the basis, away.
    demand = demand + 1e-3 * (0.5 + np.arange(count) * 0.6180339887 % 1)
    amounts = inverse @ demand
    # Prices in proportion to size bound the total from below; pulling prices towards the best
    # ones known keeps them from swinging, which would take several times the turns.
    calm, bound = sizes / room, 0.0
    for turn in range(8 * count):  # every basis is feasible, so stopping early costs only room
        prices = inverse.sum(axis=0)
        for tried in (0.8 * calm + 0.2 * prices, prices):
            column = _knapsack(sizes, tried, room)
            fair = tried / max(tried @ column, 1.0)  # no pattern is worth more than 1
            if fair @ demand > bound:
                calm, bound = fair, float(fair @ demand)
            if prices @ column > 1 + 1e-7:
                break
        if prices @ column <= 1 + 1e-7 or amounts.sum() <= bound * (1 + GAP):
            break
        step = inverse @ column
        ratio = np.full(count, np.inf)
        np.divide(amounts, step, out=ratio, where=step > 1e-9)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        basis[:, leaves] = column
        if turn % 64 == 63:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[leaves] / step[leaves]
            inverse -= np.outer(step, row)
            inverse[leaves] = row
        amounts = np.maximum(inverse @ demand, 0.0)
    return [(basis[:, i].astype(np.int64), float(amounts[i])) for i in np.argsort(-amounts, kind="stable")]


def _knapsack(sizes: np.ndarray, prices: np.ndarray, room: int) -> np.ndarray:
    """The most valuable pattern: how many pieces of each size."""
    best = np.zeros(room + 1)
    taken = np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    ascending, value = sizes[order], prices[order]
    fits = np.searchsorted(ascending, np.arange(room + 1), side="right")
    for space in range(1, room + 1):
        gains = best[space - ascending[: fits[space]]] + value[: fits[space]]
        choice = int(gains.argmax()) if len(gains) else -1
        if choice >= 0 and gains[choice] > best[space - 1]:
            best[space], taken[space] = gains[choice], order[choice]
        else:
            best[space] = best[space - 1]
    column, space = np.zeros(len(sizes)), room
    while space > 0:
        if taken[space] < 0:
            space -= 1
        else:
            column[taken[space]] += 1
            space -= sizes[taken[space]]
    return column


def _first_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns for the remainder: the largest pieces that still fit, sequence after sequence."""
    patterns = []
    left = left.copy()
    order = np.argsort(-sizes, kind="stable")
    while left.any():
        held, space = np.zeros(len(sizes), np.int64), room
        for size in order:
            held[size] = min(left[size], space // sizes[size])
            space -= held[size] * sizes[size]
        full = held > 0
        count = int((left[full] // held[full]).min())
        patterns.append((held, count))
        left -= held * count
    return patterns
