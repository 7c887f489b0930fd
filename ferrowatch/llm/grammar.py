"""Run-length grammars by recompression, and longest common extensions over them.

A sequence of numbers is shortened level by level. Block compression replaces every run of equal
symbols by one symbol; pair compression deals the symbols of a level into left and right ones and
replaces every left symbol that a right one follows by one symbol for both. Equal symbols of a level
spell equal stretches, and equal stretches are cut alike but for their ends: two positions that have
matched one symbol are both boundaries of the next level or both not. So a common extension climbs
from level to level over a few symbols each, meets unequal symbols, and descends to their first
unequal part. Every answer is exact whatever the dealing; it decides the number of levels only.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd

# A level of so few symbols is not shortened further, nor one that so many dealings leave alone.
LEAST = 64
PATIENCE = 12
# Odd numbers whose products' high bits deal symbols into left and right.
_DEALS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


@dataclass
class Level:
    """Symbols, and how the next level groups them: which boundaries it keeps, the next level's
    symbol that holds each one, and where that begins here. The top level has no groups."""

    symbols: np.ndarray
    kept: np.ndarray | None = None
    holder: np.ndarray | None = None
    begin: np.ndarray | None = None
    blocks: bool = False


def _grouped(level: Level, first: np.ndarray, blocks: bool) -> np.ndarray:
    """Set how a level is grouped by the symbols that begin a group; the groups' sizes."""
    level.kept = np.append(first, True)
    level.holder = (np.cumsum(level.kept) - 1).astype(np.int32)
    level.begin = np.flatnonzero(level.kept).astype(np.int32)
    level.blocks = blocks
    return np.diff(level.begin)


def _named(keys: np.ndarray) -> np.ndarray:
    return pd.factorize(keys)[0].astype(np.int64)


def _pairs(symbols: np.ndarray, turn: int) -> np.ndarray:
    """Where a pair begins, by the dealing and orientation that makes most pairs of two tried."""
    best = np.zeros(0, np.int64)
    for deal in range(2):
        factor = np.uint64(_DEALS[(2 * turn + deal) % len(_DEALS)])
        shift = np.uint64(63 - (2 * turn + deal) // len(_DEALS) % 24)
        left = (((symbols.astype(np.uint64) + np.uint64(1)) * factor) >> shift) & np.uint64(1) == 1
        for one, other in ((left, ~left), (~left, left)):
            found = np.flatnonzero(one[:-1] & other[1:])
            if len(found) > len(best):
                best = found
    return best


class Grammar:
    """The levels of one sequence. Its first and its last number must be unlike all others."""

    def __init__(self, sequence: np.ndarray) -> None:
        symbols = _named(sequence)
        self.levels = [Level(symbols)]
        idle, turn = 0, 0
        while len(symbols) > LEAST and idle < PATIENCE:
            first = np.append(True, symbols[1:] != symbols[:-1])
            if not first.all():
                sizes = _grouped(self.levels[-1], first, blocks=True)
                symbols = _named(symbols[first] * (int(sizes.max()) + 1) + sizes)
                self.levels.append(Level(symbols))
            pair = _pairs(symbols, turn)
            turn += 1
            idle = 0 if len(pair) else idle + 1
            if len(pair):
                first = np.ones(len(symbols), bool)
                first[pair + 1] = False
                after = np.zeros(len(symbols), np.int64)
                after[pair] = symbols[pair + 1] + 1
                keys = symbols * (int(symbols.max()) + 2) + after
                _grouped(self.levels[-1], first, blocks=False)
                symbols = _named(keys[first])
                self.levels.append(Level(symbols))

    def extend(self, one: np.ndarray, other: np.ndarray, *, forward: bool) -> np.ndarray:
        """How many numbers from two unlike boundaries on, or before them, are equal.

        Boundary i is the one before the number i.
        """
        x, y = one.astype(np.int64), other.astype(np.int64)
        where = np.arange(len(x))
        stopped: list[np.ndarray] = []
        for level in self.levels:
            lost = []
            if level.kept is not None:
                while len(where):
                    asks = where[~(level.kept[x[where]] & level.kept[y[where]])]
                    if not len(asks):
                        break
                    equal = _step(level, x, y, asks, forward)
                    if not equal.all():
                        lost.append(asks[~equal])
                        where = np.setdiff1d(where, asks[~equal], assume_unique=True)
                x[where], y[where] = level.holder[x[where]], level.holder[y[where]]
            else:
                lost.append(where)
            stopped.append(np.concatenate(lost) if lost else where[:0])
        down = where[:0]
        for number in range(len(self.levels) - 1, -1, -1):
            level = self.levels[number]
            if len(down):
                x[down], y[down] = level.begin[x[down]], level.begin[y[down]]
            down = np.append(down, stopped[number])
            asks = down
            while len(asks):
                asks = asks[_step(level, x, y, asks, forward)]
        return x - one if forward else one - x


def _step(level: Level, x: np.ndarray, y: np.ndarray, asks: np.ndarray, forward: bool) -> np.ndarray:
    """Pass one equal symbol, or the rest of the shorter block of it; tells where they are equal."""
    a, b = (x[asks], y[asks]) if forward else (x[asks] - 1, y[asks] - 1)
    equal = level.symbols[a] == level.symbols[b]
    own, a, b = asks[equal], a[equal], b[equal]
    if level.blocks and forward:
        size = np.minimum(level.begin[level.holder[a] + 1] - a, level.begin[level.holder[b] + 1] - b)
    elif level.blocks:
        size = np.minimum(a - level.begin[level.holder[a]], b - level.begin[level.holder[b]]) + 1
    else:
        size = 1
    x[own] += size if forward else -size
    y[own] += size if forward else -size
    return equal
