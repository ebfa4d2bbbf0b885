"""Rolling hashes of texts and the phrases that they trigger."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Powers are kept for data of up to so many bytes; longer data have their own while they are worked on.
KEPT = 1 << 20
#: Places of windows that a trigger can name: a longer text can't be worked on, and is refused by name.
MOST = 1 << 28
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    with np.errstate(over="ignore"):
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64, out=table))
    return tables[0], tables[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > KEPT:
        return _power_tables(n + 1)
    if not _tables:
        _tables.append(_power_tables(KEPT + 1))
    return _tables[0]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretches of the data, from sums over its start."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data) + 1)
        # A byte counts by a mixed value of itself and the next ones, so that regular data don't cancel out.
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64) * _M1)

    def all(self, length: int) -> np.ndarray:
        """Of all stretches of one length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def phrases(rolling: Rolling, bounds: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lo, hi, trigger: the starts lo..hi of strings of `length` bytes whose least window hash stands at the trigger.

    The trigger of a string depends on its own bytes alone. Strings never cross the bounds of a text.
    """
    gap = length - window + 1
    h = rolling.all(window)
    if len(h) > MOST:
        raise ValueError(f"a text of {len(rolling.sums) - 1} bytes is too long: {MOST} at most")
    n = len(rolling.sums) - 1 - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    best = (h & np.uint64(0xFFFFFFFFF0000000)) | (np.arange(len(h), dtype=np.uint64) & np.uint64(0x0FFFFFFF))  # the first of equal ones
    reach = 1
    while 2 * reach <= gap:
        best = np.minimum(best[: len(best) - reach], best[reach:])
        reach *= 2
    if reach < gap:
        best = np.minimum(best[: len(best) - (gap - reach)], best[gap - reach :])
    trigger = (best[:n] & np.uint64(0x0FFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)  # starts of strings within one text
    size = np.diff(bounds)
    long = size >= length
    first, last = bounds[:-1][long], bounds[1:][long] - length
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    live = np.cumsum(inside)[:n] > 0
    new = np.ones(n, bool)
    new[1:] = trigger[1:] != trigger[:-1]
    new[first] = True
    new &= live
    lo = np.flatnonzero(new)
    ends = np.flatnonzero(live & np.concatenate([new[1:] | ~live[1:], [True]]))
    return lo, ends, trigger[lo]
