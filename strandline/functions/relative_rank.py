"""Mergeable quantile sketch with relative rank error (relative compactors)."""

from __future__ import annotations

import struct

import numpy as np


_HEAD, _LEVEL = "<qqq?ddqQ", "<qqqd"
_MIXER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: int) -> int:
    """A 64-bit number spread over all bits."""
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 31


class RelativeRankSketch:
    """Quantiles whose rank error is a fraction of the distance to the protected end.

    A stack of compactors: an item in level h stands for 2^h values. A full compactor keeps the half of its room
    nearest the protected end, and of the rest, after a schedule that spares the sections next to it most often,
    throws away every other item at random and hands the others up. So ranks near the protected end are exact and
    the error of a rank grows with its distance from there, not with n.

    The sketch counts its compactions and how far they reached, so it gives the error it has really made room for:
    ``rank_error``. Sketches of parts are merged level by level and behave like one built over the whole.

    Coins are drawn from the sketch's own number, which follows from ``seed`` and the values it was given first and
    is mixed with those of the sketches it takes over. So parts of equal size throw different coins and their errors
    cancel, while the same part built again gives the same sketch.
    """

    def __init__(self, section: int = 32, sections: int = 4, high: bool = True, seed: int = 0) -> None:
        self.section, self.sections, self.high = section, sections, high
        self.n = 0
        self.number = _mix(seed)
        self.low, self.top = np.inf, -np.inf
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.state: list[int] = [0]  # where a level stands in its schedule
        self.made: list[int] = [0]  # compactions of a level
        self.reach: list[float] = [np.inf if not high else -np.inf]  # furthest value towards the protected end that was compacted

    def _sections(self, level: int) -> int:
        return max(self.sections, self.state[level].bit_length() + 1)

    def _room(self, level: int) -> int:
        return 2 * self.section * self._sections(level)

    def update(self, values: np.ndarray) -> None:
        """Add values (no NaN), any number at once."""
        if not len(values):
            return
        if not self.n:
            self.number = _mix(self.number ^ int(np.bitwise_xor.reduce(_MIXER * (np.ascontiguousarray(values, dtype="<f8").view(np.uint64) | np.uint64(1)))))
        self.n += len(values)
        self.low, self.top = min(self.low, float(values.min())), max(self.top, float(values.max()))
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._compress()

    def merge(self, other: RelativeRankSketch) -> None:
        """Take over what ``other`` has seen."""
        self.n += other.n
        self.number = _mix(self.number * 3 + other.number)
        self.low, self.top = min(self.low, other.low), max(self.top, other.top)
        while len(self.levels) < len(other.levels):
            self._grow()
        for h, items in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], items])
            self.state[h] |= other.state[h]
            self.made[h] += other.made[h]
            self.reach[h] = max(self.reach[h], other.reach[h]) if self.high else min(self.reach[h], other.reach[h])
        self._compress()

    def _grow(self) -> None:
        self.levels.append(np.empty(0))
        self.state.append(0)
        self.made.append(0)
        self.reach.append(-np.inf if self.high else np.inf)

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h]) > self._room(h):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        items = np.sort(self.levels[h])
        if not self.high:
            items = items[::-1]
        s = self._sections(h)
        ended = (self.state[h] ^ (self.state[h] + 1)).bit_length()  # trailing ones of the schedule, plus one
        kept = self._room(h) // 2 + self.section * max(s - ended, 0)
        cut = (len(items) - kept) // 2 * 2
        coin = _mix(self.number + (self.made[h] << 8) + h) >> 40 & 1
        if h + 1 == len(self.levels):
            self._grow()
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], items[:cut][coin::2]])
        edge = float(items[cut - 1])
        self.reach[h] = max(self.reach[h], edge) if self.high else min(self.reach[h], edge)
        self.levels[h] = items[cut:]
        self.state[h] += 1
        self.made[h] += 1

    def _weighted(self) -> tuple[np.ndarray, np.ndarray]:
        x = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(v), 1 << h, dtype=np.int64) for h, v in enumerate(self.levels)])
        order = np.argsort(x, kind="stable")
        return x[order], np.cumsum(w[order])

    def quantiles(self, q: np.ndarray) -> np.ndarray:
        """Smallest kept value whose rank reaches q n (NaN if empty)."""
        if not self.n:
            return np.full(len(q), np.nan)
        x, cum = self._weighted()
        at = np.searchsorted(cum, np.maximum(np.ceil(np.asarray(q) * cum[-1]), 1))
        out = x[np.minimum(at, len(x) - 1)]
        out = np.where(np.asarray(q) <= 0, self.low, out)
        return np.where(np.asarray(q) >= 1, self.top, out)

    def rank_error(self, values: np.ndarray) -> np.ndarray:
        """Three standard deviations of the rank of each value, as a share of n.

        A compaction of level h moves the rank of a value inside its range by 2^h either way if an odd number of its items
        lie below, else not at all, so the variance is 4^h / 2 for each compaction that reached beyond the value; one step of
        the kept items comes to it.
        """
        v = np.asarray(values, dtype=float)
        var = np.zeros(len(v))
        step = np.zeros(len(v))
        for h, (c, edge) in enumerate(zip(self.made, self.reach)):
            inside = (v <= edge) if self.high else (v >= edge)
            var += np.where(inside, c * 4.0**h / 2, 0)
            step = np.where(inside & (c > 0), 2.0 ** (h + 1), step)
        return (3 * np.sqrt(var) + step) / max(self.n, 1)

    def to_bytes(self) -> bytes:
        parts = [struct.pack(_HEAD, self.section, self.sections, self.n, self.high, self.low, self.top, len(self.levels), self.number)]
        for items, state, made, reach in zip(self.levels, self.state, self.made, self.reach):
            parts.append(struct.pack(_LEVEL, len(items), state, made, reach))
            parts.append(np.ascontiguousarray(items, dtype="<f8").tobytes())
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> RelativeRankSketch:
        section, sections, n, high, low, top, k, number = struct.unpack_from(_HEAD, data)
        s = cls(section, sections, high)
        s.n, s.low, s.top, s.number = n, low, top, number
        s.levels, s.state, s.made, s.reach = [], [], [], []
        at = struct.calcsize(_HEAD)
        for _ in range(k):
            size, state, made, reach = struct.unpack_from(_LEVEL, data, at)
            at += struct.calcsize(_LEVEL)
            s.levels.append(np.frombuffer(data, dtype="<f8", count=size, offset=at).copy())
            s.state.append(state), s.made.append(made), s.reach.append(reach)
            at += 8 * size
        return s
