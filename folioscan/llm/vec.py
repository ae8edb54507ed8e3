"""Whole batches of texts as one byte array: words, hashes and per-document sums in numpy.

A batch stays the concatenation that Arrow already holds; nothing is copied per
text.  Word hashes come from one prefix sum of ``byte * M**i`` modulo 2**64, so
they cost the same for any word length, and are finished by a 64-bit mixer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M = U64(0x9E3779B97F4A7C15 | 1)
_MINV = U64(pow(int(_M), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NON_SPACE = ~SPACE
#: ASCII letters and digits, and every byte of a longer UTF-8 sequence.
ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_a:_b] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 1 << 16), _M if which == "up" else _MINV, U64)
            steps[0] = 1
            have = _powers[which] = np.multiply.accumulate(steps)
        if n > 1 << 24:  # a giant text does not stay in the cache
            _powers[which] = have[: 1 << 20].copy()
    return have[:n]


class Texts:
    """The bytes of a batch (``data``) and where each text begins and ends (``at``)."""

    def __init__(self, column: pa.Array):
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data, self.at, self.n = data[at[0] : at[-1]], at - at[0], len(column)
        self._prefix: np.ndarray | None = None

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """Number of true bytes in each text."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def edges(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each run of member bytes; a run ends where its text does."""
        if not len(member):
            none = np.zeros(0, np.int64)
            return none, none
        inner = self.at[(self.at > 0) & (self.at < len(member))]
        before = np.zeros(len(member), bool)
        before[1:] = member[:-1]
        before[inner] = False
        after = np.zeros(len(member), bool)
        after[:-1] = member[1:]
        after[inner - 1] = False
        return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1

    def owner(self, starts: np.ndarray) -> np.ndarray:
        """Which text each of the ascending positions is in."""
        first = np.searchsorted(starts, self.at)
        return np.repeat(np.arange(self.n), np.diff(first))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self._prefix is None:
            with np.errstate(over="ignore"):
                self._prefix = np.zeros(len(self.data) + 1, U64)
                np.cumsum((self.data.astype(U64) + U64(1)) * _power("up", len(self.data)), out=self._prefix[1:])
        with np.errstate(over="ignore"):
            raw = (self._prefix[ends] - self._prefix[starts]) * _power("down", len(self.data) + 1)[starts]
            return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, owner: np.ndarray, size: int, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of ``size`` words; with ``short`` a text of fewer words is one window."""
    counts = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
    out, whose = np.zeros(0, U64), np.zeros(0, np.int64)
    if len(hashes) >= size:
        with np.errstate(over="ignore"):
            total = np.zeros(len(hashes) - size + 1, U64)
            for k in range(size):
                total = total * U64(0xD1B54A32D192ED03) + hashes[k : len(hashes) - size + 1 + k]
        whole = owner[: len(total)] == owner[size - 1 :]
        out, whose = mix(total[whole]), owner[: len(total)][whole]
    if short and (few := np.flatnonzero((counts > 0) & (counts < size))).size:
        first = np.cumsum(counts) - counts
        extra = np.zeros(len(few), U64)
        with np.errstate(over="ignore"):
            for i, t in enumerate(few):
                for h in hashes[first[t] : first[t] + counts[t]]:
                    extra[i] = extra[i] * U64(0xD1B54A32D192ED03) + h
                extra[i] += U64(counts[t])
        out, whose = np.concatenate([out, mix(extra)]), np.concatenate([whose, few])
        order = np.argsort(whose, kind="stable")
        out, whose = out[order], whose[order]
    return out, whose
