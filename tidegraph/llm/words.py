"""Words and five-word shingles of texts as 64-bit hashes, computed over whole groups of texts in numpy."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = mix((_LOWER.astype(np.uint64) + np.uint64(1)) * _BASE)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        odd = int(_BASE)
        for i, base in enumerate((odd, pow(odd, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """Hashes of the words of a group of texts, A-Z lowered; text d has words ``offsets[d]`` to ``offsets[d + 1]``."""

    def __init__(self, texts: list[str | None]) -> None:
        raws = [(x or "").encode() for x in texts]
        data = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
        ends_of = np.cumsum(np.array([len(x) + 1 for x in raws], np.int64))
        solid = ~_BLANK[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        power, inverse = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:len(data)], out=total[1:])
        self.hashes = mix((total[ends] - total[starts]) * inverse[starts])
        self.offsets = np.concatenate(([0], np.searchsorted(starts, ends_of)))

    def shingles(self) -> np.ndarray:
        """A hash for each five words from each place on; those that reach into the next text are not to be used."""
        h = self.hashes
        if len(h) < SHINGLE:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for i in range(SHINGLE):
            out *= _BASE
            out += h[i:len(h) - SHINGLE + 1 + i]
        return mix(out)

    def sequences(self) -> list[np.ndarray]:
        """Per text, the shingle at each of its places; a text of one to four words has one, of all its words."""
        s, out = self.shingles(), []
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            if b - a >= SHINGLE:
                out.append(s[a:b - SHINGLE + 1])
            elif b > a:
                x = np.uint64(b - a)
                for h in self.hashes[a:b]:
                    x = mix(np.array([x], np.uint64) * _BASE + h)[0]
                out.append(np.array([x], np.uint64))
            else:
                out.append(s[:0])
        return out
