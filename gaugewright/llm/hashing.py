"""64-bit hashes of spans of character or byte codes, for all spans of a buffer at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
MULTIPLY, STEP, SPREAD = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * SPREAD
    return x ^ (x >> U(29))


class SpanHasher:
    """Hashes spans by differences of running sums of powers; the powers' tables grow as needed."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, dtype=U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers = np.cumprod(np.concatenate([[U(1)], np.full(n, STEP)]), dtype=U)
            self.inverses = np.cumprod(np.concatenate([[U(1)], np.full(n, U(pow(int(STEP), -1, 1 << 64)))]), dtype=U)

    def hashes(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, dtype=U)
        np.cumsum(mixed((codes.astype(U) + U(1)) * MULTIPLY) * self.powers[: len(codes)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(U) * MULTIPLY)
