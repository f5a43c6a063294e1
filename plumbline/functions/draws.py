"""Repeatable pseudo-random integers from plain 64-bit arithmetic.

The values depend only on the inputs, never on partitioning, and any SQL engine can
compute them. A draw joins two of 31 bits, each modulo its own prime, so it spans 62 bits
and ids that agree modulo one prime still differ. Cubing is a permutation modulo either
prime (p % 3 == 2), and no intermediate leaves the range of a signed 64-bit integer.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIMES = (2147483579, 2147483549)
#: Draws lie in [0, RANGE).
RANGE = PRIMES[0] * PRIMES[1]
WEIGHTS = ((1288490189, 715827901, 1540483477, 48271), (1103515245, 1812433253, 69069, 1664525))
SHIFTS = (104729, 15485863)


def _start(seed: int, half: int) -> int:
    return (seed * (7919, 6007)[half] + (17, 29)[half]) % PRIMES[half]


def draw(seed: int, *parts: Column) -> Column:
    """Integer in [0, RANGE) from a seed and up to four non-negative integer columns."""

    def half(k: int) -> Column:
        p = F.lit(PRIMES[k]).cast("long")
        mixed = F.lit(_start(seed, k)).cast("long")
        for part, weight in zip(parts, WEIGHTS[k], strict=False):
            mixed = mixed + (part.cast("long") % p) * F.lit(weight).cast("long") % p

        def cube(v: Column) -> Column:
            return (v * v % p) * v % p

        return cube((cube(mixed % p) + SHIFTS[k]) % p)

    return half(0) * F.lit(PRIMES[1]).cast("long") + half(1)


#: Numbers that are worked on together, few enough to stay in a processor's cache.
_CACHED = 1 << 14


def _fold(x: np.ndarray, k: int, room: np.ndarray, times: int = 2) -> None:
    """Bring ``x`` in [0, 2**63) down modulo the prime, to it or little more: the primes lie just below 2**31.

    The upper bits are put back as multiples of 2**31 - prime, which spares the division.
    """
    short, low = np.int64((1 << 31) - PRIMES[k]), np.int64((1 << 31) - 1)
    for _ in range(times):
        np.right_shift(x, 31, out=room)
        np.bitwise_and(x, low, out=x)
        np.multiply(room, short, out=room)
        np.add(x, room, out=x)


def _cube(v: np.ndarray, k: int, square: np.ndarray, room: np.ndarray) -> None:
    np.multiply(v, v, out=square)
    _fold(square, k, room)
    np.multiply(square, v, out=v)
    _fold(v, k, room)


def _term(part: np.ndarray, weight: int, k: int) -> np.ndarray:
    """``part`` modulo the prime times the weight; the terms of a draw add up to less than 2**63."""
    if not part.size or part.max() >= PRIMES[k]:
        part = part % PRIMES[k]
    return part * np.int64(weight)


def half_array(k: int, seed: int, *parts: np.ndarray) -> np.ndarray:
    """One of the two numbers a draw is joined of, in [0, PRIMES[k])."""
    p, start = PRIMES[k], np.int64(_start(seed, k))
    terms = [_term(np.asarray(part, np.int64), weight, k) for part, weight in zip(parts, WEIGHTS[k], strict=False)]
    out = np.empty(np.broadcast_shapes(*[t.shape for t in terms]), np.int64)
    if out.ndim == 2:
        rows = max(1, _CACHED // max(1, out.shape[1]))
        cuts = [slice(i, i + rows) for i in range(0, len(out), rows)]
    else:
        cuts = [slice(i, i + _CACHED) for i in range(0, len(out), _CACHED)] if out.ndim else [...]
    for cut in cuts:
        v = out[cut]
        np.copyto(v, start)
        for t in terms:
            np.add(v, t[cut] if t.ndim == out.ndim and t.shape[:1] == out.shape[:1] else t, out=v)
        square, room = np.empty_like(v), np.empty_like(v)
        _fold(v, k, room)
        _cube(v, k, square, room)
        np.add(v, SHIFTS[k], out=v)
        _cube(v, k, square, room)
        np.subtract(v, p, out=v, where=v >= p)
    return out


def draw_array(seed: int, *parts: np.ndarray) -> np.ndarray:
    """The same integers for NumPy arrays that broadcast against each other."""
    return half_array(0, seed, *parts) * np.int64(PRIMES[1]) + half_array(1, seed, *parts)


#: Draws of a line that are formed together, few enough to stay in a processor's cache.
LINE = 1024
#: Bits of the limbs that powers are cut into, so that no product leaves the whole numbers of a double.
_LIMB = 16
_WHOLE = 2.0**52


@lru_cache(maxsize=16)
def _line_steps(k: int, at: int, length: int) -> np.ndarray:
    """What the powers of a line's start are multiplied with to give its first ``length`` draws: [18, length].

    With y a step, (((x + y)^3 + s)^3) is a polynomial in x whose factors are polynomials in y.
    """
    p = PRIMES[k]
    y = (np.arange(length) * WEIGHTS[k][at] % p).astype(object)
    a, b, c = y**3 + SHIFTS[k], 3 * y * y, 3 * y
    factors = [
        a**3, 3 * a * a * b, 3 * a * a * c + 3 * a * b * b, 3 * a * a + 6 * a * b * c + b**3, 6 * a * b + 3 * a * c * c + 3 * b * b * c,
        6 * a * c + 3 * b * b + 3 * b * c * c, 3 * a + 6 * b * c + c**3, 3 * b + 3 * c * c, 3 * c,
    ]

    def near_zero(v: np.ndarray) -> np.ndarray:
        rest = (v % p).astype(np.int64)
        return np.where(rest > p // 2, rest - p, rest)

    out = np.ones((18, length))
    for e, f in enumerate(factors):
        if e:
            out[2 * e - 2], out[2 * e - 1] = near_zero(f), near_zero(f << _LIMB)
        else:
            out[17] = near_zero(f)
    return out


def _line_powers(k: int, seed: int, at: int, parts: tuple[np.ndarray, ...], first: np.ndarray | None) -> np.ndarray:
    p = PRIMES[k]
    x = np.full(len(parts[0]), _start(seed, k), np.int64)
    for part, weight in zip(parts, WEIGHTS[k], strict=False):
        x += part % p * weight % p
    if first is not None:
        x += first % p * WEIGHTS[k][at] % p
    x %= p
    out, power = np.empty((len(x), 18)), x
    for e in range(1, 9):
        out[:, 2 * e - 2], out[:, 2 * e - 1] = power & ((1 << _LIMB) - 1), power >> _LIMB
        power = power * x % p
    # the half keeps quotients off the whole numbers, where rounding would decide
    out[:, 16], out[:, 17] = power + 0.5, 1.0
    return out


class DrawLines:
    """Lines of draws: ``draw_array(seed, *parts, j)`` for j from ``first`` on, a line for each entry of ``parts``.

    Along a line a draw is a polynomial of the ninth degree modulo a prime, so a product of matrices gives
    many draws at once. Its sums stay below 2**50 and are exact in doubles.
    """

    def __init__(self, seed: int, *parts: np.ndarray, first: np.ndarray | None = None) -> None:
        parts = tuple(np.asarray(part, np.int64) for part in parts)
        self.at = len(parts)
        self.powers = [_line_powers(k, seed, self.at, parts, first) for k in (0, 1)]

    def halves(self, rows: slice, length: int) -> list[np.ndarray]:
        """Both halves of the first ``length`` draws of some lines, each with 0.5 added, as doubles."""
        out = []
        for k, p in enumerate(PRIMES):
            steps = _line_steps(k, self.at, -(-length // LINE) * LINE if length > LINE // 4 else LINE // 4)
            v = self.powers[k][rows] @ steps[:, :length]
            q = v * (1.0 / p)
            np.floor(q, out=q)
            q *= float(p)
            v -= q
            out.append(v)
        return out

    def low_bits(self, rows: slice, length: int, bits: int) -> np.ndarray:
        """The lowest ``bits`` (at most 15) bits of the draws: [line, j]."""
        first, second = self.halves(rows, length)
        factor = PRIMES[1] % (1 << bits)
        first *= factor
        first += second
        # the halves that were added make (factor + 1) / 2; above 2**52 a double's last bit counts ones
        first += _WHOLE - (factor + 1) // 2
        whole = first.view(np.int64)
        whole &= (1 << bits) - 1
        return whole

    def whole(self, rows: slice, length: int) -> np.ndarray:
        """The draws themselves: [line, j]."""
        first, second = self.halves(rows, length)
        out = first.astype(np.int64)
        out *= PRIMES[1]
        out += second.astype(np.int64)
        return out


def draw_sql(seed: int, *parts: str) -> str:
    """The same integer as a SQL expression."""

    def half(k: int) -> str:
        p = PRIMES[k]
        mixed = f"{_start(seed, k)}::bigint"
        for part, weight in zip(parts, WEIGHTS[k], strict=False):
            mixed += f" + (({part})::bigint % {p}) * {weight} % {p}"

        def cube(v: str) -> str:
            return f"(({v}) * ({v}) % {p}) * ({v}) % {p}"

        inner = cube(f"({mixed}) % {p}")
        return cube(f"({inner} + {SHIFTS[k]}) % {p}")

    return f"(({half(0)}) * {PRIMES[1]} + {half(1)})"
