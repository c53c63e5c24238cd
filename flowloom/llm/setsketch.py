"""SetSketch registers of hashed sets, their bands and the joint likelihood estimate.

Register j of a set holds floor(1 - log_b(h / SCALE)), where h is the least of
one exponential variate per element; the variate is -ln of a hash of the element
under multiplier j. Values are spaced exponentially and truncated to a byte.
Registers of a union are the maxima of registers, so sketches can be merged, and
two sets agree in a register with a probability close to their similarity.
"""

from __future__ import annotations

import numpy as np

from .bytetext import U64

BASE = 1.1
SCALE = 20.0
BAND_ROWS = 5
#: At similarity 0.75 a register agrees with probability 0.76, so all bands miss with 0.00003.
BANDS = 36
REGISTERS = BANDS * BAND_ROWS

_RNG = np.random.default_rng(4711)
_MULTIPLY = _RNG.integers(1, 2**64 - 1, REGISTERS, dtype=U64) | U64(1)
_ADD = _RNG.integers(0, 2**64 - 1, REGISTERS, dtype=U64)
#: Similarities at which the likelihood is evaluated.
_GRID = np.linspace(0.0, 1.0, 101)


def registers(elements: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers of several nonempty sets, laid end to end and beginning at ``starts``: sets x REGISTERS bytes."""
    out = np.empty((len(starts), REGISTERS), np.uint8)
    if not len(starts):
        return out
    values = np.empty_like(elements)
    for j in range(REGISTERS):
        np.multiply(elements, _MULTIPLY[j], out=values)
        values += _ADD[j]
        out[:, j] = _levels(np.maximum.reduceat(values, starts))
    return out


def _levels(greatest: np.ndarray) -> np.ndarray:
    rest = (~greatest).astype(np.float64) + 0.5  # 2**64 - 1 - value, exactly where it is small
    least = -np.log1p(-rest / 2.0**64)
    return np.clip(np.floor(1 - np.log(least / SCALE) / np.log(BASE)), 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def bands(regs: np.ndarray) -> np.ndarray:
    """One key for each set and band: the band's number and its register values."""
    keys = np.zeros((len(regs), BANDS), np.int64)
    keys += np.arange(BANDS, dtype=np.int64) << (8 * BAND_ROWS)
    for j in range(BAND_ROWS):
        keys += regs[:, j::BAND_ROWS].astype(np.int64) << (8 * j)
    return keys


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood given how often either register is larger, and both sizes."""
    if not len(left):
        return np.zeros(0)
    more = (left > right).sum(axis=1)[:, None]
    less = (left < right).sum(axis=1)[:, None]
    same = left.shape[1] - more - less
    u = (n_left / (n_left + n_right))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = np.minimum(_GRID[None, :], most)
    p, q = _p(u - v * j), _p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        like = same * np.log(np.maximum(1 - p - q, 1e-12)) + more * np.log(np.maximum(p, 1e-12)) + less * np.log(np.maximum(q, 1e-12))
    return j[np.arange(len(j)), np.argmax(like, axis=1)]


def at_least(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the estimate reaches a similarity that both sizes allow.

    The likelihood is concave, so its slope at the similarity tells on which side the estimate lies.
    """
    more = (left > right).sum(axis=1)
    less = (left < right).sum(axis=1)
    same = left.shape[1] - more - less
    u = n_left / (n_left + n_right)
    v = 1 - u
    c, x, y = (BASE - 1) / BASE, u - v * similarity, v - u * similarity
    p, q = np.maximum(_p(x), 1e-12), np.maximum(_p(y), 1e-12)
    dp, dq = v * c / ((1 - x * c) * np.log(BASE)), u * c / ((1 - y * c) * np.log(BASE))
    return same * (dp + dq) / np.maximum(1 - p - q, 1e-12) >= more * dp / p + less * dq / q
