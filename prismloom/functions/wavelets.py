"""The matrix of a one-dimensional wavelet transform, with the rules of what stands beyond its ends, and undecimated filtering."""

from __future__ import annotations

import numpy as np

from prismloom.functions.filters import filter_bank

MODES = ("symmetric", "reflect", "periodic", "zero", "constant", "antisymmetric", "smooth", "antireflect", "periodization")


def most_levels(n: int, taps: int) -> int:
    return max(0, int(np.floor(np.log2(n / (taps - 1))))) if taps > 1 and n >= taps - 1 else 0


def _shown(at: int, n: int, mode: str) -> list[tuple[int, float]]:
    """The samples that a place beyond the ends is made of, and their factors."""
    if 0 <= at < n:
        return [(at, 1.0)]
    if mode == "zero":
        return []
    if mode == "constant" or n == 1 and mode in ("smooth", "antireflect", "reflect"):
        return [(0 if at < 0 else n - 1, 1.0)]
    if mode == "periodic":
        return [(at % n, 1.0)]
    if mode == "periodization":  # an odd number of samples is made even by its last one
        return [(min(at % (n + n % 2), n - 1), 1.0)]
    if mode == "smooth":  # a line through the two samples at the end
        end, next, far = (0, 1, -at) if at < 0 else (n - 1, n - 2, at - n + 1)
        return [(end, 1.0 + far), (next, -float(far))]
    if mode in ("reflect", "antireflect"):
        turns, m = divmod(at, 2 * (n - 1))
        back = m >= n
        own = 2 * (n - 1) - m if back else m
        if mode == "reflect":
            return [(own, 1.0)]
        # Odd about both ends: every period rises by twice the difference of the ends.
        rise = [(n - 1, 2.0 * turns), (0, -2.0 * turns)]
        return [*rise, (n - 1, 2.0), (own, -1.0)] if back else [*rise, (own, 1.0)]
    m = at % (2 * n)
    turned = m >= n
    return [(2 * n - 1 - m if turned else m, -1.0 if turned and mode == "antisymmetric" else 1.0)]


def step_matrices(n: int, wavelet: str, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """One level: approximation and detail of n samples, floor((n + taps - 1) / 2) each, or by periodization ceil(n / 2)."""
    bank = filter_bank(wavelet)
    taps = len(bank)
    size, first = (-(-n // 2), taps // 2) if mode == "periodization" else ((n + taps - 1) // 2, 1)
    out = np.zeros((2, size, n))
    for k in range(size):
        for j in range(taps):
            for at, factor in _shown(2 * k + first - j, n, mode):
                out[0, k, at] += factor * bank.low[j]
                out[1, k, at] += factor * bank.high[j]
    return out[0], out[1]


def transform_matrix(n: int, wavelet: str, mode: str, levels: int) -> np.ndarray:
    """The whole transform as a matrix: rows for the last approximation, then details from the last level to the first."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    approximation, details = np.eye(n), []
    for _ in range(levels):
        low, high = step_matrices(len(approximation), wavelet, mode)
        details.append(high @ approximation)
        approximation = low @ approximation
    return np.vstack([approximation, *details[::-1]])


def stationary_reach(wavelet: str, levels: int) -> int:
    """How far from a place the undecimated transform looks."""
    taps = len(filter_bank(wavelet))
    return sum(max(taps // 2, taps - 1 - taps // 2) << level for level in range(levels))


def along(values: np.ndarray, taps: np.ndarray, spacing: int, axis: int) -> np.ndarray:
    """Undecimated filtering along an axis; what comes around the end is right only within a halo or a period."""
    start = (len(taps) // 2) * spacing
    return sum(t * np.roll(values, j * spacing - start, axis=axis) for j, t in enumerate(taps))
