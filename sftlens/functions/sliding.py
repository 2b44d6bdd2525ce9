"""Sums, means and slopes over trailing windows of an array, at constant cost per value.

The array is cut into blocks as long as the window. A window is the end of one block and
the start of the next, so two running sums inside blocks give its sum: nothing is ever
subtracted that lies outside the window, and one huge value does not blur later windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Windows:
    """For the window that ends at each value: its length, how many of its values are not
    finite, the sum of the others, and that sum with every value times its place from 0 on.

    Sums are taken of differences to ``offset``, so that slopes of values far from zero keep
    their digits.
    """

    count: np.ndarray
    bad: np.ndarray
    total: np.ndarray
    weighted: np.ndarray
    offset: float

    def means(self) -> np.ndarray:
        """NaN where a value is not finite."""
        return np.where(self.bad == 0, self.total / self.count + self.offset, np.nan)

    def slopes(self) -> np.ndarray:
        """Least-squares slopes against the place; NaN where a value is not finite."""
        n = self.count.astype(float)
        around = self.weighted - (n - 1) / 2 * self.total
        spread = n * (n * n - 1) / 12
        slope = np.divide(around, spread, out=np.zeros(len(n)), where=spread > 0)
        return np.where(self.bad == 0, slope, np.nan)


def _two_sums(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from the start of each block, and from each value to its block's end."""
    blocks = np.zeros(-(-len(values) // width) * width)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    upward, downward = np.cumsum(blocks, axis=1), np.cumsum(blocks[:, ::-1], axis=1)[:, ::-1]
    return upward.ravel()[: len(values)], downward.ravel()[: len(values)]


def _coarse(value: float) -> float:
    """The value's first 24 bits: multiples of it are exact, so windows of zeros have sum and mean zero."""
    fraction, exponent = np.frexp(value)
    return float(np.ldexp(np.trunc(np.ldexp(fraction, 24)), exponent - 24))


def trailing_windows(values: np.ndarray, width: int) -> Windows:
    """Windows of up to ``width`` values; the first ones are shorter."""
    n = len(values)
    finite = np.isfinite(values)
    at = np.arange(n)
    place = at % width
    count = np.minimum(at + 1, width)
    bad_from, bad_to = _two_sums(~finite, width)
    offset = _coarse(float(np.median(values[finite]))) if finite.any() else 0.0
    shifted = np.where(finite, values - offset, 0.0)
    sum_from, sum_to = _two_sums(shifted, width)
    by_place_from, by_place_to = _two_sums(shifted * place, width)
    # Windows that begin in the block before, at ``begin``.
    split = (at >= width) & (place < width - 1)
    begin = np.where(split, at - width + 1, 0)
    first = begin % width
    bad = bad_from + np.where(split, bad_to[begin], 0)
    total = sum_from + np.where(split, sum_to[begin], 0.0)
    weighted = by_place_from + np.where(
        split, (by_place_to[begin] - first * sum_to[begin]) + (width - first) * sum_from, 0.0
    )
    return Windows(count, bad.astype(int), total, weighted, offset)
