"""Functions over array columns: bins, probabilities, potentials."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def rolled(a: Column, by: int = 1) -> Column:
    """Circular shift to the right."""
    n = F.size(a)
    return F.when(n == 0, a).otherwise(F.concat(F.slice(a, -by, by), F.slice(a, 1, n - by)))


def padded_circle(a: Column, width: int = 2) -> Column:
    """The last width values, all, the first width."""
    return F.concat(F.slice(a, -width, width), a, F.slice(a, 1, width))


def padded_mirror(a: Column, width: int = 2) -> Column:
    """The first width values reversed, all, the last width reversed."""
    return F.concat(F.reverse(F.slice(a, 1, width)), a, F.reverse(F.slice(a, -width, width)))


def mass(a: Column, first: int, last: int | None = None) -> Column:
    """Sum of the values from 0-based place first up to, not including, last."""
    count = F.size(a) - first if last is None else F.lit(last - first)
    return total(F.slice(a, F.lit(first + 1), count))


def digitized(value: Column, low: float, high: float, bins: int) -> Column:
    """0 below low, then 1 to bins, bins + 1 from high on."""
    return F.width_bucket(value.cast("double"), F.lit(low), F.lit(high), F.lit(bins)).cast("int")


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    raised = F.transform(a, lambda x: F.exp((x - top).cast("double")))
    return F.transform(raised, lambda x: x / total(raised))


def symmetrised(value: Column, mirrored: Column) -> Column:
    return (value + mirrored) / 2


def asinh_clamped(value: Column, cutoff: float, scale: float) -> Column:
    return F.asinh(F.greatest(value, F.lit(cutoff)) - cutoff) / scale


def separation(i: Column, j: Column) -> Column:
    """|i - j| / 100 - 1."""
    return F.abs(i - j) / 100.0 - 1


def log_separation(i: Column, j: Column) -> Column:
    return F.log(F.abs(i - j) + 1.0)


def distance_potential(probs: Column, bins: list[float], meff: float = 1e-4, ebase: float = -0.5, alpha: float = 1.57) -> Column:
    """-ln((p + meff) / (p_last * background)) + ebase for each bin's middle; background (d / d_last) ** alpha."""
    background = [(b / bins[-1]) ** alpha for b in bins]
    grounds = F.array(*[F.lit(b) for b in background])
    last = F.element_at(probs, -1)
    return F.zip_with(probs, grounds, lambda p, g: -F.log((p + meff) / ((last + meff) * g)) + ebase)


def angle_potential(probs: Column, meff: float = 1e-4) -> Column:
    last = F.element_at(probs, -1)
    return F.transform(probs, lambda p: -F.log((p + meff) / (last + meff)))


def lddt_share(histogram: Column) -> Column:
    """Share of distances within 0.5, 1, 2 and 4 A, of a 15-bin error histogram around bin 7."""
    p = [F.get(histogram, i) for i in range(15)]
    inner = p[7]
    rings = [p[6] + p[8], p[5] + p[9], p[4] + p[10]]
    return (4 * inner + 3 * rings[0] + 2 * rings[1] + rings[2]) / 4


def collapsed(a: Column, groups: list[list[int]]) -> Column:
    """Sums of the values at each group's 0-based places."""
    return F.array(*[sum((F.get(a, i) for i in g[1:]), F.get(a, g[0])) for g in groups])


def savitzky_golay(a: Column) -> Column:
    """Window of 7, cubic; the three values at either end come from the cubic fit of the nearest seven."""
    centre = [-2 / 21, 3 / 21, 6 / 21, 7 / 21, 6 / 21, 3 / 21, -2 / 21]
    ends = _cubic_ends()
    n = F.size(a)

    def weighed(weights: list[float], start: Column) -> Column:
        return sum((F.get(a, start + k) * w for k, w in enumerate(weights[1:], 1)), F.get(a, start) * weights[0])

    def at(x: Column, i: Column) -> Column:
        value = weighed(centre, i - 3)
        for k in range(3):
            value = F.when(i == k, weighed(ends[k], F.lit(0))).when(i == n - 1 - k, weighed(ends[k][::-1], n - 7)).otherwise(value)
        return value

    return F.when(n >= 7, F.transform(a, at))


def _cubic_ends() -> list[list[float]]:
    """Weights by which seven equidistant values give the cubic fit at the first three of them."""
    import numpy as np

    x = np.arange(7) - 3
    design = np.vander(x, 4)
    hat = design @ np.linalg.pinv(design)
    return hat[:3].tolist()


def hanning_weights(size: int = 13) -> list[float]:
    """Normalised, ends included as zero-free taps."""
    raw = [0.5 - 0.5 * math.cos(2 * math.pi * i / (size - 1)) for i in range(size)]
    return [w / sum(raw) for w in raw]


def band_masked(i: Column, j: Column, value: Column, width: int = 8) -> Column:
    """0 for pairs nearer than width along the chain."""
    return F.when(F.abs(i - j) < width, F.lit(0.0)).otherwise(value)


def pyramid_weight(a: Column, b: Column, first: Column | int, second: Column | int) -> Column:
    """Weight of a place (a, b) of two windows of the given lengths laid end to end: the lesser distance to its window's edge, plus 1, at most a third of the shorter window."""
    first, second = (x if isinstance(x, Column) else F.lit(x) for x in (first, second))

    def depth(x: Column) -> Column:
        inner = F.when(x < first, F.least(x, first - 1 - x)).otherwise(F.least(x - first, first + second - 1 - x))
        return inner + 1

    return F.least(depth(a), depth(b), F.floor(F.least(first, second) / 3)).cast("int")
