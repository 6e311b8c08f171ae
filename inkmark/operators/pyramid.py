"""Oriented bands of a plane at falling scales: a steerable pyramid of directional derivatives of a radial bell.

Filters follow from a rule, none is a table. The fifth derivative of a Gaussian in any direction is a sum of products
of a derivative along x and one along y, so six orientations share one pass along the rows and one down the columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.functions.formulas import KEYS
from inkmark.operators.neighbourhood import along
from inkmark.sources.scratch import stored

#: Orientations are as many as the order of the derivative and one, evenly around a half turn; taps of the filters.
ORIENTATIONS, ORDER, FIRST_TAPS, LOW_TAPS, BAND_TAPS = 6, 5, 5, 9, 7
#: Spreads: the first low pass and that between scales halve what lies at three and at two quarters of the highest
#: frequency; bands pass most at half of it.
FIRST_SPREAD, LOW_SPREAD, BAND_SPREAD = (math.sqrt(2 * math.log(2)) / (0.75 * math.pi), math.sqrt(2 * math.log(2)) / (0.5 * math.pi), math.sqrt(ORDER) / (0.5 * math.pi))


def bell(size: int, spread: float, order: int = 0) -> list[float]:
    """Samples of the order-th derivative of exp(-t*t/2), t in spreads, from Hermite polynomials; order 0 sums to 1."""
    out = []
    for i in range(size):
        t = (i - size // 2) / spread
        before, now = 0.0, 1.0
        for k in range(order):
            before, now = now, t * now - k * before
        out.append((-1) ** order * now * math.exp(-t * t / 2))
    return [v / sum(out) for v in out] if order == 0 else out


def steering(k: int) -> list[float]:
    """What the i-th derivative along x and the rest along y weigh in orientation k."""
    angle = math.pi * k / ORIENTATIONS
    weights = [math.comb(ORDER, i) * math.cos(angle) ** i * math.sin(angle) ** (ORDER - i) for i in range(ORDER + 1)]
    return [0.0 if abs(w) < 1e-15 else w for w in weights]


def gain() -> float:
    """Makes the energies of all orientations add up to 1 at the frequency that the bands pass most, but for the few
    hundredths that the cut of the bell at seven taps adds."""
    across = sum(math.exp(-(((i - BAND_TAPS // 2) / BAND_SPREAD) ** 2) / 2) for i in range(BAND_TAPS))
    along_x = sum(v * math.sin(math.pi / 2 * (i - BAND_TAPS // 2)) for i, v in enumerate(bell(BAND_TAPS, BAND_SPREAD, ORDER)))
    total = sum(math.cos(math.pi * k / ORIENTATIONS) ** (2 * ORDER) for k in range(ORIENTATIONS))
    return 1 / (math.sqrt(total) * abs(across * along_x))


def kernel(k: int) -> list[list[float]]:
    """The filter of orientation k as rows; what the passes add up to."""
    plain = [math.exp(-(((i - BAND_TAPS // 2) / BAND_SPREAD) ** 2) / 2) for i in range(BAND_TAPS)]
    parts = [plain if i == 0 else bell(BAND_TAPS, BAND_SPREAD, i) for i in range(ORDER + 1)]
    s = steering(k)
    return [[gain() * sum(s[i] * parts[ORDER - i][y] * parts[i][x] for i in range(ORDER + 1)) for x in range(BAND_TAPS)] for y in range(BAND_TAPS)]


def oriented_subbands(plane: DataFrame, height: int = 4, orientations: tuple[int, ...] = tuple(range(ORIENTATIONS)), names: tuple[str, ...] = ("v",)) -> list[DataFrame]:
    """Scale by scale, finest first: (carrier_id, y, x, <name>_<orientation>...) of each named column of a plane.

    A scale is stored with the low pass that the next one starts from, so no scale is computed twice. Each has half
    the side of the one before, rounded up; edges are mirrored. A frame of any size has all scales.
    """
    first = bell(FIRST_TAPS, FIRST_SPREAD)
    low = along(along(plane, {c: [(c, first)] for c in names}, "x"), {c: [(c, first)] for c in names}, "y")
    plain = [math.exp(-(((i - BAND_TAPS // 2) / BAND_SPREAD) ** 2) / 2) for i in range(BAND_TAPS)]
    parts = [plain if i == 0 else bell(BAND_TAPS, BAND_SPREAD, i) for i in range(ORDER + 1)]
    used = sorted({i for k in orientations for i, w in enumerate(steering(k)) if w})
    smooth, factor, scales = bell(LOW_TAPS, LOW_SPREAD), gain(), []
    for scale in range(height):
        rows = {f"{c}__{i}": [(c, parts[i])] for c in names for i in used} | {f"{c}__low": [(c, smooth)] for c in names}
        columns = {f"{c}__{i}": [(f"{c}__{i}", parts[ORDER - i])] for c in names for i in used} | {f"{c}__low": [(f"{c}__low", smooth)] for c in names}
        both = along(along(low, rows, "x"), columns, "y")
        bands = [sum((F.lit(factor * w) * F.col(f"{c}__{i}") for i, w in enumerate(steering(k)) if w), F.lit(0.0)).alias(f"{c}_{k}") for c in names for k in orientations]
        both = stored(both.select(*KEYS, *bands, *[F.col(f"{c}__low") for c in names]), f"scale{scale}")
        scales.append(both.select(*KEYS, *[f"{c}_{k}" for c in names for k in orientations]))
        low = both.where("y % 2 = 0 and x % 2 = 0").select("carrier_id", F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x"), *[F.col(f"{c}__low").alias(c) for c in names])
    return scales


def long_subbands(scales: list[DataFrame], orientations: tuple[int, ...] = tuple(range(ORIENTATIONS)), names: tuple[str, ...] = ("v",)) -> DataFrame:
    """(carrier_id, scale, orientation, y, x, <name>...): a row for each band."""
    each = ", ".join(f"{k}, " + ", ".join(f"{c}_{k}" for c in names) for k in orientations)
    out = [s.select(*KEYS, F.lit(i).alias("scale"), F.expr(f"stack({len(orientations)}, {each}) as (orientation, {', '.join(names)})")) for i, s in enumerate(scales)]
    whole = out[0]
    for s in out[1:]:
        whole = whole.unionByName(s)
    return whole.select("carrier_id", "scale", "orientation", "y", "x", *names)
