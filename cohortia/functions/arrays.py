"""Vectors and sequences in array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortia.functions.hashing import uniform


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, eps: float = 1e-12) -> Column:
    """L2-normalised, the norm floored at `eps`."""
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(F.greatest(norm(v), F.lit(eps)), F.size(v)).alias("n")), lambda s: s["x"] / s["n"])


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def centred(v: Column) -> Column:
    return F.zip_with(v, F.array_repeat(mean(v), F.size(v)), lambda x, m: x - m)


def softmax(v: Column) -> Column:
    """Shifted by the maximum before exponents."""
    e = F.zip_with(v, F.array_repeat(F.array_max(v), F.size(v)), lambda x, m: F.exp(x - m))
    return F.zip_with(e, F.array_repeat(total(e), F.size(v)), lambda x, s: x / s)


def mixed(layers: Column, weights: Column) -> Column:
    """Weighted sum of an array of equally long vectors."""
    scaled = F.zip_with(layers, weights, lambda v, w: F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(w, F.size(v)).alias("w")), lambda s: s["x"] * s["w"]))
    return F.aggregate(F.slice(scaled, F.lit(2), F.size(scaled) - 1), scaled[0], lambda a, v: F.zip_with(a, v, lambda x, y: x + y))


def standardised(v: Column, mu: Column, sd: Column) -> Column:
    return F.zip_with(F.zip_with(v, mu, lambda x, m: x - m), sd, lambda x, s: x / s)


def restored(z: Column, mu: Column, sd: Column) -> Column:
    return F.zip_with(F.zip_with(z, sd, lambda x, s: x * s), mu, lambda x, m: x + m)


def roll(v: Column, k: Column) -> Column:
    """The last `k` entries come first."""
    n = F.size(v)
    k = F.pmod(k, n)
    return F.concat(F.slice(v, n - k + 1, k), F.slice(v, F.lit(1), n - k))


def best_shift(a: Column, b: Column) -> Column:
    """The shift of `b`, from 0, whose dot product with `a` is largest, the first of equals."""
    dots = F.transform(F.sequence(F.lit(0), F.size(b) - 1), lambda k: dot(a, roll(b, k)))
    return (F.array_position(dots, F.array_max(dots)) - 1).cast("int")


def pooled(v: Column, factor: int) -> Column:
    """Means of each `factor` consecutive entries; what is left over is dropped."""
    n = F.floor(F.size(v) / factor).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: total(F.slice(v, i * factor + 1, F.lit(factor))) / factor)).otherwise(F.expr("cast(array() as array<double>)"))


def band_energy(v: Column, bands: int) -> Column:
    """Sums of squares in `bands` consecutive slices of equal length; the last takes what is left over."""
    width = F.floor(F.size(v) / bands).cast("int")
    length = lambda i: F.when(i == bands - 1, F.size(v) - (bands - 1) * width).otherwise(width)
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.aggregate(F.slice(v, i * width + 1, length(i)), F.lit(0.0), lambda a, x: a + x * x))


def log_ratios(v: Column) -> Column:
    """Centred log-ratio of positive entries."""
    return centred(F.transform(v, lambda x: F.ln(x)))


def centre_starts(duration: Column, window: Column, k: int) -> Column:
    """`k` window starts in the middles of equal slices, to the millisecond; null if too short."""
    span = duration - window
    return F.when(span >= 0, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(span * (i + 0.5) / k, 3)))


def even_positions(n: Column, k: int) -> Column:
    """At most `k` positions of 0..n-1, evenly spaced, rounded half to even, without repeats."""
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround((n - 1) * i / max(1, k - 1)).cast("int"))
    return F.when(n <= k, F.sequence(F.lit(0), n - 1)).otherwise(F.array_distinct(at))


def clamped_start(centre: Column, window: Column | float, duration: Column) -> Column:
    """Start of a window around `centre` that stays inside [0, duration]."""
    window = F.lit(window) if isinstance(window, (int, float)) else window
    return F.least(F.greatest(centre - window / 2, F.lit(0.0)), F.greatest(duration - window, F.lit(0.0)))


def jittered(centre: Column, n: int, spread: float, *seed: Column | str) -> Column:
    """`n` candidate centres: the centre itself, then draws within `spread` to either side, from the seed's text."""
    draws = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: centre + (2 * uniform(*seed, k) - 1) * spread) if n > 1 else F.array().cast("array<double>")
    return F.concat(F.array(centre), draws)


def frame_count(samples: Column, strides: list[int], kernels: list[int]) -> Column:
    """Frames of a stack of strided convolutions: (samples - field) div hop + 1, or 0."""
    hop, field = 1, 1
    for stride, kernel in zip(strides, kernels):
        field += (kernel - 1) * hop
        hop *= stride
    return F.when(samples < field, F.lit(0).cast("bigint")).otherwise(F.floor((samples - field) / hop) + 1)


def entropy(w: Column) -> Column:
    return -total(F.transform(w, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution, by its series of odd powers over double factorials; 0 or 1 beyond 8 deviations."""
    def grown(acc: Column, k: Column) -> Column:
        term = acc["t"] * acc["x2"] / (2 * k + 1)
        return F.struct(acc["x2"].alias("x2"), term.alias("t"), (acc["s"] + term).alias("s"))

    near = F.greatest(F.least(x, F.lit(8.0)), F.lit(-8.0))
    start = F.struct((near * near).alias("x2"), near.alias("t"), near.alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(150)), start, grown, lambda acc: 0.5 + acc["s"] * F.exp(-acc["x2"] / 2) / math.sqrt(2 * math.pi))
    return F.when(x > 8, F.lit(1.0)).when(x < -8, F.lit(0.0)).otherwise(series)


def below(marks: Column, n: int, x: Column, equal: bool = False) -> Column:
    """How many of n sorted marks are less than x (or equal to it, too), by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))])

    def go(low: Column, step: Column) -> Column:
        mark = F.get(marks, low + step - 1)
        return F.when(F.coalesce(mark <= x if equal else mark < x, F.lit(False)), low + step).otherwise(low)

    return F.aggregate(steps, F.lit(0), go)
