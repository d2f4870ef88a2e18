"""Descriptors of pitch-class sequences: moments, key, patches, windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from cohortia.functions.arrays import roll

#: How well each pitch class fits a major and a minor key, from the tonic up.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def pitch_class_moments(frames: DataFrame, key: str, pc: str) -> DataFrame:
    """(key, moments): the 12 means and the 78 means of products, of i with j from i on, over a key's frames.

    All are sums of one pass over the frames, which are not listed by element.
    """
    x = [F.col(pc)[i].cast("double") for i in range(12)]
    sums = [F.avg(v) for v in x] + [F.avg(x[i] * x[j]) for i in range(12) for j in range(i, 12)]
    return frames.groupBy(key).agg(F.array(*sums).alias("moments"))


def _correlation(a: Column, b: Column) -> Column:
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    times = lambda x, y: F.zip_with(x, y, lambda p, q: p * q)
    n = 12.0
    cov = total(times(a, b)) - total(a) * total(b) / n
    va, vb = total(times(a, a)) - total(a) * total(a) / n, total(times(b, b)) - total(b) * total(b) / n
    return F.when((va > 1e-12) & (vb > 1e-12), cov / F.sqrt(va * vb))


def key_of(profile: Column) -> Column:
    """(tonic, minor) of a mean pitch-class profile: the best of 24 rotated key profiles, the first of equals.

    A profile without variance is (0, major).
    """
    rolled = lambda shape, k: F.array(*[F.lit(float(x)) for x in (*shape[12 - k :], *shape[: 12 - k])])
    shapes = F.array(*[F.struct(rolled(s, k).alias("w"), F.lit(-m).alias("m"), F.lit(-k).alias("k")) for m, s in enumerate((MAJOR, MINOR)) for k in range(12)])
    fits = F.transform(shapes, lambda s: F.struct(F.coalesce(F.round(_correlation(profile, s["w"]), 9), F.lit(0.0)).alias("fit"), s["m"].alias("m"), s["k"].alias("k")))
    # The best fit; of equals the major, then the lowest tonic, as both are negated.
    best = F.transform(F.array(F.array_max(fits)), lambda b: F.struct((-b["k"]).cast("int").alias("tonic"), (b["m"] != 0).alias("minor")))
    return best[0]


def to_tonic(v: Column, tonic: Column) -> Column:
    """Pitch classes rotated so that the tonic comes first."""
    return roll(v, -tonic)


def patch_magnitudes(x: np.ndarray, length: int = 16) -> np.ndarray:
    """Medians over sliding patches of `length` frames of their 2-D Fourier magnitudes; short sequences are tiled."""
    if len(x) < length:
        x = np.tile(x, (-(-length // len(x)), 1))[:length]
    patches = np.lib.stride_tricks.sliding_window_view(x, length, axis=0)
    return np.median(np.abs(np.fft.fft2(patches)), axis=0)


def window_moments(x: np.ndarray) -> np.ndarray:
    """What `pitch_class_moments` gives, for the frames (rows) of one window."""
    return np.concatenate([x.mean(0), (x.T @ x / len(x))[np.triu_indices(x.shape[1])]])


def _expect(given: dict[str, tuple[AnalyzeArgument, type]]) -> None:
    for name, (argument, kind) in given.items():
        if not isinstance(argument.dataType, (kind, NullType)):
            raise ValueError(f"{name} is {argument.dataType.simpleString()}, not {kind.typeName()}")


class WindowTable:
    """Table function: the windows of `seconds`, `hop` apart, that fit into a recording; none for a null duration."""

    @staticmethod
    def analyze(duration: AnalyzeArgument, seconds: AnalyzeArgument, hop: AnalyzeArgument) -> AnalyzeResult:
        _expect({"duration": (duration, DoubleType), "seconds": (seconds, DoubleType), "hop": (hop, DoubleType)})
        if hop.value is not None and not hop.value > 0:
            raise ValueError("hop must be above 0")
        return AnalyzeResult(StructType().add("slot", LongType()).add("start", DoubleType()))

    def eval(self, duration, seconds, hop):
        if duration is not None and duration >= seconds:
            for k in range(int((duration - seconds) // hop) + 1):
                yield k, k * hop


class DescribedWindows:
    """Table function: one track in, a row for each window out; a bad track gives one row with an error.

    A window [start, start + seconds) with `least` frames or more is ok and has the moments of its
    pitch classes (90), the same with the tonic first and the mode last (91), and half of its patches'
    spectrum (12 * (patch / 2 + 1)); the others have none.
    """

    @staticmethod
    def analyze(times: AnalyzeArgument, frames: AnalyzeArgument, starts: AnalyzeArgument, tonic: AnalyzeArgument, minor: AnalyzeArgument, seconds: AnalyzeArgument, patch: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        _expect({"times": (times, ArrayType), "frames": (frames, ArrayType), "starts": (starts, ArrayType), "tonic": (tonic, IntegerType), "minor": (minor, BooleanType)})
        if patch.value is not None and patch.value < 2:
            raise ValueError("a patch has 2 frames or more")
        values = ArrayType(DoubleType())
        out = StructType().add("start", DoubleType()).add("ok", BooleanType()).add("n", LongType())
        return AnalyzeResult(out.add("absolute", values).add("relative", values).add("spectrum", values).add("error", StringType()))

    def eval(self, times, frames, starts, tonic, minor, seconds, patch, least):
        rows = []
        try:
            t, x = np.asarray(times, np.float64), np.asarray(frames, np.float64).reshape(len(times), 12)
            for start in starts:
                inside = x[(t >= start) & (t < start + seconds)]
                if len(inside) < least:
                    rows.append((start, False, len(inside), None, None, None, None))
                    continue
                rolled = np.roll(inside, -tonic, axis=1)
                half = patch_magnitudes(inside, patch)[:, : patch // 2 + 1]
                rows.append((start, True, len(inside), window_moments(inside).tolist(), [*window_moments(rolled).tolist(), float(minor)], half.ravel().tolist(), None))
        except (ValueError, TypeError) as e:
            rows = [(None, False, 0, None, None, None, f"{type(e).__name__}: {e}")]
        yield from rows


def described_windows(tracks: DataFrame, seconds: float, patch: int = 16, least: int = 4) -> DataFrame:
    """`tracks` (times, frames, starts, tonic, minor, ...) beside the windows that `DescribedWindows` makes of each."""
    given = [F.col(c).outer() for c in ("times", "frames", "starts", "tonic", "minor")]
    return tracks.lateralJoin(F.udtf(DescribedWindows)(*given, F.lit(float(seconds)), F.lit(patch), F.lit(least)))


def window_table(recordings: DataFrame, duration: str, seconds: float, hop: float) -> DataFrame:
    """`recordings` beside the slots and starts of their windows."""
    return recordings.lateralJoin(F.udtf(WindowTable)(F.col(duration).outer(), F.lit(float(seconds)), F.lit(float(hop))))


def hop_starts(times: Column, window: float, hop: float) -> Column:
    """Starts from 0 in steps of `hop`, until the last window reaches past the last of `times`; at least one."""
    until = F.greatest(F.lit(float(hop)), F.array_max(times) - window + hop)
    return F.transform(F.sequence(F.lit(0), F.ceil(until / hop).cast("int") - 1), lambda k: k * F.lit(float(hop)))
