"""Functions from value to value, for pixel tables as column expressions and for tile tables as NumPy kernels. NaN stays NaN
unless stated; comparisons of columns are guarded because Spark orders NaN above every number."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.errors import FrameError

Fn = Callable[[Column], Column]
Kernel = Callable[[np.ndarray], np.ndarray]


class Stage:
    """A column function with the same on arrays of doubles, which must not change its argument."""

    def __init__(self, column: Fn, kernel: Kernel):
        self.column, self.kernel = column, kernel

    def __call__(self, v: Column) -> Column:
        return self.column(v)


class Staged:
    """A function of several steps, each of which names its argument more than once.

    `pointwise` gives a pixel table a projection for each step, which Spark compiles apart, and runs the kernels of all steps
    over a tile table in one pass. Anywhere else the steps are bound one by one, so that the expression grows with the steps
    and not with their product."""

    def __init__(self, stages: Sequence[Fn]):
        self.stages = tuple(stages)

    def __call__(self, v: Column) -> Column:
        if len(self.stages) == 1:
            return self.stages[0](v)
        for stage in self.stages:
            v = F.get(F.transform(F.array(v), stage), F.lit(0))
        return v

    @property
    def kernels(self) -> list[Kernel] | None:
        """The kernels of all steps; None if one is a bare column function."""
        return [s.kernel for s in self.stages] if all(isinstance(s, Stage) for s in self.stages) else None


def chain(*fns: Fn) -> Staged:
    """Functions one after the other."""
    return Staged([s for f in fns for s in getattr(f, "stages", (f,))])


def plain(low: float | None, high: float | None) -> Kernel:
    """`limit` on arrays."""
    return lambda a: a if low is None and high is None else np.clip(a, low, high)


def limit(v: Column, low: float | None, high: float | None) -> Column:
    out = v
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(F.isnan(v), v).otherwise(out)


def invert(low: float = 0.0, high: float = 65535.0) -> Staged:
    ends = float(low) + float(high)
    return Staged([Stage(lambda v: F.lit(ends) - v, lambda a: ends - a)])


def clip(low: float | None = None, high: float | None = None) -> Staged:
    if low is not None and high is not None and low > high:
        raise FrameError(f"low {low} is above high {high}")
    return Staged([Stage(lambda v: v if low is None and high is None else limit(v, low, high), plain(low, high))])


def threshold(value: float = 0.0, keep: str = "above") -> Staged:
    """1 where kept (>= value, or < value for below), else 0; NaN is 0."""
    at, above = float(value), keep == "above"
    kept = lambda v: F.when(~F.isnan(v) & ((v >= F.lit(at)) if above else (v < F.lit(at))), F.lit(1.0))
    return Staged([Stage(lambda v: kept(v).otherwise(F.lit(0.0)), lambda a: (a >= at if above else a < at).astype(np.float64))])


def pchip(points: Sequence[Sequence[float]]) -> list[tuple[float, float, float, float, float]]:
    """Shape-preserving cubics: (x0, c0, c1, c2, c3) for each interval, in powers of x - x0."""
    x, y = [float(p[0]) for p in points], [float(p[1]) for p in points]
    h = [b - a for a, b in zip(x, x[1:], strict=False)]
    slope = [(b - a) / d for a, b, d in zip(y, y[1:], h, strict=False)]
    n = len(x)
    if n == 2:
        d = [slope[0]] * 2
    else:
        d = [0.0] * n
        for k in range(1, n - 1):
            if slope[k - 1] * slope[k] > 0:
                a, b = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
                d[k] = (a + b) / (a / slope[k - 1] + b / slope[k])

        def end(h0: float, h1: float, s0: float, s1: float) -> float:
            e = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
            if e * s0 <= 0:
                return 0.0
            return 3 * s0 if s0 * s1 <= 0 and abs(e) > 3 * abs(s0) else e

        d[0], d[-1] = end(h[0], h[1], slope[0], slope[1]), end(h[-1], h[-2], slope[-1], slope[-2])
    return [(x[k], y[k], d[k], (3 * slope[k] - 2 * d[k] - d[k + 1]) / h[k], (d[k] + d[k + 1] - 2 * slope[k]) / h[k] ** 2) for k in range(n - 1)]


def check_curve(curve: Sequence[Sequence[float]]) -> list[tuple[float, float]]:
    """Two or more [x, y] points in 0..1 with increasing x."""
    try:
        points = [(float(a), float(b)) for a, b in curve]
    except (TypeError, ValueError) as e:
        raise FrameError("a curve is a list of [x, y] points") from e
    if len(points) < 2 or any(not (0 <= a <= 1 and 0 <= b <= 1) for a, b in points):
        raise FrameError("a curve has two [x, y] points or more, all in 0 to 1")
    if any(b[0] <= a[0] for a, b in zip(points, points[1:], strict=False)):
        raise FrameError("a curve has increasing x")
    return points


def curve_value(curve: Sequence[Sequence[float]], at: float) -> float:
    """The curve at one point, on the driver."""
    points = check_curve(curve)
    if at <= points[0][0]:
        return points[0][1]
    if at >= points[-1][0]:
        return points[-1][1]
    x0, c0, c1, c2, c3 = pchip(points)[bisect_right([p[0] for p in points], at) - 1]
    t = at - x0
    return c0 + t * (c1 + t * (c2 + t * c3))


def curve_stage(curve: Sequence[Sequence[float]]) -> Stage:
    """The curve as a function, flat beyond its ends."""
    points = check_curve(curve)
    places, parts = np.array([p[0] for p in points]), np.array(pchip(points))

    def fn(v: Column) -> Column:
        out = F.when(F.isnan(v), v).when(v <= points[0][0], F.lit(points[0][1]))
        for (x0, c0, c1, c2, c3), (x1, _) in zip(pchip(points), points[1:], strict=True):
            t = v - F.lit(x0)
            out = out.when(v < F.lit(x1), F.lit(c0) + t * (F.lit(c1) + t * (F.lit(c2) + t * F.lit(c3))))
        return out.otherwise(F.lit(points[-1][1]))

    def kernel(a: np.ndarray) -> np.ndarray:
        # NaN and what lies beyond the ends takes the last part; both are put right below
        x0, c0, c1, c2, c3 = parts.T[:, np.clip(np.searchsorted(places, a, "right") - 1, 0, len(parts) - 1)]
        t = a - x0
        out = c0 + t * (c1 + t * (c2 + t * c3))
        return np.where(a <= places[0], points[0][1], np.where(a >= places[-1], points[-1][1], out))

    return Stage(fn, kernel)


def tone_map(
    exposure: float = 0.0, contrast: float = 0.0, highlights: float = 0.0, shadows: float = 0.0, whites: float = 0.0,
    blacks: float = 0.0, curve: Sequence[Sequence[float]] | None = None,
) -> Staged:
    """Tone sliders (-100 to 100; exposure in stops, -5 to 5) and a curve on values of 0..1; sliders at 0 add no step."""
    for name, x, most in (
        ("exposure", exposure, 5), ("contrast", contrast, 100), ("highlights", highlights, 100), ("shadows", shadows, 100),
        ("whites", whites, 100), ("blacks", blacks, 100),
    ):
        if not -most <= x <= most:
            raise FrameError(f"{name} is not in -{most} to {most}")
    straight = curve is None or [list(map(float, p)) for p in curve] == [[0.0, 0.0], [1.0, 1.0]]
    line = None if straight else curve_stage(curve)
    unit = Stage(lambda v: limit(v, 0, 1), plain(0.0, 1.0))
    gain, bend, steep = 2.0**exposure, 0.14 * 27 / 4, contrast / 100
    low, high, s, h = -0.25 * blacks / 100, 1 - 0.25 * whites / 100, shadows / 100, highlights / 100
    stages: list[Stage] = [Stage(lambda v: v * F.lit(gain), lambda a: a * gain)] if exposure else []
    stages.append(unit)
    if whites or blacks:
        span = high - low
        stages += [Stage(lambda v: (v - F.lit(low)) / F.lit(span), lambda a: (a - low) / span), unit]
    if shadows or highlights:
        lift = lambda v, s, h, bend: v + bend * v * (1 - v) * (s * (1 - v) + h * v)
        stages += [Stage(lambda v: lift(v, F.lit(s), F.lit(h), F.lit(bend)), lambda a: lift(a, s, h, bend)), unit]
    if contrast:
        push = lambda v, k: v + k * (v * v * (3 - 2 * v) - v)
        stages.append(Stage(lambda v: push(v, F.lit(steep)), lambda a: push(a, steep)))
    if line:
        stages.append(line)
    if line or contrast:
        stages.append(unit)
    return Staged(stages)


def tone(black: float = 0.0, white: float = 1.0, **sliders) -> Staged:
    """Tone mapping between a black and a white point, and back."""
    if white <= black:
        raise FrameError("the white point must be above the black point")
    span, start = float(white - black), float(black)
    to_unit = Stage(lambda v: (v - F.lit(start)) / F.lit(span), lambda a: (a - start) / span)
    back = Stage(lambda v: v * F.lit(span) + F.lit(start), lambda a: a * span + start)
    return chain(to_unit, tone_map(**sliders), back)


def to_uint8(low: float, high: float, tone_fn: Fn | None = None) -> Staged:
    """0..255 (half to even) of low..high; NaN, and everything of an empty span, is 0."""
    if high <= low:
        return Staged([Stage(lambda v: F.lit(0.0), np.zeros_like)])
    start, span = float(low), float(high - low)
    to_unit = Stage(lambda v: (v - F.lit(start)) / F.lit(span), lambda a: (a - start) / span)

    def level(v: Column) -> Column:
        return F.when(F.isnan(v), F.lit(0.0)).otherwise(F.rint(limit(v * 255.0, 0, 255)))

    last = Stage(level, lambda a: np.nan_to_num(np.rint(np.clip(a * 255.0, 0, 255)), copy=False, nan=0.0))
    return chain(to_unit, *([tone_fn] if tone_fn else []), last)


#: Least and largest value of integer types, and the exact range of the floating ones.
INTEGERS = {
    "uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767), "uint32": (0, 2**32 - 1),
    "int32": (-(2**31), 2**31 - 1), "uint64": (0, 2**64 - 1), "int64": (-(2**63), 2**63 - 1),
}
SPARK_TYPES = {
    "uint8": "smallint", "int8": "tinyint", "uint16": "int", "int16": "smallint", "uint32": "bigint", "int32": "int",
    "uint64": "decimal(20,0)", "int64": "bigint", "float32": "float", "float64": "double", "bool": "boolean",
}
ITEM_BYTES = {"uint8": 1, "int8": 1, "uint16": 2, "int16": 2, "uint32": 4, "int32": 4, "uint64": 8, "int64": 8, "float32": 4, "float64": 8, "bool": 1}


def holds(source: str, target: str) -> bool:
    """Whether every value of one pixel type is one of the other's."""
    if source == target:
        return True
    if target in ("float32", "float64"):
        bits = 24 if target == "float32" else 53
        if source in INTEGERS:
            low, high = INTEGERS[source]
            return high <= 2**bits and low >= -(2**bits)
        return source in ("bool", "float32")
    if source == "bool":
        return target in INTEGERS
    return source in INTEGERS and target in INTEGERS and INTEGERS[target][0] <= INTEGERS[source][0] and INTEGERS[source][1] <= INTEGERS[target][1]


class Cast:
    """A cast of values, or of whole arrays, to the Spark type that holds a pixel type."""

    def __init__(self, kind: str):
        self.kind = kind

    def __call__(self, v: Column) -> Column:
        return v.cast(self.kind)

    def of_array(self, pixels: Column) -> Column:
        return pixels.cast(f"array<{self.kind}>")


def cast_dtype(target: str) -> Cast:
    """Cast to the Spark type that holds a pixel type."""
    if target not in SPARK_TYPES:
        raise FrameError(f"{target} is not a pixel type")
    return Cast(SPARK_TYPES[target])
