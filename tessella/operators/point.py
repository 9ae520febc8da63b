"""Operators on single samples: projections over the arrays of a row."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.clip import Clip, by_plane, chosen, joined, mapped, same_format
from tessella.functions.rpn import compiled
from tessella.info import FLOAT, INTEGER, VideoFormat, need
from tessella.registry import operator


def each(make: Callable[[Column], Column], data: str = "data") -> Column:
    return F.transform(data, make)


def level(x: float) -> int:
    """A number given for an integer sample, rounded half up."""
    return math.floor(x + 0.5)


def stored(value: Column, fmt: VideoFormat) -> Column:
    """A float32 result as a sample: clamped and rounded half to even for integers."""
    if fmt.is_float:
        return value.cast("float")
    top = F.lit(float(fmt.top)).cast("float")
    return F.rint(F.when(value > top, top).when(value >= 0, value).otherwise(F.lit(0).cast("float"))).cast("int")


def spread(values: list | None, planes: int, default: Callable[[int], float]) -> list[float]:
    """A value per plane: the last one given is for the rest; without any, the defaults."""
    if not values:
        return [default(p) for p in range(planes)]
    need(len(values) <= planes, "more values than planes")
    return [values[min(p, len(values) - 1)] for p in range(planes)]


def _inverted(clip: Clip, planes: list[int] | None, mask: bool) -> Clip:
    fmt = clip.info.format
    top = int(fmt.top) if not fmt.is_float else None

    def make(p: int) -> Column:
        if not fmt.is_float:
            return each(lambda v: top - F.least(v, F.lit(top)))
        return each(lambda v: -v if fmt.chroma(p) and not mask else (1 - v).cast("float"))

    return mapped(clip, chosen(clip.info, planes, "Invert"), make)


@operator("std", "Invert", "clip:clip planes:int[]?")
def invert(clip: Clip, planes=None) -> Clip:
    return _inverted(clip, planes, False)


@operator("std", "InvertMask", "clip:clip planes:int[]?")
def invert_mask(clip: Clip, planes=None) -> Clip:
    return _inverted(clip, planes, True)


@operator("std", "Limiter", "clip:clip min:float[]? max:float[]? planes:int[]?")
def limiter(clip: Clip, min=None, max=None, planes=None) -> Clip:
    fmt = clip.info.format
    low, high = spread(min, fmt.planes, fmt.low), spread(max, fmt.planes, fmt.high)
    if not fmt.is_float:
        low, high = list(map(level, low)), list(map(level, high))
    need(all(a <= b for a, b in zip(low, high, strict=True)), "Limiter: a minimum above its maximum")
    kind = "float" if fmt.is_float else "int"
    return mapped(clip, chosen(clip.info, planes, "Limiter"), lambda p: each(lambda v: F.least(F.greatest(v, F.lit(low[p]).cast(kind)), F.lit(high[p]).cast(kind))))


def _two_valued(clip: Clip, threshold, v0, v1, planes, mask: bool) -> Clip:
    fmt = clip.info.format
    plain = lambda p: mask or not fmt.chroma(p)
    half = (lambda p: 0.5 if plain(p) else 0.0) if fmt.is_float else (lambda p: (1 << fmt.bits) // 2)
    at = spread(threshold, fmt.planes, half)
    low = spread(v0, fmt.planes, lambda p: 0 if plain(p) else fmt.low(p))
    high = spread(v1, fmt.planes, lambda p: fmt.top if plain(p) else fmt.high(p))
    if not fmt.is_float:
        at, low, high = (list(map(level, x)) for x in (at, low, high))
    kind = "float" if fmt.is_float else "int"
    return mapped(clip, chosen(clip.info, planes, "Binarize"), lambda p: each(lambda v: F.when(v < F.lit(at[p]).cast(kind), F.lit(low[p]).cast(kind)).otherwise(F.lit(high[p]).cast(kind))))


@operator("std", "Binarize", "clip:clip threshold:float[]? v0:float[]? v1:float[]? planes:int[]?")
def binarize(clip: Clip, threshold=None, v0=None, v1=None, planes=None) -> Clip:
    return _two_valued(clip, threshold, v0, v1, planes, False)


@operator("std", "BinarizeMask", "clip:clip threshold:float[]? v0:float[]? v1:float[]? planes:int[]?")
def binarize_mask(clip: Clip, threshold=None, v0=None, v1=None, planes=None) -> Clip:
    return _two_valued(clip, threshold, v0, v1, planes, True)


@operator("std", "Levels", "clip:clip min_in:float[]? max_in:float[]? gamma:float[]? min_out:float[]? max_out:float[]? planes:int[]?")
def levels(clip: Clip, min_in=None, max_in=None, gamma=None, min_out=None, max_out=None, planes=None) -> Clip:
    fmt = clip.info.format
    n = fmt.planes
    a, b = spread(min_in, n, lambda p: 0), spread(max_in, n, lambda p: fmt.top)
    c, d = spread(min_out, n, lambda p: 0), spread(max_out, n, lambda p: fmt.top)
    g = spread(gamma, n, lambda p: 1.0)
    if not fmt.is_float:
        a, b, c, d = (list(map(level, x)) for x in (a, b, c, d))
    need(all(x < y for x, y in zip(a, b, strict=True)), "Levels: max_in must be above min_in")
    need(all(x > 0 for x in g), "Levels: gamma must be positive")

    def make(p: int) -> Column:
        def out(v: Column) -> Column:
            x = F.greatest(F.least(v, F.lit(b[p]).cast(kind)) - F.lit(a[p]).cast(kind), F.lit(0).cast(kind)).cast("double") / (b[p] - a[p])
            y = (x if g[p] == 1 else F.pow(x, F.lit(1 / g[p]))) * (d[p] - c[p]) + c[p]
            return y.cast("float") if fmt.is_float else F.floor(F.least(F.greatest(y, F.lit(0.0)), F.lit(float(fmt.top))) + 0.5).cast("int")

        return each(out)

    kind = "float" if fmt.is_float else "int"
    return mapped(clip, chosen(clip.info, planes, "Levels"), make)


def _out_format(fmt: VideoFormat, bits: int | None, floatout: int | None, name: str) -> VideoFormat:
    if floatout:
        return VideoFormat(fmt.family, FLOAT, 32, fmt.ss_w, fmt.ss_h)
    bits = bits or fmt.bits
    need(8 <= bits <= 16, f"{name}: bits is 8 to 16")
    return VideoFormat(fmt.family, INTEGER, bits, fmt.ss_w, fmt.ss_h)


def _table(lut, lutf, values: list, out: VideoFormat, floatout, name: str) -> list:
    """A table's entries, checked."""
    need(sum(x is not None for x in (lut, lutf, values)) == 1, f"{name}: give one of lut, lutf and function")
    table = lut if lut is not None else lutf if lutf is not None else values
    if floatout:
        need(lut is None and all(isinstance(x, (int, float)) for x in table), f"{name}: floatout needs float values")
    else:
        need(lutf is None and all(isinstance(x, int) for x in table), f"{name}: integer values are needed")
        need(all(0 <= x <= out.top for x in table), f"{name}: a value out of range")
    return table


@operator("std", "Lut", "clip:clip planes:int[]? lut:int[]? lutf:float[]? function:func? bits:int? floatout:int?")
def lut(clip: Clip, planes=None, lut=None, lutf=None, function=None, bits=None, floatout=None) -> Clip:
    fmt = clip.info.format
    need(not fmt.is_float and fmt.bits <= 16, "Lut: integer input of up to 16 bits")
    out = _out_format(fmt, bits, floatout, "Lut")
    table = _table(lut, lutf, [function(x) for x in range(1 << fmt.bits)] if function else None, out, floatout, "Lut")
    need(len(table) == 1 << fmt.bits, f"Lut: the table needs {1 << fmt.bits} entries")
    kind = "float" if floatout else "int"
    at = clip.spark.range(1).select(F.lit(table).cast(f"array<{kind}>").alias("table"))  # up to 2^16 entries
    use = chosen(clip.info, planes, "Lut")
    data = by_plane(clip.info, lambda p: each(lambda v: F.get("table", F.least(v, F.lit(int(fmt.top))))) if p in use else F.col("data").cast(f"array<{kind}>"))
    return clip.but(clip.info.but(format=out), clip.frames.crossJoin(F.broadcast(at)).select("n", "plane", data.alias("data")))


@operator("std", "Lut2", "clipa:clip clipb:clip planes:int[]? lut:int[]? lutf:float[]? function:func? bits:int? floatout:int?")
def lut2(clipa: Clip, clipb: Clip, planes=None, lut=None, lutf=None, function=None, bits=None, floatout=None) -> Clip:
    fa, fb = clipa.info.format, clipb.info.format
    same_format([clipa, clipb], "Lut2", depth=False)
    need(not fa.is_float and not fb.is_float and fa.bits + fb.bits <= 20, "Lut2: integer inputs of up to 20 bits together")
    out = _out_format(fa, bits, floatout, "Lut2")
    values = [function(x, y) for y in range(1 << fb.bits) for x in range(1 << fa.bits)] if function else None
    table = _table(lut, lutf, values, out, floatout, "Lut2")
    need(len(table) == 1 << fa.bits + fb.bits, f"Lut2: the table needs {1 << fa.bits + fb.bits} entries")
    kind = "float" if floatout else "int"
    at = clipa.spark.createDataFrame([(table,)], f"table array<{kind}>")  # up to 2^20 entries
    use = chosen(clipa.info, planes, "Lut2")
    index = lambda v, i: F.least(F.get("a1", i), F.lit(int(fb.top))) * (1 << fa.bits) + F.least(v, F.lit(int(fa.top)))
    data = by_plane(clipa.info, lambda p: F.transform("a0", lambda v, i: F.get("table", index(v, i))) if p in use else F.col("a0").cast(f"array<{kind}>"))
    return clipa.but(clipa.info.but(format=out), joined([clipa, clipb]).crossJoin(F.broadcast(at)).select("n", "plane", data.alias("data")))


@operator("std", "Expr", "clips:clip[] expr:data[] format:int?")
def expr(clips: list[Clip], expr: list[str], format: int | None = None) -> Clip:
    need(1 <= len(clips) <= 26, "Expr: 1 to 26 clips")
    same_format(clips, "Expr", depth=False)
    fmt = clips[0].info.format
    out = VideoFormat.of_id(format) if format is not None else fmt
    need(out.planes == fmt.planes, "Expr: the output has other planes")
    need(len(expr) <= fmt.planes, "Expr: more expressions than planes")
    texts = [expr[min(p, len(expr) - 1)] for p in range(fmt.planes)]

    def make(p: int) -> Column:
        if not texts[p].strip():
            return F.col("a0").cast("array<float>" if out.is_float else "array<int>")
        return F.transform("a0", lambda v, i: stored(compiled(texts[p], [v, *(F.get(f"a{k}", i) for k in range(1, len(clips)))]), out))

    info = clips[0].info.but(format=out)
    return clips[0].but(info, joined(clips).select("n", "plane", by_plane(info, make).alias("data")))
