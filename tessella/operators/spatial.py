"""Neighbourhood operators: within a row's array, so without any shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.clip import Clip, chosen, mapped
from tessella.info import OperatorError, need
from tessella.operators.point import level
from tessella.registry import operator

#: Places around a sample, row by row, as the coordinates argument counts them.
AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def _replicate(p: Column, n: int) -> Column:
    return F.least(F.greatest(p, F.lit(0)), F.lit(n - 1))


def _mirror(p: Column, n: int) -> Column:
    return F.when(p < 0, -p - 1).when(p >= n, 2 * n - 1 - p).otherwise(p)


def _tap(i: Column, dy: int, dx: int, w: int, h: int, edge=_replicate) -> Column:
    y, x = F.floor(i / w).cast("int"), (i % w).cast("int")
    y = edge(y + dy, h) if dy else y
    x = edge(x + dx, w) if dx else x
    return F.get("data", y * w + x)


def _sized(clip: Clip, name: str, planes: set[int], least: int = 4) -> None:
    need(all(min(clip.info.size(p)) >= least for p in planes), f"{name}: planes of {least}x{least} at least")


def around(clip: Clip, planes, name: str, make) -> Clip:
    """data made by make(plane, centre, taps); taps(dy, dx) is a neighbour, edges replicated."""
    use = chosen(clip.info, planes, name)
    _sized(clip, name, use)

    def data(p: int) -> Column:
        w, h = clip.info.size(p)
        return F.transform("data", lambda v, i: make(p, v, lambda dy, dx: _tap(i, dy, dx, w, h)))

    return mapped(clip, use, data)


def _kind(clip: Clip) -> str:
    return "float" if clip.info.format.is_float else "int"


def _limit(clip: Clip, threshold) -> float | None:
    if threshold is None:
        return None
    need(threshold >= 0, "a threshold is not negative")
    return threshold if clip.info.format.is_float else level(threshold)


def _extreme(clip: Clip, planes, threshold, coordinates, lowest: bool, name: str) -> Clip:
    need(coordinates is None or len(coordinates) == 8, f"{name}: coordinates are 8 values")
    use = [d for d, on in zip(AROUND, coordinates or [1] * 8, strict=True) if on]
    limit, fmt, kind = _limit(clip, threshold), clip.info.format, _kind(clip)

    def make(p, v, tap):
        out = (F.least if lowest else F.greatest)(v, *[tap(*d) for d in use]) if use else v
        if limit is not None:
            edge = (v - F.lit(limit).cast(kind)) if lowest else (v + F.lit(limit).cast(kind))
            out = F.greatest(out, edge) if lowest else F.least(out, edge)
        return out.cast("float") if fmt.is_float else F.least(out, F.lit(int(fmt.top)))

    return around(clip, planes, name, make)


@operator("std", "Minimum", "clip:clip planes:int[]? threshold:float? coordinates:int[]?")
def minimum(clip: Clip, planes=None, threshold=None, coordinates=None) -> Clip:
    return _extreme(clip, planes, threshold, coordinates, True, "Minimum")


@operator("std", "Maximum", "clip:clip planes:int[]? threshold:float? coordinates:int[]?")
def maximum(clip: Clip, planes=None, threshold=None, coordinates=None) -> Clip:
    return _extreme(clip, planes, threshold, coordinates, False, "Maximum")


@operator("std", "Median", "clip:clip planes:int[]?")
def median(clip: Clip, planes=None) -> Clip:
    return around(clip, planes, "Median", lambda p, v, tap: F.get(F.sort_array(F.array(v, *[tap(*d) for d in AROUND])), 4))


def _flattened(clip: Clip, planes, threshold, down: bool, name: str) -> Clip:
    limit, fmt, kind = _limit(clip, threshold), clip.info.format, _kind(clip)

    def make(p, v, tap):
        total = sum((tap(*d) for d in AROUND), F.lit(0).cast(kind))
        mean = (total / 8).cast("float") if fmt.is_float else F.floor((total + 4) / 8).cast("int")
        out = (F.least if down else F.greatest)(mean, v)
        if limit is not None:
            out = F.greatest(out, v - F.lit(limit).cast(kind)) if down else F.least(out, v + F.lit(limit).cast(kind))
        return out

    return around(clip, planes, name, make)


@operator("std", "Deflate", "clip:clip planes:int[]? threshold:float?")
def deflate(clip: Clip, planes=None, threshold=None) -> Clip:
    return _flattened(clip, planes, threshold, True, "Deflate")


@operator("std", "Inflate", "clip:clip planes:int[]? threshold:float?")
def inflate(clip: Clip, planes=None, threshold=None) -> Clip:
    return _flattened(clip, planes, threshold, False, "Inflate")


def _edges(clip: Clip, planes, scale, middle: int, name: str) -> Clip:
    fmt = clip.info.format
    scale = 1.0 if scale is None else scale

    def make(p, v, tap):
        side = lambda s, over: tap(*((s, -1) if over else (-1, s))) + middle * tap(*((s, 0) if over else (0, s))) + tap(*((s, 1) if over else (1, s)))
        gx, gy = (side(1, o).cast("float") - side(-1, o).cast("float") for o in (False, True))
        out = (F.sqrt((gx * gx + gy * gy).cast("float")).cast("float") * F.lit(scale).cast("float")).cast("float")
        return out if fmt.is_float else F.least(F.rint(out).cast("int"), F.lit(int(fmt.top)))

    return around(clip, planes, name, make)


@operator("std", "Prewitt", "clip:clip planes:int[]? scale:float?")
def prewitt(clip: Clip, planes=None, scale=None) -> Clip:
    return _edges(clip, planes, scale, 1, "Prewitt")


@operator("std", "Sobel", "clip:clip planes:int[]? scale:float?")
def sobel(clip: Clip, planes=None, scale=None) -> Clip:
    return _edges(clip, planes, scale, 2, "Sobel")


@operator("std", "Convolution", "clip:clip matrix:float[] bias:float? divisor:float? planes:int[]? saturate:int? mode:data?")
def convolution(clip: Clip, matrix, bias=0, divisor=0, planes=None, saturate=1, mode="s") -> Clip:
    fmt, n = clip.info.format, len(matrix)
    need(mode in ("s", "h", "v", "hv", "vh"), "Convolution: mode is s, h, v, hv or vh")
    side = math.isqrt(n)
    need(n in (9, 25, 49, 81, 121) if mode == "s" else n % 2 == 1 and 3 <= n <= 25, "Convolution: a matrix of another size")
    if not fmt.is_float:
        matrix = [level(c) for c in matrix]
        need(all(abs(c) <= 1023 for c in matrix), "Convolution: a coefficient beyond 1023")
    total = sum(matrix)
    divisor = divisor or (total if abs(total) > 1e-6 else 1)
    if mode in ("hv", "vh"):
        out = convolution(clip, matrix, bias, divisor, planes, saturate, mode[0])
        return convolution(out, matrix, bias, divisor, planes, saturate, mode[1])
    r = side // 2 if mode == "s" else n // 2
    places = [(k // side - r, k % side - r) for k in range(n)] if mode == "s" else [(0, k - r) if mode == "h" else (k - r, 0) for k in range(n)]
    use = chosen(clip.info, planes, "Convolution")
    _sized(clip, "Convolution", use, max(4, r + 1))
    edge = _replicate if mode == "s" and side == 3 else _mirror

    def data(p: int) -> Column:
        w, h = clip.info.size(p)

        def one(v: Column, i: Column) -> Column:
            acc = F.lit(0).cast("float" if fmt.is_float else "long")
            for c, d in zip(matrix, places, strict=True):
                if c:
                    acc = acc + _tap(i, *d, w, h, edge) * F.lit(c).cast("float" if fmt.is_float else "long")
            out = ((acc.cast("float") * F.lit(1 / divisor).cast("float")).cast("float") + F.lit(bias).cast("float")).cast("float")
            out = out if saturate else F.abs(out)
            return out if fmt.is_float else F.least(F.greatest(F.rint(out).cast("int"), F.lit(0)), F.lit(int(fmt.top)))

        return F.transform("data", one)

    return mapped(clip, use, data)


@operator("std", "BoxBlur", "clip:clip planes:int[]? hradius:int? hpasses:int? vradius:int? vpasses:int?")
def box_blur(clip: Clip, planes=None, hradius=1, hpasses=1, vradius=1, vpasses=1) -> Clip:
    need(min(hradius, hpasses, vradius, vpasses) >= 0, "BoxBlur: radii and passes are not negative")
    if not (hradius and hpasses or vradius and vpasses):
        raise OperatorError("BoxBlur: nothing to do")
    use = chosen(clip.info, planes, "BoxBlur")
    _sized(clip, "BoxBlur", use)
    sizes, kind = {p: clip.info.size(p) for p in use}, np.dtype(np.float32 if clip.info.format.is_float else np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, plane, data = batch.columns
            offsets, flat, number = data.offsets.to_numpy(), data.values.to_numpy().astype(kind), plane.to_numpy()
            for p, (w, h) in sizes.items():
                rows = np.flatnonzero(number == p)
                at = offsets[rows][:, None] + np.arange(w * h)
                x = flat[at].reshape(len(rows), h, w)
                for turn in range(hpasses if hradius else 0):
                    x = _window_means(x, hradius, turn % 2 == 0)
                for turn in range(vpasses if vradius else 0):
                    x = _window_means(x.swapaxes(1, 2), vradius, turn % 2 == 0).swapaxes(1, 2)
                flat[at] = x.reshape(len(rows), w * h)
            yield pa.RecordBatch.from_arrays([n, plane, pa.ListArray.from_arrays(data.offsets, pa.array(flat))], ["n", "plane", "data"])

    frames = clip.frames.select("n", "plane", "data")
    return clip.but(frames=frames.mapInArrow(run, frames.schema))


def _window_means(x: np.ndarray, radius: int, up: bool) -> np.ndarray:
    """Means of 2 * radius + 1 samples along the last axis by prefix sums, edges replicated; integers rounded up or down."""
    span, is_float = 2 * radius + 1, x.dtype.kind == "f"
    total = np.cumsum(np.pad(x, ((0, 0), (0, 0), (radius + 1, radius)), "edge"), axis=2, dtype=np.float64 if is_float else np.int64)
    total = total[..., span:] - total[..., :-span]
    return (total * (1 / span)).astype(x.dtype) if is_float else ((total + (2 * radius if up else 0)) // span).astype(x.dtype)
