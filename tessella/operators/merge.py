"""Operators on several clips: joins on the frame index, the shorter side held at its last frame."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.clip import Clip, bound_to, by_plane, chosen, clamped, joined, same_format
from tessella.info import GRAY, RGB, VideoFormat, need
from tessella.operators.resize import LOCATIONS, scaled, taps
from tessella.registry import operator


def _zipped(a: Clip, b: Clip, make, planes: set[int] | None = None, info=None) -> Clip:
    out = by_plane(a.info, lambda p: F.zip_with("a0", "a1", make(p)) if planes is None or p in planes else F.col("a0"))
    return a.but(info, joined([a, b]).select("n", "plane", out.alias("data")))


def _clamp(v: Column, top: int) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(top)).cast("int")


@operator("std", "Merge", "clipa:clip clipb:clip weight:float[]?")
def merge(clipa: Clip, clipb: Clip, weight=None) -> Clip:
    same_format([clipa, clipb], "Merge")
    fmt = clipa.info.format
    weights = list(weight or [0.5])
    need(len(weights) <= fmt.planes and all(0 <= w <= 1 for w in weights), "Merge: up to a weight per plane, from 0 to 1")
    weights += [weights[-1]] * (3 - len(weights))

    def make(p: int):
        w = weights[p]
        if w in (0, 1):
            return lambda a, b: b if w else a
        if fmt.is_float:
            return lambda a, b: (a + (b - a) * F.lit(w).cast("float")).cast("float")
        k = min(math.floor(w * 32768 + 0.5), 32767)
        return lambda a, b: (a + F.shiftright((b - a).cast("long") * k + 16384, 15)).cast("int")

    return _zipped(clipa, clipb, make)


@operator("std", "MakeDiff", "clipa:clip clipb:clip planes:int[]?")
def make_diff(clipa: Clip, clipb: Clip, planes=None) -> Clip:
    same_format([clipa, clipb], "MakeDiff")
    fmt = clipa.info.format
    make = (lambda a, b: a - b) if fmt.is_float else (lambda a, b: _clamp(a - b + (1 << fmt.bits - 1), int(fmt.top)))
    return _zipped(clipa, clipb, lambda p: make, chosen(clipa.info, planes, "MakeDiff"))


@operator("std", "MergeDiff", "clipa:clip clipb:clip planes:int[]?")
def merge_diff(clipa: Clip, clipb: Clip, planes=None) -> Clip:
    same_format([clipa, clipb], "MergeDiff")
    fmt = clipa.info.format
    make = (lambda a, b: a + b) if fmt.is_float else (lambda a, b: _clamp(a + b - (1 << fmt.bits - 1), int(fmt.top)))
    return _zipped(clipa, clipb, lambda p: make, chosen(clipa.info, planes, "MergeDiff"))


@operator("std", "MakeFullDiff", "clipa:clip clipb:clip")
def make_full_diff(clipa: Clip, clipb: Clip) -> Clip:
    same_format([clipa, clipb], "MakeFullDiff")
    fmt = clipa.info.format
    if fmt.is_float:
        return _zipped(clipa, clipb, lambda p: lambda a, b: a - b)
    deeper = VideoFormat(fmt.family, fmt.sample, fmt.bits + 1, fmt.ss_w, fmt.ss_h)
    return _zipped(clipa, clipb, lambda p: lambda a, b: a - b + (1 << fmt.bits), info=clipa.info.but(format=deeper))


@operator("std", "MergeFullDiff", "clipa:clip clipb:clip")
def merge_full_diff(clipa: Clip, clipb: Clip) -> Clip:
    same_format([clipa, clipb], "MergeFullDiff", depth=False)
    fmt = clipa.info.format
    if fmt.is_float:
        return _zipped(clipa, clipb, lambda p: lambda a, b: a + b)
    need(clipb.info.format.bits == fmt.bits + 1, "MergeFullDiff: the difference has one bit more")
    return _zipped(clipa, clipb, lambda p: lambda a, b: _clamp(a + b - (1 << fmt.bits), int(fmt.top)))


#: By _ChromaLocation: left, centre, top left, top, bottom left, bottom.
SITES = list(LOCATIONS.values())


def site(props: str = "props") -> Column:
    """A frame's place in SITES; left where it's unknown."""
    return F.coalesce(F.get(F.col(props).getItem("_ChromaLocation")["i"], 0), F.lit(0).cast("long"))


def mask_for(clip: Clip, mask: Clip, name: str, first_plane: bool = True) -> Clip:
    """The mask as a clip with the planes and sizes of `clip`. A single plane serves all; where chroma is subsampled
    it's scaled bilinearly to where each of the clip's frames has its chroma samples."""
    need((mask.info.width, mask.info.height) == (clip.info.width, clip.info.height), f"{name}: the mask's size differs")
    need(mask.info.format.bits == clip.info.format.bits and mask.info.format.sample == clip.info.format.sample, f"{name}: the mask's depth differs")
    fmt = clip.info.format
    if not first_plane:
        return mask
    rows = clamped(mask, len(clip)).frames.where("plane = 0")
    planes = F.explode(F.array(*[F.lit(p) for p in range(fmt.planes)])).alias("plane")
    info = clip.info
    if not (fmt.ss_w or fmt.ss_h):
        return Clip(info, rows.select("n", planes, "data"), clip.props)
    (w, h), (cw, ch) = (info.width, info.height), info.size(1)
    store = (lambda v: v.cast("float")) if fmt.is_float else (lambda v: F.least(F.greatest(F.rint(F.round(v, 6)), F.lit(0.0)), F.lit(float(fmt.top))).cast("int"))

    def small(dx: float, dy: float) -> Column:
        across, down = taps("Bilinear", w, cw, dx if fmt.ss_w else 0.0), taps("Bilinear", h, ch, dy if fmt.ss_h else 0.0)
        return F.transform(bound_to(F.transform("data", lambda v: v.cast("double")), lambda d: scaled(d, w, h, across, down)), store)

    sited = rows.join(clip.props.select("n", site().alias("site")), "n")
    chroma = F.raise_error(F.lit(f"{name}: no such chroma location")).cast(f"array<{'float' if fmt.is_float else 'int'}>")
    for k, place in reversed(list(enumerate(SITES))):
        chroma = F.when(F.col("site") == k, small(*place)).otherwise(chroma)
    whole = sited.select("n", F.array("data", chroma).alias("sizes"))
    return Clip(info, whole.select("n", "sizes", planes).select("n", "plane", F.get("sizes", F.when(F.col("plane") == 0, 0).otherwise(1)).alias("data")), clip.props)


def _black_level(fmt: VideoFormat, plane: int, limited: bool) -> int:
    """What a premultiplied sample is measured from."""
    return 1 << fmt.bits - 1 if fmt.chroma(plane) else 16 << fmt.bits - 8 if limited else 0


def _times(x: Column, m: Column, top: int, off: int) -> Column:
    d = x - off
    return (F.signum(d) * F.floor((F.abs(d) * m + top // 2) / top)).cast("int") + off


@operator("std", "PreMultiply", "clip:clip alpha:clip")
def premultiply(clip: Clip, alpha: Clip, limited: bool | None = None) -> Clip:
    fmt = clip.info.format
    need(alpha.info.format.family == GRAY, "PreMultiply: alpha has one plane")
    limited = fmt.family != RGB if limited is None else limited

    def make(p: int):
        if fmt.is_float:
            return lambda x, m: (x * m).cast("float")
        return lambda x, m: _times(x, m, int(fmt.top), _black_level(fmt, p, limited))

    return _zipped(clip, clamped(mask_for(clip, alpha, "PreMultiply"), len(clip)), make)


@operator("std", "MaskedMerge", "clipa:clip clipb:clip mask:clip planes:int[]? first_plane:int? premultiplied:int?")
def masked_merge(clipa: Clip, clipb: Clip, mask: Clip, planes=None, first_plane=None, premultiplied=None) -> Clip:
    same_format([clipa, clipb], "MaskedMerge")
    fmt = clipa.info.format
    single = bool(first_plane) or mask.info.format.planes == 1
    use = chosen(clipa.info, planes, "MaskedMerge")
    top = int(fmt.top) if not fmt.is_float else 1

    def make(p: int) -> Column:
        if p not in use:
            return F.col("a0")
        off = _black_level(fmt, p, fmt.family != RGB)

        def one(a: Column, i: Column) -> Column:
            b, m = F.get("a1", i), F.get("a2", i)
            if fmt.is_float:
                m = F.least(F.greatest(m, F.lit(0).cast("float")), F.lit(1).cast("float"))
                return (a * (1 - m) + b if premultiplied else a + (b - a) * m).cast("float")
            if premultiplied:
                return _clamp(_times(a, top - m, top, off) + b - off, top)
            return F.floor(((top - m).cast("long") * a + m.cast("long") * b + top // 2) / top).cast("int")

        return F.transform("a0", one)

    both = joined([clipa, clipb, mask_for(clipa, mask, "MaskedMerge", single)])
    if (fmt.ss_w or fmt.ss_h) and use - {0}:  # chroma of both has to lie at the same places
        apart = clipa.props.select("n", site().alias("sa")).join(clamped(clipb, len(clipa)).props.select("n", site().alias("sb")), "n")
        both = both.join(apart.select("n", F.when(F.col("sa") != F.col("sb"), F.raise_error(F.lit("MaskedMerge: chroma locations differ")).cast("boolean")).otherwise(True).alias("same")), "n").where("same")
    return clipa.but(frames=both.select("n", "plane", by_plane(clipa.info, make).alias("data")))
