"""Operators on the frame index. Each frame is sent forward to where it goes, so selection needs no join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.clip import Clip, by_plane, chosen, clamped, joined, mapped, moved, neighbours, repeated, same_format
from tessella.info import need, reduced
from tessella.operators.props import rescaled_durations, with_ints
from tessella.registry import operator

MANY = 2**31 - 1


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def ranged(first, last, length, total: int, name: str) -> tuple[int, int]:
    """The inclusive range that first, last and length select of total."""
    need(last is None or length is None, f"{name}: give last or length")
    first = first or 0
    last = first + length - 1 if length is not None else total - 1 if last is None else last
    need(0 <= first <= last < total, f"{name}: the range is empty or outside")
    return first, last


@operator("std", "Trim", "clip:clip first:int? last:int? length:int?")
def trim(clip: Clip, first=None, last=None, length=None) -> Clip:
    a, b = ranged(first, last, length, len(clip), "Trim")
    if (a, b) == (0, len(clip) - 1):
        return clip
    if clip.looped is not None:
        return _looped(clip.looped, a, b)
    cut = lambda df: df.where(F.col("n").between(a, b)).withColumn("n", F.col("n") - a)
    return Clip(clip.info.but(length=b - a + 1), cut(clip.frames), cut(clip.props))


@operator("std", "Reverse", "clip:clip")
def reverse(clip: Clip) -> Clip:
    turn = lambda df: df.withColumn("n", len(clip) - 1 - F.col("n"))
    return clip.but(frames=turn(clip.frames), props=turn(clip.props))


@operator("std", "Loop", "clip:clip times:int?")
def loop(clip: Clip, times=0) -> Clip:
    need(times >= 0, "Loop: times is not negative")
    if times == 1:
        return clip
    total = min(len(clip) * times, MANY) if times else MANY
    out = _looped(clip, 0, total - 1)
    out.looped = clip
    return out


def _looped(clip: Clip, first: int, last: int) -> Clip:
    """The frames from first to last of the clip repeated without end."""
    cut = lambda df: repeated(df, "n", len(clip), first, last)
    return Clip(clip.info.but(length=last - first + 1), cut(clip.frames), cut(clip.props))


@operator("std", "SelectEvery", "clip:clip cycle:int offsets:int[] modify_duration:int?")
def select_every(clip: Clip, cycle: int, offsets: list[int], modify_duration=1) -> Clip:
    need(cycle >= 2 or cycle == 1 and offsets == [0], "SelectEvery: cycle is 2 or more")
    need(len(offsets) > 0 and all(0 <= x < cycle for x in offsets), "SelectEvery: offsets lie in the cycle")
    whole, rest = divmod(len(clip), cycle)
    tail = [x for x in offsets if x < rest]
    total = whole * len(offsets) + len(tail)
    need(total > 0, "SelectEvery: no frame is selected")
    places = lambda held, r: F.array(*[_long(j) for j, x in enumerate(held) if x == r]).cast("array<bigint>")
    pick = lambda held: F.element_at(F.array(*[places(held, r) for r in range(cycle)]), (F.col("n") % cycle + 1).cast("int"))
    to = F.transform(F.when(F.col("n") < whole * cycle, pick(offsets)).otherwise(pick(tail)), lambda j: F.floor(F.col("n") / cycle) * len(offsets) + j)
    info = clip.info.but(length=total)
    if not modify_duration:
        return moved(clip, info, to)
    num, den = clip.info.fps
    return moved(clip, info.but(fps=reduced(num * len(offsets), den * cycle)), to, lambda df: rescaled_durations(df, cycle, len(offsets)))


@operator("std", "DuplicateFrames", "clip:clip frames:int[]")
def duplicate_frames(clip: Clip, frames: list[int]) -> Clip:
    need(all(0 <= x < len(clip) for x in frames), "DuplicateFrames: no such frame")
    held = F.lit(sorted(frames)).cast("array<bigint>")
    before, own = F.size(F.filter(held, lambda x: x < F.col("n"))), F.size(F.filter(held, lambda x: x == F.col("n")))
    return moved(clip, clip.info.but(length=len(clip) + len(frames)), F.sequence(F.col("n") + before, F.col("n") + before + own))


@operator("std", "DeleteFrames", "clip:clip frames:int[]")
def delete_frames(clip: Clip, frames: list[int]) -> Clip:
    need(all(0 <= x < len(clip) for x in frames) and len(set(frames)) == len(frames) < len(clip), "DeleteFrames: frames that exist, once each, and not all")
    held = F.lit(sorted(frames)).cast("array<bigint>")
    cut = lambda df: df.where(~F.array_contains(held, F.col("n"))).withColumn("n", F.col("n") - F.size(F.filter(held, lambda x: x < F.col("n"))))
    return Clip(clip.info.but(length=len(clip) - len(frames)), cut(clip.frames), cut(clip.props))


@operator("std", "FreezeFrames", "clip:clip first:int[]? last:int[]? replacement:int[]?")
def freeze_frames(clip: Clip, first=(), last=(), replacement=()) -> Clip:
    need(len(first) == len(last) == len(replacement), "FreezeFrames: as many of each")
    spans = sorted((min(a, b), max(a, b), r) for a, b, r in zip(first, last, replacement, strict=True))
    need(all(0 <= a and b < len(clip) and 0 <= r < len(clip) for a, b, r in spans), "FreezeFrames: no such frame")
    need(all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False)), "FreezeFrames: ranges overlap")
    if not spans:
        return clip
    frozen = F.lit(False)
    for a, b, _ in spans:
        frozen = frozen | F.col("n").between(a, b)
    to = F.when(frozen, F.array().cast("array<bigint>")).otherwise(F.array(F.col("n")))
    for a, b, r in spans:
        to = F.concat(to, F.when(F.col("n") == r, F.sequence(_long(a), _long(b))).otherwise(F.array().cast("array<bigint>")))
    return moved(clip, clip.info, to)


@operator("std", "Splice", "clips:clip[] mismatch:int?")
def splice(clips: list[Clip], mismatch=0) -> Clip:
    if len(clips) == 1:
        return clips[0]
    same_format(clips, "Splice")  # clips of varying format are not supported
    shift = lambda df, k: df.withColumn("n", F.col("n") + k)
    frames, props, at = clips[0].frames, clips[0].props, len(clips[0])
    for c in clips[1:]:
        frames, props = frames.unionByName(shift(c.frames, at)), props.unionByName(shift(c.props, at))
        at += len(c)
    fps = clips[0].info.fps if len({c.info.fps for c in clips}) == 1 else (0, 0)
    return Clip(clips[0].info.but(length=at, fps=fps), frames, props)


@operator("std", "Interleave", "clips:clip[] extend:int? mismatch:int? modify_duration:int?")
def interleave(clips: list[Clip], extend=0, mismatch=0, modify_duration=1) -> Clip:
    if len(clips) == 1:
        return clips[0]
    same_format(clips, "Interleave")
    need(mismatch or len({c.info.fps for c in clips}) == 1, "Interleave: frame rates differ")
    k = len(clips)
    total = max(map(len, clips)) * k if extend else max((len(c) - 1) * k + i + 1 for i, c in enumerate(clips))
    frames = props = None
    for i, c in enumerate(clips):
        c = clamped(c, -(-(total - i) // k))
        a, b = (df.withColumn("n", F.col("n") * k + i) for df in (c.frames, c.props))
        frames, props = (a, b) if frames is None else (frames.unionByName(a), props.unionByName(b))
    info = clips[0].info.but(length=total)
    if not modify_duration:
        return Clip(info, frames, props)
    num, den = info.fps
    return Clip(info.but(fps=reduced(num * k, den)), frames, rescaled_durations(props, 1, k))


def _weighted(parts: list[Column], weights: list[float], scale: float, clip: Clip, p: int) -> Column:
    """Sample by sample, the weighted sum of arrays, scaled."""
    fmt = clip.info.format
    off = 1 << fmt.bits - 1 if fmt.chroma(p) and not fmt.is_float else 0

    def one(v: Column, i: Column) -> Column:
        kind = "float" if fmt.is_float else "long"
        total = F.lit(0).cast(kind)
        for c, w in zip(parts, weights, strict=True):
            total = total + (F.get(c, i).cast(kind) - off) * F.lit(w).cast(kind)
        out = (total.cast("float") * F.lit(1 / scale).cast("float")).cast("float")
        if fmt.is_float:
            return out
        return F.least(F.greatest(F.rint(out).cast("int") + off, F.lit(0)), F.lit(int(fmt.top)))

    return F.transform(parts[0], one)


@operator("std", "AverageFrames", "clips:clip[] weights:float[] scale:float? scenechange:int? planes:int[]?")
def average_frames(clips: list[Clip], weights: list[float], scale=None, scenechange=None, planes=None) -> Clip:
    first = clips[0]
    fmt = first.info.format
    if not fmt.is_float:
        need(all(abs(w) <= 1023 for w in weights), "AverageFrames: a weight beyond 1023")
        weights = [math.floor(w + 0.5) for w in weights]
    total = sum(weights)
    scale = scale if scale else (total if abs(total) > 1e-6 else 1)
    use = chosen(first.info, planes, "AverageFrames")
    if len(clips) > 1:
        need(len(weights) == len(clips), "AverageFrames: a weight for each clip")
        same_format(clips, "AverageFrames")
        need(not scenechange, "AverageFrames: scene changes go with one clip")
        length = max(map(len, clips))
        rows = joined(clips, length)
        parts = [F.col(f"a{i}") for i in range(len(clips))]
        data = by_plane(first.info, lambda p: _weighted(parts, weights, scale, first, p) if p in use else F.col("a0"))
        return Clip(first.info.but(length=length), rows.select("n", "plane", data.alias("data")), clamped(first, length).props)
    need(len(weights) % 2 == 1 and len(weights) <= 31, "AverageFrames: an odd number of weights, up to 31")
    r = len(weights) // 2
    frames, columns = first.frames, ["data"]
    if scenechange and r:
        flag = lambda k: F.coalesce(F.get(F.col("props").getItem(k)["i"], 0) == 1, F.lit(False))
        flags = first.props.select("n", flag("_SceneChangePrev").alias("prev"), flag("_SceneChangeNext").alias("next"))
        frames, columns = frames.join(flags, "n"), ["data", "prev", "next"]
    rows = neighbours(frames, len(first), r, columns)
    parts = [F.col(f"`data_{k}`") for k in range(-r, r + 1)]
    if scenechange and r:  # beyond a change the centre stands in
        parts = list(parts)
        for side, mark in ((-1, "prev"), (1, "next")):
            shut = F.lit(False)
            for k in range(1, r + 1):
                shut = shut | F.col(f"`{mark}_{side * (k - 1)}`")
                parts[r + side * k] = F.when(shut, F.col("data")).otherwise(parts[r + side * k])
    data = by_plane(first.info, lambda p: _weighted(parts, weights, scale, first, p) if p in use else F.col("data"))
    return first.but(frames=rows.select("n", "plane", data.alias("data")))


def _field_order(clip: Clip, tff) -> DataFrame:
    """(n, tff): whether a frame's top field is first, by its properties, else by the argument."""
    kind = F.get(F.col("props").getItem("_FieldBased")["i"], 0)
    known = F.when(kind.isin(1, 2), kind == 2)
    given = F.lit(None).cast("boolean") if tff is None else F.lit(bool(tff))
    return clip.props.select("n", F.coalesce(known, given, F.raise_error(F.lit("no field order")).cast("boolean")).alias("tff"))


@operator("std", "SeparateFields", "clip:clip tff:int? modify_duration:int?")
def separate_fields(clip: Clip, tff=None, modify_duration=1) -> Clip:
    need(clip.info.height % (2 << clip.info.format.ss_h) == 0, "SeparateFields: the height must be even in all planes")
    order = _field_order(clip, tff)
    rows = clip.frames.join(order, "n").select("n", "plane", "data", "tff", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    bottom = (F.col("k") == 1) == F.col("tff")  # the second field is the bottom one if the top is first
    info = clip.info.but(length=2 * len(clip), height=clip.info.height // 2)
    width = lambda p: info.size(p)[0]
    lines = lambda p: F.transform(F.sequence(F.lit(0), F.lit(math.prod(info.size(p)) - 1)), lambda i: F.get("data", ((F.floor(i / width(p)) * 2 + F.col("odd")) * width(p) + i % width(p)).cast("int")))
    frames = rows.withColumn("odd", bottom.cast("int")).select((F.col("n") * 2 + F.col("k")).alias("n"), "plane", by_plane(info, lines).alias("data"))
    props = clip.props.join(order, "n").select("n", "props", "tff", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    props = props.select((F.col("n") * 2 + F.col("k")).alias("n"), with_ints("props", {"_Field": (F.col("k").cast("boolean") != F.col("tff")).cast("long")}, drop=["_FieldBased"]).alias("props"))
    if modify_duration:
        num, den = clip.info.fps
        info, props = info.but(fps=reduced(num * 2, den)), rescaled_durations(props, 1, 2)
    return Clip(info, frames, props)


@operator("std", "DoubleWeave", "clip:clip tff:int?")
def double_weave(clip: Clip, tff=None) -> Clip:
    mark = F.get(F.col("props").getItem("_Field")["i"], 0)
    marks = neighbours(clip.props.select("n", mark.alias("mark")), len(clip), 1, ["mark"])
    given = F.raise_error(F.lit("no field order")).cast("boolean") if tff is None else F.lit(bool(tff)) != (F.col("n") % 2 == 1)
    top = F.when(F.col("mark").isin(0, 1) & (F.col("mark") != F.col("`mark_1`")), F.col("mark") == 1).otherwise(given)
    order = marks.select("n", top.alias("top"))
    info = clip.info.but(height=clip.info.height * 2)
    rows = neighbours(clip.frames, len(clip), 1, ["data"]).join(order, "n").withColumn("other", F.col("`data_1`"))

    def woven(p: int) -> Column:
        w, h = info.size(p)

        def one(i: Column) -> Column:
            at = (F.floor(i / (2 * w)) * w + i % w).cast("int")
            even = F.floor(i / w) % 2 == 0
            return F.when(even == F.col("top"), F.get("data", at)).otherwise(F.get("other", at))

        return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), one)

    props = clip.props.join(order, "n").select("n", with_ints("props", {"_FieldBased": F.when(F.col("top"), 2).otherwise(1).cast("long")}, drop=["_Field"]).alias("props"))
    return Clip(info, rows.select("n", "plane", by_plane(info, woven).alias("data")), props)


@operator("std", "AssumeFPS", "clip:clip src:clip? fpsnum:int? fpsden:int?")
def assume_fps(clip: Clip, src=None, fpsnum=None, fpsden=None) -> Clip:
    need((src is None) != (fpsnum is None), "AssumeFPS: give src or fpsnum")
    fps = src.info.fps if src is not None else reduced(fpsnum, fpsden or 1)
    need(fps[0] > 0, "AssumeFPS: a positive rate")
    props = with_ints("props", {"_DurationNum": F.lit(fps[1]).cast("long"), "_DurationDen": F.lit(fps[0]).cast("long")})
    return clip.but(clip.info.but(fps=fps), props=clip.props.select("n", props.alias("props")))


__all__ = ["mapped", "ranged"]
