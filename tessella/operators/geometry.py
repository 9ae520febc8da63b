"""Operators on the places of samples and planes: index projections within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.clip import Clip, by_plane, clamped, joined, same_format
from tessella.info import GRAY, INTEGER, RGB, YUV, VideoFormat, VideoInfo, need
from tessella.operators.point import level, spread
from tessella.operators.props import with_ints
from tessella.registry import operator


def placed(clip: Clip, info: VideoInfo, at) -> Clip:
    """Samples by their place: at(plane, y, x) is the Column of the output sample at y, x."""

    def data(p: int) -> Column:
        w, h = info.size(p)
        # data stands here twice, or the optimizer would put what makes it inside the lambda, once for each sample
        return F.when(F.col("data").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda i: at(p, F.floor(i / w).cast("int"), (i % w).cast("int"))))

    return clip.but(info, clip.frames.select("n", "plane", by_plane(info, data).alias("data")))


def source(info: VideoInfo, p: int, y: Column, x: Column) -> Column:
    return F.get("data", y * info.size(p)[0] + x)


def shift(info: VideoInfo, p: int, x: int, y: int) -> tuple[int, int]:
    f = info.format
    return (x >> f.ss_w, y >> f.ss_h) if f.chroma(p) else (x, y)


def aligned(info: VideoInfo, *values: int) -> bool:
    f = info.format
    return all(v % (1 << (f.ss_w, f.ss_h)[k % 2]) == 0 for k, v in enumerate(values))


@operator("std", "CropAbs", "clip:clip width:int height:int left:int? top:int? x:int? y:int?")
def crop_abs(clip: Clip, width: int, height: int, left=None, top=None, x=None, y=None) -> Clip:
    left, top = left or x or 0, top or y or 0
    i = clip.info
    need(width > 0 and height > 0 and left >= 0 and top >= 0 and left + width <= i.width and top + height <= i.height, "Crop: the area is empty or outside")
    need(aligned(i, left, top, width, height), "Crop: the area must fit the subsampling")
    if (width, height) == (i.width, i.height):
        return clip

    def at(p, yy, xx):
        dx, dy = shift(i, p, left, top)
        return source(i, p, yy + dy, xx + dx)

    return placed(clip, i.but(width=width, height=height), at)


@operator("std", "Crop", "clip:clip left:int? right:int? top:int? bottom:int?")
@operator("std", "CropRel", "clip:clip left:int? right:int? top:int? bottom:int?")
def crop(clip: Clip, left=0, right=0, top=0, bottom=0) -> Clip:
    need(min(left, right, top, bottom) >= 0, "Crop: no border is negative")
    return crop_abs(clip, clip.info.width - left - right, clip.info.height - top - bottom, left, top)


@operator("std", "AddBorders", "clip:clip left:int? right:int? top:int? bottom:int? color:float[]?")
def add_borders(clip: Clip, left=0, right=0, top=0, bottom=0, color=None) -> Clip:
    i = clip.info
    need(min(left, right, top, bottom) >= 0, "AddBorders: no border is negative")
    need(aligned(i, left, top, right, bottom), "AddBorders: borders must fit the subsampling")
    if not (left or right or top or bottom):
        return clip
    need(color is None or len(color) == i.format.planes, "AddBorders: a colour value for each plane")
    colour = spread(color, i.format.planes, i.format.black)
    kind = "float" if i.format.is_float else "int"

    def at(p, y, x):
        dx, dy = shift(i, p, left, top)
        w, h = i.size(p)
        inside = (x >= dx) & (x < dx + w) & (y >= dy) & (y < dy + h)
        fill = colour[p] if i.format.is_float else level(colour[p])
        return F.when(inside, source(i, p, y - dy, x - dx)).otherwise(F.lit(fill).cast(kind))

    return placed(clip, i.but(width=i.width + left + right, height=i.height + top + bottom), at)


@operator("std", "FlipVertical", "clip:clip")
def flip_vertical(clip: Clip) -> Clip:
    return placed(clip, clip.info, lambda p, y, x: source(clip.info, p, clip.info.size(p)[1] - 1 - y, x))


@operator("std", "FlipHorizontal", "clip:clip")
def flip_horizontal(clip: Clip) -> Clip:
    return placed(clip, clip.info, lambda p, y, x: source(clip.info, p, y, clip.info.size(p)[0] - 1 - x))


@operator("std", "Turn180", "clip:clip")
def turn180(clip: Clip) -> Clip:
    return clip.but(frames=clip.frames.withColumn("data", F.reverse("data")))


def _turned(clip: Clip, at) -> Clip:
    i, f = clip.info, clip.info.format
    turned = VideoFormat(f.family, f.sample, f.bits, f.ss_h, f.ss_w)
    return placed(clip, i.but(format=turned, width=i.height, height=i.width), at)


@operator("std", "Transpose", "clip:clip")
def transpose(clip: Clip) -> Clip:
    return _turned(clip, lambda p, y, x: source(clip.info, p, x, y))


@operator("std", "Turn90", "clip:clip")
def turn90(clip: Clip) -> Clip:
    return _turned(clip, lambda p, y, x: source(clip.info, p, clip.info.size(p)[1] - 1 - x, y))


@operator("std", "Turn270", "clip:clip")
def turn270(clip: Clip) -> Clip:
    return _turned(clip, lambda p, y, x: source(clip.info, p, x, clip.info.size(p)[0] - 1 - y))


def _stacked(clips: list[Clip], upright: bool, name: str) -> Clip:
    if len(clips) == 1:
        return clips[0]
    first = clips[0].info
    need(all(c.info.format == first.format for c in clips), f"{name}: formats differ")
    side = (lambda i: i.width) if upright else (lambda i: i.height)
    need(all(side(c.info) == side(first) for c in clips), f"{name}: sizes differ")
    length = max(map(len, clips))
    rows = joined(clips, length)
    if upright:
        info = first.but(length=length, height=sum(c.info.height for c in clips))
        return Clip(info, rows.select("n", "plane", F.concat(*[f"a{k}" for k in range(len(clips))]).alias("data")), clamped(clips[0], length).props)
    info = first.but(length=length, width=sum(c.info.width for c in clips))

    def data(p: int) -> Column:
        h = info.size(p)[1]
        parts = lambda y: [F.slice(f"a{k}", (y * c.info.size(p)[0] + 1).cast("int"), c.info.size(p)[0]) for k, c in enumerate(clips)]
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.concat(*parts(y))))

    return Clip(info, rows.select("n", "plane", by_plane(info, data).alias("data")), clamped(clips[0], length).props)


@operator("std", "StackVertical", "clips:clip[]")
def stack_vertical(clips: list[Clip]) -> Clip:
    return _stacked(clips, True, "StackVertical")


@operator("std", "StackHorizontal", "clips:clip[]")
def stack_horizontal(clips: list[Clip]) -> Clip:
    return _stacked(clips, False, "StackHorizontal")


@operator("std", "ShufflePlanes", "clips:clip[] planes:int[] colorfamily:int prop_src:clip?")
def shuffle_planes(clips: list[Clip], planes: list[int], colorfamily: int, prop_src=None) -> Clip:
    n = 1 if colorfamily == GRAY else 3
    need(len(planes) == n and 1 <= len(clips) <= n, "ShufflePlanes: as many planes as the family has, and no more clips")
    clips = [clips[min(k, len(clips) - 1)] for k in range(n)]
    need(all(0 <= p < c.info.format.planes for c, p in zip(clips, planes, strict=True)), "ShufflePlanes: no such plane")
    need(len({(c.info.format.bits, c.info.format.sample) for c in clips}) == 1, "ShufflePlanes: depths differ")
    sizes = [c.info.size(p) for c, p in zip(clips, planes, strict=True)]
    ss = (0, 0)
    if n == 3:
        need(sizes[1] == sizes[2], "ShufflePlanes: the second and third plane differ in size")
        found = [(a, b) for a in range(5) for b in range(5) if (sizes[0][0] >> a, sizes[0][1] >> b) == sizes[1] and sizes[1][0] << a == sizes[0][0] and sizes[1][1] << b == sizes[0][1]]
        need(bool(found), "ShufflePlanes: no subsampling fits the sizes")
        ss = found[0]
        need(colorfamily == YUV or ss == (0, 0), "ShufflePlanes: RGB is never subsampled")
    f = clips[0].info.format
    length = max(map(len, clips))
    info = VideoInfo(VideoFormat(colorfamily, f.sample, f.bits, *ss), *sizes[0], length, clips[0].info.fps)
    frames = None
    for k, (c, p) in enumerate(zip(clips, planes, strict=True)):
        rows = clamped(c, length).frames.where(F.col("plane") == p).select("n", F.lit(k).alias("plane"), "data")
        frames = rows if frames is None else frames.unionByName(rows)
    return Clip(info, frames, clamped(prop_src or clips[0], length).props)


@operator("std", "SplitPlanes", "clip:clip")
def split_planes(clip: Clip) -> list[Clip]:
    f = clip.info.format
    gray = VideoFormat(GRAY, f.sample, f.bits)
    return [Clip(VideoInfo(gray, *clip.info.size(p), len(clip), clip.info.fps), clip.frames.where(F.col("plane") == p).select("n", F.lit(0).alias("plane"), "data"), clip.props) for p in range(f.planes)]


@operator("std", "BlankClip", "clip:clip? width:int? height:int? format:int? length:int? fpsnum:int? fpsden:int? color:float[]? keep:int?")
def blank_clip(clip=None, width=None, height=None, format=None, length=None, fpsnum=None, fpsden=None, color=None, keep=None, spark=None) -> Clip:
    from pyspark.sql import SparkSession

    spark = spark or (clip.spark if clip is not None else SparkSession.active())
    base = clip.info if clip is not None else None
    fmt = VideoFormat.of_id(format) if format is not None else base.format if base else VideoFormat(RGB, INTEGER, 8)
    fps = base.fps if base else (24, 1)
    if fpsnum is not None or fpsden is not None:
        fps = (fpsnum if fpsnum is not None else fps[0], fpsden if fpsden is not None else fps[1])
        fps = (0, 0) if 0 in fps else fps
    from tessella.info import reduced

    fps = reduced(*fps)
    length = length or (base.length if base else fps[0] * 10 // fps[1] if fps[0] else 300)
    info = VideoInfo(fmt, width or (base.width if base else 640), height or (base.height if base else 480), length, fps)
    need(color is None or len(color) == fmt.planes, "BlankClip: a colour value for each plane")
    colour = spread(color, fmt.planes, fmt.black)
    kind = "float" if fmt.is_float else "int"
    value = lambda p: F.lit(colour[p] if fmt.is_float else level(colour[p])).cast(kind)
    rows = spark.range(length).select(F.col("id").alias("n"), F.explode(F.array(*map(F.lit, range(fmt.planes)))).alias("plane"))
    frames = rows.select("n", "plane", by_plane(info, lambda p: F.array_repeat(value(p), info.size(p)[0] * info.size(p)[1])).alias("data"))
    out = Clip(info, frames)
    if not fps[0]:
        return out
    props = with_ints("props", {"_DurationNum": F.lit(fps[1]).cast("long"), "_DurationDen": F.lit(fps[0]).cast("long")})
    return out.but(props=out.props.select("n", props.alias("props")))


__all__ = ["same_format"]
