"""Sequences of frames and of audio samples as lazy DataFrames.

A Clip's frames are rows (n, plane, data), data the plane's samples by rows, so operators on a frame
are projections without a shuffle, and those on several clips join on (n, plane). Properties are
rows (n, props) apart from the samples. An Audio's rows are (s, v), v the channels' samples.
Nothing runs until an action; infos are checked when an operator is applied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.info import AudioInfo, VideoInfo, need

PROP = "struct<i:array<bigint>,f:array<double>,d:array<string>>"
PROPS = f"map<string,{PROP}>"
HALO = 256  # frames of a block whose neighbours are looked up together


class Clip:
    """A video sequence. looped: the clip that this one only repeats; a range of it is taken without the rest."""

    looped: Clip | None = None

    def __init__(self, info: VideoInfo, frames: DataFrame, props: DataFrame | None = None):
        self.info, self.frames = info, frames
        self.props = props if props is not None else self.spark.range(info.length).select(F.col("id").alias("n"), F.create_map().cast(PROPS).alias("props"))

    @property
    def spark(self):
        return self.frames.sparkSession

    def __len__(self) -> int:
        return self.info.length

    def __getattr__(self, space: str):
        if space.startswith("_"):
            raise AttributeError(space)
        from tessella import registry

        return registry.bound(space, self)

    def __getitem__(self, at):
        if isinstance(at, int):
            at = at + len(self) if at < 0 else at
            if not 0 <= at < len(self):
                raise IndexError("no such frame")
            return self.std.Trim(first=at, length=1)
        start, stop, step = at.indices(len(self))
        taken = range(start, stop, step)
        need(len(taken) > 0, "an empty slice")
        low, high = min(taken[0], taken[-1]), max(taken[0], taken[-1])
        out = self.std.Trim(first=low, last=high)
        out = out.std.Reverse() if step < 0 else out
        return out.std.SelectEvery(cycle=abs(step), offsets=0) if abs(step) > 1 else out

    def __add__(self, other: Clip) -> Clip:
        from tessella import registry

        return registry.bound("std").Splice([self, other])

    def __mul__(self, times: int) -> Clip:
        need(times >= 1, "times is at least 1")
        return self.std.Loop(times=times)

    def but(self, info: VideoInfo | None = None, frames: DataFrame | None = None, props: DataFrame | None = None) -> Clip:
        return Clip(info or self.info, self.frames if frames is None else frames, self.props if props is None else props)

    def samples(self) -> DataFrame:
        """(n, plane, y, x, v): a row per sample."""
        width = by_plane(self.info, lambda p: F.lit(self.info.size(p)[0]))
        # the inner form would bring a filter on size(data), pushed down to the scan with all operators' lambdas in it
        long = self.frames.select("n", "plane", F.posexplode_outer("data").alias("i", "v"))
        return long.select(F.col("n"), F.col("plane"), F.expr("i").alias("i"), width.alias("w"), "v").select("n", "plane", F.expr("cast(i div w as int)").alias("y"), (F.col("i") % F.col("w")).alias("x"), "v")

    def frame(self, n: int) -> dict[int, list]:
        """The planes of one frame."""
        need(0 <= n < len(self), "no such frame")
        return {r.plane: r.data for r in self.frames.where(F.col("n") == n).collect()}

    def describe(self) -> str:
        i = self.info
        return f"{i.format.name} {i.width}x{i.height}, {i.length} frames at {i.fps[0]}/{i.fps[1]}"


class Audio:
    """An audio sequence. looped: as a Clip's."""

    looped: Audio | None = None

    def __init__(self, info: AudioInfo, rows: DataFrame):
        self.info, self.rows = info, rows

    @property
    def spark(self):
        return self.rows.sparkSession

    def __len__(self) -> int:
        return self.info.length

    __getattr__ = Clip.__getattr__

    def __getitem__(self, at: slice) -> Audio:
        start, stop, step = at.indices(len(self))
        need(step in (1, -1), "audio is sliced by single samples")
        taken = range(start, stop, step)
        need(len(taken) > 0, "an empty slice")
        out = self.std.AudioTrim(first=min(taken[0], taken[-1]), last=max(taken[0], taken[-1]))
        return out.std.AudioReverse() if step < 0 else out

    def __add__(self, other: Audio) -> Audio:
        from tessella import registry

        return registry.bound("std").AudioSplice([self, other])

    def __mul__(self, times: int) -> Audio:
        return self.std.AudioLoop(times=times)

    def but(self, info: AudioInfo | None = None, rows: DataFrame | None = None) -> Audio:
        return Audio(info or self.info, self.rows if rows is None else rows)

    def samples(self) -> DataFrame:
        """(s, ch, v): a row per sample and channel, ch counted from 0."""
        return self.rows.select("s", F.posexplode_outer("v").alias("ch", "v"))


def by_plane(info: VideoInfo, make: Callable[[int], Column]) -> Column:
    """make(plane) for the row's plane."""
    out = make(0)
    for p in range(1, info.format.planes):
        out = F.when(F.col("plane") == p, make(p)).otherwise(out)
    return out


def bound_to(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value) with value computed once per row, however often make refers to it (also within lambdas)."""
    return F.get(F.transform(F.array(value), make), 0)


def moved(clip: Clip, info: VideoInfo, to: Column, props: Callable[[DataFrame], DataFrame] | None = None) -> Clip:
    """Frames sent to the indices in the array `to` (a Column over n): selection, repetition and order without a join."""
    send = lambda df: df.select(F.explode(to).alias("_to"), *[c for c in df.columns if c != "n"]).withColumnRenamed("_to", "n")
    kept = send(clip.props)
    return Clip(info, send(clip.frames), props(kept) if props else kept)


def repeated(rows: DataFrame, index: str, length: int, first: int, last: int) -> DataFrame:
    """Rows 0 to length - 1 over and over, of which those from first to last are taken and counted from 0. Each row's
    places come in blocks, so that none holds a long array, however often it's repeated."""
    at = F.col(index)
    turn = lambda x, up: F.floor((F.lit(x).cast("long") - at + (length - 1 if up else 0)) / F.lit(length).cast("long"))
    low, high = turn(first, True), turn(last, False)
    block = 1 << 12
    blocks = F.when(low <= high, F.sequence(F.lit(0).cast("long"), F.floor((high - low) / block))).otherwise(F.array().cast("array<bigint>"))
    rest = [c for c in rows.columns if c != index]
    dealt = rows.select(at, *rest, low.alias("_low"), high.alias("_high"), F.explode(blocks).alias("_block"))
    start = F.col("_low") + F.col("_block") * block
    dealt = dealt.select(at, *rest, F.explode(F.sequence(start, F.least(F.col("_high"), start + block - 1))).alias("_turn"))
    return dealt.select((at + F.col("_turn") * length - first).alias(index), *rest)


def clamped(clip: Clip, length: int) -> Clip:
    """The clip cut or, with its last frame repeated, prolonged to a length."""
    if length == len(clip):
        return clip
    last = len(clip) - 1
    n = F.col("n")
    if length < len(clip):
        return clip.but(clip.info.but(length=length), clip.frames.where(n < length), clip.props.where(n < length))
    return moved(clip, clip.info.but(length=length), F.when(n == last, F.sequence(F.lit(last).cast("long"), F.lit(length - 1).cast("long"))).otherwise(F.array(n)))


def joined(clips: list[Clip], length: int | None = None) -> DataFrame:
    """(n, plane, a0, a1, ..) of clips of the same size, all clamped to a length (the first's)."""
    length = length or len(clips[0])
    out = clamped(clips[0], length).frames.withColumnRenamed("data", "a0")
    for i, c in enumerate(clips[1:], 1):
        out = out.join(clamped(c, length).frames.withColumnRenamed("data", f"a{i}"), ["n", "plane"])
    return out


def neighbours(df: DataFrame, length: int, radius: int, columns: list[str]) -> DataFrame:
    """df's rows with, for each column c, c_k for k in -radius..radius: its value k frames on, at the ends the end's.

    Frames are dealt in blocks of HALO, each with the frames around it, so no window spans the whole clip."""
    n = F.col("n")
    keys = [c for c in df.columns if c == "plane"]
    low, high = F.floor((n - radius) / HALO), F.floor((n + radius) / HALO)
    last = (length - 1) // HALO
    dealt = df.withColumn("_block", F.explode(F.sequence(F.greatest(low, F.lit(0).cast("long")), F.least(high, F.lit(last).cast("long")))))
    over = Window.partitionBy(*keys, "_block").orderBy("n")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    more = {}
    for c in columns:
        for k in range(-radius, radius + 1):
            if k < 0:
                more[f"{c}_{k}"] = F.coalesce(F.lag(c, -k).over(over), F.first(c).over(whole))
            else:
                more[f"{c}_{k}"] = F.coalesce(F.lead(c, k).over(over), F.last(c).over(whole)) if k else F.col(c)
    return dealt.withColumns(more).where(F.floor(n / HALO) == F.col("_block")).drop("_block")


def same_format(clips: list[Clip], name: str, depth: bool = True) -> None:
    first = clips[0].info
    for c in clips[1:]:
        i = c.info
        need((i.width, i.height) == (first.width, first.height), f"{name}: sizes differ")
        need(i.format == first.format if depth else (i.format.planes, i.format.ss_w, i.format.ss_h) == (first.format.planes, first.format.ss_w, first.format.ss_h), f"{name}: formats differ")


def chosen(info: VideoInfo, planes: list[int] | None, name: str) -> set[int]:
    """The planes to process; all by default."""
    if not planes:
        return set(range(info.format.planes))
    need(all(0 <= p < info.format.planes for p in planes), f"{name}: no such plane")
    need(len(set(planes)) == len(planes), f"{name}: a plane is given twice")
    return set(planes)


def mapped(clip: Clip, planes: set[int], make: Callable[[int], Column], info: VideoInfo | None = None) -> Clip:
    """data replaced on some planes by make(plane), a Column over data."""
    every = set(range(clip.info.format.planes))
    if planes == every and len(every) == 1:
        data = make(0)
    else:
        data = by_plane(clip.info, lambda p: make(p) if p in planes else F.col("data"))
    return clip.but(info, clip.frames.select("n", "plane", data.alias("data")))
