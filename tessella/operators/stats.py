"""Statistics of frames and checks of their samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.clip import Clip, by_plane, clamped, joined, same_format
from tessella.info import need
from tessella.operators.point import spread
from tessella.operators.props import _value, with_values
from tessella.registry import operator


def plane_stats_rows(clip: Clip, other: Clip | None = None, plane: int = 0) -> DataFrame:
    """(n, low, high, average, difference) of a plane; difference is null without another clip."""
    need(0 <= plane < clip.info.format.planes, "PlaneStats: no such plane")
    if other is not None:
        same_format([clip, other], "PlaneStats")
    fmt = clip.info.format
    w, h = clip.info.size(plane)
    whole = float(w * h * (1 if fmt.is_float else fmt.top))
    kind = "double" if fmt.is_float else "long"
    total = lambda a: F.aggregate(a, F.lit(0).cast(kind), lambda s, v: s + v.cast(kind)) / F.lit(whole)
    rows = (joined([clip, other]) if other is not None else clip.frames.withColumnRenamed("data", "a0")).where(F.col("plane") == plane)
    apart = total(F.zip_with("a0", "a1", lambda a, b: F.abs(a - b))) if other is not None else F.lit(None).cast("double")
    return rows.select("n", F.array_min("a0").alias("low"), F.array_max("a0").alias("high"), total(F.col("a0")).alias("average"), apart.alias("difference"))


@operator("std", "PlaneStats", "clipa:clip clipb:clip? plane:int? prop:data?")
def plane_stats(clipa: Clip, clipb=None, plane=0, prop="PlaneStats") -> Clip:
    is_float = clipa.info.format.is_float
    edge = (lambda c: _value(f=F.array(F.col(c).cast("double")))) if is_float else (lambda c: _value(i=F.array(F.col(c).cast("long"))))
    values = {f"{prop}Min": edge("low"), f"{prop}Max": edge("high"), f"{prop}Average": _value(f=F.array("average"))}
    if clipb is not None:
        values[f"{prop}Diff"] = _value(f=F.array("difference"))
    rows = clipa.props.join(plane_stats_rows(clipa, clipb, plane), "n")
    return clipa.but(props=rows.select("n", with_values("props", values).alias("props")))


def bad_samples(clip: Clip, upper: list[float] | None = None, lower: list[float] | None = None) -> DataFrame:
    """(n, plane, y, x, v): the first sample of each frame that isn't finite or lies outside the bounds."""
    fmt = clip.info.format
    low, high = spread(lower, fmt.planes, fmt.low), spread(upper, fmt.planes, fmt.high)
    wrong = lambda v, p: (v < F.lit(low[p])) | (v > F.lit(high[p])) | (F.isnan(v.cast("double")) if fmt.is_float else F.lit(False))
    found = by_plane(clip.info, lambda p: F.get(F.filter(F.transform("data", lambda v, i: F.when(wrong(v, p), F.struct(i.alias("i"), v.alias("v")))), lambda s: s.isNotNull()), 0))
    width = by_plane(clip.info, lambda p: F.lit(clip.info.size(p)[0]))
    rows = clip.frames.select("n", "plane", found.alias("f"), width.alias("w")).where("f IS NOT NULL")
    first = rows.groupBy("n").agg(F.min_by(F.struct("plane", "f", "w"), "plane").alias("r"))
    return first.select("n", "r.plane", F.floor(F.col("r.f.i") / F.col("r.w")).cast("int").alias("y"), (F.col("r.f.i") % F.col("r.w")).alias("x"), F.col("r.f.v").alias("v"))


@operator("std", "PEMVerifier", "clip:clip upper:float[]? lower:float[]?")
def pem_verifier(clip: Clip, upper=None, lower=None) -> Clip:
    """Reading a frame with a bad sample stops with a message of its place."""
    fmt = clip.info.format
    low, high = spread(lower, fmt.planes, fmt.low), spread(upper, fmt.planes, fmt.high)

    def checked(p: int):
        w = clip.info.size(p)[0]
        text = lambda v, i: F.concat(F.lit(f"illegal value in plane {p} at y "), F.floor(i / w).cast("string"), F.lit(", x "), (i % w).cast("string"), F.lit(", frame "), F.col("n").cast("string"))
        bad = lambda v: (v < F.lit(low[p])) | (v > F.lit(high[p])) | (F.isnan(v.cast("double")) if fmt.is_float else F.lit(False))
        return F.transform("data", lambda v, i: F.when(bad(v), F.raise_error(text(v, i)).cast("float" if fmt.is_float else "int")).otherwise(v))

    return clip.but(frames=clip.frames.select("n", "plane", by_plane(clip.info, checked).alias("data")))


__all__ = ["clamped"]
