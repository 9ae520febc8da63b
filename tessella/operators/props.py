"""Operators on frame properties: maps from a key to arrays of integers, floats or text."""

from __future__ import annotations

import re
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.clip import PROP, PROPS, Clip, clamped
from tessella.info import need
from tessella.registry import operator


def _value(i=None, f=None, d=None) -> Column:
    """A property's struct of arrays."""
    part = lambda x, kind: (F.lit(None) if x is None else x if isinstance(x, Column) else F.array(*map(F.lit, x))).cast(f"array<{kind}>")
    return F.struct(part(i, "bigint").alias("i"), part(f, "double").alias("f"), part(d, "string").alias("d")).cast(PROP)


def without(props: Column, keys: list[str]) -> Column:
    return F.map_filter(props, lambda k, v: ~k.isin(keys)) if keys else props


def with_values(props: str, values: dict[str, Column], drop: list[str] = ()) -> Column:
    """The map with keys replaced by structs and others dropped."""
    rest = without(F.col(props), [*values, *drop])
    if not values:
        return rest
    pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
    return F.map_concat(rest, F.create_map(*pairs).cast(PROPS))


def with_ints(props: str, values: dict[str, Column], drop: list[str] = ()) -> Column:
    return with_values(props, {k: _value(i=F.array(v)) for k, v in values.items()}, drop)


def rescaled_durations(df: DataFrame, num: int, den: int) -> DataFrame:
    """Durations times num / den, in lowest terms, where a frame has one."""
    g = gcd(num, den)
    n = F.get(F.col("props").getItem("_DurationNum")["i"], 0) * (num // g)
    d = F.get(F.col("props").getItem("_DurationDen")["i"], 0) * (den // g)
    # the fraction comes reduced, so only factors across it can still be shared
    step = F.struct(n.alias("a"), d.alias("b"))
    common = F.aggregate(F.sequence(F.lit(1), F.lit(64)), step, lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(F.struct(acc["b"].alias("a"), F.try_mod(acc["a"], acc["b"]).alias("b"))))["a"]
    have = (n > 0) & (d > 0)
    new = with_ints("props", {"_DurationNum": F.expr("_n div _g"), "_DurationDen": F.expr("_d div _g")})
    return df.withColumns({"_n": n, "_d": d, "_g": common, "_have": have}).select("n", F.when(F.col("_have"), new).otherwise(F.col("props")).alias("props"))


@operator("std", "SetFrameProp", "clip:clip prop:data intval:int[]? floatval:float[]? data:data[]?")
def set_frame_prop(clip: Clip, prop: str, intval=None, floatval=None, data=None) -> Clip:
    need(sum(x is not None for x in (intval, floatval, data)) == 1, "SetFrameProp: one kind of value")
    need(bool(re.fullmatch(r"[A-Za-z_]\w*", prop)), "SetFrameProp: not a property name")
    new = with_values("props", {prop: _value(intval, floatval, data)})
    return clip.but(props=clip.props.select("n", new.alias("props")))


def _of(x) -> Column:
    x = list(x) if isinstance(x, (list, tuple)) else [x]
    if all(isinstance(v, (bool, int)) for v in x):
        return _value(i=[int(v) for v in x])
    return _value(f=x) if all(isinstance(v, (int, float)) for v in x) else _value(d=x)


@operator("std", "SetFrameProps", "clip:clip values:any?")
def set_frame_props(clip: Clip, **values) -> Clip:
    return clip.but(props=clip.props.select("n", with_values("props", {k: _of(v) for k, v in values.items()}).alias("props")))


@operator("std", "RemoveFrameProps", "clip:clip props:data[]?")
def remove_frame_props(clip: Clip, props=None) -> Clip:
    if not props:
        return clip.but(props=clip.props.select("n", F.create_map().cast(PROPS).alias("props")))
    pattern = "|".join("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in p) for p in props)
    return clip.but(props=clip.props.select("n", F.map_filter("props", lambda k, v: ~k.rlike(f"^(?:{pattern})$")).alias("props")))


@operator("std", "CopyFrameProps", "clip:clip prop_src:clip props:data[]?")
def copy_frame_props(clip: Clip, prop_src: Clip, props=None) -> Clip:
    other = clamped(prop_src, len(clip)).props.select("n", F.col("props").alias("theirs"))
    both = clip.props.join(other, "n")
    new = F.col("theirs") if not props else F.map_concat(without(F.col("props"), list(props)), F.map_filter("theirs", lambda k, v: k.isin(list(props))))
    return clip.but(props=both.select("n", new.alias("props")))


@operator("std", "SetFieldBased", "clip:clip value:int")
def set_field_based(clip: Clip, value: int) -> Clip:
    need(0 <= value <= 2, "SetFieldBased: 0, 1 or 2")
    return clip.but(props=clip.props.select("n", with_ints("props", {"_FieldBased": F.lit(value).cast("long")}, ["_Field"]).alias("props")))


@operator("std", "ClipToProp", "clip:clip mclip:clip prop:data?")
def clip_to_prop(clip: Clip, mclip: Clip, prop="_Alpha") -> Clip:
    """mclip's frames ride along, as columns of the frames; the length is mclip's."""
    out = clamped(clip, len(mclip))
    extra = mclip.frames.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("plane", F.col("data").cast("array<double>")))).alias("planes"))
    rows = out.frames.drop("attached").join(extra, "n").withColumn("attached", F.create_map(F.lit(prop), F.col("planes")))
    new = Clip(out.info, rows, out.props)
    new.attached = {**getattr(clip, "attached", {}), prop: mclip.info}
    return new


@operator("std", "PropToClip", "clip:clip prop:data? index:int?")
def prop_to_clip(clip: Clip, prop="_Alpha", index=0) -> Clip:
    need(prop in getattr(clip, "attached", {}) and index == 0, "PropToClip: no frame is attached under that name")
    info = clip.attached[prop].but(length=len(clip))
    kind = "array<float>" if info.format.is_float else "array<int>"
    rows = clip.frames.where("plane = 0").select("n", F.explode(F.col("attached").getItem(prop)).alias("plane", "data"))
    return Clip(info, rows.select("n", "plane", F.col("data").cast(kind).alias("data")))
