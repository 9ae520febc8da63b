"""Text about frames, as properties: a string per frame instead of drawn glyphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.clip import Clip
from tessella.operators.props import _value, with_values
from tessella.registry import operator


def _noted(clip: Clip, text: Column, prop: str) -> Clip:
    return clip.but(props=clip.props.select("n", with_values("props", {prop: _value(d=F.array(text))}).alias("props")))


@operator("text", "Text", "clip:clip text:data alignment:int? scale:int? prop:data?")
def text(clip: Clip, text: str, alignment=7, scale=1, prop="_Text") -> Clip:
    return _noted(clip, F.lit(text), prop)


@operator("text", "FrameNum", "clip:clip alignment:int? scale:int? prop:data?")
def frame_num(clip: Clip, alignment=7, scale=1, prop="_Text") -> Clip:
    return _noted(clip, F.col("n").cast("string"), prop)


@operator("text", "ClipInfo", "clip:clip alignment:int? scale:int? prop:data?")
def clip_info(clip: Clip, alignment=7, scale=1, prop="_Text") -> Clip:
    return _noted(clip, F.lit(clip.describe()), prop)


@operator("text", "CoreInfo", "clip:clip? alignment:int? scale:int? prop:data?")
def core_info(clip: Clip, alignment=7, scale=1, prop="_Text") -> Clip:
    return _noted(clip, F.lit(f"Spark {clip.spark.version}, {clip.spark.sparkContext.defaultParallelism} tasks at a time"), prop)


@operator("text", "FrameProps", "clip:clip props:data[]? alignment:int? scale:int? prop:data?")
def frame_props(clip: Clip, props=None, alignment=7, scale=1, prop="_Text") -> Clip:
    held = F.map_filter("props", lambda k, v: k.isin(list(props))) if props else F.col("props")
    shown = lambda v: F.concat_ws(", ", F.transform(F.coalesce(v["i"], F.array()), lambda x: x.cast("string")), F.transform(F.coalesce(v["f"], F.array()), lambda x: x.cast("string")), F.coalesce(v["d"], F.array()))
    lines = F.transform(F.array_sort(F.map_keys(held)), lambda k: F.concat(k, F.lit(": "), shown(F.element_at(held, k))))
    return _noted(clip, F.concat_ws("\n", lines), prop)
