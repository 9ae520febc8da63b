"""Operators that call functions of the user."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.clip import Clip, clamped
from tessella.info import need
from tessella.registry import operator


def _fits(clip: Clip, got: Clip) -> None:
    need((got.info.format, got.info.width, got.info.height) == (clip.info.format, clip.info.width, clip.info.height), "FrameEval: a frame of another format")


def _plain(props: dict) -> dict:
    """A property's values, whichever their kind."""
    return {k: next((x for x in v if x is not None), None) for k, v in props.items()}


@operator("std", "FrameEval", "clip:clip eval:func prop_src:clip[]? clip_src:clip[]?")
def frame_eval(clip: Clip, eval, prop_src=None, clip_src=None) -> Clip:
    """Frame n of the clip that eval(n), or eval(n, properties) chooses.

    With clip_src, eval gives the place of one of these clips and runs in tasks, so nothing passes through the
    driver. Without, it returns a clip of its own making: then it runs on the driver, once a frame, over properties
    that are streamed there, and runs of frames of one returned clip are kept as ranges."""
    if clip_src:
        for c in clip_src:
            _fits(clip, c)
        by_props = bool(prop_src)
        source = clamped(prop_src[0], len(clip)).props.select("n", "props") if by_props else clip.spark.range(len(clip)).select(F.col("id").alias("n"))

        def choices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                n = part.column(0).to_pylist()
                found = [eval(k, _plain({name: tuple(v.values()) for name, v in held})) for k, held in zip(n, part.column(1).to_pylist(), strict=True)] if by_props else list(map(eval, n))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int32())], ["n", "choice"])

        chosen = source.mapInArrow(choices, "n long, choice int")
        taken = lambda i: chosen.where(F.col("choice") == i).select("n")
    else:
        groups: dict[int, tuple[Clip, list[list[int]]]] = {}
        rows = ((r.n, (_plain(r.props),)) for r in clamped(prop_src[0], len(clip)).props.orderBy("n").toLocalIterator()) if prop_src else ((n, ()) for n in range(len(clip)))
        for n, more in rows:
            got = eval(n, *more)
            _fits(clip, got)
            ranges = groups.setdefault(id(got), (got, []))[1]
            if ranges and ranges[-1][1] == n - 1:
                ranges[-1][1] = n
            else:
                ranges.append([n, n])
        clip_src = [got for got, _ in groups.values()]
        spans = [ranges for _, ranges in groups.values()]
        taken = lambda i: clip.spark.createDataFrame(spans[i], "a long, b long").select(F.explode(F.sequence("a", "b")).alias("n"))
    frames = props = None
    for i, got in enumerate(clip_src):
        got, pick = clamped(got, len(clip)), taken(i)
        a, b = got.frames.join(pick, "n", "left_semi"), got.props.join(pick, "n", "left_semi")
        frames, props = (a, b) if frames is None else (frames.unionByName(a), props.unionByName(b))
    return Clip(clip.info, frames, props)


@operator("std", "ModifyFrame", "clip:clip clips:clip[] selector:func")
def modify_frame(clip: Clip, clips: list[Clip], selector) -> Clip:
    """selector(n, planes of each clip) gives a frame's planes, in tasks: planes are lists of numpy arrays, which are
    views of a batch's samples."""
    rows, shapes = None, []
    for i, c in enumerate(clips):
        planes = range(c.info.format.planes)
        own = clamped(c, len(clip)).frames.groupBy("n").agg(*(F.max(F.when(F.col("plane") == p, F.col("data"))).alias(f"c{i}_{p}") for p in planes))
        rows = own if rows is None else rows.join(own, "n")
        shapes.append([c.info.size(p)[::-1] for p in planes])
    info, kind = clip.info, np.dtype(np.float32 if clip.info.format.is_float else np.int32)
    names = [[f"c{i}_{p}" for p in range(len(s))] for i, s in enumerate(shapes)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            held = {name: part.column(part.schema.get_field_index(name)).flatten().to_numpy().astype(float) for own in names for name in own}
            whole = [[held[name].reshape(part.num_rows, *size) for name, size in zip(own, sizes, strict=True)] for own, sizes in zip(names, shapes, strict=True)]
            n, plane, data = [], [], []
            for k, frame in enumerate(part.column(0).to_pylist()):
                for p, x in enumerate(selector(frame, [[x[k] for x in own] for own in whole])):
                    x = np.asarray(x)
                    if x.shape != info.size(p)[::-1]:
                        raise ValueError("ModifyFrame: a plane of another size")
                    n.append(frame)
                    plane.append(p)
                    data.append(x.ravel().astype(kind))
            edges = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(data) if data else np.zeros(0, kind)))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(plane, pa.int32()), values], ["n", "plane", "data"])

    order = rows.select("n", *(name for own in names for name in own))
    return clip.but(frames=order.mapInArrow(run, f"n long, plane int, data array<{'float' if info.format.is_float else 'int'}>"))
