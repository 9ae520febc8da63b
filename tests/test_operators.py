"""Operators against worked values, and the queries against their SQL counterparts."""

import io

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import registry
from tessella.clip import Clip
from tessella.functions.rpn import compiled
from tessella.info import GRAY, INTEGER, YUV, OperatorError, VideoFormat, VideoInfo, reduced
from tessella.plans import catalog
from tessella.sources import sinks, tables

SF = "/root/testdata/sf0.001"
TABLES = ("events", "embeddings")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(r) for r in df.select(cols).collect()), key=repr)
    found = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    assert mine == sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=repr)


# inputs, expression, value of the first sample; fixed values
GOLDEN = [
    ((58,), "x 2 *", 116), ((57,), "x 2 /", 28), ((58,), "x 2 / 0.1 +", 29), ((58,), "x -1 * abs", 58), ((58,), "x sqrt", 8), ((58,), "x dup -", 0),
    ((58,), "2 x swap /", 29), ((58,), "40 x min", 40), ((2,), "x exp", 7), ((3,), "x exp", 20), ((58,), "x log", 4), ((58,), "10 x <", 1),
    ((58,), "58 x <=", 1), ((0, 58), "x y and", 0), ((0, 58), "x y xor", 1), ((8, 7), "x y xor", 0), ((100, 200, 0), "z x y ?", 200),
    ((100, 200, 100), "z not x y ?", 200), ((3,), "x 2 pow", 9), ((10, 2, 3), "x y z swap2 * +", 23), ((10, 2, 3), "x y z swap1 * +", 16),
    ((10, 2, 3), "x dup0 dup1 dup2 y swap3 z * + + swap / +", 35), ((10, 2, 3), "10 dup0 dup1 dup2 2 swap3 3 * + + swap / +", 35), ((10, 2, 3), "x dup0 10 dup2 y swap3 3 * + + swap / +", 35),
    ((58,), "x 10 +", 68), ((58,), "x 28 -", 30), ((58,), "x dup +", 116), ((58,), "x 60 max", 60), ((0,), "x exp", 1), ((58,), "x log exp", 58), ((4,), "x x 1 - =", 0),
    ((100, 200, 1), "z x y ?", 100), ((100, 200, 0), "z not x y ?", 100), ((58,), "x not", 0), ((58,), "x not not", 1), ((6,), "2 x pow", 64), ((10, 2, 3), "10 2 3 swap2 * +", 23), ((10, 2, 3), "10 2 3 swap1 * +", 16),
]
#: Every comparison of less, equal and greater, with the sample on either side; every logical operation.
COMPARED = {"<": int.__lt__, ">": int.__gt__, "<=": int.__le__, ">=": int.__ge__, "=": int.__eq__}
GOLDEN += [((58,), f"{a} {b} {op}", int(f(58 if a == "x" else int(a), 58 if b == "x" else int(b)))) for op, f in COMPARED.items() for a, b in (("x", "10"), ("10", "x"), ("58", "x"), ("x", "58"))]
GOLDEN += [((a, b), f"x y {op}", int(f(a > 0, b > 0))) for op, f in {"and": bool.__and__, "or": bool.__or__, "xor": bool.__xor__}.items() for a in (0, 1, 8) for b in (0, 7, 58)]


def test_expressions(spark):
    cols = [F.least(F.greatest(F.rint(compiled(text, [F.lit(v) for v in values])), F.lit(0.0)), F.lit(255.0)).cast("int").alias(f"c{i}") for i, (values, text, _) in enumerate(GOLDEN)]
    assert list(spark.range(1).select(cols).head()) == [x for *_, x in GOLDEN]


@pytest.mark.parametrize("text", ["", "x x", "x +", "y", "x foo"])
def test_bad_expressions(spark, text):
    with pytest.raises(OperatorError):
        compiled(text, [F.lit(1)])


def test_formats():
    assert VideoFormat(YUV, INTEGER, 10, 1, 1).name == "YUV420P10" and VideoFormat(GRAY).name == "Gray8"
    assert VideoFormat.of_id(VideoFormat(YUV, INTEGER, 16, 2, 0).id) == VideoFormat(YUV, INTEGER, 16, 2, 0)
    assert reduced(60000, 2002) == (30000, 1001) and reduced(0, 5) == (0, 0)
    with pytest.raises(OperatorError):
        VideoInfo(VideoFormat(YUV, INTEGER, 8, 1, 1), 5, 4, 1)


def test_binding(spark):
    blank = registry.bound("std").BlankClip
    assert blank(width=50, length=1).info.width == 50 and blank(width=[50], length=1).info.width == 50 and blank(width_=50, length=1).info.width == 50
    for bad in ({"width": [50, 50]}, {"widths": 5}, {"width": "5"}):
        with pytest.raises(OperatorError):
            blank(**bad)
    with pytest.raises(OperatorError):
        registry.bound("std").Trim()
    assert blank(clip=None).info.length == 240


def clip_of(spark, rows, width, height) -> Clip:
    frames = spark.createDataFrame([(n, 0, d) for n, d in enumerate(rows)], "n long, plane int, data array<int>")
    return Clip(VideoInfo(VideoFormat(GRAY), width, height, len(rows)), frames)


def test_clip_protocol(spark):
    clip = clip_of(spark, [[n] * 16 for n in range(6)], 4, 4)
    order = lambda c: [c.frame(n)[0][0] for n in range(len(c))]
    assert order(clip[4:0:-2]) == [4, 2] and order(clip[1] + clip[5]) == [1, 5] and order(clip[:2] * 2) == [0, 1, 0, 1]
    with pytest.raises(IndexError):
        clip[6]


def test_errors(spark):
    clip = clip_of(spark, [list(range(16))] * 2, 4, 4)
    for call in (lambda: clip.std.Trim(first=2), lambda: clip.std.DeleteFrames([0, 1]), lambda: clip.std.Lut(lut=[0] * 255), lambda: clip.std.Limiter(min=5, max=4), lambda: clip.std.Crop(left=4), lambda: clip.std.Invert(planes=3), lambda: clip.std.Convolution([1] * 8), lambda: clip.std.BoxBlur(hradius=0, vradius=0)):
        with pytest.raises(OperatorError):
            call()
    with pytest.raises(Exception, match="illegal value"):
        clip.std.PEMVerifier(upper=[7.0]).frames.collect()


def test_y4m(spark):
    import io

    from tessella.sources import sinks, tables

    out = io.BytesIO()
    sinks.write_raw(clip_of(spark, [[1, 2, 3, 4], [5, 6, 7, 8]], 2, 2), out, y4m=True)
    assert out.getvalue() == b"YUV4MPEG2 Cmono W2 H2 F24:1 Ip A0:0 XLENGTH=2\nFRAME\n\x01\x02\x03\x04FRAME\n\x05\x06\x07\x08"


@pytest.mark.parametrize("name", ["std_box_blur", "resize_bicubic", "std_turn90"])
def test_no_operator_is_put_into_a_filter(spark, name):
    """What makes a sample array stays out of the scan's filters and out of other lambdas."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if line.strip(" :+-").startswith("Filter") and "transform" in line]


def test_endless_loops_are_taken_by_range(spark):
    clip = registry.bound("std").BlankClip(format=VideoFormat(GRAY, INTEGER, 8).id, width=4, height=2, length=3).std.FrameEval(lambda n: n, clip_src=[registry.bound("std").BlankClip(format=VideoFormat(GRAY, INTEGER, 8).id, width=4, height=2, length=3, color=[c]) for c in (5, 6, 7)])
    far = clip.std.Loop().std.Trim(first=2**31 - 10, length=5)
    assert [far.frame(n)[0][0] for n in range(5)] == [5 + (2**31 - 10 + n) % 3 for n in range(5)]
    many = clip.std.Loop(times=5000)
    assert len(many) == 15000 and many.frames.count() == 15000 and many.frame(14999)[0][0] == 7
    assert many.frames.select("n").distinct().count() == 15000


def test_widened_samples_keep_their_values(spark, tmp_path):
    """Ids far beyond those of the small tables: samples that don't fit 16 bits, and not 32 bits once widened."""
    events = [(0, 0.5, 0), (1, 490.0, 238), (2, 560.0, 239), (3, 12.5, 1499), (4, 0.0, 89999)]
    spark.createDataFrame(events, "event_id long, value double, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = duckdb.connect()
    found.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    rows = catalog.QUERIES["std_audio_resample_format"](spark, str(tmp_path)).select("s", "ch", "v").collect()
    assert sorted(map(tuple, rows)) == sorted(found.execute(f"SELECT s, ch, v FROM ({catalog.ORACLES['std_audio_resample_format']})").fetchall())
    assert (4, 1, (89999 - 75) * 200 * 256) in map(tuple, rows)


def test_wave64(spark):
    audio = registry.bound("std").BlankAudio(channels=[0, 1], samplerate=8000, length=40, waveform="square", amplitude=0.5)
    plain, wide, riff = io.BytesIO(), io.BytesIO(), io.BytesIO()
    sinks.write_wav(audio, plain, header=False)
    sinks.write_w64(audio, wide)
    sinks.write_wav(audio, riff)
    body = plain.getvalue()
    assert len(body) == 160 and riff.getvalue()[:4] == b"RIFF" and riff.getvalue()[44:] == body
    got = wide.getvalue()
    assert got[:4] == b"riff" and got[24:28] == b"wave" and got[40:44] == b"fmt " and got[80:84] == b"data" and got[104:] == body
    assert int.from_bytes(got[16:24], "little") == len(got) and int.from_bytes(got[96:104], "little") == 24 + len(body)


def test_raw_parts_are_the_stream(spark, tmp_path):
    clip = tables.yuv(spark, SF)
    whole = io.BytesIO()
    sinks.write_raw(clip, whole)
    rows = sinks.write_raw_parts(clip, f"{tmp_path}/raw").collect()
    parts = [open(f"{tmp_path}/raw/part-{r.part:06d}.raw", "rb").read() for r in rows]
    assert b"".join(parts) == whole.getvalue() and [len(x) for x in parts] == [r.bytes for r in rows]
    assert [r.offset for r in rows] == [sum(map(len, parts[:i])) for i in range(len(parts))] and sum(r.frames for r in rows) == len(clip)


def test_masks_follow_chroma_locations(spark):
    """Each location of chroma samples weighs a ramp of a mask at its own place; clips of different ones don't merge."""
    from tessella.operators.merge import SITES

    std = registry.bound("std")
    kind = VideoFormat(YUV, INTEGER, 8, 1, 1)
    black, white = (std.BlankClip(format=kind.id, width=8, height=8, length=1, color=[c] * 3) for c in (0, 255))
    mask = std.BlankClip(format=VideoFormat(GRAY, INTEGER, 8).id, width=8, height=8, length=1).std.ModifyFrame([std.BlankClip(length=1)], lambda n, f: [np.add.outer(20 * np.arange(8), 3 * np.arange(8))])
    for k, (dx, dy) in enumerate(SITES):
        out = std.MaskedMerge(*(c.std.SetFrameProp("_ChromaLocation", intval=k) for c in (black, white)), mask, first_plane=1).frame(0)[1]
        assert abs(out[5] - (20 * (2.5 + dy) + 3 * (2.5 + dx))) <= 0.5  # inside, a ramp is its value there
    with pytest.raises(Exception, match="chroma locations differ"):
        std.MaskedMerge(black, white.std.SetFrameProp("_ChromaLocation", intval=1), mask, first_plane=1).frame(0)


def test_transfers_invert_each_other(spark):
    from tessella.operators import resize

    names = ["srgb", "st2084", *resize.POWERS]
    v = F.col("id") / 20.0
    row = spark.range(21).select("id", *(F.abs(resize.coded(k, resize.light(k, v)) - v).alias(f"d{i}") for i, k in enumerate(names))).agg(*(F.max(f"d{i}").alias(f"d{i}") for i in range(len(names)))).head()
    assert all(x < 1e-6 for x in row)  # st2084 gives black a code value just above 0
    assert np.allclose(resize.gamut("470m", "2020") @ np.ones(3), 1) and np.allclose(resize.gamut("709", "709"), np.eye(3))
