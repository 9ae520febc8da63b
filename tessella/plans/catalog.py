"""The named queries of the library and their SQL counterparts: one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.clip import Audio, Clip
from tessella.info import GRAY, INTEGER, RGB, YUV, AudioInfo, VideoFormat, VideoInfo  # noqa: F401
from tessella.operators import audio, resize, stats
from tessella.plans import sql
from tessella.plans.sql import A16, COUNT, E8, EF, EVENTS, P8, R8, Y8
from tessella.registry import bound
from tessella.sources import sinks, tables
from tessella.streaming import samples as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "flagship_smoothed_bright_frames"


def shown(clip: Clip, places: int = 4) -> DataFrame:
    """A clip's samples in the columns of the counterparts."""
    v = F.round(F.col("v").cast("double"), places) if clip.info.format.is_float else F.col("v").cast("long")
    return clip.samples().select(*(F.col(c).cast("long").alias(c) for c in ("n", "plane", "y", "x")), v.alias("v"))


def heard(clip: Audio) -> DataFrame:
    return clip.samples().select(*(F.col(c).cast("long").alias(c) for c in ("s", "ch", "v")))


def add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def gray(name: str, apply: Callable[[Clip], Clip], oracle: str | None, bits: int = 8) -> None:
    add(name, lambda spark, d: shown(apply(tables.gray(spark, d, bits))), oracle)


def colour(name: str, apply: Callable[[Clip], Clip], oracle: str, halved: bool = False) -> None:
    add(name, lambda spark, d: shown(apply((tables.yuv if halved else tables.rgb)(spark, d))), oracle)


def sound(name: str, apply: Callable[[Audio], Audio], oracle: str) -> None:
    add(name, lambda spark, d: heard(apply(tables.audio(spark, d))), oracle)


def ints(clip: Clip, *keys: str) -> DataFrame:
    """(n, key, ..): integer properties, null where a frame has none."""
    return clip.props.select("n", *(F.get(F.col("props").getItem(k)["i"], 0).alias(k.strip("_").lower()) for k in keys))


# -- samples ----------------------------------------------------------------------------------------
gray("std_invert", lambda c: c.std.Invert(), sql.point("255 - v"))
gray("std_invert_float", lambda c: c.std.Invert(), sql.point("1 - v", EF, "ef", True), 32)
colour("std_invert_mask", lambda c: c.std.InvertMask(planes=[1, 2]), sql.point("CASE WHEN plane = 0 THEN v ELSE 255 - v END", Y8, "y8"), True)
gray("std_limiter", lambda c: c.std.Limiter(min=90, max=[150.4]), sql.point("least(greatest(v, 90), 150)"))
gray("std_binarize", lambda c: c.std.Binarize(threshold=120, v0=5, v1=250), sql.point("CASE WHEN v < 120 THEN 5 ELSE 250 END"))
colour("std_binarize_mask", lambda c: c.std.BinarizeMask(), sql.point("CASE WHEN v < 128 THEN 0 ELSE 255 END", Y8, "y8"), True)
gray("std_levels", lambda c: c.std.Levels(min_in=40, max_in=220, gamma=1.0, min_out=16, max_out=235), sql.point("floor(least(greatest(greatest(least(v, 220) - 40, 0)::DOUBLE / 180 * 219 + 16, 0), 255) + 0.5)"))
gray("std_levels_gamma", lambda c: c.std.Levels(gamma=2.0), sql.point("floor(pow(v::DOUBLE / 255, 0.5) * 255 + 0.5)"))
gray("std_lut", lambda c: c.std.Lut(function=lambda x: (x * 7 + 3) % 256), sql.point("(v * 7 + 3) % 256"))
gray("std_lut_float", lambda c: c.std.Lut(function=lambda x: x / 512, floatout=1), sql.point("v / 512.0", is_float=True))
gray("std_lut2", lambda c: c.std.Lut2(c.std.Reverse(), function=lambda x, y: (2 * x + y) % 256), sql.pair("(2 * a.v + b.v) % 256", sql.BACK))
_half = "round_even(CAST(CAST(a.v AS FLOAT) * CAST(0.5 AS FLOAT) + CAST(b.v AS FLOAT) AS DOUBLE), 0)"
gray("std_expr", lambda c: bound("std").Expr([c, c.std.Trim(last=99)], "x 0.5 * y +"), sql.pair(f"least(greatest({_half}, 0), 255)", sql.HELD))
gray("std_expr_logic", lambda c: bound("std").Expr([c], "x 100 > x 200 < and x 255 x - ? dup 3 max swap 250 min min"), sql.point("least(CASE WHEN v > 100 AND v < 200 THEN v ELSE 255 - v END, 250)"))
gray("std_expr_sqrt", lambda c: bound("std").Expr([c], "x sqrt 15 *"), sql.point("least(round_even(CAST(CAST(sqrt(CAST(v AS DOUBLE)) AS FLOAT) * CAST(15 AS FLOAT) AS DOUBLE), 0), 255)"))

# -- several clips ----------------------------------------------------------------------------------
gray("std_merge", lambda c: c.std.Merge(c.std.Reverse(), weight=0.3), sql.pair("a.v + CAST(floor(((b.v - a.v) * 9830 + 16384) / 32768.0) AS BIGINT)", sql.BACK))
gray("std_make_diff", lambda c: c.std.MakeDiff(c.std.Reverse()), sql.pair("least(greatest(a.v - b.v + 128, 0), 255)", sql.BACK))
gray("std_merge_diff", lambda c: c.std.MergeDiff(c.std.Reverse()), sql.pair("least(greatest(a.v + b.v - 128, 0), 255)", sql.BACK))
gray("std_make_full_diff", lambda c: c.std.MakeFullDiff(c.std.Reverse()), sql.pair("a.v - b.v + 256", sql.BACK))
gray("std_merge_full_diff", lambda c: c.std.Reverse().std.MergeFullDiff(c.std.MakeFullDiff(c.std.Reverse())), sql.point("v"))
gray("std_masked_merge", lambda c: c.std.MaskedMerge(c.std.Reverse(), c.std.Trim(last=99)), sql.video(E8 + f", b AS ({sql.BACK}), m AS ({sql.HELD})", "e8.n, e8.plane, e8.y, e8.x, ((255 - m.v) * e8.v + m.v * b.v + 127) // 255 AS v", "e8 JOIN b USING (n, plane, y, x) JOIN m USING (n, plane, y, x)"))
gray("std_premultiply", lambda c: c.std.PreMultiply(c.std.Reverse()), sql.pair("sign(a.v - 16) * floor((abs(a.v - 16) * b.v + 127) / 255) + 16", sql.BACK))

_first = lambda c: bound("std").ShufflePlanes([c], [0], GRAY)
_sited = lambda dx, dy: sql.sited(resize.taps("Bilinear", 8, 4, dx), resize.taps("Bilinear", 8, 4, dy))
_reversed = "b AS (SELECT (SELECT max(n) FROM y8) - n AS n, plane, y, x, v FROM y8)"
_masked = lambda dx, dy: sql.video(f"{Y8}, {_reversed}, {_sited(dx, dy)}", "a.n, a.plane, a.y, a.x, ((255 - m.v) * a.v + m.v * b.v + 127) // 255 AS v", "y8 a JOIN b USING (n, plane, y, x) JOIN m USING (n, plane, y, x)")
colour("std_masked_merge_chroma", lambda c: c.std.MaskedMerge(c.std.Reverse(), _first(c), first_plane=1), _masked(-0.5, 0.0), True)
colour("std_masked_merge_chroma_sited", lambda c: (lambda t: t.std.MaskedMerge(t.std.Reverse(), _first(c), first_plane=1))(c.std.SetFrameProp("_ChromaLocation", intval=5)), _masked(0.0, 0.5), True)
colour("std_premultiply_chroma", lambda c: c.std.PreMultiply(_first(c)), sql.video(f"{Y8}, {_sited(-0.5, 0.0)}, o AS (SELECT y8.n, plane, y, x, y8.v - CASE plane WHEN 0 THEN 16 ELSE 128 END AS d, CASE plane WHEN 0 THEN 16 ELSE 128 END AS base, m.v AS m FROM y8 JOIN m USING (n, plane, y, x))", "n, plane, y, x, sign(d) * floor((abs(d) * m + 127) / 255) + base AS v", "o"), True)
colour("std_merge_chroma", lambda c: c.std.Merge(c.std.Reverse(), weight=[0.3, 0.5]), sql.video(f"{Y8}, {_reversed}", "a.n, a.plane, a.y, a.x, a.v + CAST(floor(((b.v - a.v) * CASE a.plane WHEN 0 THEN 9830 ELSE 16384 END + 16384) / 32768.0) AS BIGINT) AS v", "y8 a JOIN b USING (n, plane, y, x)"), True)
colour("std_make_diff_chroma", lambda c: c.std.MakeDiff(c.std.Reverse()), sql.video(f"{Y8}, {_reversed}", "a.n, a.plane, a.y, a.x, least(greatest(a.v - b.v + 128, 0), 255) AS v", "y8 a JOIN b USING (n, plane, y, x)"), True)

# -- the frame index --------------------------------------------------------------------------------
gray("std_trim", lambda c: c.std.Trim(first=10, length=90), sql.resampled("SELECT range AS n, range + 10 AS src FROM range(90)", "e8"))
gray("std_reverse", lambda c: c.std.Reverse(), sql.resampled(f"SELECT range AS n, {COUNT} - 1 - range AS src FROM range({COUNT})", "e8"))
gray("std_loop", lambda c: c.std.Loop(times=3), sql.resampled(f"SELECT range AS n, range % {COUNT} AS src FROM range(3 * {COUNT})", "e8"))
gray("std_loop_endless", lambda c: c.std.Loop(times=0).std.Trim(first=len(c) - 7, length=2 * len(c) + 20), sql.resampled(f"SELECT range AS n, (range + {COUNT} - 7) % {COUNT} AS src FROM range(2 * {COUNT} + 20)", "e8"))
gray("std_select_every", lambda c: c.std.SelectEvery(cycle=3, offsets=[2, 0]), sql.video(E8 + f", k AS (SELECT unnest([0, 1]) AS j, unnest([2, 0]) AS o)", "n // 3 * 2 + CASE WHEN n >= " + COUNT + " // 3 * 3 THEN 0 ELSE j END AS n, plane, y, x, v", "e8 JOIN k ON n % 3 = o"))
gray("std_duplicate_frames", lambda c: c.std.DuplicateFrames([3, 3, 9]), sql.resampled(f"SELECT range AS n, CASE WHEN range <= 3 THEN range WHEN range <= 5 THEN 3 WHEN range <= 11 THEN range - 2 WHEN range = 12 THEN 9 ELSE range - 3 END AS src FROM range({COUNT} + 3)", "e8"))
gray("std_delete_frames", lambda c: c.std.DeleteFrames([0, 5, 6]), sql.resampled(f"SELECT range AS n, CASE WHEN range < 4 THEN range + 1 ELSE range + 3 END AS src FROM range({COUNT} - 3)", "e8"))
gray("std_freeze_frames", lambda c: c.std.FreezeFrames([2, 7], [4, 8], [9, 3]), sql.resampled(f"SELECT range AS n, CASE WHEN range BETWEEN 2 AND 4 THEN 9 WHEN range BETWEEN 7 AND 8 THEN 3 ELSE range END AS src FROM range({COUNT})", "e8"))
gray("std_splice", lambda c: c + c.std.Reverse(), sql.resampled(f"SELECT range AS n, CASE WHEN range < {COUNT} THEN range ELSE 2 * {COUNT} - 1 - range END AS src FROM range(2 * {COUNT})", "e8"))
gray("std_interleave", lambda c: bound("std").Interleave([c, c.std.Trim(first=20)], extend=1), sql.resampled(f"SELECT range AS n, CASE range % 2 WHEN 0 THEN range // 2 ELSE least(20 + range // 2, {COUNT} - 1) END AS src FROM range(2 * {COUNT})", "e8"))
gray("clip_slicing", lambda c: c[30:10:-3], sql.resampled("SELECT range AS n, 30 - 3 * range AS src FROM range(7)", "e8"))
add("std_assume_fps", lambda spark, d: ints(tables.gray(spark, d).std.AssumeFPS(fpsnum=60000, fpsden=2002), "_DurationNum", "_DurationDen"), "SELECT vec_id AS n, 1001::BIGINT AS durationnum, 30000::BIGINT AS durationden FROM embeddings")
add("std_select_every_durations", lambda spark, d: ints(tables.gray(spark, d).std.SelectEvery(cycle=6, offsets=[1, 4]), "_DurationNum", "_DurationDen"), f"SELECT range AS n, 1::BIGINT AS durationnum, 8::BIGINT AS durationden FROM range({COUNT} // 6 * 2 + CASE WHEN {COUNT} % 6 > 4 THEN 2 WHEN {COUNT} % 6 > 1 THEN 1 ELSE 0 END)")
_three = E8 + f", w AS (SELECT unnest([-1, 0, 1]) AS k, unnest([1, 2, 1]) AS w), m AS (SELECT range AS n, k, w, least(greatest(range + k, 0), {COUNT} - 1) AS src FROM range({COUNT}), w)"
gray("std_average_frames", lambda c: c.std.AverageFrames(weights=[1, 2, 1]), sql.video(_three + ", s AS (SELECT m.n, plane, y, x, sum(v * w) AS t FROM m JOIN e8 ON e8.n = src GROUP BY m.n, plane, y, x)", "n, plane, y, x, least(greatest(round_even(CAST(CAST(t AS FLOAT) * CAST(0.25 AS FLOAT) AS DOUBLE), 0), 0), 255) AS v", "s"))
gray("std_average_frames_scenes", lambda c: c.std.AverageFrames(weights=[1, 2, 1], scenechange=1), sql.video(E8 + ", " + P8 + f", m AS (SELECT n, k, CASE k WHEN 0 THEN 2 ELSE 1 END AS w, CASE WHEN k = -1 AND prev = 1 OR k = 1 AND next = 1 THEN n ELSE least(greatest(n + k, 0), {COUNT} - 1) END AS src FROM p, (SELECT unnest([-1, 0, 1]) AS k)), s AS (SELECT m.n, plane, y, x, sum(v * w) AS t FROM m JOIN e8 ON e8.n = src GROUP BY m.n, plane, y, x)", "n, plane, y, x, round_even(CAST(CAST(t AS FLOAT) * CAST(0.25 AS FLOAT) AS DOUBLE), 0) AS v", "s"))
gray("std_average_frames_clips", lambda c: bound("std").AverageFrames([c, c.std.Reverse()], weights=[3, 1]), sql.pair("round_even(CAST(CAST(3 * a.v + b.v AS FLOAT) * CAST(0.25 AS FLOAT) AS DOUBLE), 0)", sql.BACK))
gray("std_separate_fields", lambda c: c.std.SeparateFields(tff=1), sql.video(E8, "2 * n + y % 2 AS n, plane, y // 2 AS y, x, v", "e8"))
gray("std_double_weave", lambda c: c.std.SeparateFields(tff=1).std.DoubleWeave(tff=1), sql.video(E8 + f", fl AS (SELECT 2 * n + y % 2 AS n, y // 2 AS y, x, v FROM e8), m AS (SELECT range AS n, unnest([0, 1]) AS par FROM range(2 * {COUNT}))", "m.n, 0 AS plane, 2 * fl.y + par AS y, fl.x, fl.v", f"m JOIN fl ON fl.n = CASE WHEN m.n = 2 * {COUNT} - 1 THEN m.n WHEN m.n % 2 = par THEN m.n ELSE m.n + 1 END"))

# -- neighbourhoods ---------------------------------------------------------------------------------
gray("std_minimum", lambda c: c.std.Minimum(), sql.near(f"least({sql.taps('v')})"))
gray("std_maximum", lambda c: c.std.Maximum(threshold=10, coordinates=[0, 1, 0, 1, 1, 0, 1, 0]), sql.near(f"least(greatest(v, {', '.join(sql.tap(*d) for d in [(-1, 0), (0, -1), (0, 1), (1, 0)])}), v + 10)"))
gray("std_median", lambda c: c.std.Median(), sql.near(f"list_sort([{sql.taps('v')}])[5]"))
_mean = f"(({' + '.join(sql.tap(*d) for d in sql.AROUND)}) + 4) // 8"
gray("std_deflate", lambda c: c.std.Deflate(threshold=6), sql.near(f"greatest(least({_mean}, v), v - 6)"))
gray("std_inflate", lambda c: c.std.Inflate(), sql.near(f"greatest({_mean}, v)"))
gray("std_convolution", lambda c: c.std.Convolution([1, 2, 1, 2, 4, 2, 1, 2, 1]), sql.convolved([1, 2, 1, 2, 4, 2, 1, 2, 1], 16))
gray("std_convolution_edges", lambda c: c.std.Convolution([-1, -1, -1, -1, 8, -1, -1, -1, -1], bias=1, saturate=0), sql.convolved([-1, -1, -1, -1, 8, -1, -1, -1, -1], 1, 1, False))
gray("std_convolution_square", lambda c: c.std.Convolution(list(range(1, 26))), sql.convolved(list(range(1, 26)), 325, places=[(k // 5 - 2, k % 5 - 2) for k in range(25)], mirror=True))
gray("std_convolution_across", lambda c: c.std.Convolution([1, 3, 4, 3, 1], mode="h"), sql.convolved([1, 3, 4, 3, 1], 12, places=[(0, k - 2) for k in range(5)], mirror=True))
gray("std_prewitt", lambda c: c.std.Prewitt(), sql.edges(1))
gray("std_sobel", lambda c: c.std.Sobel(), sql.edges(2))
_row = lambda src, name, up, across: f"{name} AS (SELECT s.n, 0 AS plane, s.y, s.x, CAST(floor((sum(t.v) + {4 if up else 0}) / 5) AS BIGINT) AS v FROM {src} s, (SELECT unnest([-2, -1, 0, 1, 2]) AS k) JOIN {src} t ON t.n = s.n AND " + ("t.y = s.y AND t.x = least(greatest(s.x + k, 0), 7)" if across else "t.x = s.x AND t.y = least(greatest(s.y + k, 0), 7)") + " GROUP BY s.n, s.y, s.x)"
gray("std_box_blur", lambda c: c.std.BoxBlur(hradius=2, hpasses=2, vradius=2, vpasses=1), sql.video(", ".join([E8, _row("e8", "b1", True, True), _row("b1", "b2", False, True), _row("b2", "b3", True, False)]), "n, plane, y, x, v", "b3"))

# -- geometry and planes ----------------------------------------------------------------------------
gray("std_crop", lambda c: c.std.Crop(left=2, right=1, top=3), sql.video(E8, "n, plane, y - 3 AS y, x - 2 AS x, v", "e8", where="y >= 3 AND x BETWEEN 2 AND 6"))
colour("std_crop_rel", lambda c: c.std.CropRel(left=2, bottom=4), sql.video(Y8, "n, plane, y, x - CASE plane WHEN 0 THEN 2 ELSE 1 END AS x, v", "y8", where="CASE plane WHEN 0 THEN x >= 2 AND y < 4 ELSE x >= 1 AND y < 2 END"), True)
gray("std_crop_abs", lambda c: c.std.CropAbs(4, 5, left=1, top=2), sql.video(E8, "n, plane, y - 2 AS y, x - 1 AS x, v", "e8", where="y BETWEEN 2 AND 6 AND x BETWEEN 1 AND 4"))
gray("std_add_borders", lambda c: c.std.AddBorders(left=1, bottom=2, color=[77]), sql.video(E8 + f", c AS (SELECT n.range AS n, y.range AS y, x.range AS x FROM range({COUNT}) n, range(10) y, range(9) x)", "c.n, 0 AS plane, c.y, c.x, coalesce(e8.v, 77) AS v", "c LEFT JOIN e8 ON e8.n = c.n AND e8.y = c.y AND e8.x = c.x - 1"))
gray("std_flip_vertical", lambda c: c.std.FlipVertical(), sql.video(E8, "n, plane, 7 - y AS y, x, v", "e8"))
gray("std_flip_horizontal", lambda c: c.std.FlipHorizontal(), sql.video(E8, "n, plane, y, 7 - x AS x, v", "e8"))
gray("std_turn180", lambda c: c.std.Turn180(), sql.video(E8, "n, plane, 7 - y AS y, 7 - x AS x, v", "e8"))
gray("std_turn90", lambda c: c.std.Crop(bottom=2).std.Turn90(), sql.video(E8, "n, plane, x AS y, 5 - y AS x, v", "e8", where="y < 6"))
gray("std_turn270", lambda c: c.std.Crop(bottom=2).std.Turn270(), sql.video(E8, "n, plane, 7 - x AS y, y AS x, v", "e8", where="y < 6"))
gray("std_transpose", lambda c: c.std.Transpose(), sql.video(E8, "n, plane, x AS y, y AS x, v", "e8"))
_two = E8 + f", b AS ({sql.HELD})"
gray("std_stack_vertical", lambda c: bound("std").StackVertical([c, c.std.Trim(last=99)]), sql.video(_two, "n, plane, y, x, v", "(SELECT * FROM e8 UNION ALL SELECT n, plane, y + 8, x, v FROM b)"))
gray("std_stack_horizontal", lambda c: bound("std").StackHorizontal([c, c.std.Trim(last=99)]), sql.video(_two, "n, plane, y, x, v", "(SELECT * FROM e8 UNION ALL SELECT n, plane, y, x + 8, v FROM b)"))
colour("std_shuffle_planes", lambda c: bound("std").ShufflePlanes([c], [2, 0, 1], RGB), sql.video(R8, "n, (plane + 1) % 3 AS plane, y, x, v", "r8"))
colour("std_split_planes", lambda c: c.std.SplitPlanes()[1], sql.video(Y8, "n, 0 AS plane, y, x, v", "y8", where="plane = 1"), True)
add("std_blank_clip", lambda spark, d: shown(bound("std").BlankClip(width=4, height=2, format=VideoFormat(YUV, INTEGER, 8).id, length=5, color=[81.4, 90, 240])), "SELECT n.range AS n, p.range AS plane, y.range AS y, x.range AS x, CASE p.range WHEN 0 THEN 81 WHEN 1 THEN 90 ELSE 240 END::BIGINT AS v FROM range(5) n, range(3) p, range(2) y, range(4) x")
for _name in ("Bilinear", "Bicubic", "Point", "Lanczos", "Spline16", "Spline36", "Spline64"):
    gray(f"resize_{_name.lower()}", lambda c, k=_name: getattr(c.resize, k)(width=12, height=5), sql.scaled(resize.taps(_name, 8, 12), resize.taps(_name, 8, 5), 12, 5))
gray("resize_depth", lambda c: c.resize.Point(format=VideoFormat(GRAY, INTEGER, 10).id, range_s="full", range_in_s="full"), sql.point("round_even(round(v / 255.0 * 1023.0, 6), 0)"))
colour("resize_matrix", lambda c: c.resize.Point(format=VideoFormat(YUV, INTEGER, 8).id, matrix_s="709", range_s="limited"), sql.video(R8 + ", w AS (SELECT n, y, x, max(CASE plane WHEN 0 THEN v / 255.0 END) AS r, max(CASE plane WHEN 1 THEN v / 255.0 END) AS g, max(CASE plane WHEN 2 THEN v / 255.0 END) AS b FROM r8 GROUP BY n, y, x), l AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS l FROM w)", "n, plane, y, x, round_even(round(CASE plane WHEN 0 THEN l * 219 + 16 WHEN 1 THEN (b - l) / 1.8556 * 224 + 128 ELSE (r - l) / 1.5748 * 224 + 128 END, 6), 0) AS v", "l, (SELECT unnest([0, 1, 2]) AS plane)"))
_mixed = lambda m, names: [" + ".join(f"{float(w)!r} * {x}" for w, x in zip(row, names, strict=True)) for row in m]
_lit = [f"CASE WHEN {x} <= 0.04045 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END" for x in "rgb"]
_wide, _luma = _mixed(resize.gamut("709", "2020"), "rgb"), _mixed(resize.luma_matrix(*resize.MATRICES["2020ncl"]), "rgb")
_triples = f"{R8}, t0 AS (SELECT n, y, x, max(CASE plane WHEN 0 THEN v / 255.0 END)::DOUBLE AS r, max(CASE plane WHEN 1 THEN v / 255.0 END)::DOUBLE AS g, max(CASE plane WHEN 2 THEN v / 255.0 END)::DOUBLE AS b FROM r8 GROUP BY n, y, x)"
_step = lambda of, to, parts: f", {to} AS (SELECT n, y, x, {', '.join(f'{e} AS {c}' for e, c in zip(parts, 'rgb', strict=True))} FROM {of})"
_back = [f"pow(greatest({x}, 0), {1 / 2.4!r})" for x in "rgb"]
_recoded = _triples + _step("t0", "t1", _lit) + _step("t1", "t2", _wide) + _step("t2", "t3", _back)
colour("resize_primaries", lambda c: c.resize.Point(transfer_in_s="srgb", transfer_s="709", primaries_in_s="709", primaries_s="2020"), sql.video(_recoded, "n, plane, y, x, least(greatest(round_even(round(CASE plane WHEN 0 THEN r WHEN 1 THEN g ELSE b END * 255.0, 6), 0), 0), 255) AS v", "t3, (SELECT unnest([0, 1, 2]) AS plane)"))
colour("resize_transfer_matrix", lambda c: c.resize.Point(format=VideoFormat(YUV, INTEGER, 10).id, matrix_s="2020ncl", range_s="limited", transfer_in_s="srgb", transfer_s="709", primaries_in_s="709", primaries_s="2020"), sql.video(_recoded + _step("t3", "t4", _luma), "n, plane, y, x, least(greatest(round_even(round(CASE plane WHEN 0 THEN r * 876 + 64 WHEN 1 THEN g * 896 + 512 ELSE b * 896 + 512 END, 6), 0), 0), 1023) AS v", "t4, (SELECT unnest([0, 1, 2]) AS plane)"))
_placed = lambda dx, dy: ", ".join(f"{t}(o, k, w) AS (VALUES {', '.join(f'({i}, {k}, {w!r}::DOUBLE)' for i, row in enumerate(resize.taps('Bilinear', 4, 8, -d / 2)) for k, w in row)})" for t, d in (("tx", dx), ("ty", dy)))
for _where in ("left", "top"):
    colour(f"resize_chroma_{_where}", lambda c, k=_where: c.resize.Bilinear(format=VideoFormat(YUV, INTEGER, 8).id, chromaloc_in_s=k), sql.video(f"{Y8}, {_placed(*resize.LOCATIONS[_where])}, hx AS (SELECT n, plane, y, o AS x, sum((v - 128) / 224.0 * w) AS v FROM y8 JOIN tx ON k = x WHERE plane > 0 GROUP BY n, plane, y, o), hy AS (SELECT n, plane, o AS y, x, sum(v * w) AS v FROM hx JOIN ty ON k = y GROUP BY n, plane, x, o)", "n, plane, y, x, v", "(SELECT n, plane, y, x, v FROM y8 WHERE plane = 0 UNION ALL SELECT n, plane, y, x, least(greatest(round_even(round(v * 224 + 128, 6), 0), 0), 255) FROM hy)"), True)
_bob = ", ".join(f"({parity}, {i}, {k}, {w!r}::DOUBLE)" for parity in (0, 1) for i, r in enumerate(resize.taps("Bicubic", 4, 8, resize.FIELD * (1 - 2 * parity))) for k, w in r)
gray("resize_bob", lambda c: c.resize.Bob(tff=1), sql.video(E8 + f", fl AS (SELECT 2 * n + y % 2 AS n, y % 2 AS parity, y // 2 AS y, x, v FROM e8), ty(parity, o, k, w) AS (VALUES {_bob}), s AS (SELECT n, o AS y, x, sum(v / 255.0 * w) AS v FROM fl JOIN ty ON k = y AND ty.parity = fl.parity GROUP BY n, o, x)", "n, 0 AS plane, y, x, least(greatest(round_even(round(v * 255.0, 6), 0), 0), 255) AS v", "s"))

# -- statistics and properties ----------------------------------------------------------------------
add("std_plane_stats", lambda spark, d: _stats(tables.gray(spark, d)), f"WITH {E8}, b AS ({sql.BACK}) SELECT n, min(e8.v)::BIGINT AS low, max(e8.v)::BIGINT AS high, round(sum(e8.v)::DOUBLE / (64 * 255), 8) AS average, round(sum(abs(e8.v - b.v))::DOUBLE / (64 * 255), 8) AS difference FROM e8 JOIN b USING (n, plane, y, x) GROUP BY n")
add("std_pem_verifier", lambda spark, d: stats.bad_samples(tables.gray(spark, d), upper=[170.0]).select("n", *(F.col(c).cast("long").alias(c) for c in ("plane", "y", "x", "v"))), f"WITH {E8} SELECT n, 0::BIGINT AS plane, min(y * 8 + x) // 8 AS y, min(y * 8 + x) % 8 AS x, arg_min(v, y * 8 + x) AS v FROM e8 WHERE v > 170 GROUP BY n")
add("std_set_frame_prop", lambda spark, d: ints(tables.gray(spark, d).std.SetFrameProp("Label", intval=7).std.SetFrameProps(Extra=9), "Label", "Extra"), "SELECT vec_id AS n, 7::BIGINT AS label, 9::BIGINT AS extra FROM embeddings")
add("std_set_frame_props", lambda spark, d: tables.gray(spark, d).std.SetFrameProps(A=[1, 2], B="text", C=0.5).props.select("n", F.size(F.col("props")["A"]["i"]).cast("long").alias("a"), F.get(F.col("props")["B"]["d"], 0).alias("b"), F.get(F.col("props")["C"]["f"], 0).alias("c")), "SELECT vec_id AS n, 2::BIGINT AS a, 'text' AS b, 0.5::DOUBLE AS c FROM embeddings")
add("std_remove_frame_props", lambda spark, d: tables.gray(spark, d).std.RemoveFrameProps(["_Scene*", "Labe?"]).props.select("n", F.array_join(F.array_sort(F.map_keys("props")), ",").alias("keys")), "SELECT vec_id AS n, '_DurationDen,_DurationNum' AS keys FROM embeddings")
add("std_copy_frame_props", lambda spark, d: ints((lambda c: c.std.CopyFrameProps(c.std.Reverse(), props=["Label"]))(tables.gray(spark, d)), "Label", "_DurationDen"), f"SELECT {COUNT} - 1 - vec_id AS n, label::BIGINT AS label, 24::BIGINT AS durationden FROM embeddings")
add("std_set_field_based", lambda spark, d: ints(tables.gray(spark, d).std.SetFrameProp("_Field", intval=1).std.SetFieldBased(2), "_FieldBased", "_Field"), "SELECT vec_id AS n, 2::BIGINT AS fieldbased, NULL::BIGINT AS field FROM embeddings")
gray("std_clip_to_prop", lambda c: c.std.ClipToProp(c.std.Reverse()).std.PropToClip(), sql.video(E8, f"{COUNT} - 1 - n AS n, plane, y, x, v", "e8"))
gray("std_prop_to_clip", lambda c: c.std.ClipToProp(c.std.Invert(), prop="Mask").std.PropToClip("Mask"), sql.point("255 - v"))
_text = lambda clip, name="text": clip.props.select("n", F.get(F.col("props")["_Text"]["d"], 0).alias(name))
add("text_text", lambda spark, d: _text(tables.gray(spark, d).text.Text("hello")), "SELECT vec_id AS n, 'hello' AS text FROM embeddings")
add("text_frame_num", lambda spark, d: _text(tables.gray(spark, d).text.FrameNum()), "SELECT vec_id AS n, CAST(vec_id AS VARCHAR) AS text FROM embeddings")
add("text_clip_info", lambda spark, d: _text(tables.gray(spark, d).text.ClipInfo()), f"SELECT vec_id AS n, 'Gray8 8x8, ' || {COUNT} || ' frames at 24/1' AS text FROM embeddings")
add("text_core_info", lambda spark, d: _text(tables.gray(spark, d).text.CoreInfo()).withColumn("text", F.regexp_replace("text", "[0-9.]+", "#")), "SELECT vec_id AS n, 'Spark #, # tasks at a time' AS text FROM embeddings")
add("text_frame_props", lambda spark, d: _text(tables.gray(spark, d).text.FrameProps(props=["Label", "_DurationDen"])), "SELECT vec_id AS n, 'Label: ' || label || chr(10) || '_DurationDen: 24' AS text FROM embeddings")
add("cli_timecodes", lambda spark, d: sinks.timecodes(tables.gray(spark, d)).select("n", F.round("ms", 6).alias("ms")), "SELECT vec_id AS n, round(vec_id * 1000.0::DOUBLE / 24, 6) AS ms FROM embeddings")
add("cli_props_json", lambda spark, d: sinks.props_json(tables.gray(spark, d)), f"WITH {P8} SELECT n, '{{\"Label\": ' || label || ', \"_DurationDen\": 24, \"_DurationNum\": 1, \"_SceneChangeNext\": ' || next || ', \"_SceneChangePrev\": ' || prev || '}}' AS json FROM p")


def _stats(clip: Clip) -> DataFrame:
    rows = stats.plane_stats_rows(clip, clip.std.Reverse())
    return rows.select("n", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.round("average", 8).alias("average"), F.round("difference", 8).alias("difference"))


# -- functions of the user --------------------------------------------------------------------------
gray("std_frame_eval", lambda c: c.std.FrameEval(lambda n: int(n % 3 != 0), clip_src=[c.std.Reverse(), c]), sql.resampled(f"SELECT range AS n, CASE range % 3 WHEN 0 THEN {COUNT} - 1 - range ELSE range END AS src FROM range({COUNT})", "e8"))
gray("std_frame_eval_props", lambda c: c.std.FrameEval(lambda n, p: p["Label"][0] % 2, prop_src=c, clip_src=[c, c.std.Invert()]), sql.video(E8, "n, plane, y, x, CASE WHEN label % 2 = 1 THEN 255 - v ELSE v END AS v", "e8 JOIN embeddings ON vec_id = n"))
gray("std_modify_frame", lambda c: c.std.ModifyFrame([c, c.std.Reverse()], lambda n, f: [abs(f[0][0] - f[1][0])]), sql.pair("abs(a.v - b.v)", sql.BACK))

# -- audio ------------------------------------------------------------------------------------------
sound("std_audio_trim", lambda a: a.std.AudioTrim(first=100, last=899), sql.audio(A16, "s - 100 AS s, ch, v", "a", "s BETWEEN 100 AND 899"))
sound("std_audio_reverse", lambda a: a.std.AudioReverse(), sql.audio(A16, f"{EVENTS} - 1 - s AS s, ch, v", "a"))
sound("std_audio_loop", lambda a: a.std.AudioLoop(times=4), sql.audio(A16, f"s + {EVENTS} * k AS s, ch, v", "a, (SELECT unnest([0, 1, 2, 3]) AS k)"))
sound("std_audio_loop_endless", lambda a: a.std.AudioLoop(times=0).std.AudioTrim(first=len(a) - 5, length=len(a) + 9), sql.audio(A16, f"s + {EVENTS} * k - ({EVENTS} - 5) AS s, ch, v", "a, (SELECT unnest([0, 1, 2]) AS k)", f"s + {EVENTS} * k BETWEEN {EVENTS} - 5 AND 2 * {EVENTS} + 3"))
sound("std_audio_splice", lambda a: a + a.std.AudioTrim(first=500), sql.audio(A16, f"s + k * ({EVENTS} - 500) AS s, ch, v", "a, (SELECT unnest([0, 1]) AS k)", "k = 0 OR s >= 500"))
sound("std_audio_gain", lambda a: a.std.AudioGain([0.75, 3.0]), sql.audio(A16, f"s, ch, {sql.away('v * CASE ch WHEN 0 THEN 0.75::DOUBLE ELSE 3.0 END')} AS v", "a"))
sound("std_audio_mix", lambda a: bound("std").AudioMix([a], [0.5, 0.5, 1.0, -0.25], [0, 1]), sql.audio(A16 + ", w AS (SELECT s, max(CASE ch WHEN 0 THEN v END) AS l, max(CASE ch WHEN 1 THEN v END) AS r FROM a GROUP BY s)", "s, ch, " + sql.away("CASE ch WHEN 0 THEN 0.5::DOUBLE * l + 0.5 * r ELSE 1.0::DOUBLE * l - 0.25 * r END") + " AS v", "w, (SELECT unnest([0, 1]) AS ch)"))
sound("std_shuffle_channels", lambda a: bound("std").ShuffleChannels([a, a.std.AudioTrim(last=499)], [1, 0], [0, 1]), sql.audio(A16, "s, 1 - ch AS ch, CASE WHEN ch = 0 AND s >= 500 THEN 0 ELSE v END AS v", "a"))
sound("std_split_channels", lambda a: a.std.SplitChannels()[1], sql.audio(A16, "s, 0 AS ch, v", "a", "ch = 1"))
sound("std_assume_sample_rate", lambda a: a.std.AssumeSampleRate(samplerate=44100), sql.audio(A16, "s, ch, v", "a"))
add("std_blank_audio", lambda spark, d: heard(bound("std").BlankAudio(channels=[0], samplerate=48000, length=960, waveform="triangle", amplitude=0.5, frequency=375.0)), "SELECT CAST(s AS BIGINT) AS s, 0::BIGINT AS ch, CAST(least(greatest(sign(v) * floor(abs(v) + 0.5), -32768), 32767) AS BIGINT) AS v FROM (SELECT range AS s, (CASE WHEN range % 128 < 32 THEN range % 128 / 32.0 WHEN range % 128 < 96 THEN 2 - range % 128 / 32.0 ELSE range % 128 / 32.0 - 4 END)::DOUBLE * 0.5 * 32768 AS v FROM range(960))")
sound("std_audio_resample_format", lambda a: a.std.AudioResample(bits=24), sql.audio(A16, "s, ch, v * 256 AS v", "a"))
sound("std_audio_resample_mono", lambda a: a.std.AudioResample(channels=[2]), sql.audio(A16 + ", w AS (SELECT s, max(CASE ch WHEN 0 THEN v END) AS l, max(CASE ch WHEN 1 THEN v END) AS r FROM a GROUP BY s)", "s, 0 AS ch, " + sql.away("(l / 32768.0::DOUBLE * 0.5 + r / 32768.0::DOUBLE * 0.5) * 32768") + " AS v", "w"))
_taps = ", ".join(f"({phase}, {j - audio.sinc_taps(2, 3).shape[1] // 2 + 1}, {w!r}::DOUBLE)" for phase, row in enumerate(audio.sinc_taps(2, 3).tolist()) for j, w in enumerate(row))
sound("std_audio_resample_rate", lambda a: a.std.AudioResample(samplerate=32000), sql.audio(A16 + f", t(phase, k, w) AS (VALUES {_taps}), m AS (SELECT range AS s, range * 3 // 2 AS place, range * 3 % 2 AS phase FROM range(({EVENTS} * 2 + 2) // 3)), r AS (SELECT m.s, c.ch, sum(coalesce(a.v, 0) / 32768.0::DOUBLE * w) AS v FROM m JOIN t USING (phase) CROSS JOIN (SELECT unnest([0, 1]) AS ch) c LEFT JOIN a ON a.s = m.place + t.k AND a.ch = c.ch GROUP BY m.s, c.ch)", "s, ch, " + sql.away("v * 32768") + " AS v", "r"))

# -- control, streams, the flagship -----------------------------------------------------------------
gray("std_cache", lambda c: c.std.Cache().std.SetVideoCache(mode=1), sql.point("v"))
sound("std_set_audio_cache", lambda a: a.std.SetAudioCache(mode=1), sql.audio(A16, "s, ch, v", "a"))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' values per hour of event time."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may match a file, too
    events = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("value"))
    return streams.drained(streams.windowed_levels(events), streams.shared(spark, "levels")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), *(F.col(c).cast("long").alias(c) for c in ("count", "low", "high", "total")))


add("stream_windowed_levels", _streamed, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS count, min(v)::BIGINT AS low, max(v)::BIGINT AS high, sum(v)::BIGINT AS total FROM (SELECT ts, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY 1")


def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed frames brighter than the middle, with their statistics."""
    rows = stats.plane_stats_rows(tables.gray(spark, sf_dir).std.Convolution([1, 2, 1, 2, 4, 2, 1, 2, 1]))
    return rows.where("average > 0.5").select("n", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.round("average", 8).alias("average"))


add(FLAGSHIP, _flagship, f"WITH s AS ({sql.convolved([1, 2, 1, 2, 4, 2, 1, 2, 1], 16)}) SELECT n, min(v)::BIGINT AS low, max(v)::BIGINT AS high, round(sum(v)::DOUBLE / (64 * 255), 8) AS average FROM s GROUP BY n HAVING sum(v)::DOUBLE / (64 * 255) > 0.5")

