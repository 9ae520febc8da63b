"""Scaling by separable kernels, with depth and colour conversion.

Each axis has a table of taps per output coordinate, made on the driver from the kernel's formula; it
grows with the picture's side, not with the data. Rows are scaled within their arrays: no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.clip import Clip, bound_to, by_plane
from tessella.info import FLOAT, RGB, YUV, VideoFormat, VideoInfo, need
from tessella.registry import operator


def _bicubic(b: float, c: float) -> Callable[[float], float]:
    def f(x: float) -> float:
        x = abs(x)
        if x < 1:
            return ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + 6 - 2 * b) / 6
        return ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + 8 * b + 24 * c) / 6 if x < 2 else 0.0

    return f


def _lanczos(taps: int) -> Callable[[float], float]:
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    return lambda x: sinc(x) * sinc(x / taps) if abs(x) < taps else 0.0


def _spline(reach: int) -> Callable[[float], float]:
    """The cardinal natural cubic spline through 2 * reach points, a unit at 0: solved, not tabulated."""
    n = 2 * reach
    knots = np.arange(n) - reach + 1

    def weights(t: float) -> list[float]:
        """How much each knot counts at t in [0, 1), between knots 0 and 1."""
        m = np.zeros((n, n))
        m[0, 0] = m[-1, -1] = 1
        for i in range(1, n - 1):
            m[i, i - 1 : i + 2] = 1, 4, 1
        k = reach - 1
        out = []
        for j in range(n):
            y = (knots == knots[j]).astype(float)
            r = np.zeros(n)
            r[1:-1] = 6 * (y[:-2] - 2 * y[1:-1] + y[2:])
            d = np.linalg.solve(m, r)
            out.append(float((1 - t) * y[k] + t * y[k + 1] + ((1 - t) ** 3 - (1 - t)) * d[k] / 6 + (t**3 - t) * d[k + 1] / 6))
        return out

    def f(x: float) -> float:
        if abs(x) >= reach:
            return 0.0
        base = math.floor(-x) if x <= 0 else math.floor(-x)
        t = -x - base  # the sample stands at knot -base when the point is at t
        j = -base + reach - 1
        return weights(t)[j] if 0 <= j < n else 0.0

    return f


KERNELS: dict[str, tuple[float, Callable]] = {
    "Bilinear": (1, lambda a, b: lambda x: max(0.0, 1 - abs(x))),
    "Bicubic": (2, lambda a, b: _bicubic(1 / 3 if a is None else a, 1 / 3 if b is None else b)),
    "Lanczos": (3, lambda a, b: _lanczos(int(a or 3))),
    "Spline16": (2, lambda a, b: _spline(2)),
    "Spline36": (3, lambda a, b: _spline(3)),
    "Spline64": (4, lambda a, b: _spline(4)),
}


FIELD = 0.25


def taps(kind: str, n_in: int, n_out: int, start: float = 0.0, span: float | None = None, a=None, b=None) -> list[list[tuple[int, float]]]:
    """(source, weight) pairs per output coordinate; sources beyond an edge are mirrored. A side that keeps its place
    and length keeps its samples, whatever the kernel."""
    span = span or n_in
    if (n_out, start, span) == (n_in, 0.0, n_in):
        return [[(i, 1.0)] for i in range(n_out)]
    step = span / n_out
    if kind == "Point":
        return [[(min(max(math.floor(start + (i + 0.5) * step), 0), n_in - 1), 1.0)] for i in range(n_out)]
    reach, make = KERNELS[kind]
    reach = int(a) if kind == "Lanczos" and a else reach
    kernel, wide = make(a, b), max(1.0, step)
    out = []
    for i in range(n_out):
        centre = start + (i + 0.5) * step - 0.5
        found: dict[int, float] = {}
        for k in range(math.floor(centre - reach * wide) + 1, math.ceil(centre + reach * wide)):
            w = kernel((k - centre) / wide)
            if w:
                at = -k - 1 if k < 0 else 2 * n_in - 1 - k if k >= n_in else k
                at = min(max(at, 0), n_in - 1)
                found[at] = found.get(at, 0.0) + w
        total = sum(found.values())
        out.append([(k, w / total) for k, w in sorted(found.items())])
    return out


def _table(rows: list[list[tuple[int, float]]]) -> Column:
    return F.array(*[F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in row]) for row in rows])


def scaled(data: Column, w: int, h: int, across: list, down: list) -> Column:
    """An array of doubles scaled along x, then along y."""
    nw, nh = len(across), len(down)
    tx, ty = _table(across), _table(down)
    total = lambda t, at: F.aggregate(t, F.lit(0.0), lambda s, x: s + x["w"] * at(x["k"]))
    wide = F.transform(F.sequence(F.lit(0), F.lit(nw * h - 1)), lambda i: total(F.get(tx, (i % nw).cast("int")), lambda k: F.get(data, F.floor(i / nw).cast("int") * w + k)))
    return bound_to(wide, lambda d: F.transform(F.sequence(F.lit(0), F.lit(nw * nh - 1)), lambda i: total(F.get(ty, F.floor(i / nw).cast("int")), lambda k: F.get(d, k * nw + (i % nw).cast("int")))))


def _range(fmt: VideoFormat, plane: int, full: bool) -> tuple[float, float]:
    """(offset, width) of a plane's code values for 0..1 (-0.5..0.5 for chroma)."""
    if fmt.is_float:
        return 0.0, 1.0
    unit = 1 << fmt.bits - 8
    if full:
        return (float(1 << fmt.bits - 1) if fmt.chroma(plane) else 0.0), fmt.top
    return (128.0 * unit, 224.0 * unit) if fmt.chroma(plane) else (16.0 * unit, 219.0 * unit)


#: Luma weights (red, blue) by matrix name. Fixed values.
MATRICES = {"709": (0.2126, 0.0722), "470bg": (0.299, 0.114), "170m": (0.299, 0.114), "2020ncl": (0.2627, 0.0593), "240m": (0.212, 0.087), "fcc": (0.30, 0.11)}


#: Chromaticities of red, green, blue and white by name. Fixed values.
_D65, _C, _DCI, _E = (0.3127, 0.3290), (0.310, 0.316), (0.314, 0.351), (1 / 3, 1 / 3)
PRIMARIES = {
    "709": ((0.640, 0.330), (0.300, 0.600), (0.150, 0.060), _D65),
    "470m": ((0.670, 0.330), (0.210, 0.710), (0.140, 0.080), _C),
    "470bg": ((0.640, 0.330), (0.290, 0.600), (0.150, 0.060), _D65),
    "170m": ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), _D65),
    "240m": ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), _D65),
    "film": ((0.681, 0.319), (0.243, 0.692), (0.145, 0.049), _C),
    "2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), _D65),
    "st431-2": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), _DCI),
    "st432-1": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), _D65),
    "xyz": ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0), _E),
}
#: Exponents from code values to light on a display, by transfer name; the Bradford cone responses; the constants of
#: the st2084 curve, whose 1.0 is a hundredth of its range. Fixed values.
POWERS = {"linear": 1.0, "709": 2.4, "601": 2.4, "240m": 2.4, "2020_10": 2.4, "2020_12": 2.4, "470m": 2.2, "470bg": 2.8}
CONES = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])
PQ = (0.1593017578125, 78.84375, 0.8359375, 18.8515625, 18.6875)
#: Where chroma samples lie from the middle of their luma samples, in luma samples. Fixed values.
LOCATIONS = {"left": (-0.5, 0.0), "center": (0.0, 0.0), "top_left": (-0.5, -0.5), "top": (0.0, -0.5), "bottom_left": (-0.5, 0.5), "bottom": (0.0, 0.5)}


def light(name: str, v: Column) -> Column:
    """Code value 0..1 to linear light."""
    v = F.greatest(v, F.lit(0.0))
    if name == "srgb":
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    if name == "st2084":
        m1, m2, c1, c2, c3 = PQ
        return bound_to(F.pow(v, F.lit(1 / m2)), lambda x: 100 * F.pow(F.greatest(x - c1, F.lit(0.0)) / (c2 - c3 * x), F.lit(1 / m1)))
    return v if POWERS[name] == 1 else F.pow(v, F.lit(POWERS[name]))


def coded(name: str, v: Column) -> Column:
    """Linear light to code value."""
    v = F.greatest(v, F.lit(0.0))
    if name == "srgb":
        return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    if name == "st2084":
        m1, m2, c1, c2, c3 = PQ
        return bound_to(F.pow(v / 100, F.lit(m1)), lambda x: F.pow((c1 + c2 * x) / (1 + c3 * x), F.lit(m2)))
    return v if POWERS[name] == 1 else F.pow(v, F.lit(1 / POWERS[name]))


def gamut(have: str, want: str) -> np.ndarray:
    """Linear RGB of one set of primaries to another, white adapted by cone responses."""
    full = lambda c: np.array([c[0] / c[1], 1.0, (1 - c[0] - c[1]) / c[1]])
    xyz = lambda c: np.array([c[0], c[1], 1 - c[0] - c[1]])

    def to_xyz(name: str) -> np.ndarray:
        *rgb, white = PRIMARIES[name]
        m = np.stack([xyz(c) for c in rgb], 1)
        return m * np.linalg.solve(m, full(white))

    a, b = CONES @ full(PRIMARIES[have][3]), CONES @ full(PRIMARIES[want][3])
    adapted = np.linalg.inv(CONES) @ np.diag(b / a) @ CONES
    return np.linalg.inv(to_xyz(want)) @ adapted @ to_xyz(have)


def luma_matrix(kr: float, kb: float) -> np.ndarray:
    """RGB to Y, U, V, of which the last two run from -0.5 to 0.5."""
    y = np.array([kr, 1 - kr - kb, kb])
    return np.stack([y, (np.array([0, 0, 1]) - y) / (2 * (1 - kb)), (np.array([1, 0, 0]) - y) / (2 * (1 - kr))])


def _resize(kind: str, clip: Clip, width=None, height=None, format=None, matrix_s=None, matrix_in_s=None, range_s=None, range_in_s=None, filter_param_a=None, filter_param_b=None, src_left=0.0, src_top=0.0, src_width=None, src_height=None, transfer_s=None, transfer_in_s=None, primaries_s=None, primaries_in_s=None, chromaloc_s=None, chromaloc_in_s=None, fields: bool = False) -> Clip:
    """fields: top fields (_Field 1) are taken to lie a quarter of their lines higher than the frame, bottom ones lower."""
    old = clip.info
    fmt = VideoFormat.of_id(format) if format is not None else old.format
    info = VideoInfo(fmt, width or old.width, height or old.height, old.length, old.fps)
    full = lambda f, s: s == "full" if s else f.family == RGB
    full_in, full_out = full(old.format, range_in_s), full(fmt, range_s)
    crosses = (old.format.family == YUV) != (fmt.family == YUV)
    need(not crosses or bool(matrix_in_s if old.format.family == YUV else matrix_s), "Resize: a matrix must be given between YUV and RGB")
    need(old.format.planes == fmt.planes or crosses is False and fmt.planes == 1, "Resize: planes can only be kept or dropped")
    recoded = bool(transfer_s) and transfer_s != transfer_in_s or bool(primaries_s) and primaries_s != primaries_in_s
    if recoded:
        need(fmt.planes == 3, "Resize: transfer and primaries are of three planes")
        need(not transfer_s or bool(transfer_in_s), "Resize: transfer_in_s is needed")
        need(not primaries_s or bool(primaries_in_s and transfer_in_s), "Resize: primaries_in_s and transfer_in_s are needed")
        need(all(x in (None, "srgb", "st2084", *POWERS) for x in (transfer_s, transfer_in_s)) and all(x in (None, *PRIMARIES) for x in (primaries_s, primaries_in_s)), "Resize: no such transfer or primaries")
        need(old.format.family == RGB or bool(matrix_in_s), "Resize: matrix_in_s is needed")
    need(all(x in (None, *LOCATIONS) for x in (chromaloc_s, chromaloc_in_s)), "Resize: no such chroma location")
    site_in, site_out = (LOCATIONS[x or "left"] for x in (chromaloc_in_s, chromaloc_s or chromaloc_in_s))
    whole = (width or old.width, height or old.height) == (old.width, old.height) and (src_left, src_top, src_width, src_height) == (0.0, 0.0, None, None)
    if whole and fmt == old.format and full_in == full_out and not recoded and site_in == site_out:
        return clip
    joins = crosses or recoded
    need(not joins or fmt.family != YUV or not (fmt.ss_w or fmt.ss_h), "Resize: colour is converted to planes of one size")
    frames = clip.frames.where(F.col("plane") < fmt.planes)
    unit = lambda p: _range(old.format, p, full_in)
    level = lambda p: F.transform("data", lambda v: (v.cast("double") - unit(p)[0]) / unit(p)[1])
    sizes = {p: info.size(p) if not joins else (info.width, info.height) for p in range(fmt.planes)}

    def shift(p: int, axis: int, scale: float) -> float:
        """How far chroma's place among luma moves a plane's samples, in its own samples."""
        before, after = (1 << (f.ss_h if axis else f.ss_w) if f.chroma(p) else 1 for f in (old.format, fmt if not joins else VideoFormat(RGB)))
        return (site_out[axis] * scale * (after > 1) - site_in[axis] * (before > 1)) / before

    picture = {}
    for p in range(fmt.planes):
        w, h = old.size(p)
        nw, nh = sizes[p]
        rx, ry = w / old.width, h / old.height
        sw, sh = (src_width or old.width) * rx, (src_height or old.height) * ry
        left, top = src_left * rx + shift(p, 0, (src_width or old.width) / info.width), src_top * ry + shift(p, 1, (src_height or old.height) / info.height)
        across = taps(kind, w, nw, left, sw, filter_param_a, filter_param_b)
        down = taps(kind, h, nh, top + FIELD * fields, sh, filter_param_a, filter_param_b)
        below = taps(kind, h, nh, top - FIELD, sh, filter_param_a, filter_param_b) if fields else down
        same = not fields and all(len(t) == 1 and t[0] == (i, 1.0) for side in (across, down) for i, t in enumerate(side)) and (nw, nh) == (w, h)
        if same:
            picture[p] = level(p)
            continue
        at = lambda down: bound_to(level(p), lambda d: scaled(d, w, h, across, down))  # noqa: B023, E731 - called at once
        picture[p] = F.when(F.col("top"), at(down)).otherwise(at(below)) if fields else at(down)
    if fields:
        frames = frames.join(clip.props.select("n", (F.get(F.col("props").getItem("_Field")["i"], 0) == 1).alias("top")), "n")
    rows = frames.select("n", "plane", by_plane(info, picture.get).alias("data"))
    if joins:
        steps: list[Callable[[Column], Column]] = []
        if old.format.family == YUV:
            steps.append(_times(np.linalg.inv(luma_matrix(*MATRICES[matrix_in_s]))))
        if recoded:
            steps.append(lambda c: F.transform(c, lambda v: light(transfer_in_s, v)))
            if primaries_s and primaries_s != primaries_in_s:
                steps.append(_times(gamut(primaries_in_s, primaries_s)))
            steps.append(lambda c: F.transform(c, lambda v: coded(transfer_s or transfer_in_s, v)))
        if fmt.family == YUV:
            steps.append(_times(luma_matrix(*MATRICES[matrix_s or matrix_in_s])))
        rows = _converted(rows, steps)
    end = lambda p: _range(fmt, p, full_out)
    code = lambda v, p: v * end(p)[1] + end(p)[0]
    store = lambda p: F.transform("data", lambda v: code(v, p).cast("float") if fmt.is_float else F.least(F.greatest(F.rint(F.round(code(v, p), 6)), F.lit(0.0)), F.lit(float(fmt.top))).cast("int"))
    return Clip(info, rows.select("n", "plane", by_plane(info, store).alias("data")), clip.props)


def _times(m: np.ndarray) -> Callable[[Column], Column]:
    """A pixel's three values times a matrix."""
    return lambda c: bound_to(c, lambda x: F.array(*(sum(float(w) * F.get(x, k) for k, w in enumerate(row)) for row in m)))


def _nth(k: int) -> Callable[[Column], Column]:
    return lambda c: F.get(c, k)


def _converted(rows, steps: list[Callable[[Column], Column]]):
    """Planes of equal size, pixel by pixel (arrays of three values) through some steps; one row per frame on the way."""
    wide = rows.groupBy("n").agg(*[F.max(F.when(F.col("plane") == p, F.col("data"))).alias(f"p{p}") for p in range(3)])

    def pixel(a: Column, i: Column) -> Column:
        out = F.array(a, F.get("p1", i), F.get("p2", i))
        for step in steps:
            out = step(out)
        return out

    made = wide.select("n", F.transform("p0", pixel).alias("pixels"))
    return made.select("n", F.posexplode(F.array(*(F.transform("pixels", _nth(k)) for k in range(3)))).alias("plane", "data"))


_SIGNATURE = "clip:clip width:int? height:int? format:int? matrix_s:data? matrix_in_s:data? range_s:data? range_in_s:data? filter_param_a:float? filter_param_b:float? src_left:float? src_top:float? src_width:float? src_height:float? transfer_s:data? transfer_in_s:data? primaries_s:data? primaries_in_s:data? chromaloc_s:data? chromaloc_in_s:data?"
for _kind in ("Point", *KERNELS):
    operator("resize", _kind, _SIGNATURE)(lambda _kind=_kind, **args: _resize(_kind, **args))


@operator("resize", "Bob", "clip:clip filter:data? tff:int?")
def bob(clip: Clip, filter="bicubic", tff=None) -> Clip:
    """Each field scaled to the height of a frame."""
    known = {k.lower(): k for k in ("Point", *KERNELS)}
    need(filter.lower() in known, "Bob: no such filter")
    fields = clip.std.SeparateFields(**({} if tff is None else {"tff": tff}))
    return _resize(known[filter.lower()], fields, height=clip.info.height, fields=True)


__all__ = ["FLOAT"]
