"""Audio operators. A row holds one sample of all channels, so gains, mixes and channel choices are projections."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.clip import Audio, repeated
from tessella.info import FLOAT, INTEGER, AudioInfo, need
from tessella.operators.temporal import MANY, ranged
from tessella.registry import operator


def _same(clips: list[Audio], name: str) -> None:
    first = clips[0].info
    need(all((c.info.rate, c.info.channels, c.info.sample, c.info.bits) == (first.rate, first.channels, first.sample, first.bits) for c in clips), f"{name}: formats differ")


def _kind(info: AudioInfo) -> str:
    return "float" if info.is_float else "int"


def _away(x: Column) -> Column:
    """Rounded, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def stored(x: Column, info: AudioInfo, strict: bool) -> Column:
    """A double as a sample: rounded and held in range; with strict, out of range is an error."""
    if info.is_float:
        return x.cast("float")
    low, high = -(1 << info.bits - 1), (1 << info.bits - 1) - 1
    r = _away(x)
    if strict:
        r = F.when((r < low) | (r > high), F.raise_error(F.lit("a sample clips")).cast("double")).otherwise(r)
    return F.least(F.greatest(r, F.lit(float(low))), F.lit(float(high))).cast("int")


@operator("std", "AudioTrim", "clip:audio first:int? last:int? length:int?")
def audio_trim(clip: Audio, first=None, last=None, length=None) -> Audio:
    a, b = ranged(first, last, length, len(clip), "AudioTrim")
    if (a, b) == (0, len(clip) - 1):
        return clip
    rows = clip.rows.where(F.col("s").between(a, b)).withColumn("s", F.col("s") - a) if clip.looped is None else repeated(clip.looped.rows, "s", len(clip.looped), a, b)
    return clip.but(clip.info.but(length=b - a + 1), rows)


@operator("std", "AudioReverse", "clip:audio")
def audio_reverse(clip: Audio) -> Audio:
    return clip.but(rows=clip.rows.withColumn("s", len(clip) - 1 - F.col("s")))


@operator("std", "AudioLoop", "clip:audio times:int?")
def audio_loop(clip: Audio, times=0) -> Audio:
    need(times >= 0, "AudioLoop: times is not negative")
    if times == 1:
        return clip
    total = len(clip) * times if times else MANY * 3072
    out = clip.but(clip.info.but(length=total), repeated(clip.rows, "s", len(clip), 0, total - 1))
    out.looped = clip
    return out


@operator("std", "AudioSplice", "clips:audio[]")
def audio_splice(clips: list[Audio]) -> Audio:
    _same(clips, "AudioSplice")
    rows, at = clips[0].rows, len(clips[0])
    for c in clips[1:]:
        rows, at = rows.unionByName(c.rows.withColumn("s", F.col("s") + at)), at + len(c)
    return clips[0].but(clips[0].info.but(length=at), rows)


@operator("std", "AudioGain", "clip:audio gain:float[] overflow_error:int?")
def audio_gain(clip: Audio, gain, overflow_error=0) -> Audio:
    need(len(gain) in (1, len(clip.info.channels)), "AudioGain: one gain, or one for each channel")
    gains = F.array(*[F.lit(float(g)) for g in (gain if len(gain) > 1 else gain * len(clip.info.channels))])
    return clip.but(rows=clip.rows.select("s", F.zip_with("v", gains, lambda v, g: stored(v.cast("double") * g, clip.info, bool(overflow_error))).alias("v")))


def _aligned(clips: list[Audio], how: str, length: int):
    """(s, a0, a1, ..) of several clips; how: inner, or left from all samples up to a length, with silence."""
    out = clips[0].rows.withColumnRenamed("v", "a0") if how == "inner" else clips[0].spark.range(length).select(F.col("id").alias("s"))
    for i, c in enumerate(clips):
        if how == "inner" and i == 0:
            continue
        out = out.join(c.rows.withColumnRenamed("v", f"a{i}"), "s", how)
    return out


@operator("std", "AudioMix", "clips:audio[] matrix:float[] channels_out:int[] overflow_error:int?")
def audio_mix(clips: list[Audio], matrix, channels_out, overflow_error=0) -> Audio:
    first = clips[0].info
    need(len({len(c) for c in clips}) == 1, "AudioMix: lengths differ")
    need(all((c.info.rate, c.info.sample, c.info.bits) == (first.rate, first.sample, first.bits) for c in clips), "AudioMix: formats differ")
    ins = [F.get(f"a{i}", k) for i, c in enumerate(clips) for k in range(len(c.info.channels))]
    need(len(matrix) == len(ins) * len(channels_out), "AudioMix: a weight for each input of each output")
    order = sorted(range(len(channels_out)), key=lambda k: channels_out[k])
    info = first.but(channels=tuple(channels_out[k] for k in order))
    mixed = [sum((F.lit(float(matrix[k * len(ins) + j])) * x.cast("double") for j, x in enumerate(ins)), F.lit(0.0)) for k in order]
    rows = _aligned(clips, "inner", len(clips[0]))
    return Audio(info, rows.select("s", F.array(*[stored(m, info, bool(overflow_error)) for m in mixed]).alias("v")))


@operator("std", "ShuffleChannels", "clips:audio[] channels_in:int[] channels_out:int[]")
def shuffle_channels(clips: list[Audio], channels_in, channels_out) -> Audio:
    need(len(channels_in) == len(channels_out) >= len(clips), "ShuffleChannels: as many channels out as in, and no more clips")
    first = clips[0].info
    need(len({(c.info.rate, c.info.sample, c.info.bits) for c in clips}) == 1, "ShuffleChannels: formats differ")
    length = max(map(len, clips))
    picks = []
    for k, want in enumerate(channels_in):
        at = min(k, len(clips) - 1)
        have = clips[at].info.channels
        n = -want - 1 if want < 0 else 0 if want == 0 and 0 not in have else have.index(want) if want in have else -1
        need(0 <= n < len(have), "ShuffleChannels: no such channel")
        picks.append(F.coalesce(F.get(f"a{at}", n), F.lit(0).cast(_kind(first))))
    order = sorted(range(len(picks)), key=lambda k: channels_out[k])
    info = first.but(channels=tuple(channels_out[k] for k in order), length=length)
    rows = _aligned(clips, "inner" if len(clips) == 1 else "left", length)
    return Audio(info, rows.select("s", F.array(*[picks[k] for k in order]).alias("v")))


@operator("std", "SplitChannels", "clip:audio")
def split_channels(clip: Audio) -> list[Audio]:
    return [Audio(clip.info.but(channels=(c,)), clip.rows.select("s", F.array(F.get("v", k)).alias("v"))) for k, c in enumerate(clip.info.channels)]


@operator("std", "AssumeSampleRate", "clip:audio src:audio? samplerate:int?")
def assume_sample_rate(clip: Audio, src=None, samplerate=None) -> Audio:
    need((src is None) != (samplerate is None), "AssumeSampleRate: give src or samplerate")
    return clip.but(clip.info.but(rate=src.info.rate if src is not None else samplerate))


@operator("std", "BlankAudio", "clip:audio? channels:int[]? bits:int? sampletype:int? samplerate:int? length:int? keep:int? waveform:data? amplitude:float? frequency:float?")
def blank_audio(clip=None, channels=None, bits=None, sampletype=None, samplerate=None, length=None, keep=None, waveform="none", amplitude=1.0, frequency=440.0, spark=None) -> Audio:
    from pyspark.sql import SparkSession

    spark = spark or (clip.spark if clip is not None else SparkSession.active())
    base = clip.info if clip is not None else None
    sample = sampletype if sampletype is not None else base.sample if base else INTEGER
    rate = samplerate or (base.rate if base else 44100)
    info = AudioInfo(rate, length or (base.length if base else rate * 10), tuple(sorted(channels or (base.channels if base else (0, 1)))), sample, bits or (base.bits if base else 32 if sample == FLOAT else 16))
    need(waveform in ("none", "slope", "sine", "square", "triangle"), "BlankAudio: no such waveform")
    # the phase in units of 2^-64 turns wraps exactly: decimals of 38 digits hold s * step before the remainder
    step = math.floor(math.modf(frequency / rate)[0] * 2**64)
    turn = F.lit(str(2**64)).cast("decimal(38,0)")
    phase = (F.expr(f"cast(s as decimal(18,0)) * cast({step} as decimal(20,0))").cast("decimal(38,0)") % turn).cast("double") / float(2**64)
    t = phase
    wave = {
        "none": F.lit(0.0),
        "slope": 2 * t - 1,
        "sine": F.sin(2 * math.pi * t),
        "square": F.when(t < 0.5, 1.0).otherwise(-1.0),
        "triangle": F.when(t < 0.25, 4 * t).when(t < 0.75, 2 - 4 * t).otherwise(4 * t - 4),
    }[waveform] * F.lit(float(amplitude))
    value = wave.cast("float") if info.is_float else stored(wave * float(1 << info.bits - 1), info, False)
    return Audio(info, spark.range(info.length).select(F.col("id").alias("s")).select("s", F.array_repeat(value, len(info.channels)).alias("v")))


TAPS, BETA, CUTOFF = 64, 9.0, 0.91


def sinc_taps(p: int, q: int) -> np.ndarray:
    """Windowed sinc weights for p / q times the rate: [phase, tap], a phase for each of the p places between samples."""
    scale = CUTOFF * min(1.0, p / q)
    phase = (np.arange(p) / p)[:, None]
    reach = math.ceil(TAPS / min(1.0, p / q))
    at = np.arange(-reach + 1, reach + 1)[None, :] - phase
    shape = np.i0(BETA * np.sqrt(np.maximum(0, 1 - (at / reach) ** 2))) / np.i0(BETA)
    out = np.sinc(scale * at) * scale * shape
    return out / out.sum(axis=1, keepdims=True)


@operator("std", "AudioResample", "clip:audio samplerate:int? sampletype:int? bits:int? channels:int[]? dither_type:data? normalize:int? overflow_error:int?")
def audio_resample(clip: Audio, samplerate=None, sampletype=None, bits=None, channels=None, dither_type="none", normalize=None, overflow_error=0) -> Audio:
    """Channel folding, rate and format conversion. Dither is none (the position-hashed noise of other
    implementations can't be compared); a rate change goes in blocks of samples with their surroundings."""
    old = clip.info
    sample = sampletype if sampletype is not None else old.sample
    depth = bits or (32 if sample == FLOAT and old.sample != FLOAT else 16 if sample != FLOAT and old.sample == FLOAT else old.bits)
    rate = samplerate or old.rate
    ids = tuple(sorted(channels)) if channels else old.channels
    if not overflow_error and INTEGER == sample == old.sample and depth >= old.bits and (rate, ids) == (old.rate, old.channels):
        # only more bits: exact, so nothing is rounded or held in range
        return clip.but(old.but(bits=depth), clip.rows.select("s", F.transform("v", lambda v: v.cast("long") * (1 << depth - old.bits)).alias("v")) if depth > old.bits else clip.rows)
    wide = clip.rows.select("s", F.transform("v", lambda v: v.cast("double") / (1.0 if old.is_float else float(1 << old.bits - 1))).alias("v"))
    if ids != old.channels:
        weights = fold(old.channels, ids)
        most = max(sum(abs(w) for w in row) for row in weights)
        if (normalize if normalize is not None else sample == INTEGER) and most > 1:
            weights = [[w / most for w in row] for row in weights]
        wide = wide.select("s", F.array(*[sum((F.lit(w) * F.get("v", k) for k, w in enumerate(row) if w), F.lit(0.0)) for row in weights]).alias("v"))
    length = old.length
    if rate != old.rate:
        g = math.gcd(rate, old.rate)
        p, q = rate // g, old.rate // g
        length = -(-old.length * p // q)
        wide = _resampled(wide, old.length, length, p, q, len(ids))
    info = AudioInfo(rate, length, ids, sample, depth)
    full = F.lit(1.0 if info.is_float else float(1 << depth - 1))
    return Audio(info, wide.select("s", F.transform("v", lambda v: stored(v * full, info, bool(overflow_error))).alias("v")))


def fold(have: tuple[int, ...], want: tuple[int, ...]) -> list[list[float]]:
    """Down-mix weights: a channel goes to itself, else to the front (a centre to both sides) at -3 dB."""
    half = math.sqrt(0.5)
    # ids: 0 left, 1 right, 2 centre, 3 low, 4 5 back, 8 back centre, 9 10 side
    left, right = {0, 4, 6, 9}, {1, 5, 7, 10}
    out = []
    for w in want:
        row = []
        for h in have:
            if h == w:
                row.append(1.0)
            elif h in want or h == 3:
                row.append(0.0)
            elif w == 0 and (h in left or h in (2, 8)) or w == 1 and (h in right or h in (2, 8)):
                row.append(half)
            elif w == 2 and not {0, 1} & set(want):
                row.append(half if h in (0, 1) else 0.5)
            else:
                row.append(0.0)
        out.append(row)
    return out


def _resampled(rows, n_in: int, n_out: int, p: int, q: int, channels: int):
    """(s, v) at p / q times the rate: each block of output gets the input around it, silence beyond the ends."""
    import pandas as pd

    taps = sinc_taps(p, q)
    reach = taps.shape[1] // 2
    block = max(1, 4096 * q // p)  # input samples
    low = F.greatest(F.floor((F.col("s") - reach) / block), F.lit(0).cast("long"))
    high = F.least(F.floor((F.col("s") + reach) / block), F.lit((n_in - 1) // block).cast("long"))
    names = [f"c{k}" for k in range(channels)]
    dealt = rows.select("s", *(F.get("v", k).alias(c) for k, c in enumerate(names)), F.explode(F.sequence(low, high)).alias("block"))

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        base = b * block - reach
        x = np.zeros((block + 2 * reach + 1, channels))
        df = df[(df.s >= base) & (df.s < base + len(x))]
        x[df.s.to_numpy() - base] = df[names].to_numpy()
        first = -(-b * block * p // q)
        m = np.arange(first, min(n_out, -(-(b + 1) * block * p // q)), dtype=np.int64)
        at, phase = m * q // p, m * q % p
        v = np.zeros((len(m), channels))
        for j in range(taps.shape[1]):
            v += taps[phase, j][:, None] * x[at + j - reach + 1 - base]
        return pd.DataFrame({"s": m} | {c: v[:, k] for k, c in enumerate(names)})

    made = dealt.groupBy("block").applyInPandas(run, ", ".join(["s long", *(f"{c} double" for c in names)]))
    return made.select("s", F.array(*names).alias("v"))
