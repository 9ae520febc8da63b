"""Formats and infos of sequences: plain values on the driver, never columns."""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import gcd

GRAY, RGB, YUV = 1, 2, 3
INTEGER, FLOAT = 0, 1
BLOCK = 3072  # samples of an audio frame


class OperatorError(ValueError):
    """An argument that an operator refuses, named by the operator."""


def need(ok: bool, message: str) -> None:
    if not ok:
        raise OperatorError(message)


def reduced(num: int, den: int) -> tuple[int, int]:
    """A fraction in lowest terms; 0/0 if either part is 0."""
    if num <= 0 or den <= 0:
        return 0, 0
    g = gcd(num, den)
    return num // g, den // g


@dataclass(frozen=True)
class VideoFormat:
    family: int
    sample: int = INTEGER
    bits: int = 8
    ss_w: int = 0
    ss_h: int = 0

    def __post_init__(self):
        need(self.family in (GRAY, RGB, YUV), "a colour family is GRAY, RGB or YUV")
        need(self.bits in (16, 32) if self.sample == FLOAT else 8 <= self.bits <= 32, "integer samples have 8 to 32 bits, float ones 16 or 32")
        need(self.family == YUV or not (self.ss_w or self.ss_h), "only YUV can be subsampled")
        need(0 <= self.ss_w <= 4 and 0 <= self.ss_h <= 4, "subsampling is 0 to 4")

    @property
    def planes(self) -> int:
        return 1 if self.family == GRAY else 3

    @property
    def is_float(self) -> bool:
        return self.sample == FLOAT

    @property
    def top(self) -> float:
        return 1.0 if self.is_float else (1 << self.bits) - 1

    @property
    def id(self) -> int:
        return self.family << 28 | self.sample << 24 | self.bits << 16 | self.ss_w << 8 | self.ss_h

    @classmethod
    def of_id(cls, id_: int) -> VideoFormat:
        return cls(id_ >> 28 & 15, id_ >> 24 & 15, id_ >> 16 & 255, id_ >> 8 & 255, id_ & 255)

    @property
    def name(self) -> str:
        depth = {16: "H", 32: "S"}[self.bits] if self.is_float else str(self.bits)
        if self.family == GRAY:
            return f"Gray{depth}"
        if self.family == RGB:
            return f"RGB{depth if self.is_float else self.bits * 3}"
        known = {(0, 0): "444", (1, 0): "422", (1, 1): "420", (2, 0): "411", (2, 2): "410", (0, 1): "440"}.get((self.ss_w, self.ss_h))
        return f"YUV{known or f'ssw{self.ss_w}ssh{self.ss_h}'}P{depth}"

    def chroma(self, plane: int) -> bool:
        return self.family == YUV and plane > 0

    def low(self, plane: int) -> float:
        return -0.5 if self.is_float and self.chroma(plane) else 0

    def high(self, plane: int) -> float:
        return 0.5 if self.is_float and self.chroma(plane) else self.top

    def black(self, plane: int) -> float:
        return (1 << self.bits - 1) if self.chroma(plane) and not self.is_float else 0


@dataclass(frozen=True)
class VideoInfo:
    format: VideoFormat
    width: int
    height: int
    length: int
    fps: tuple[int, int] = (24, 1)

    def __post_init__(self):
        need(self.length >= 1, "a clip has at least one frame")
        need(self.width > 0 and self.height > 0, "width and height are positive")
        need(self.width % (1 << self.format.ss_w) == 0 and self.height % (1 << self.format.ss_h) == 0, "the size must be a multiple of the subsampling")

    def size(self, plane: int) -> tuple[int, int]:
        f = self.format
        return (self.width >> f.ss_w, self.height >> f.ss_h) if f.chroma(plane) else (self.width, self.height)

    def but(self, **changes) -> VideoInfo:
        return replace(self, **changes)


@dataclass(frozen=True)
class AudioInfo:
    rate: int
    length: int
    channels: tuple[int, ...] = (0, 1)  # ids, ascending
    sample: int = INTEGER
    bits: int = 16

    def __post_init__(self):
        need(self.length >= 1 and self.rate >= 1, "length and rate are positive")
        need(self.bits == 32 if self.sample == FLOAT else 16 <= self.bits <= 32, "integer samples have 16 to 32 bits, float ones 32")
        need(len(self.channels) > 0 and tuple(sorted(set(self.channels))) == tuple(self.channels), "channels are ascending and differ")

    @property
    def is_float(self) -> bool:
        return self.sample == FLOAT

    @property
    def blocks(self) -> int:
        return -(-self.length // BLOCK)

    def but(self, **changes) -> AudioInfo:
        return replace(self, **changes)
