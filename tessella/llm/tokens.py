"""Token ids of whole texts by a tokenizers file, made once for each different piece of text in a task.

A text is cut where its tokenizer cannot join: before white space that follows a letter, digit or
sign known not to be white space itself, and between an ASCII letter and a sign after it (but for
those in contractions and special tokens). Pieces seen before get their ids from a bounded cache, found
by hash and compared byte by byte, so equal words are tokenized once; a text without such places is one piece, tokenized whole.
"""

from __future__ import annotations

import os

import numpy as np

from tessella.llm import words as W

_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
#: Signs that end a run of letters and belong to no contraction or special token.
_SIGN = np.zeros(256, bool)
_SIGN[list(b'!"#$%&()*+,-./:;=?@[]^_`{}~')] = True
SLICE = 1 << 20


def pieces(data: np.ndarray, offsets: np.ndarray, spaced: bool) -> W.Words:
    """The pieces in order. spaced: white space is dropped, and A-Z count as a-z."""
    n = len(data)
    edge = offsets[offsets < n]
    head = np.zeros(n, bool)
    if n > 1:
        head[1:] = _SIGN[data[1:]] & _LETTER[data[:-1]]
    if spaced:
        inside = W.SPACED[data]
        head[1:] |= inside[1:] & ~inside[:-1]
        head[edge] = True
        head &= inside
        starts = np.flatnonzero(head)
        stop = np.zeros(n + 1, bool)
        stop[:n] = ~inside
        stop[offsets] = True
        stop[starts] = True
        stop = np.flatnonzero(stop)
        ends = stop[np.searchsorted(stop, starts, "right")] if len(starts) else starts
    else:
        if n > 1:
            before = _PLAIN[data[:-1]].copy()
            before[1:] |= (data[1:-1] >= 0x80) & (data[:-2] == 0xC3)
            head[1:] |= ~W.SPACED[data[1:]] & before
        head[edge] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], n)[: len(starts)]
    return W.Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


_held: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, spaced: bool = False) -> "Encoder":
    """This worker process's encoder, with what it has learned in earlier tasks."""
    if (path, spaced) not in _held:
        _held[path, spaced] = Encoder(path, spaced)
    return _held[path, spaced]


class Encoder:
    """Ids of many texts at a time. spaced: the tokenizer drops white space and lower-cases ASCII."""

    def __init__(self, path: str, spaced: bool = False, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.keep = Tokenizer.from_file(path), spaced, keep
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._reset()

    def _reset(self) -> None:
        self.keys, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 20, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32), 0
        self.at, self.bytes, self.held = np.zeros(0, np.int64), np.zeros(1 << 20, np.uint8), 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """Where each of the sorted keys is held, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch([x.decode() for x in texts], add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        ids = self._ids(texts)
        size, long = np.array([len(x) for x in ids], np.int32), np.array([len(x) for x in texts], np.int64)
        flat, whole = np.array([i for x in ids for i in x], self.flat.dtype), np.frombuffer(b"".join(texts), np.uint8)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.held + len(whole) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.bytes[self.held : self.held + len(whole)] = whole
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, self.used + np.cumsum(size) - size)
        self.at = np.insert(self.at, at, self.held + np.cumsum(long) - long)
        self.size = np.insert(self.size, at, size)
        self.used, self.held = self.used + len(flat), self.held + len(whole)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(uint32 ids of all texts, where each text's begin); with `end`, that id closes each text."""
        if self.spaced and not ((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any():  # with "<|" case may tell special tokens from text
            data = W.LOWER[data]
        got = pieces(data, offsets, self.spaced)
        keys, first, which = np.unique(got.hashes(), return_index=True, return_inverse=True)
        at = self._place(keys)
        if (at < 0).any():
            if len(self.keys) + (at < 0).sum() > self.keep:  # begins anew with what this slice has
                self._reset()
                at[:] = -1
            new = first[at < 0]
            whole = data.tobytes()
            self._learn(keys[at < 0], [whole[a:b] for a, b in zip(got.starts[new].tolist(), got.ends[new].tolist(), strict=True)])
            at = self._place(keys)
        slot = at[which]
        size, source = self.size[slot], self.start[slot]
        flat = self.flat[: self.used]
        apart = np.flatnonzero(~W.same_bytes(data, got.starts, self.bytes[: self.held], self.at[slot], got.ends - got.starts))
        if len(apart):  # other pieces of the same hash have ids of their own
            ids = self._ids([got.text(i, i + 1) for i in apart.tolist()])
            size[apart] = own = np.array([len(x) for x in ids])
            source[apart] = len(flat) + np.cumsum(own) - own
            flat = np.concatenate([flat, np.array([i for x in ids for i in x], flat.dtype)])
        to = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        edge = to[got.first]
        n = len(offsets) - 1
        gap = np.arange(n + 1) if end is not None else np.zeros(n + 1, np.int64)
        out = np.zeros(to[-1] + gap[-1], np.uint32)
        steps = np.arange(to[-1])
        source = np.repeat(source - to[:-1], size) + steps
        out[np.repeat(np.repeat(gap[:-1], got.counts), size) + steps if end is not None else steps] = flat[source]
        starts = edge + gap
        if end is not None:
            out[starts[1:] - 1] = end
        return out, starts
