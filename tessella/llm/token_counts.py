"""Token counts of whole texts by a sentencepiece model, huge texts in overlapping chunks.

A text longer than CHUNK bytes is encoded in chunks with offsets. A chunk begins after a space
(whose place the model's own leading mark takes), and its encoding is spliced to the one before at
the first boundary in their overlap that is stable: both encodings have a token border there, no
piece of the vocabulary has the mark for a space after another character, so no merge crosses it,
and the next tokens in both agree. Where an overlap has no such place, it is widened; a text without
any is encoded whole.

Defined results: null and empty texts have no bytes and no tokens; every row gives a row, equal ones
too; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import words as W

CHUNK, OVERLAP, AGREE = 20_000, 256, 4
LIMIT = 4096
_MARK = "▁"


class Counter:
    """Counts by one model. `stable`: whether no piece has the space mark after another character."""

    def __init__(self, model: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model, self.chunk, self.overlap = sentencepiece.SentencePieceProcessor(model_file=model), chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.stable = not any(_MARK in x.lstrip(_MARK) for x in pieces)

    def _tokens(self, data: bytes, begin: int, end: int) -> tuple[list[int], list[int]]:
        """(ids, the byte after `begin` that each token begins at), of whole characters before `end`."""
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        got = self.model.encode(data[begin:end].decode(), return_type="proto").pieces
        return [p.id for p in got], [p.begin for p in got]

    def count(self, text: str) -> int:
        if len(text) <= self.chunk // 4 or not self.stable or len(data := text.encode()) <= self.chunk:
            return len(self.model.encode(text))
        return sum(map(len, self.spliced(data)))

    def spliced(self, data: bytes) -> Iterator[list[int]]:
        """The ids of each part of a UTF-8 text between two splices."""
        begin, end = 0, self.chunk
        ids, at = self._tokens(data, 0, end)
        low = 0  # tokens of this chunk that begin before this byte of it belong to the part before
        while begin + end < len(data):
            overlap, splice = self.overlap, None
            while splice is None:
                place = self._after_space(data, begin + max(low + 1, end - overlap), begin + end)
                if place is not None:
                    more, where = self._tokens(data, place, place + self.chunk)
                    splice = self._common(ids, at, more, where, place - begin, low)
                if splice is None and overlap < end - low:
                    overlap *= 2
                elif splice is None:  # nothing in the whole chunk: take in more text
                    end, overlap = end + self.chunk, self.overlap
                    ids, at = self._tokens(data, begin, begin + end)
                    if begin + end >= len(data):
                        break
            if splice is None:
                break
            own, mark = splice
            yield [x for x, y in zip(ids[:own], at, strict=False) if y >= low]
            begin, end, low = place, self.chunk, mark
            ids, at = more, where
        yield [x for x, y in zip(ids, at, strict=True) if y >= low]

    def _after_space(self, data: bytes, low: int, high: int) -> int | None:
        """The first place from low on that follows a single space between other characters."""
        at = data.find(b" ", low, high)
        while at >= 0:
            if 0 < at < len(data) - 1 and data[at - 1] != 0x20 and data[at + 1] != 0x20:
                return at + 1
            at = data.find(b" ", at + 1, high)
        return None

    def _common(self, ids: list[int], at: list[int], more: list[int], where: list[int], shift: int, low: int) -> tuple[int, int] | None:
        """(index in ids, byte of the later chunk) of the first token after the later chunk's beginning from
        which AGREE tokens agree, if it begins with the space mark and neither encoding has a token over it."""
        place = {x + shift: k for k, x in reversed(list(enumerate(where))) if x > 0}
        for i, x in enumerate(at):
            k = place.get(x)
            if k is None or x <= low or i and at[i - 1] == x:
                continue
            if not self.model.id_to_piece(ids[i]).startswith(_MARK) or self.model.id_to_piece(ids[i - 1]).endswith(_MARK):
                continue
            if i + AGREE < len(ids) and ids[i : i + AGREE] == more[k : k + AGREE]:
                return i, x - shift
        return None


_held: dict[str, Counter] = {}


def counted(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _held:
            _held[model] = Counter(model)
        for batch in W.slices(batches):
            texts = W.column(batch, "text")
            n = [_held[model].count(x) for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([W.column(batch, "doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
