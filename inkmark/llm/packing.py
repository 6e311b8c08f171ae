"""Vector bin packing of tokenised examples into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.llm.tokenizing import encoder

#: The registered queries' limits: tokens, segments and loss-bearing tokens of a sequence. A document is an example
#: whose first eighth of tokens, 256 at most, is context that bears no loss.
PRODUCTION = {"tokens": 2048, "segments": 12, "loss": 1920, "context": (8, 256)}


@dataclass
class Piece:
    """Tokens ids[start : start + len] of an example; those at or after `bears` bear loss."""

    id: object
    start: int
    ids: np.ndarray
    total: int
    bears: int = 0

    @property
    def loss(self) -> int:
        return min(len(self.ids), max(0, self.start + len(self.ids) - self.bears))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.id, self.start, self.ids[:n], self.total, self.bears), Piece(self.id, self.start + n, self.ids[n:], self.total, self.bears)


class Packer:
    """A bounded pool of pieces from which sequences are filled.

    Of the pieces that fit into what is left of all limits (tokens, segments, loss-bearing tokens) the one with the
    largest dot product of its sizes and the remaining room, both as shares of the limits, goes next. When none
    fits, the piece with the largest product is cut to fill the room. A sequence that a limit other than that of
    tokens closes, and the last ones of a task, end at a power of two, where no padding is due.
    """

    def __init__(self, tokens: int = 2048, segments: int = 256, loss: int | None = None, pool: int = 512):
        self.limits = np.array([tokens, segments, loss or tokens], float)
        self.size, self.pieces = np.zeros((3, pool)), [None] * pool  # a free place has no size
        self.free, self.held = list(range(pool)), 0
        self.closed: Counter = Counter()  # sequences by the limit that ended them

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Takes a piece; gives the sequences that this completes."""
        most = int(self.limits[0])
        while len(piece.ids) >= most and self.limits[2] >= most:
            head, piece = piece.cut(most)
            yield [head]
        while len(piece.ids) > most:  # a lower limit of loss-bearing tokens: by the pool
            head, piece = piece.cut(most)
            yield from self._hold(head)
        if len(piece.ids):
            yield from self._hold(piece)

    def _hold(self, piece: Piece) -> Iterator[list[Piece]]:
        while not self.free:
            yield self._fill(int(self.limits[0]))
        self._put(piece)

    def _put(self, piece: Piece) -> None:
        at = self.free.pop()
        self.pieces[at], self.size[:, at] = piece, (len(piece.ids), 1, piece.loss)
        self.held += len(piece.ids)

    def _take(self, at: int) -> Piece:
        piece, self.pieces[at] = self.pieces[at], None
        self.size[:, at] = 0
        self.free.append(at)
        self.held -= len(piece.ids)
        return piece

    def _fill(self, tokens: int) -> list[Piece]:
        room, found, n = self.limits.copy(), [], 0
        room[0] = tokens
        while room[0] > 0 and room[1] > 0 and self.held:
            weight = (room / self.limits**2) @ self.size
            length, _, loss = self.size
            fitting = np.where((length <= room[0]) & (loss <= room[2]), weight, 0.0)  # a segment fits while there is room
            at = int(fitting.argmax())
            if fitting[at] > 0:
                piece = self._take(at)
            else:
                most = np.minimum(np.minimum(room[0], length), room[2] + (length - loss))  # what bears no loss comes first
                at = int(np.where(most > 0, weight, -1.0).argmax())
                if most[at] <= 0:
                    break
                piece, rest = self._take(at).cut(int(most[at]))
                if len(rest.ids):
                    self._put(rest)
            found.append(piece)
            room -= (len(piece.ids), 1, piece.loss)
            n += len(piece.ids)
        self.closed["tokens" if room[0] <= 0 else "segments" if room[1] <= 0 else "loss" if self.held else "end"] += 1
        over = n - (1 << (n.bit_length() - 1)) if n < self.limits[0] else 0
        while over:  # ends at a power of two
            piece = found.pop()
            if len(piece.ids) > over:
                piece, rest = piece.cut(len(piece.ids) - over)
                found.append(piece)
                self._back(rest)
                over = 0
            else:
                self._back(piece)
                over -= len(piece.ids)
        return found

    def _back(self, piece: Piece) -> None:
        if not self.free:  # a cut piece comes back into a full pool
            self.free.append(len(self.pieces))
            self.pieces.append(None)
            self.size = np.hstack([self.size, np.zeros((3, 1))])
        self._put(piece)

    def rest(self) -> Iterator[list[Piece]]:
        while self.held:
            yield self._fill(int(min(self.limits[0], 1 << (self.held.bit_length() - 1))))


def pack(docs: DataFrame, path: str, *, tokens: int = 2048, segments: int = 256, loss: int | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, context: tuple[int, int] | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens): one row a piece.

    An example's ids are those of its prompt (none by default), of its text, and end_id. The prompt bears no loss; nor
    does, with a context of (share, most), the text's beginning: a share-th of the example's ids, `most` at most. Each
    id lies in exactly one piece; pieces of a sequence follow on each other from 0. Null and empty texts have end_id
    alone; very long ones are packed whole, in as many pieces as they need. Repeated rows are packed as often as they
    stand, null ids stay, an empty table gives no rows; other columns of docs, of any name, are left alone.

    Each task packs what it reads, through a pool of bounded size: no shuffle, memory independent of the input, and
    a lost task packs the same rows again. sequence_id is unique over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, packer = encoder(path), Packer(tokens, segments, loss)
        number, out = TaskContext.get().partitionId() << 33, []

        def sequences() -> Iterator[list[Piece]]:
            for b in batches:
                for i, text, prompt in zip(*b.columns, strict=True):
                    ids = e.encode(prompt.as_py())
                    bears = len(ids)
                    ids += e.encode(text.as_py()) + array("I", [end_id])
                    bears = max(bears, min(len(ids) // context[0], context[1])) if context else bears
                    yield from packer.add(Piece(i.as_py(), 0, np.array(ids, "<u4"), len(ids), bears))
            yield from packer.rest()

        for sequence in sequences():
            at = 0
            for p in sequence:
                out.append((p.id, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, number, at, p.loss))
                at += len(p.ids)
            number += 1
            if len(out) >= 10_000:
                yield table(out)
                out = []
        yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    kind = docs.select(id_col).schema[0].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    schema = pa.schema([("id", to_arrow_type(kind)), *((n, pa.int64()) for n in names)])
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(prompt_col) if prompt_col else F.lit(None).cast("string")).alias("prompt"))
    return chosen.mapInArrow(run, f"id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names))
