"""Sum-of-squares online packing of tokenized documents into fixed windows.

Every task packs the documents it reads as they come. ``level[h]`` counts the open windows filled to ``h``
tokens; a piece goes to the open window, or to a new one, whose choice leaves the smallest sum of squared
counts. Nothing else decides. When the open windows hold more than ``max_held`` tokens, or the rows end, they are
poured together: documents are cut so that all windows but one are full. The last one is cut at powers of two,
so a task leaves almost no padding. A task's memory is bounded by ``max_held`` and one batch of documents;
nothing is shuffled.

Cases: a null or empty text has just the closing id; rows with null ids, repeated rows and ties are packed
like any other; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.bpe_words import word_tokenizer

WINDOW = 2048
MAX_HELD = 4 << 20  # tokens: 16 MB of ids
END_ID = 1
#: Sequence ids of a task begin at its number times this.
TASK_STRIDE = 1 << 33

Piece = tuple[int, int, int]  # document's index, start, length


class SumOfSquares:
    """Packs lengths; yields ``(document, start, length, window, offset)``."""

    def __init__(self, capacity: int = WINDOW, max_held: int = MAX_HELD, first_window: int = 0):
        self.capacity, self.max_held = capacity, max_held
        self.level = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}  # fill level: windows
        self.pieces: dict[int, list[Piece]] = {}
        self.next = first_window
        self.held = 0  # tokens in open windows

    def _choose(self, size: int) -> int:
        """The fill level whose window takes the piece; 0 for a new window."""
        c, level = self.capacity, self.level
        heights = np.flatnonzero(level[: c - size + 1])
        after = heights + size
        # d/d(sum of squares): one window leaves level h, one joins h + size (not when full); a new one only joins
        cost = 1 - 2 * level[heights] + np.where(after < c, 1 + 2 * level[after], 0)
        new = 1 + 2 * int(level[size]) if size < c else 0
        if not len(cost) or (least := int(cost.min())) > new:
            return 0
        return int(heights[cost == least][-1])  # ties: the fullest

    def _put(self, height: int, piece: Piece) -> Iterator[tuple[int, int, int, int, int]]:
        if height:
            windows = self.open[height]
            window = windows.pop()
            self.level[height] -= 1
            if not windows:
                del self.open[height]
            self.held -= height
        else:
            window, self.next = self.next, self.next + 1
            self.pieces[window] = []
        held = self.pieces[window]
        held.append(piece)
        filled = height + piece[2]
        if filled == self.capacity:
            yield from self._emit(window)
        else:
            self.open.setdefault(filled, []).append(window)
            self.level[filled] += 1
            self.held += filled

    def _emit(self, window: int) -> Iterator[tuple[int, int, int, int, int]]:
        offset = 0
        for doc, start, length in self.pieces.pop(window):
            yield doc, start, length, window, offset
            offset += length

    def add(self, doc: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
        start = 0
        while length - start >= self.capacity:
            yield from self._put(0, (doc, start, self.capacity))
            start += self.capacity
        if start < length:
            size = length - start
            yield from self._put(self._choose(size), (doc, start, size))
        if self.held > self.max_held:
            yield from self._pour()

    def _pour(self, end: bool = False) -> Iterator[tuple[int, int, int, int, int]]:
        """Pours the open windows together, fullest first. What fills no window stays open or, at the end, is cut at powers of two."""
        left = [p for h in sorted(self.open, reverse=True) for w in self.open[h] for p in self.pieces.pop(w)]
        self.open, total, self.held = {}, self.held, 0
        self.level[:] = 0
        room, offset, rest = self._room(total), 0, []
        for doc, start, length in left:
            while length:
                size = min(length, room - offset)
                if end or room == self.capacity:
                    yield doc, start, size, self.next, offset
                else:
                    size = length
                    rest.append((doc, start, size))
                start, length, offset, total = start + size, length - size, offset + size, total - size
                if offset == room and not rest:
                    self.next += 1
                    room, offset = self._room(total), 0
        if rest:
            filled = sum(p[2] for p in rest)
            self.pieces[self.next], self.open[filled], self.level[filled], self.held = rest, [self.next], 1, filled
            self.next += 1

    def finish(self) -> Iterator[tuple[int, int, int, int, int]]:
        yield from self._pour(end=True)

    def _room(self, total: int) -> int:
        return self.capacity if total >= self.capacity else 1 << max(total.bit_length() - 1, 0)


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_held: int = MAX_HELD, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: the document's id, ``start``, ``length``, ``doc_tokens``, ``sequence_id``,
    ``offset`` and ``ids`` (little-endian unsigned 32-bit token ids)."""
    import pyarrow as pa

    ids_type = docs.schema[id_col].dataType
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        encode = word_tokenizer(tokenizer).encode
        packer = SumOfSquares(window, max_held, TaskContext.get().partitionId() * TASK_STRIDE)
        tokens: dict[int, tuple[int, bytes]] = {}  # of documents with pieces in open windows: from which token on, ids
        names: dict[int, tuple[object, int]] = {}  # id, tokens
        count = 0

        def rows(placed: list) -> pa.RecordBatch:
            cut = lambda d, s, n: tokens[d][1][4 * (s - tokens[d][0]) : 4 * (s - tokens[d][0] + n)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([names[p[0]][0] for p in placed], kind),
                    pa.array([p[1] for p in placed], pa.int64()),
                    pa.array([p[2] for p in placed], pa.int64()),
                    pa.array([names[p[0]][1] for p in placed], pa.int64()),
                    pa.array([p[3] for p in placed], pa.int64()),
                    pa.array([p[4] for p in placed], pa.int64()),
                    pa.array([cut(*p[:3]) for p in placed], pa.binary()),
                ],
                ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            texts = batch.column(1)
            ids = batch.column(0).to_pylist()
            for low in range(0, batch.num_rows, 256):
                placed, fresh = [], count
                for k, text in enumerate(texts.slice(low, 256).to_pylist(), low):
                    data = encode(text or "") + end
                    tokens[count] = 0, data
                    names[count] = ids[k], len(data) // 4
                    placed.extend(packer.add(count, len(data) // 4))
                    count += 1
                if placed:
                    yield rows(placed)
                open_from: dict[int, int] = {}  # first token that an open window still needs
                for held in packer.pieces.values():
                    for d, start, _ in held:
                        open_from[d] = min(start, open_from.get(d, start))
                tokens = {d: (tokens[d] if d < fresh or not start else (start, tokens[d][1][4 * start :])) for d, start in open_from.items()}
                names = {d: names[d] for d in open_from}
        if kind is not None and (placed := list(packer.finish())):
            yield rows(placed)

    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {ids_type.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    return packed.withColumnRenamed("id", id_col)


def op4_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from chronolith.llm.common import table

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
