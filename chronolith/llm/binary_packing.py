"""Best-fit-decreasing packing into binary token-id matrices.

Each task takes its documents in blocks of about ``block_tokens`` tokens, cuts documents longer than a window
into whole windows and a remainder, and packs the remainders longest first, each into the window with the
least room that still holds it; a segment tree over the amounts of room finds that window. A task writes
one matrix of ids (rows of ``window`` unsigned integers of two or four bytes, padded with zeros), the cumulative
segment lengths of each row (from 0), and the position reset of each segment: the document's tokens before it,
from which a reader counts on, or restarts at 0. Nothing is shuffled; memory is bounded by a block.

Files go to the shared folder. An attempt writes under names of its own; the table of finished files is written
as Parquet.

Cases: a null or empty text has just the closing id; very long texts are split without loss; null ids, repeated
rows and ties are packed like any other; an empty table gives no files; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.bpe_words import word_tokenizer
from chronolith.llm.common import materialize, work_path

WINDOW = 2048
END_ID = 49407
BLOCK_TOKENS = 1 << 21
CACHE = 700_000


class RoomTree:
    """Finds the least room of at least a size; leaves are amounts of room, with the windows that have it."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.n)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        i = room + self.n
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, window) of the best fit, which is removed."""
        i = size + self.n
        if not self.some[i]:
            while i > 1 and (i & 1 or not self.some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.n:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.n
        window = self.windows[room].pop()
        if not self.windows[room]:
            self.some[i] = 0
            i >>= 1
            while i and not (self.some[2 * i] or self.some[2 * i + 1]):
                self.some[i] = 0
                i >>= 1
        return room, window


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length); documents of 0 tokens have no piece."""
    windows: list[list[tuple[int, int, int]]] = []
    rest = []
    for d, n in enumerate(lengths):
        whole = n - n % window
        windows.extend([(d, s, window)] for s in range(0, whole, window))
        if n % window:
            rest.append((n % window, d, whole))
    tree = RoomTree(window)
    for size, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        found = tree.take(size)
        if found is None:
            found = window, len(windows)
            windows.append([])
        windows[found[1]].append((d, start, size))
        if found[0] > size:
            tree.add(found[0] - size, found[1])
    return windows


def position_ids(cu_seqlens: list[int], resets: list[int] | None = None) -> np.ndarray:
    """Positions of a row's tokens: from 0 in each segment, or from its reset."""
    parts = [np.arange(b - a) + (resets[i] if resets else 0) for i, (a, b) in enumerate(zip(cu_seqlens, cu_seqlens[1:]))]
    return np.concatenate(parts) if parts else np.empty(0, int)


def write_matrices(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Writes the matrices; returns one row for each matrix row: folder, row, the byte at which its entries begin in
    ``cu_seqlens.bin`` and in ``resets.bin``, and the ids of its documents."""
    import pyarrow as pa
    from pyarrow import fs

    folder = work_path(docs.sparkSession, "matrices")
    kind = docs.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(width, "little")

    def run(batches: Iterator) -> Iterator:
        encode = word_tokenizer(tokenizer, width, CACHE).encode
        uri = f"{folder}/{uuid.uuid4().hex}"
        store, path = fs.FileSystem.from_uri(uri)
        ids_file = None
        row = cu_at = resets_at = 0
        arrow_id = None

        def pack(names: list, tokens: list[bytes]) -> pa.RecordBatch:
            nonlocal row, ids_file, cu_at, resets_at
            if ids_file is None:
                store.create_dir(path, recursive=True)
                ids_file = store.open_output_stream(f"{path}/ids.bin"), store.open_output_stream(f"{path}/cu_seqlens.bin"), store.open_output_stream(f"{path}/resets.bin")
            placed = best_fit_decreasing([len(t) // width for t in tokens], window)
            cols: list[list] = [[], [], []]
            for pieces in placed:
                data = b"".join([tokens[d][width * s : width * (s + n)] for d, s, n in pieces])
                ids_file[0].write(data.ljust(window * width, b"\0"))
                cu = [0]
                for _, _, n in pieces:
                    cu.append(cu[-1] + n)
                starts = [s for _, s, _ in pieces]
                ids_file[1].write(np.array([len(cu), *cu], "<u4").tobytes())
                ids_file[2].write(np.array([len(starts), *starts], "<u4").tobytes())
                cols[0].append([names[d] for d, _, _ in pieces])
                cols[1].append(cu_at)
                cols[2].append(resets_at)
                cu_at, resets_at = cu_at + 4 * (1 + len(cu)), resets_at + 4 * (1 + len(starts))
            first, row = row, row + len(placed)
            return pa.RecordBatch.from_arrays(
                [pa.array([uri] * len(placed)), pa.array(range(first, row), pa.int64()), pa.array(cols[0], pa.list_(arrow_id)), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                ["uri", "row", "ids", "cu_at", "resets_at"],
            )

        names: list = []
        tokens: list[bytes] = []
        held = 0
        for batch in batches:
            arrow_id = batch.schema.field(0).type
            texts, ids = batch.column(1), batch.column(0).to_pylist()
            for low in range(0, batch.num_rows, 256):
                for k, text in enumerate(texts.slice(low, 256).to_pylist(), low):
                    names.append(ids[k])
                    tokens.append(encode(text or "") + end)
                    held += len(tokens[-1]) // width
                    if held >= block_tokens:
                        yield pack(names, tokens)
                        names, tokens, held = [], [], 0
        if tokens:
            yield pack(names, tokens)
        for f in ids_file or ():
            f.close()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"uri string, row long, ids array<{kind}>, cu_at long, resets_at long")
    return materialize(rows, "matrix-rows")


def _entries(file, at: int) -> list[int]:
    """The numbers of one row in a file of counted rows."""
    file.seek(at)
    return np.frombuffer(file.read(4 * int.from_bytes(file.read(4), "little")), "<u4").tolist()


def read_pieces(rows: DataFrame, *, window: int = WINDOW, width: int = 2) -> DataFrame:
    """Reads the three files back: one row for each piece, with a checksum of its ids as unsigned 32-bit integers."""
    import pyarrow as pa
    from pyarrow import fs

    kind = rows.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator) -> Iterator:
        opened: dict = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for r in batch.to_pylist():
                if (r["uri"], "ids") not in opened:
                    for f in opened.values():
                        f.close()
                    store, path = fs.FileSystem.from_uri(r["uri"])
                    opened = {(r["uri"], f): store.open_input_file(f"{path}/{f}.bin") for f in ("ids", "cu_seqlens", "resets")}
                ids_file, cu_file, resets_file = opened.values()
                ids_file.seek(r["row"] * window * width)
                ids = np.frombuffer(ids_file.read(window * width), f"<u{width}").astype("<u4")
                cu, starts = _entries(cu_file, r["cu_at"]), _entries(resets_file, r["resets_at"])
                if len(starts) != len(r["ids"]) or len(cu) != len(starts) + 1 or cu[0]:
                    raise ValueError("segments differ from the table of rows")
                if ids[cu[-1] :].any():
                    raise ValueError("padding is not zero")
                for i, (doc, start) in enumerate(zip(r["ids"], starts)):
                    a, b = cu[i], cu[i + 1]
                    for c, x in zip(out, (doc, start, b - a, zlib.crc32(ids[a:b].tobytes()), r["uri"][-32:], r["row"], a)):
                        c.append(x)
            kinds = [batch.schema.field("ids").type.value_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["id", "start", "length", "ids_crc32", "matrix", "matrix_row", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, matrix string, matrix_row long, offset long")


def op7_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from chronolith.llm.common import table

    rows = write_matrices(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_pieces(rows).withColumnRenamed("id", "doc_id")
