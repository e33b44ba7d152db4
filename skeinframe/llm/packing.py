"""Packing tokenized documents into fixed windows with bounded open space.

Each task keeps a fixed number of open windows. A document's whole windows leave
at once; its rest goes to the open window that it fits best. When none fits and
no more may be opened, the fullest leaves. What is open at the end of a task is
merged with that of neighbouring tasks, longest pieces first.

Nothing is shuffled but the pieces left open: at most `open_windows` windows a
task, and MERGED tasks meet in one merge.

Cases: a null text is an empty one, which has the end id alone; a null id stays
null; rows with equal ids are packed each for itself; an empty table gives no
rows; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinframe.llm import _common, bpe

#: Tasks whose open windows are merged together.
MERGED = 16
#: Sequence ids: of a task's own windows the task's number above this many bits, of merged ones also MERGE_BIT.
TASK_BITS, MERGE_BIT = 40, 1 << 62

FIELDS = (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"))


class Windows:
    """Open windows by free space; a bit set of the spaces finds the best fit."""

    def __init__(self, size: int, most: int | None):
        self.size, self.most, self.open = size, most, 0
        self.by_free: dict[int, list[list]] = {}
        self.frees = 0

    def _put(self, free: int, window: list) -> None:
        if free:
            self.by_free.setdefault(free, []).append(window)
            self.frees |= 1 << free
            self.open += 1

    def _take(self, free: int) -> list:
        window = self.by_free[free].pop()
        if not self.by_free[free]:
            del self.by_free[free]
            self.frees &= ~(1 << free)
        self.open -= 1
        return window

    def place(self, piece: tuple, length: int) -> Iterator[list]:
        """Windows that leave."""
        fits = self.frees >> length << length
        free = (fits & -fits).bit_length() - 1 if fits else self.size
        window = self._take(free) if fits else []
        if not fits and self.most is not None and self.open >= self.most:
            yield self._take((self.frees & -self.frees).bit_length() - 1)
        window.append(piece)
        if free == length:
            yield window
        else:
            self._put(free - length, window)

    def rest(self) -> Iterator[list]:
        while self.open:
            yield self._take((self.frees & -self.frees).bit_length() - 1)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, open_windows: int = 512, vocab: str = bpe.VOCAB, end_id: int = 0) -> DataFrame:
    """A row per piece: the id, start (the document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the vocabulary and end_id. Each lies in one piece. Only the last piece of a document is
    shorter than a window, and a window holds pieces without gaps from 0.
    """
    spark = docs.sparkSession
    _common.prepare(spark)
    kind = docs.schema[id_col].dataType
    fields = ", ".join(f"{n} {t}" for n, t in FIELDS)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder, windows, made = bpe.load(vocab), Windows(size, open_windows), 0
        rows: list[tuple] = []
        id_type = None

        def close(window: list, left: bool) -> None:
            nonlocal made
            offset = 0
            for piece in window:
                rows.append((*piece, (task << TASK_BITS) | made, offset, left))
                offset += piece[2]
            made += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.bool_()), pa.array([task] * len(columns[0]), pa.int32())]
            return pa.RecordBatch.from_arrays(arrays, ["id", *(n for n, _ in FIELDS), "left_over", "task"])

        for batch in batches:
            keys, id_type = batch.column(0).to_pylist(), batch.column(0).type
            for i, j, ids, counts in encoder.column(batch.column(1)):
                ids, off = bpe.with_end(ids, counts, end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = off.tolist()
                for key, a, b in zip(keys[i:j], ends[:-1], ends[1:], strict=True):
                    for s in range(a, b, size):
                        n = min(size, b - s)
                        piece = (key, s - a, n, zlib.crc32(raw[4 * s : 4 * (s + n)]), b - a)
                        if n == size:
                            close([piece], False)
                        else:
                            for window in windows.place(piece, n):
                                close(window, False)
                if len(rows) > 20_000:
                    yield flush()
        for window in windows.rest():
            close(window, True)
        if rows:
            yield flush()

    def merge(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        windows, rows, made = Windows(size, None), [], (int(key[0]) << TASK_BITS) | MERGE_BIT
        pieces = pieces.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable")

        def close(window: list) -> None:
            nonlocal made
            offset = 0
            for at, n in window:
                rows.append((at, made, offset))
                offset += n
            made += 1

        for at, n in enumerate(pieces["length"].tolist()):
            for window in windows.place((at, n), n):
                close(window)
        for window in windows.rest():
            close(window)
        at, sequence, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        return pieces.iloc[at].assign(sequence_id=sequence, offset=offset)[["id", *(n for n, _ in FIELDS)]]

    schema = f"id {kind.simpleString()}, {fields}"
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(first, f"{schema}, left_over boolean, task int")
    made = _common.settle(made, "pack")
    names = ["id", *(n for n, _ in FIELDS)]
    left = made.where("left_over").withColumn("g", F.floor(F.col("task") / MERGED))
    merged = left.groupBy("g").applyInPandas(merge, schema)
    return made.where("not left_over").select(names).unionByName(merged).withColumnRenamed("id", id_col)
