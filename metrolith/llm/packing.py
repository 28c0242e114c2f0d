"""Operator 5: documents into sequences of bounded length, by bounded-space online best fit.

A fixed number of bins stays open, in stacks by their free space; a bitset says which free spaces exist. A piece goes
to the open bin with the least space that holds it: the lowest set bit at or above its length. If there is none, a new
bin opens, and if all places are taken the fullest bin closes first. Pieces arrive longest first within a partition,
so a partition of up to `open_bins` bins gets the packing of best fit decreasing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, encoder, small_batches, trim

OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Bins:
    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.most = capacity, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = self.open = self.made = 0

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        bin_ = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        self.open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of that length, 0 to the capacity."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
            bin_, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.stacks[left].append(bin_)
            self.mask |= 1 << left
            self.open += 1
        return bin_, self.capacity - free


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", keep: int = 500_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document of up to `capacity` ids whole; of a longer one the first
    piece takes the rest of the division, so all others fill a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encoder.cache_info().currsize:
            trim()
        encode, end = encoder(tokenizer, keep), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(t.as_py()) + end)
                n = len(ids) // 4
                at = k = 0
                size = n % capacity or capacity
                while at < n:
                    for column, x in zip(rows, (d, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                        column.append(x)
                    at, k, size = at + size, k + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(rows: DataFrame, capacity: int, open_bins: int = 32_768, rows_a_task: int = 50_000) -> DataFrame:
    """Gives each row of `pieces` its sequence_id and offset. Sequences are numbered by partition and bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = Bins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    tasks = max(1, -(-rows.count() // rows_a_task))
    return rows.repartition(tasks, "doc_id", "piece", "start", "ids_crc32").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32").mapInArrow(run, OUT)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, open_bins: int = 32_768, id_col: str = "doc_id", text_col: str = "text", keep: int = 500_000) -> DataFrame:
    """Every row of docs in sequences of at most `capacity` ids, its own end id included.

    A null or empty text is the end id alone; null ids and repeated rows are packed like any other; other columns are
    ignored; an empty table gives no row. The pieces, without their ids, are cut into the shared folder, so texts are
    encoded once.
    """
    return pack(cut(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, keep)), capacity, open_bins)
