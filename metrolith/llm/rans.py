"""Operator 1: token ids of documents in files coded by a static range asymmetric numeral system (rANS).

A file holds whole documents in ascending order of id. Its symbol frequencies are counted first and kept once in its
header; all its blocks share that table. A block interleaves `LANES` coder states, so numpy advances all of them at a
time, and stands alone: it has its own length, checksum and checkpoints (coder states at regular steps), from which a
reader may begin without what comes before.

File layout, little-endian: magic `MRANS1`, u32 header length, header (zlib-packed JSON: vocabulary bound, symbols and
frequencies, documents, blocks with offset, token range, crc32, checkpoints), then the blocks' 32-bit words.
"""

from __future__ import annotations

import base64
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, encoder, filesystem, small_batches, work_folder

MAGIC = b"MRANS1"
SCALE = 20  # frequencies of a table add up to 2 ** SCALE
LOW = np.uint64(1 << 31)  # a state stays within [LOW, LOW << 32)
LANES = 1024
BLOCK = 1 << 20  # tokens
EVERY = 256  # steps between checkpoints
FILE_TOKENS = 1 << 24  # a task begins another file beyond that


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur, ascending, and their frequencies, each at least 1, adding up to 2 ** SCALE."""
    count = np.bincount(ids)
    symbols = np.flatnonzero(count)
    if len(symbols) > 1 << (SCALE - 1):
        raise ValueError(f"{len(symbols)} symbols; a table takes {1 << (SCALE - 1)}")
    if not len(symbols):
        return symbols.astype(np.uint32), symbols.astype(np.uint64)
    share = count[symbols] / count.sum() * (1 << SCALE)
    freq = np.maximum(1, np.floor(share)).astype(np.int64)
    left = (1 << SCALE) - int(freq.sum())
    if left > 0:
        freq[np.argmax(freq)] += left
    while left < 0:  # many rare symbols were rounded up to 1: the frequent ones pay
        cut = np.minimum(freq - 1, np.ceil(freq * (-left / freq.sum())).astype(np.int64))
        over = int(cut.sum()) + left
        if over > 0:
            order = np.argsort(-cut, kind="stable")
            back = np.minimum(cut[order], np.maximum(0, over - (np.cumsum(cut[order]) - cut[order])))
            cut[order] -= back
        freq -= cut
        left = (1 << SCALE) - int(freq.sum())
    return symbols.astype(np.uint32), freq.astype(np.uint64)


class Table:
    def __init__(self, symbols: np.ndarray, freq: np.ndarray) -> None:
        self.symbols, self.freq = symbols, freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.at = np.zeros(int(symbols.max()) + 1 if len(symbols) else 0, np.uint32)
        self.at[symbols] = np.arange(len(symbols), dtype=np.uint32)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, table: Table) -> tuple[bytes, list[tuple[int, int, str]]]:
    """Words of a block, and its checkpoints: (first token, words before it, the lanes' states in base 64).

    The coder runs from the last step to the first; the reader meets the words in their written order.
    """
    n = len(ids)
    index = table.at[ids]
    freq, start = table.freq[index], table.start[index]
    top = freq << np.uint64(63 - SCALE)  # ((LOW >> SCALE) << 32) * freq
    state = np.full(LANES, LOW, np.uint64)
    out: list[np.ndarray] = []
    written = 0
    marks: list[tuple[int, int, np.ndarray]] = []
    mask32, s32, scale = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(SCALE)
    for step in range((n - 1) // LANES, -1, -1):
        a = step * LANES
        b = min(n, a + LANES)
        x = state[: b - a]
        full = x >= top[a:b]
        if full.any():
            words = (x[full] & mask32).astype(np.uint32)
            out.append(words)
            written += len(words)
            x[full] >>= s32
        f = freq[a:b]
        q = x // f
        x[:] = (q << scale) + (x - q * f) + start[a:b]
        if step % EVERY == 0:
            marks.append((a, written, state.copy()))
    words = np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)
    return words.astype("<u4").tobytes(), [(a, len(words) - w, base64.b64encode(x.astype("<u8").tobytes()).decode()) for a, w, x in reversed(marks)]


def decode_block(data: bytes, n: int, marks: list, table: Table, first: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids of the block's tokens from `first`, beginning at the checkpoint at or before it."""
    stop = n if stop is None else min(stop, n)
    if first >= stop:
        return np.empty(0, np.uint32)
    at, pos, packed = max((m for m in marks if m[0] <= first), key=lambda m: m[0])
    state = np.frombuffer(base64.b64decode(packed), "<u8").astype(np.uint64)
    words = np.frombuffer(data, "<u4")
    slots, freqs, starts = table.slots, table.freq, table.start
    low, mask, scale, s32 = LOW, np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    out = np.empty(stop - at, np.uint32)
    for a in range(at, stop, LANES):
        b = min(n, a + LANES)
        x = state[: b - a]
        slot = x & mask
        index = slots[slot]
        x[:] = freqs[index] * (x >> scale) + slot - starts[index]
        need = x < low
        k = int(np.count_nonzero(need))
        if k:
            x[need] = (x[need] << s32) | words[pos : pos + k]
            pos += k
        out[a - at : b - at] = index[: max(0, stop - a)]
    return table.symbols[out][first - at :]


def pack_file(docs: list[tuple[int | None, int]], ids: np.ndarray) -> bytes:
    """docs: (doc_id, its number of tokens), in the order of ids."""
    table = Table(*frequencies(ids))
    blocks, body, offset = [], [], 0
    for a in range(0, len(ids), BLOCK):
        own = ids[a : a + BLOCK]
        data, marks = encode_block(own, table)
        blocks.append({"at": offset, "bytes": len(data), "first": a, "n": len(own), "crc32": zlib.crc32(data), "marks": marks})
        body.append(data)
        offset += len(data)
    head = {"symbols": base64.b64encode(table.symbols.astype("<u4").tobytes()).decode(), "freq": base64.b64encode(table.freq.astype("<u4").tobytes()).decode(), "doc_id": [d for d, _ in docs], "n": [n for _, n in docs], "blocks": blocks}
    packed = zlib.compress(json.dumps(head).encode(), 6)
    return b"".join([MAGIC, struct.pack("<I", len(packed)), packed, *body])


class TokenFile:
    """Reads one file; only its header until a span is asked for."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = filesystem(uri)
        with self.fs.open_input_file(self.path) as f:
            lead = f.read(len(MAGIC) + 4)
            if lead[: len(MAGIC)] != MAGIC:
                raise ValueError(f"{uri} is no token file")
            (size,) = struct.unpack("<I", lead[len(MAGIC) :])
            try:
                head = json.loads(zlib.decompress(f.read(size)))
            except zlib.error as e:
                raise ValueError(f"{uri}: the header is damaged") from e
        self.body = len(lead) + size
        self.docs, self.lengths, self.blocks = head["doc_id"], head["n"], head["blocks"]
        self.table = Table(*(np.frombuffer(base64.b64decode(head[k]), "<u4").astype(t) for k, t in (("symbols", np.uint32), ("freq", np.uint64))))
        self.n = sum(self.lengths)

    def span(self, first: int, stop: int) -> np.ndarray:
        """Ids first..stop of the file; of each block only what follows the nearest checkpoint is decoded."""
        out = []
        with self.fs.open_input_file(self.path) as f:
            for b in self.blocks:
                if b["first"] < stop and b["first"] + b["n"] > first:
                    f.seek(self.body + b["at"])
                    data = f.read(b["bytes"])
                    if zlib.crc32(data) != b["crc32"]:
                        raise ValueError(f"{self.path}: the block at token {b['first']} is damaged")
                    out.append(decode_block(data, b["n"], b["marks"], self.table, max(0, first - b["first"]), stop - b["first"]))
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def documents(self, block: int | None = None) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, first token, n_tokens, crc32 of the ids) of all documents, or of those that begin in one block: for a
        block, decoding starts at the checkpoint before the first of them and ends with the last, maybe in later blocks."""
        lengths = np.array(self.lengths, np.int64)
        first = np.cumsum(lengths) - lengths
        if block is None:
            lo, hi = 0, len(lengths)
        else:
            at = self.blocks[block]["first"]
            lo = 0 if block == 0 else int(np.searchsorted(first, at))
            hi = len(lengths) if block == len(self.blocks) - 1 else int(np.searchsorted(first, at + self.blocks[block]["n"]))
        step = 0
        for a in range(lo, hi):  # some documents at a time, about a block of tokens
            if a < step:
                continue
            step = max(a + 1, min(hi, int(np.searchsorted(first, first[a] + BLOCK))))
            raw = self.span(int(first[a]), int(first[step - 1] + lengths[step - 1])).astype("<u4").tobytes()
            for k in range(a, step):
                x = 4 * int(first[k] - first[a])
                yield self.docs[k], int(first[k]), int(lengths[k]), zlib.crc32(raw[x : x + 4 * int(lengths[k])])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_text_mb: int = 32) -> DataFrame:
    """Encodes every whole text into token files below `folder`; returns (path, file_no, sub, n_docs, n_tokens, n_blocks).

    Rows are put in ranges of (id, hash of the text), so that equal ids may span files; ids that are null come first.
    A null text counts as empty, repeated rows are kept, other columns are ignored. An empty table gives no file.
    A file is written under the attempt's own name and then renamed, so a task that is run again replaces it.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    parts = max(2, -(-size // (file_text_mb << 20)))
    order = ["d", F.xxhash64("t")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], np.uint32).tobytes()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        held: list[bytes] = []
        names: list[tuple[int | None, int]] = []
        sub = tokens = 0

        def close() -> pa.RecordBatch:
            nonlocal sub, tokens
            ids = np.frombuffer(b"".join(held), np.uint32)
            path = f"{base}/part-{part:07d}-{sub:04d}.rans"
            with fs.open_output_stream(f"{path}.{attempt}") as f:
                f.write(pack_file(names, ids))
            fs.move(f"{path}.{attempt}", path)
            made = pa.RecordBatch.from_pylist([{"path": f"{folder}/{path.rsplit('/', 1)[1]}", "file_no": part, "sub": sub, "n_docs": len(names), "n_tokens": len(ids), "n_blocks": -(-len(ids) // BLOCK)}], schema=pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("file_no", "sub", "n_docs", "n_tokens", "n_blocks"))]))
            held.clear()
            names.clear()
            sub, tokens = sub + 1, 0
            return made

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(t.as_py()) + end
                held.append(ids)
                names.append((d, len(ids) // 4))
                tokens += len(ids) // 4
                if tokens >= FILE_TOKENS:
                    yield close()
        if names:
            yield close()

    return rows.mapInArrow(write, "path string, file_no long, sub long, n_docs long, n_tokens long, n_blocks long")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from files (path, before, n_blocks), before being the number of tokens in the
    files ahead. A row a block is dealt to the tasks, so the blocks of a file are decoded side by side."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file = None, None
        for batch in batches:
            for path, before, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path != last:
                    last, file = path, TokenFile(path)
                rows = list(file.documents(block))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([before + r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = files.select("path", "before", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n_blocks").cast("int") - 1))).alias("block"))
    many = files.agg(F.sum("n_blocks")).first()[0] or 0
    tasks = max(1, min(int(many), 4 * files.sparkSession.sparkContext.defaultParallelism, 100_000))
    return blocks.repartitionByRange(tasks, "path", "block").sortWithinPartitions("path", "block").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes the files (at once), then lists every document as the files give it back. The list of files, one short row
    each, stays in the shared folder; the tokens ahead of a file are summed up in ranges of a thousand files, then over
    these ranges."""
    folder = folder or work_folder(docs.sparkSession, "rans")
    made = cut(write_token_files(docs, folder, tokenizer, end_id).withColumn("range", F.floor(F.col("file_no") / 1000)))
    order = Window.partitionBy("range").orderBy("file_no", "sub").rowsBetween(Window.unboundedPreceding, -1)
    ranges = made.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    ahead = ranges.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = made.withColumn("inside", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    return read_token_files(cut(within.join(ahead, "range").select("path", (F.col("ahead") + F.col("inside")).alias("before"), "n_blocks")))
