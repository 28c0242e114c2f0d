"""Operator 4: near duplicates by SimHash fingerprints, found with Golay-code fuzzy keys.

The perfect binary Golay code (23, 12, 7) puts every 23-bit word within three bits of one codeword. Take as keys of a
word all codewords within FOUR bits: one or six of 4096. Two words that differ in at most two bits then always share
a key (`tests/llm` checks it for all cosets). A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits; of two
differing bits at least one segment has none, and the segment after it has two at most. So each fingerprint gets, for
each segment, its exact bits together with the Golay keys of the next one: 33 to 34 bits a key, about 16 keys. The
join on keys misses no link, and its candidates are verified by counting bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, small_batches

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits


def _remainders() -> np.ndarray:
    """Of (i << 11) by the generator, for all 12-bit i."""
    out = np.zeros(4096, np.uint32)
    for i in range(4096):
        r = i << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - 11)
        out[i] = r
    return out


class Golay:
    def __init__(self) -> None:
        self.remainder = _remainders()
        near: list[list[int]] = [[] for _ in range(2048)]
        words = [0]
        ones = [1 << i for i in range(23)]
        level = [(0, 0)]
        for _ in range(4):  # all error patterns of up to four bits
            level = [(w | ones[i], i + 1) for w, k in level for i in range(k, 23)]
            words += [w for w, _ in level]
        for w in words:
            near[int(self.syndrome(np.array([w], np.uint32))[0])].append(w)
        most = max(map(len, near))
        self.flip = np.array([[w >> 11 for w in x] + [-1] * (most - len(x)) for x in near], np.int32)

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return (words & 0x7FF) ^ self.remainder[words >> 11]

    def keys(self, words: np.ndarray) -> np.ndarray:
        """For each 23-bit word the indices of the codewords within four bits of it; -1 fills."""
        flip = self.flip[self.syndrome(words)]
        return np.where(flip < 0, -1, (words >> 11).astype(np.int32)[:, None] ^ flip)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the shingles; zero for a text without words."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    if len(parts) < words:
        return digest(joined, 42)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(parts) - words + 1
    total = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        h = np.fromiter((digest(joined[x:y], 42) for x, y in zip(starts[a:b].tolist(), ends[a + words - 1 : b + words - 1].tolist(), strict=True)), np.uint64, b - a)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes."""
    if not len(h):
        return 0
    total = sum(np.unpackbits(h[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for a in range(0, len(h), 1 << 16))
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id long, fp long): the 64 bits of `fingerprint`, as a signed integer. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): all pairs a < b of distinct fingerprints (column fp) that differ in at most max_bits (0 to 2) bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the Golay keys vouch for two differing bits at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            parts = [(fp >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.uint32) for at, bits in SEGMENTS]
            for i in range(3):
                near = golay.keys(parts[(i + 1) % 3])
                row, col = np.nonzero(near >= 0)
                key = np.int64(i) << np.int64(40) | parts[i][row].astype(np.int64) << np.int64(12) | near[row, col].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64))], names=["key", "fp"])

    keys = distinct.select("fp").mapInArrow(run, "key long, fp long")
    a, b = keys.select("key", F.col("fp").alias("a")), keys.select("key", F.col("fp").alias("b"))
    return a.join(b, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row a row of docs.

    component_id is the smallest id reachable over links of at most max_bits differing bits, its own included. Copies
    are one class by their fingerprint and never paired. A text without words has fingerprint zero and links like any
    other; a null id keeps its row and never names a component; an empty table gives no row; repeated rows stay.
    """
    own = cut(fingerprints(docs, id_col, text_col, words))
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    pairs = cut(links(classes, max_bits))
    if pairs.isEmpty():
        named = classes.select("fp", F.col("first").alias("component_id"))
    else:
        group = components(pairs).withColumnRenamed("id", "fp")
        labelled = classes.join(group, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
        named = labelled.join(least, "component").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
