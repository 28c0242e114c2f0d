"""Operator 10: documents that hold passages of a benchmark, copied, edited or paraphrased.

Word trigrams of the benchmark's items are seeds. One pass over the documents lists where they hold seeds, behind a
filter of bounded size that drops most words which no item has; the number of documents that hold each seed follows. Of
an item those seeds are used that aren't far more frequent than its others, and besides the rarest one of every eight
in a row, whatever its frequency: so no stretch of an item is left out, and a document with ten of its words in a row
always meets it. Documents and items are joined on these rare seeds; the passages about them are aligned with the items
by Smith-Waterman over words, and the score, over that of a perfect copy, decides.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small_batches, trim

WORD = re.compile(r"\w+")
MATCH, MISS, GAP = 2, -1, 1
SEED, STRETCH = 3, 8
FILTER_BITS = 29  # of the filter of seeds at most: 64 MB, however large the benchmark
_MIX = np.uint64(0x9E3779B97F4A7C15)


def smith_waterman(a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray | None = None, b_lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best local scores of pairs of rows of a and b, and the ends of the alignments in b (exclusive), first best ones.

    Rows are filled up to one length; what lies beyond their own lengths matches nothing.
    """
    a, b = np.atleast_2d(a), np.atleast_2d(b)
    k, width = b.shape
    inside_a = np.ones(a.shape, bool) if a_lengths is None else np.arange(a.shape[1]) < np.asarray(a_lengths)[:, None]
    inside_b = np.ones(b.shape, bool) if b_lengths is None else np.arange(width) < np.asarray(b_lengths)[:, None]
    steps = (GAP * np.arange(1, width + 1)).astype(np.int32)
    row = np.zeros((k, width + 1), np.int32)
    best, end = np.zeros(k, np.int32), np.zeros(k, np.int64)
    for i in range(a.shape[1]):
        same = (b == a[:, i : i + 1]) & inside_b & inside_a[:, i : i + 1]
        now = np.maximum(row[:, :-1] + np.where(same, MATCH, MISS), row[:, 1:] - GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum(now, np.maximum.accumulate(now + steps, axis=1) - steps)  # gaps along b
        row[:, 1:] = now
        at = now.argmax(axis=1)
        top = now[np.arange(k), at]
        better = top > best
        best[better], end[better] = top[better], at[better] + 1
    return best, end


def hashes(text: str | None) -> np.ndarray:
    """Of the words of a text: runs of letters, digits and underscores, without case."""
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams(w: np.ndarray, k: int = SEED) -> np.ndarray:
    """64-bit hashes of the runs of k words."""
    n = max(0, len(w) - k + 1)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + n]) * _MIX
        h ^= h >> np.uint64(31)
    return h


def _slots(seeds: np.ndarray, bits: int) -> np.ndarray:
    s = seeds * _MIX
    return np.stack([seeds >> np.uint64(64 - bits), s >> np.uint64(64 - bits)]).astype(np.int64)


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, key, words): hashes of the words of each item that has an id and a word, 8 bytes each, little-endian. Rows
    of one id with different texts have a key each; equal rows are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [hashes(t.as_py()).astype("<u8").tobytes() for t in batch.column(2)]
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary())], names=["item", "key", "words"])
            yield made.filter(pa.array([bool(w) for w in words], pa.bool_()))

    given = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("t")).where("item is not null and t is not null")
    return given.select("item", F.xxhash64("item", "t").alias("key"), "t").dropDuplicates(["item", "key"]).mapInArrow(run, "item long, key long, words binary")


def seeds_of(items: DataFrame) -> DataFrame:
    """(key, n, seed, q): the trigrams of each item of n words; an item of fewer words is one seed as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = np.frombuffer(raw.as_buffer(), "<u8")
                s = grams(w, min(SEED, len(w)))
                for a in range(0, len(s), 1 << 16):
                    part = s[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i)), pa.array(np.full(len(part), len(w), np.int32)), pa.array(part.view(np.int64)), pa.array(np.arange(a, a + len(part), dtype=np.int32))], names=["key", "n", "seed", "q"])

    return items.select("key", "words").mapInArrow(run, "key long, n int, seed long, q int")


def _filter(seeds: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """Bits that are set for all seeds, their number as a power of two, and the lengths of seeds that there are. The
    words of the filter come to the driver: at most 64 MB, whatever the benchmark's size; a full one drops less."""
    count = seeds.count()
    bits = min(FILTER_BITS, max(16, (32 * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_slots(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], names=["place", "bit"])

    words = seeds.select("seed").mapInArrow(run, "place long, bit long").groupBy("place").agg(F.bit_or("bit").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[words["place"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    return table, bits, [r[0] for r in seeds.select(F.least("n", F.lit(SEED))).distinct().collect()]


def _hits(given: DataFrame, seeds: DataFrame) -> DataFrame:
    """(d, h, seed, at): where each document holds what passes the filter of seeds."""
    shared = given.sparkSession.sparkContext.broadcast(_filter(seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits, lengths = shared.value
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for d, t, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                w = hashes(t.as_py())
                for k in lengths:
                    g = grams(w, k)
                    one, two = _slots(g, bits)
                    at = np.flatnonzero((table[one >> 5] >> (one & 31).astype(np.uint32)) & (table[two >> 5] >> (two & 31).astype(np.uint32)) & 1)
                    if len(at):
                        order = np.argsort(g[at], kind="stable")
                        own, starts = np.unique(g[at][order], return_index=True)
                        rows[0] += [d] * len(own)
                        rows[1] += [h] * len(own)
                        rows[2] += own.view(np.int64).tolist()
                        rows[3] += np.split(at[order].astype(np.int32), starts[1:])
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.list_(pa.int32()))], names=["d", "h", "seed", "at"])
        batch = rows = None
        trim()

    return given.mapInArrow(run, "d long, h long, seed long, at array<int>")


def rare(counts: np.ndarray) -> np.ndarray:
    """Of an item's seeds, in their order, those to be used: none over 20 times as frequent as the median one, but of
    every STRETCH in a row the rarest in any case (ties: the first)."""
    used = counts <= 20 * (np.median(counts) + 1)
    if len(counts) <= STRETCH:
        used[counts.argmin()] = True
    else:
        windows = np.lib.stride_tricks.sliding_window_view(counts, STRETCH)
        used[np.unique(windows.argmin(axis=1) + np.arange(len(windows)))] = True
    return used


def _candidates(given: DataFrame, items: DataFrame) -> DataFrame:
    """(d, h, key, n, ks): documents that meet rare seeds of an item, and about where it would begin, in steps of
    half its length."""
    seeds = cut(seeds_of(items))
    hits = cut(_hits(given, seeds))
    counted = seeds.join(hits.groupBy("seed").agg(F.count(F.lit(1)).alias("docs")), "seed", "left").fillna(0, ["docs"])

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("q")
        return rows[rare(rows["docs"].to_numpy())][["key", "n", "seed", "q"]]

    used = cut(counted.groupBy("key").applyInPandas(choose, "key long, n int, seed long, q int"))
    step = "transform(at, p -> cast(floor((p - q) / (n div 2 + 2)) as int))"
    met = hits.join(used, "seed").select("d", "h", "key", "n", F.expr(f"array_distinct({step})").alias("ks"))
    return met.groupBy("d", "h", "key").agg(F.first("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("ks"))).alias("ks"))


def _windows(given: DataFrame, candidates: DataFrame) -> DataFrame:
    """(d, h, key, lo, passage): the words of a document about a place where an item would begin."""
    lists = candidates.groupBy("d", "h").agg(F.collect_list(F.struct("key", "n", "ks")).alias("met"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for d, h, t, met in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                w = hashes(t.as_py())
                for m in met:
                    n, slack = m["n"], m["n"] // 2 + 2
                    spans: list[list[int]] = []
                    for k in sorted(m["ks"]):
                        lo, hi = max(0, (k - 1) * slack), min(len(w), (k + 2) * slack + n)
                        if spans and lo <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], hi)
                        else:
                            spans.append([lo, hi])
                    for lo, hi in spans:
                        for column, x in zip(rows, (d, h, m["key"], lo, w[lo:hi].astype("<u8").tobytes()), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["d", "h", "key", "lo", "passage"])

    # a text is met again by its id and hash; rows that are equal in both need their passages only once
    texts = given.join(lists, ["d", "h"]).select("d", "h", "t", "met")
    return texts.mapInArrow(run, "d long, h long, key long, lo long, passage binary")


def _aligned(windows: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(d, h, item, score, first_word, end_word) of passages that reach `least`."""

    def filled(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in rows])
        out = np.zeros((len(rows), n.max()), np.uint64)
        out[np.arange(n.max()) < n[:, None]] = np.concatenate(rows)
        return out, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column("words")]
            b = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column("passage")]
            score, first, end = np.zeros(len(a)), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
            order = sorted(range(len(a)), key=lambda i: (len(b[i]), len(a[i])))
            at = 0
            while at < len(order):  # passages of about one length together, up to about a million cells a step
                part = order[at : at + max(1, min(256, (1 << 18) // max(1, len(b[order[at]]))))]
                part = [i for i in part if len(b[i]) <= 2 * len(b[part[0]]) + 16]
                at += len(part)
                (x, nx), (y, ny) = filled([a[i] for i in part]), filled([b[i] for i in part])
                best, stop = smith_waterman(x, y, nx, ny)
                share = np.minimum(1.0, best / (MATCH * nx))
                score[part], end[part] = share, stop
                good = [(i, s) for i, s, v in zip(part, stop.tolist(), share, strict=True) if v >= least]
                if good:
                    (x, nx), (y, ny) = filled([a[i][::-1] for i, _ in good]), filled([b[i][:s][::-1] for i, s in good])
                    first[[i for i, _ in good]] = np.array([s for _, s in good]) - smith_waterman(x, y, nx, ny)[1]
            lo = batch.column("lo").to_numpy()
            made = pa.RecordBatch.from_arrays([batch.column("d"), batch.column("h"), batch.column("item"), pa.array(score), pa.array(lo + first), pa.array(lo + end)], names=["d", "h", "item", "score", "first_word", "end_word"])
            yield made.filter(pa.array(score >= least))

    joined = windows.join(items, "key").select("d", "h", "item", "lo", "passage", "words")
    return joined.mapInArrow(run, "d long, h long, item long, score double, first_word long, end_word long")


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("d"), text.alias("t"), F.xxhash64(text).alias("h"))


def _found(docs: DataFrame, benchmark: DataFrame, least: float, id_col: str, text_col: str) -> DataFrame:
    """(d, h, item, score, first_word, end_word): the best passage for each text and item."""
    small_batches(docs.sparkSession)
    given = _given(docs, id_col, text_col).where("t is not null")
    items = cut(items_of(benchmark))
    found = _aligned(_windows(given, _candidates(given, items)), items, least)
    best = F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"), -F.col("end_word"))).alias("best")
    return found.groupBy("d", "h", "item").agg(best).select("d", "h", "item", "best.*")


def matches(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): a row for each row of docs and item whose score reaches `least`.

    Words are runs of letters, digits and underscores without case. Items of fewer than three words match where they
    stand whole. Null and wordless texts and items match nothing, nor do items without an id; repeated rows and rows of
    a null id match each by itself; items with equal texts are all named; of passages with one score the first one
    counts. Texts of any length are read whole, an empty table gives no row, other columns are ignored.
    """
    found = cut(_found(docs, benchmark, least, id_col, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("d"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    return rows.join(found, ["d", "h"]).select("doc_id", F.col("item").alias("item_id"), "score", "first_word", "end_word")


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a passage of the benchmark, by `matches`; columns as they were, clashing names
    too. Rows of a null id are judged like any other, null texts stay, an empty benchmark drops nothing."""
    d, h = fresh("_doc", docs.columns), fresh("_hash", docs.columns)
    leaks = cut(_found(docs, benchmark, least, id_col, text_col).select(F.col("d").alias(d), F.col("h").alias(h)).distinct())
    return docs.join(leaks, (F.coalesce(docs[id_col].cast("long"), F.lit(0)) == leaks[d]) & (F.xxhash64(docs[text_col].cast("string")) == leaks[h]), "left_anti")
