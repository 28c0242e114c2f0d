"""Operator 6: repeated passages of over 50 words by content-defined chunks.

A gear hash rolls over the words of a text. Where it is below a bound, a text is cut into variable chunks, of 128 words
on the average, each with the 50 words that follow; a chunk that an earlier document holds, by its 128-bit digest, is
a repeated passage as it is. That settles copies at once. For the rest, a chunk of 26 words stands for each run of 51
words: the one where the gear hash is least. The choice depends on the run alone, so a run that two documents share has
that chunk in common. These are candidates: around repeated ones, all runs of 51 words are compared (96 bits), and the
first document that holds a run (by id) keeps it. Joined runs make a passage, exact to the word, with no text fetched
from the other document. A first holder is never settled by a chunk, so leaving out settled runs loses no first holder.
`boundaries` cuts a text's bytes by a gear hash of the last 16.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, release, remove, small_batches, trim, work_folder

WINDOW = 16
GEAR = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[:2] for i in range(256)), "<u2").astype(np.uint16)


def boundaries(raw: bytes, least: int = 16, bits: int = 4, most: int = 96) -> list[int]:
    """Ends of the chunks of a text in UTF-8, the last one included; none for an empty text."""
    if not raw:
        return []
    b = np.frombuffer(raw, np.uint8)
    h = GEAR[b]
    span = 1
    while span < WINDOW:  # the sum over the last 16 bytes, doubling the length
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] << np.uint16(span) if span < len(h) else 0
        h = h + shifted
        span *= 2
    inside = np.zeros(len(b) + 1, bool)  # a character goes on at this byte
    inside[:-1] = (b & 0xC0) == 0x80
    ends: list[int] = []
    last = 0

    def forced(until: int) -> None:
        nonlocal last
        while until - last > most:
            last += most
            while inside[last]:
                last -= 1
            ends.append(last)

    for p in (np.flatnonzero((h >> np.uint16(16 - bits) == 0) & ~inside[1:]) + 1).tolist():
        if p - last >= least:
            forced(p)
            if p - last >= least:
                ends.append(p)
                last = p
    forced(len(raw))
    if last < len(raw):
        ends.append(len(raw))
    return ends


CHUNK = 26  # words under the rolling hash, and at most between two cuts
APART = 128  # words between two cuts of variable chunks, on the average
_MIX, _CHECK = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the words of a text in UTF-8: what white space parts; of scripts that are written
    without spaces (ideographs, kana, hangul, Thai and Lao) each character is a word."""
    b = np.frombuffer(raw, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    after = np.append(space[1:], True)
    if raw.isascii():
        return np.flatnonzero(~space & np.insert(space[:-1], 0, True)), np.flatnonzero(~space & after) + 1
    lead = (b & 0xC0) != 0x80
    second = np.append(b[1:], np.uint8(0))
    own = ((b >= 0xE3) & (b <= 0xED)) | (b >= 0xF0) | ((b == 0xE0) & (second >= 0xB8) & (second <= 0xBB))
    owned = own[np.maximum.accumulate(np.where(lead, np.arange(len(b)), 0))]  # each byte as its character
    begins = ~space & lead & (own | np.insert(space[:-1] | owned[:-1], 0, True))
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(~space & (after | np.append(begins[1:], True))) + 1
    return starts, ends


def _rolled(w: np.ndarray, k: int, by: int = _MIX) -> np.ndarray:
    """Hashes of all runs of k words, by doubling lengths."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, span, at, out = w, 1, 0, np.zeros(n, np.uint64)
    while True:
        if k & span:
            out = out * np.uint64(pow(by, span, 1 << 64)) + h[at : at + n]
            at += span
        if 2 * span > k:
            return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = h[:-span] * np.uint64(pow(by, span, 1 << 64)) + h[span:]
        span *= 2


def _digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def cuts(w: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words and hashes of the chunks that stand for a text, those of least gear hash in each run of least_words
    words; and the first words of its variable chunks. Nothing for a text without such a run."""
    k = min(CHUNK, least_words)
    gear = _rolled(w, k)
    reach = least_words - k + 1
    runs = len(gear) - reach + 1
    if runs <= 0:
        return np.empty(0, np.int64), gear[:0], np.empty(0, np.int64)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(gear, reach).argmin(axis=1) + np.arange(runs))
    return at, gear[at], np.union1d([0], np.flatnonzero(gear[:runs] < np.uint64((1 << 64) // APART))).astype(np.int64)


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), F.xxhash64(text).alias("h")).where("doc_id is not null and t is not null")


_MADE = {"digest": pa.int64(), "check": pa.int64(), "word": pa.int32(), "stop": pa.int32(), "start": pa.int32(), "end": pa.int32()}
_SCHEMA = "doc_id long, h long, digest long, check long, word int, stop int, start int, end int"


def _batches(rows: list[tuple[int, int, list]]) -> Iterator[pa.RecordBatch]:
    """Record batches of a document's id, its text's hash and columns (None: null), of bounded length."""
    if rows:
        many = [len(c[0]) for _, _, c in rows]
        keys = [pa.array(np.repeat(np.array([r[i] for r in rows], np.int64), many)) for i in (0, 1)]
        columns = [pa.concat_arrays([pa.nulls(n, t) if c[i] is None else pa.array(c[i], t) for (_, _, c), n in zip(rows, many, strict=True)]) for i, t in enumerate(_MADE.values())]
        made = pa.RecordBatch.from_arrays([*keys, *columns], names=["doc_id", "h", *_MADE])
        for a in range(0, made.num_rows, 1 << 16):
            yield made.slice(a, 1 << 16)


def chunked(docs: DataFrame, least_words: int = 51, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, digest, check, word, stop, start, end): the chunks of `cuts`, word being the number of the first
    word; stop, the first word of the next one, and the place in bytes only for variable ones. h: hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, list]] = []
            held = 0
            for d, t, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = t.as_py().encode()
                starts, ends = words_of(raw) if raw else ((), ())
                if len(starts) < least_words:
                    continue
                w = _digests(raw, starts, ends)
                at, hashes, first = cuts(w, least_words)
                stop = np.append(first[1:], len(w) - least_words + 1)
                both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w[a : b + least_words - 1].tobytes()) for a, b in zip(first.tolist(), stop.tolist(), strict=True)), "<i8").reshape(-1, 2)
                rows.append((d, x, [hashes.view(np.int64), None, at, None, None, None]))
                rows.append((d, x, [both[:, 0], both[:, 1], first, stop, starts[first], ends[stop + least_words - 2]]))
                held += len(at)
                if held > 1 << 17:
                    yield from _batches(rows)
                    rows, held = [], 0
            yield from _batches(rows)
        batch = rows = None
        trim()

    return _given(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def _runs(docs: DataFrame, places: DataFrame, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """Like `chunked`: all runs of least_words words around the chunks that begin at `words`, without those that begin
    in one of `settled`, pairs of first word and stop."""
    k = min(CHUNK, least_words)

    def marked(n: int, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, np.clip(first, 0, n), 1)
        np.add.at(marks, np.clip(stop, 0, n), -1)
        return marks[:-1].cumsum() > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, list]] = []
            held = 0
            for d, t, x, own, done in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), strict=True):
                raw = t.as_py().encode()
                starts, ends = words_of(raw)
                w = _digests(raw, starts, ends)
                n = len(w) - least_words + 1
                at = np.array(own.as_py(), np.int64)
                some = marked(n, at - (least_words - k), at + 1)
                if done:
                    some &= ~marked(n, np.array([s["word"] for s in done]), np.array([s["stop"] for s in done]))
                i = np.flatnonzero(some)
                if len(i):
                    rows.append((d, x, [_rolled(w, least_words)[i].view(np.int64), (_rolled(w, least_words, _CHECK)[i] >> np.uint64(32)).astype(np.int64), i, i + 1, starts[i], ends[i + least_words - 1]]))
                    held += len(i)
                if held > 1 << 17:
                    yield from _batches(rows)
                    rows, held = [], 0
            yield from _batches(rows)
        batch = rows = None
        trim()

    key = ["doc_id", "h"]
    return _given(docs, id_col, text_col).join(places, key).select("doc_id", "t", "h", "words", "settled").mapInArrow(run, _SCHEMA)


def _first_holders(rows: DataFrame, *digest: str) -> DataFrame:
    return rows.groupBy(*digest).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(*digest, "first")


def _stored(df: DataFrame, folder: str) -> DataFrame:
    """df in the shared folder as Parquet: ids and places of words take next to no room there."""
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _spans(docs: DataFrame, least_words: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The spans, with h, and the folder that they are read from. Shuffles and chunks go as soon as what they gave is cut."""
    spark = docs.sparkSession
    small_batches(spark)
    folders = [work_folder(spark, x) for x in ("chunks", "runs")]
    made = _stored(chunked(docs, least_words, id_col, text_col), folders[0])
    variable, fixed = made.where("stop is not null"), made.where("stop is null").select("doc_id", "h", "digest", "word")
    settled = cut(variable.join(_first_holders(variable, "digest", "check"), ["digest", "check"]).where("doc_id > first").select("doc_id", "h", "first", "word", "stop", "start", "end"))
    release(spark)
    again = fixed.join(_first_holders(fixed, "digest").select("digest"), "digest")
    places = cut(again.groupBy("doc_id", "h").agg(F.collect_set("word").alias("words")))
    remove(spark, folders[0])
    del made, variable, fixed, again
    release(spark)
    lists = settled.groupBy("doc_id", "h").agg(F.collect_set(F.struct("word", "stop")).alias("settled"))
    runs = _stored(_runs(docs, places.join(lists, ["doc_id", "h"], "left"), least_words, id_col, text_col), folders[1])
    del places, lists
    release(spark)
    found = runs.join(_first_holders(runs, "digest", "check"), ["digest", "check"]).where("doc_id > first").select(*settled.columns)
    before = Window.partitionBy("doc_id", "h").orderBy("word", "stop", "first")
    reach = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.union(settled).withColumn("reach", reach)
    parts = parts.withColumn("new", F.coalesce((F.col("word") - F.col("reach") + 1 >= least_words).cast("int"), F.lit(0))).withColumn("runs", F.expr("greatest(0, stop - greatest(word, coalesce(reach, 0)))"))
    spans = parts.withColumn("part", F.sum("new").over(before)).groupBy("doc_id", "h", "part")
    return spans.agg(F.min("first").alias("first_doc_id"), F.min("start").alias("start_byte"), F.max("end").alias("end_byte"), F.sum("runs").alias("n_chunks")).drop("part"), folders[1]


def repeated_spans(docs: DataFrame, least_words: int = 51, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first_doc_id, start_byte, end_byte, n_chunks): passages of at least least_words words, the same word by
    word, that documents of smaller ids hold, each to its exact ends; n_chunks counts its runs of least_words words.

    Passages that overlap are one span; first_doc_id is the smallest id among the earlier holders that were met, which
    for a chunk settled by its digest are those of the whole chunk. The first holder of a passage, and repeats inside
    one document, give no row; nor do null ids, null and empty texts. Rows of one id never count as earlier than each
    other; where their texts differ, each has its own spans, and where rows are equal, the spans are given once. Long
    texts are read whole. An empty table gives no row. A digest that many documents share is counted within partitions
    first, and the join back streams over its rows, which Spark splits where they are skewed.
    """
    spans, folder = _spans(docs, least_words, id_col, text_col)
    spans = cut(spans.drop("h"))
    remove(docs.sparkSession, folder)
    release(docs.sparkSession)
    return spans


def without_repeats(docs: DataFrame, least_words: int = 51, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with repeated spans cut from the texts, and length_col, where there is one, made to fit.

    A document of which nothing but white space is left goes; all others, and all other columns, stay. Spans are met by
    id and hash of the text, so rows of one id with different texts lose each its own passages. Null ids and null texts
    stay as they are; an empty table stays empty.
    """
    own, hashed, holes = (fresh(x, docs.columns) for x in ("_doc", "_hash", "_holes"))
    spans, folder = _spans(docs, least_words, id_col, text_col)
    lists = cut(spans.groupBy(F.col("doc_id").alias(own), F.col("h").alias(hashed)).agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias(holes)))
    remove(docs.sparkSession, folder)
    release(docs.sparkSession)

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, all_holes: pd.Series) -> pd.Series:
        def one(text: str | None, spans: list | None) -> str | None:
            if spans is None:
                return text
            raw, at, out = text.encode(), 0, []
            for s in spans:
                out.append(raw[at : s["start_byte"]])
                at = max(at, s["end_byte"])
            return b"".join([*out, raw[at:]]).decode()

        return pd.Series([one(t, h) for t, h in zip(texts, all_holes, strict=True)])

    joined = docs.join(lists, (docs[id_col].cast("long") == lists[own]) & (F.xxhash64(docs[text_col].cast("string")) == lists[hashed]), "left").withColumn(text_col, cut_out(F.col(text_col).cast("string"), holes))
    left = joined.where(F.col(holes).isNull() | F.col(text_col).rlike(r"\S"))
    if length_col in docs.columns:
        left = left.withColumn(length_col, F.when(F.col(holes).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return left.select(*docs.columns)
