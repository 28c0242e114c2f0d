"""Operator 3: audio fingerprints from chroma frames, and recordings aligned by them.

The spectrum of overlapping frames is summed into the twelve pitch classes. Over the image of classes by frames, sixteen
rectangular filters compare areas by means of its integral image; each gives two bits in Gray code, so a frame with its
followers makes one 32-bit integer. Recordings are aligned by integers that agree but for one of their four bytes, for
a frame and the next one: a histogram of offsets collects such votes, and at each offset the bit errors over the
best stretch say how close the recordings are.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

RATE, FRAME, HOP = 8000, 1024, 341
WIDTH = 16  # frames under a filter at most
#: Kind of comparison, first pitch class, classes, frames, and the two steps between the four levels.
FILTERS = tuple((k % 4, (k * 5) % 9, 3 + k % 2, (4, 8, 12, 16)[k // 4], 0.0) for k in range(16))


def _classes() -> np.ndarray:
    """Sums bins of the spectrum into pitch classes, from 130 Hz, where bins are as narrow as semitones, to 3520 Hz."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12))
    for i, f in enumerate(hz):
        if 130 <= f <= 3520:
            out[i, int(round(12 * np.log2(f / 440.0))) % 12] = 1
    return out


_CLASSES, _WINDOW = _classes(), np.hamming(FRAME)


def chroma(samples: np.ndarray, together: int = 2048) -> np.ndarray:
    """Frames by twelve classes, each frame of length one (zero where it is nearly silent); spectra of `together` frames
    are held at a time, so a long recording costs its samples and 96 bytes a frame."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    image = np.concatenate([(np.abs(np.fft.rfft(frames[a : a + together] * _WINDOW, axis=1)) ** 2) @ _CLASSES for a in range(0, len(frames), together)])
    norm = np.linalg.norm(image, axis=1, keepdims=True)
    return np.where(norm > 1e-2, image / np.maximum(norm, 1e-12), 0.0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer a frame, as far as the filters reach; empty for a short recording."""
    image = chroma(samples)
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)

    def area(at: int, frames: int, low: int, high: int) -> np.ndarray:
        return total[at + frames : at + frames + n, high] - total[at : at + n, high] - total[at + frames : at + frames + n, low] + total[at : at + n, low]

    out = np.zeros(n, np.uint32)
    for kind, low, size, frames, middle in FILTERS:
        high, half, mid = low + size, frames // 2, low + size // 2
        if kind == 0:  # later against earlier
            a, b = area(half, half, low, high), area(0, half, low, high)
        elif kind == 1:  # upper against lower classes
            a, b = area(0, frames, mid, high), area(0, frames, low, mid)
        elif kind == 2:  # crosswise
            a, b = area(0, half, mid, high) + area(half, half, low, mid), area(0, half, low, mid) + area(half, half, mid, high)
        else:  # the band against all classes
            a, b = area(0, frames, low, high) * 12 / size, area(0, frames, 0, 12)
        x = np.log((a + 1) / (b + 1)) - middle
        level = (x > -0.25).astype(np.uint32) + (x > 0) + (x > 0.25)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
    return out


#: The code of frames without sound: it says nothing of where in a recording it is, and casts no vote.
SILENCE = int(fingerprint(np.zeros(FRAME + HOP * WIDTH))[0])
OVERLAP, MOST_ERROR, VOTES = 48, 0.12, 1


def fingerprints(recordings: DataFrame, id_col: str, pcm_col: str) -> DataFrame:
    """(id, codes): codes of 16-bit little-endian mono samples at 8 kHz in a binary column. Null audio has no codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(np.frombuffer((p.as_py() or b"")[: len(p.as_py() or b"") // 2 * 2], "<i2") / 32768.0).astype(np.int64) for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int64()))], names=["id", "codes"])

    small_batches(recordings.sparkSession, 100)
    return recordings.select(F.col(id_col).cast("long").alias("id"), F.col(pcm_col).cast("binary").alias("p")).mapInArrow(run, "id long, codes array<long>")


def least_error(a: np.ndarray, b: np.ndarray, offset: int, stretch: int = OVERLAP) -> tuple[int, float]:
    """Codes of a over b shifted by offset: how many overlap, and the least share of differing bits over `stretch`
    codes in a row of them, or over the whole of a shorter recording; 1.0 where less than that overlaps."""
    x, y = a[max(0, offset) : len(b) + offset], b[max(0, -offset) : max(0, len(a) - offset)]
    n = min(len(x), len(y))
    size = min(stretch, len(a), len(b))
    if n < size or not size:
        return n, 1.0
    total = np.concatenate([[0], np.bitwise_count(x[:n] ^ y[:n]).cumsum(dtype=np.int64)])
    return n, float((total[size:] - total[:-size]).min() / (32 * size))


def _with_class(prints: DataFrame) -> DataFrame:
    """Adds class: recordings of equal codes have the same, and so have all that are silent throughout; null where
    there are no codes or no id."""
    silent = F.forall("codes", lambda x: x == SILENCE)
    own = F.when(F.col("id").isNotNull() & (F.size("codes") > 0), F.xxhash64(F.when(silent, F.array(F.lit(SILENCE).cast("long"))).otherwise(F.col("codes"))))
    return prints.withColumn("class", own)


def _class_pairs(own: DataFrame, query: str, least_votes: int, most_error: float) -> DataFrame:
    """(qc, class, offset, votes, overlap, bit_error): the best offset of each pair of classes, qc holding a query."""
    classes = cut(own.where("class is not null").groupBy("class").agg(F.first("codes").alias("codes"), F.max(F.expr(query)).alias("asked")))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each position under four keys: its code and the next one, without one byte each."""
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                codes = batch.column(2)
                flat = codes.flatten().to_numpy().astype(np.uint64)
                many = np.diff(codes.offsets.to_numpy())
                row = np.repeat(np.arange(len(many)), many)
                at = np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
                i = np.flatnonzero((at + 1 < many[row]) & (flat != SILENCE))
                i = i[~((flat[i] == flat[i - 1]) & (at[i] > 0) & (flat[i] == flat[np.minimum(i + 1, len(flat) - 1)]))]  # of a held code only its ends vote
                for m in range(4):
                    mask = np.uint64(0xFFFFFFFF & ~(0xFF << 8 * m))
                    key = ((flat[i] & mask) << np.uint64(32) | (flat[i + 1] & mask)) ^ np.uint64(m << 8 * m)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(i), m, np.int8)), batch.column(0).take(pa.array(row[i])), batch.column(1).take(pa.array(row[i])), pa.array(at[i].astype(np.int32))], names=["key", "m", "class", "asked", "at"])

    posts = cut(classes.select("class", "asked", "codes").mapInArrow(keys, "key long, m byte, class long, asked boolean, at int"))
    a = posts.where("asked").select("m", "key", F.col("class").alias("qc"), F.col("at").alias("qa"))
    votes = a.join(posts.drop("asked"), ["m", "key"]).where("qc != class").groupBy("qc", "class", (F.col("qa") - F.col("at")).alias("offset")).agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= least_votes)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([c.values.to_numpy().astype(np.uint32) if len(c) else np.empty(0, np.uint32) for c in batch.column(k)] for k in ("q", "c"))
            got = [least_error(p, q, o) for p, q, o in zip(x, y, batch.column("offset").to_pylist(), strict=True)]
            error = np.array([e for _, e in got])
            made = pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("qc", "class", "offset", "votes")), pa.array([n for n, _ in got], pa.int64()), pa.array(error, pa.float64())], names=["qc", "class", "offset", "votes", "overlap", "bit_error"])
            yield made.filter(pa.array(error <= most_error, pa.bool_()))

    both = votes.join(classes.select(F.col("class").alias("qc"), F.col("codes").alias("q")), "qc").join(classes.select("class", F.col("codes").alias("c")), "class")
    found = both.select("qc", "class", "offset", "votes", "q", "c").mapInArrow(scored, "qc long, class long, offset int, votes long, overlap long, bit_error double")
    best = F.min_by(F.struct("offset", "votes", "overlap", "bit_error"), F.struct("bit_error", -F.col("votes"), "offset")).alias("best")
    return found.groupBy("qc", "class").agg(best).select("qc", "class", "best.*")


def align(prints: DataFrame, query: str = "id % 20 = 0", least_votes: int = VOTES, most_error: float = MOST_ERROR) -> DataFrame:
    """(query_id, id, offset, votes, overlap, bit_error): each query with every other recording that, at some offset with
    at least least_votes votes, differs from it in at most most_error of the bits over OVERLAP codes in a row (a shorter
    recording: over the whole of it); the closest such offset (ties: most votes, then the smallest offset).

    Recordings of equal codes are one class, all silent ones too: votes and errors are found once for each class and then
    joined to its members. A position votes if its code and the next one agree but for one byte each, the same
    in both; silence doesn't vote, of a held code its two ends do. Null ids and recordings without codes match nothing;
    equal rows are one recording, rows of one id with different codes are recordings of their own; a recording of any
    length is used whole; an empty table gives no row.
    """
    own = cut(_with_class(prints).where("class is not null").dropDuplicates(["id", "class"]))
    pairs = _class_pairs(own, query, least_votes, most_error)
    asked = own.where(query).select(F.col("id").alias("query_id"), F.col("class").alias("qc"))
    members = own.select("id", "class", F.size("codes").cast("long").alias("n"))
    equal = asked.join(members.withColumnRenamed("class", "qc"), "qc").where("query_id != id").select("query_id", "id", F.lit(0).alias("offset"), F.lit(None).cast("long").alias("votes"), F.col("n").alias("overlap"), F.lit(0.0).alias("bit_error"))
    return pairs.join(asked, "qc").join(members, "class").where("query_id != id").select("query_id", "id", "offset", "votes", "overlap", "bit_error").union(equal)


def matches(prints: DataFrame, query: str = "id % 20 = 0", least_votes: int = VOTES, most_error: float = MOST_ERROR) -> DataFrame:
    """(class, id, n_codes, other_class, offset, votes, overlap, bit_error): all that `align` finds, not multiplied out.

    A membership row for each row of prints names its class and no other_class; a row without an id names each pair of
    different classes, class holding a query. Partners of a query are the other members of its class (offset 0, no bit
    error) and all members of the classes paired with it. The class is null where there is no id or no code.
    """
    kept = cut(_with_class(prints))
    pairs = _class_pairs(kept, query, least_votes, most_error)
    members = kept.select("class", "id", F.size("codes").alias("n_codes"))
    return members.unionByName(pairs.select(F.col("qc").alias("class"), F.col("class").alias("other_class"), "offset", "votes", "overlap", "bit_error"), allowMissingColumns=True)


def render(vector: list[float] | None, note: int = 500) -> bytes:
    """A recording from a vector, for tables without audio: each number picks the note that sounds for `note` samples."""
    if not vector:
        return b""
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], np.float64))
    pitch = 220.0 * 2 ** (np.clip(np.floor(v * 40 + 12), 0, 24) / 12)
    t = np.arange(note) / RATE
    wave = np.sin(2 * np.pi * pitch[:, None] * t) * np.hanning(note)
    return (wave.ravel() * 20000).astype("<i2").tobytes()


def rendered(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, pcm) of `render`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(v.as_py()) for v in part.column(1)], pa.binary())], names=["id", "pcm"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id long, pcm binary")
