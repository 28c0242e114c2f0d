"""Near duplicates by the Jaccard similarity of their word shingles: groups that links at or above the threshold join.

Operator 4 with a verification by similarity in place of bits. Candidates come from two sources. SimHash fingerprints
of the shingles with at most two differing bits share Golay keys; but at Jaccard 0.8 about ten of 64 bits differ, too
many for any fuzzy key to find all pairs, so shared prefixes find the rest: each set is put in one global order,
frequent shingles last. Of two sets similar by t, the first n - ceil(2t / (1 + t) n) + 1 shingles of the smaller and the
first n - ceil(t n) + 1 of the larger always have one in common.

A group of many near copies would give pairs in the square of its size. So, first, each set is compared only with one
of each of its buckets, another one in each, and the links found are joined to components; then only pairs of sets that
are still in different components are compared: in a bucket, those outside its largest component with all others. Pairs
inside a component can't change the result. What is left may still grow with the square of a group, so it has to be
cheap: a pair is named where a run of shared shingles begins, not in every bucket, and sets are moved once to a bucket
that has pairs, not once a pair. Before whole sets are moved, pairs go whose fingerprints differ in more bits than six
standard deviations over what the threshold makes likely (26 of 64 at 0.8: about one pair in a million is lost).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, fresh, release, remove, small_batches, trim, work_folder
from .simhash import links, majority

MIX = 0x9E3779B97F4A7C15
SAMPLE, SHARE = 4_000, 16  # documents that frequencies are taken from: so many, and one in so many, at least
HOT = 250_000  # shingles that count as frequent, at most
CELL = 2_048  # sets that are compared in one place, about


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words; a shorter text is one run, one without words none."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(MIX) + w[i : i + len(h)]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(29)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b))
    return both / max(1, len(a) + len(b) - both)


def _class(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def packed(own: np.ndarray) -> bytes:
    """32 bits of each hash, ascending, as differences in groups of seven bits: about four bytes each. Two sets of 1,000
    unequal shingles have one in common by chance in 4,300 pairs, which counts only for a pair exactly at the threshold."""
    d = np.diff(np.sort((own >> np.uint64(32)).astype(np.int64)), prepend=0)
    parts = np.stack([(d >> 7 * k) & 127 for k in range(5)], axis=1)
    used = np.maximum(1, (parts > 0)[:, ::-1].argmax(axis=1) * -1 + 5) * (d > 0) + (d == 0)
    keep = np.arange(5) < used[:, None]
    more = np.arange(5) < (used - 1)[:, None]
    return (parts | more * 128).astype(np.uint8)[keep].tobytes()


def unpacked(data: pa.Buffer | bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    last = raw < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts).cumsum()


def _frequent(given: DataFrame, words: int) -> np.ndarray:
    """Shingles of many documents of a sample, rarest first. They only order the sets: no result depends on them. The
    sample grows with the table: else a shingle of a fixed share of all documents, and so more and more of them, would
    pass for rare."""
    share = max(1, min(SHARE, given.count() // SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), words).view(np.int64))], names=["s"])

    sample = given.where(F.pmod(F.xxhash64("d"), F.lit(share)) == 0).mapInArrow(run, "s long")
    top = sample.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").orderBy(F.desc("n"), "s").limit(HOT)
    return top.select("s").toArrow()["s"].to_numpy()[::-1].astype(np.int64).view(np.uint64)


def _prepared(given: DataFrame, least: float, words: int) -> DataFrame:
    """(d, class, n, fp, first, set): rows of equal sets have the same class; first: the longest prefix that is due."""
    hot = _frequent(given, words)
    by = np.argsort(hot)
    frequent = given.sparkSession.sparkContext.broadcast((hot[by], by.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        known, order = frequent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows: list[list] = [[], [], [], [], []]
                for t in batch.column(1):
                    own = shingles(t.as_py(), words)
                    first = own
                    if len(known) and len(own):
                        i = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        first = own[np.argsort(np.where(known[i] == own, order[i], -1), kind="stable")]
                    first = first[: len(own) - math.ceil(least * len(own) - 1e-9) + 1]
                    for column, x in zip(rows, (_class(own), len(own), majority(own), first.view(np.int64), packed(own)), strict=True):
                        column.append(x)
                fp = np.array(rows[2], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(fp), pa.array(rows[3], pa.list_(pa.int64())), pa.array(rows[4], pa.binary())], names=["d", "class", "n", "fp", "first", "set"])
        whole = batch = rows = own = first = column = x = fp = None
        trim()

    return given.mapInArrow(run, "d long, class long, n int, fp long, first array<long>, set binary")


def _fits(x: str, y: str, least: float) -> str:
    """Whether prefixes, sizes and positions allow the sets x and y of a bucket to be similar, x being the smaller."""
    return (
        f"(n{x} < n{y} or n{x} = n{y} and {x} < {y}) and i{x} <= n{x} - ceil({2 * least / (1 + least)!r}D * n{x} - 1e-9D)"
        f" and n{x} >= {least!r}D * n{y} - 1e-9D and least(i{x}, i{y}) + least(n{x} - i{x}, n{y} - i{y}) >= {least / (1 + least)!r}D * (n{x} + n{y}) - 1e-9D"
    )


def most_bits(least: float) -> int:
    """How many of 64 bits the fingerprints of sets as similar as `least` may differ in, but for a chance of one in a million."""
    p = math.acos(2 * least / (1 + least)) / math.pi
    return min(64, math.floor(64 * p + 6 * math.sqrt(64 * p * (1 - p))))


def _likely(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, cell) of classes that their fingerprints don't rule out. prints: (class, fp)."""
    both = pairs.join(prints.select(F.col("class").alias("a"), F.col("fp").alias("x")), "a").join(prints.select(F.col("class").alias("b"), F.col("fp").alias("y")), "b")
    return both.where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= most_bits(least)).select("a", "b", "cell")


def _cell(*parted: str) -> Column:
    """Where pairs of the bucket s of k sets are compared: one place, or several by hashes of the columns `parted`."""
    parts = F.ceil(F.col("k") / CELL)
    return F.when(F.col("k") <= CELL, F.col("s")).otherwise(F.xxhash64("s", *(F.pmod(F.xxhash64(c), parts) for c in parted)))


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair (a, b) once, in the least of its cells."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cell").groupBy("a", "b").agg(F.min("cell").alias("cell"))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b, cell) of classes that are similar by `least`. A set is moved once to each cell that
    names it, whatever the number of its pairs there."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            found: list[list] = [[], []]
            for c, a, b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if c != cell:
                    cell, held = c, {}
                if b is None:
                    held[a] = unpacked(x.as_py())
                elif similarity(held[a], held[b]) >= least - 1e-9:
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    named = pairs.select("cell", F.col("a").alias("class")).union(pairs.select("cell", "b")).distinct()
    moved = named.join(sets, "class").select("cell", F.col("class").alias("a"), F.lit(None).cast("long").alias("b"), "set")
    rows = moved.union(pairs.select("cell", "a", "b", F.lit(None).cast("binary")))
    return rows.repartition("cell").sortWithinPartitions("cell", F.asc_nulls_first("b")).mapInArrow(compared, "a long, b long")


def _shared(own: DataFrame) -> DataFrame:
    """(s, class, n, i): the shingles of prefixes that unequal sets share, copies once. Posts are moved once, and whether
    a shingle is shared is seen where they meet."""
    posts = own.where("n > 0").select("class", "n", F.posexplode("first").alias("i", "s"))
    met = Window.partitionBy("s")
    shared = posts.withColumn("least", F.min("class").over(met)).withColumn("most", F.max("class").over(met)).where("least < most")
    return shared.groupBy("s", "class").agg(F.first("n").alias("n"), F.first("i").alias("i"))


def similar_groups(given: DataFrame, least: float = 0.8, words: int = 5) -> tuple[DataFrame, str]:
    """Of (d, t), d not null: (d, class, group) for each row, and the folder that it is read from. Rows of equal sets are one class; group is the least class
    that links of similarity `least` or more reach. Rows without words are one class of their own."""
    spark = given.sparkSession
    small_batches(spark)
    folder = work_folder(spark, "near")
    _prepared(given, least, words).write.parquet(folder)
    own = spark.read.parquet(folder)
    kept = work_folder(spark, "classes")
    own.select("d", "class").write.parquet(kept)
    member = spark.read.parquet(kept)
    prints = cut(own.where("n > 0").groupBy("class").agg(F.first("fp").alias("fp"), F.min("d").alias("d")))  # d: a row that stands for it
    release(spark)

    hot = cut(_shared(own))
    release(spark)

    # each set with one of each of its buckets, and fingerprints that share a Golay key
    reps = hot.groupBy("s").agg(F.min(F.struct(F.xxhash64("s", "class"), "class", "n", "i")).alias("r"), F.count(F.lit(1)).alias("k")).select("s", F.col("r.class").alias("a"), F.col("r.n").alias("na"), F.col("r.i").alias("ia"), "k")
    stars = _once(hot.select("s", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib")).join(reps, "s").where("a != b").where(f"{_fits('a', 'b', least)} or {_fits('b', 'a', least)}").select("a", "b", _cell("b").alias("cell")))
    same = cut(prints.groupBy("fp").agg(F.min("class").alias("class"), F.max("class").alias("last")))
    near = links(same).join(same.select(F.col("fp").alias("a"), F.col("class").alias("ca")), "a").join(same.select(F.col("fp").alias("b"), F.col("class").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"), F.col("ca").alias("cell"))
    twins = same.where("class != last").select(F.col("class").alias("a"), F.col("last").alias("b"), F.col("class").alias("cell"))  # unequal sets of one fingerprint
    pairs = cut(_once(_likely(stars, prints, least).union(near).union(twins)))
    del reps, stars, same, near, twins
    release(spark)

    asked = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(hot.select("class")).distinct()
    sets = cut(own.select("class", "d", "set").join(prints.select("class", "d").join(asked, "class", "left_semi"), ["class", "d"]).dropDuplicates(["class", "d"]).select("class", "set"))  # repeated rows once, in the partitions of the join
    del own, asked
    remove(spark, folder)
    release(spark)
    edges = cut(_verified(pairs, sets, least))
    release(spark)
    group = components(edges).withColumnRenamed("id", "class") if not edges.isEmpty() else None

    # what is still apart: in each bucket, all outside its largest component with all of other components
    placed = hot.join(group, "class", "left") if group is not None else hot.withColumn("component", F.lit(None).cast("long"))
    placed = cut(placed.withColumn("component", F.coalesce("component", "class")))
    counted = placed.groupBy("s", "component").agg(F.count(F.lit(1)).alias("k"))
    major = counted.groupBy("s").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("k")).where("parts > 1").select("s", "major", "k")
    # where both of a pair have the same bucket before this one, it has been named there or earlier
    apart = cut(placed.join(major, "s").withColumn("before", F.lag("s").over(Window.partitionBy("class").orderBy("i"))))
    x = apart.where("component != major").select("s", F.col("class").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("component").alias("pa"), F.col("before").alias("ea"))
    y = apart.select("s", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("component").alias("pb"), F.col("before").alias("eb"), "major", "k")
    rest = x.join(y, "s").where("pa != pb and (pb = major or a < b) and coalesce(ea != eb, true)").where(f"{_fits('a', 'b', least)} or {_fits('b', 'a', least)}")
    rest = _once(rest.select("a", "b", _cell("a", "b").alias("cell")))
    rest = cut(_likely(rest, prints, least).join(pairs, ["a", "b"], "left_anti"))
    del hot, placed, counted, major, apart, x, y
    release(spark)
    more = cut(_verified(rest, sets, least))
    del sets, rest
    release(spark)
    if not more.isEmpty():
        group = components(edges.union(more)).withColumnRenamed("id", "class")
    if group is None:
        return member.withColumn("group", F.col("class")), kept
    return member.join(group, "class", "left").select("d", "class", F.coalesce("component", "class").alias("group")), kept


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, words: int = 5) -> DataFrame:
    """docs with one row of each group that links of similarity `least` or more join: that of its smallest id.

    Of repeated such ids all rows stay; so do rows of a null id, which link nothing. Texts without words, null ones too,
    are one group. Words are parted by white space; a text of fewer than `words` is one shingle; long texts are read
    whole. An empty table stays empty; other columns are kept as they are, whatever their names.
    """
    given = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t")).where("d is not null")
    own, folder = similar_groups(given, least, words)
    own = cut(own)
    remove(docs.sparkSession, folder)
    twin = fresh("_twin", docs.columns)
    firsts = own.groupBy("group").agg(F.min("d").alias("first"))
    later = cut(own.join(firsts, "group").where("d != first").select(F.col("d").alias(twin)).distinct())
    release(docs.sparkSession)
    return docs.join(later, docs[id_col].cast("long") == later[twin], "left_anti")
