"""What the operators of this package share: the shared folder, checkpoints, tokenizers, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import string
import tempfile
import threading
import time
import uuid
from array import array
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCK = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach: `spark.checkpoint.dir`. Only where that is unset and Spark runs in one
    process, as in tests, a folder of our own serves, which goes when the process ends; on a cluster it is an error.

    Spark's checkpoint folder is set to it as well if the context has none yet.
    """
    with _LOCK:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = getattr(spark, "_metrolith_folder", None)
            if root is None:
                made = tempfile.mkdtemp(prefix="metrolith-")
                atexit.register(shutil.rmtree, made, ignore_errors=True)
                root = spark._metrolith_folder = f"file://{made}"
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh place below the shared folder, as a URI."""
    return f"{shared_folder(spark)}/metrolith-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder: a lost executor costs a reread, not the whole lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Lowers the session's rows an Arrow batch: texts of some thousand characters by ten thousands, as is Spark's own
    setting, cost each Python worker, and the executor beside it, a hundred megabytes and more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of tables that nothing refers to any more, once a step is cut: Spark removes them
    when the driver collects its garbage, which may be long after a job has filled the executors' disks. The tables of
    the last query are only found in a second collection, once Spark has cleaned up after the first one."""
    for pause in (0.5, 0):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(pause)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder below the shared one, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(wanted: str, taken: list[str]) -> str:
    """A column name that clashes with none of `taken` (compared as Spark does, without case)."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


# ---------------------------------------------------------------- tokenizers

#: A text with any of these leaves the fast road: combining marks, control characters, exotic white space.
_UNUSUAL = re.compile("[^\t\n\x20-\x7e\xa1-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
#: White space other than single spaces and single line ends between other characters; `_UNUSUAL` has met all other kinds.
_RAGGED = ("\t", "  ", "\n\n", " \n", "\n ")
_ROADS = {
    "word_bpe_49k.json": (regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"), True),
    "byte_bpe_50k.json": (regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"), False),
}


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, more = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + more)
            more += 1
    return [table[b] for b in range(256)]


class _Words(dict):
    """Ids of words as bytes; two generations of bounded size, so that frequent words outlive rare ones."""

    def __init__(self, encode: Callable[[str], bytes], keep: int) -> None:
        super().__init__()
        self.encode, self.keep, self.old = encode, keep, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) < 40:
            if len(self) >= self.keep:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts by the tokenizers library, exactly those of `encode(text, add_special_tokens=False)`.

    Both vocabularies split a text into pieces before any merge, and no piece crosses a single space or line end
    between two other characters: so the ids of what lies between them don't depend on its neighbours. The library's
    merge model encodes each distinct word; a bounded table answers for repeated ones. A text with characters outside
    a plain Latin range, or of an unknown vocabulary, goes to the library as a whole; so does one with a string of an
    added token, in whatever case where the vocabulary has no cases. The tables hold `keep` words twice and an eighth of
    that of pieces, each of less than 40 characters: about 220 MB at most.
    """

    def __init__(self, path: str, keep: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.split, self.lower = _ROADS.get(os.path.basename(path), (None, False))
        self.added = tuple({t.content.lower() if self.lower else t.content for t in self.library.get_added_tokens_decoder().values()})
        self.model = self.library.model
        if hasattr(self.model, "_resize_cache"):  # the table below does better than the library's own cache of words
            self.model._resize_cache(0)
        self.letters = _byte_letters()
        self.words = _Words(self._word, keep)
        self.marks = _Words(self._piece, keep // 8)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", self.letters[32])
        else:
            shown = "".join(map(self.letters.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        """A word that a space precedes; with a leading line end, one that follows that."""
        lead, mark = b"", "" if self.lower else " "
        if word[0] == "\n":
            lead, mark, word = self.marks["\n"], "", word[1:]
        if word.isalpha():
            return lead + self._piece(mark + word)
        stem = word.rstrip(string.punctuation)
        if stem.isalpha():  # all marks that follow it are one piece, in both vocabularies
            return lead + (self.words[stem] if mark or self.lower else self._piece(stem)) + self.marks[word[len(stem) :]]
        return lead + b"".join(map(self.marks.__getitem__, self.split.findall(mark + word)))

    def __call__(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null text counts as empty."""
        if not text:
            return b""
        if self.split is None or _UNUSUAL.search(text):
            return self.whole(text)
        given = text.lower() if self.lower else text
        for x in self.added:
            if x in given:
                return self.whole(text)
        if self.lower:
            return b"".join(map(self.words.__getitem__, given.split()))
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _RAGGED):
            return b"".join(map(self.marks.__getitem__, self.split.findall(text)))
        head, *rest = text.replace("\n", " \n").split(" ")
        return b"".join(map(self.marks.__getitem__, self.split.findall(head))) + b"".join(map(self.words.__getitem__, rest))


@lru_cache(maxsize=1)
def encoder(path: str, keep: int = 500_000) -> Encoder:
    """One per Python worker, of the last vocabulary asked for."""
    return Encoder(path, keep)


def forget_words() -> None:
    """Drops the encoder's tables in this Python worker, which Spark uses again for whatever comes next."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()


def trim() -> None:
    """Gives back to the system what this Python worker, which Spark keeps for later tasks, holds but doesn't use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give:
        give(0)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id named in an edge, the smallest id that it reaches.

    Alternates large-star and small-star steps until no edge changes, so the number of steps grows with the
    logarithm of the longest chain; each step is cut into the shared folder, and nothing but one number comes back
    to the driver (their number and checksums). A node of many edges is grouped by Spark's partial aggregation, never gathered as a list: both
    stars need only the minimum of a neighbourhood, joined back to its edges.
    """
    def told(df: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())

    now = cut(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u != v").distinct())
    before = told(now)
    while True:
        # large star: every neighbour above u links to the smallest of u's neighbourhood, u included
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the neighbours at or below u, and u itself, link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where("u != v").distinct())
        after = told(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
