"""Operator 9: quality by regularised quadratic discriminant analysis over document statistics.

Each class has the mean and the covariance of the transformed statistics, the covariance shrunk towards the pooled one
and towards a multiple of the identity. The score is a squashed difference of the two Mahalanobis log densities and
log priors; the Cholesky factors of both covariances are computed once and kept with the model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .langid import remainder

NAMES = ("words", "word_length", "upper", "digit", "mark", "stop", "bang", "bar", "line", "distinct", "repeated_lines", "top_word", "short_lines", "end_marks", "plain_words")
_EPS = 1e-3


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_MARK, _STOP, _BANG, _BAR = _class("#$%&*@^~<>{}[]\\/=+_"), _class(".,;:"), _class("!?"), _class("|")
_CLASSES = np.stack([_UPPER, _DIGIT, _MARK, _STOP, _BANG, _BAR], axis=1)


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text; those of the empty text for null."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(raw))
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / size
    counted = Counter(words)
    distinct_lines = len(set(lines))
    plain = sum(k for w, k in counted.items() if w.isalpha() or w[-1:] in b".," and w[:-1].isalpha() or not w.isascii())
    return np.array(
        [
            np.log1p(len(words)),
            np.log(len(raw) / n + 1),
            *np.log(share + _EPS),
            np.log(len(lines) / n + _EPS),
            np.log(len(counted) / n + _EPS),
            np.log(1 - distinct_lines / max(1, len(lines)) + _EPS),
            np.log(max(counted.values(), default=0) / n + _EPS),
            np.log(sum(len(x) < 40 for x in lines) / max(1, len(lines)) + _EPS),
            np.log(sum(k for w, k in counted.items() if w[-1:] in b".!?") / n + _EPS),
            np.log(1 - plain / n + _EPS),
        ]
    )


@dataclass
class Discriminant:
    """means, Cholesky factors, log determinants and log priors of class 0 and 1; scale: the statistics' spread."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logs: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 for each row; 0.5 where both classes are as likely. Squashed so that far differences stay apart."""
        x = (x - self.centre) / self.scale
        density = [c - 0.5 * (np.linalg.solve(f, (x - m).T) ** 2).sum(axis=0) for m, f, c in zip(self.means, self.factors, self.logs, strict=True)]
        z = density[1] - density[0]
        return 0.5 + 0.5 * z / (4 + np.abs(z))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = 0.1, to_identity: float = 0.05) -> Discriminant:
    """moments: for class 0 and 1 the count, sum and sum of outer products. A class without rows takes the pooled shape."""
    d = len(NAMES)
    n = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
    total = max(1.0, n[0] + n[1])
    everything = [sum((moments[k][i] for k in moments), np.zeros(s)) for i, s in ((1, d), (2, (d, d)))]
    centre = everything[0] / total
    scale = np.sqrt(np.maximum(np.diag(everything[1]) / total - centre**2, 1e-6))
    means, spreads = [], []
    for k in (0, 1):
        c, s, o = moments.get(k, (0.0, np.zeros(d), np.zeros((d, d))))
        m = s / c if c else centre
        spread = (o / c - np.outer(m, m)) if c else np.eye(d)
        means.append((m - centre) / scale)
        spreads.append(spread / np.outer(scale, scale))
    pooled = sum(n[k] * spreads[k] for k in (0, 1)) / total if n[0] + n[1] else np.eye(d)
    factors, logs = [], []
    for k in (0, 1):
        own = (1 - to_pooled) * spreads[k] + to_pooled * pooled
        own = (1 - to_identity) * own + to_identity * np.eye(d) * max(np.trace(own) / d, 1e-3)
        f = np.linalg.cholesky(own)
        factors.append(f)
        logs.append(float(np.log((n[k] + 1) / (total + 2)) - np.log(np.diag(f)).sum()))
    return Discriminant(centre, scale, means, factors, logs)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], names=["doc_id", "x"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, x array<double>")


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Over rows (y 0 or 1, x): partial sums by partition, then by Spark; one row a class and place reaches the driver."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).to_numpy(zero_copy_only=False)
                x = np.column_stack([np.ones(batch.num_rows), np.array(batch.column(1).to_pylist())])
                for k in (0, 1):
                    own = x[y == k]
                    total[k] = total.get(k, 0) + own.T @ own
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())], names=["y", "place", "v"])

    got: dict[int, np.ndarray] = {}
    for r in rows.select(F.col("y").cast("int").alias("y"), "x").where("y in (0, 1)").mapInArrow(run, "y int, place int, v double").groupBy("y", "place").agg(F.sum("v").alias("v")).collect():
        got.setdefault(r["y"], np.zeros((d + 1) ** 2))[r["place"]] = r["v"]
    full = {k: v.reshape(d + 1, d + 1) for k, v in got.items()}
    return {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in full.items() if m[0, 0] > 0}


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; learnt from all labels outside the held-out fold.

    Null and empty texts are scored like any other; labels other than 0 and 1, null ids and labels without a document
    teach nothing; a repeated label counts as often as it stands there. Without labels every score is 0.5. Statistics
    are cut into the shared folder, so a text is read once.
    """
    own = cut(features(docs, id_col, text_col))
    taught = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where((remainder("doc_id", folds) != held) & F.col("y").isin(0, 1))
    seen = moments(taught.join(own, "doc_id"))
    model = discriminant(seen) if seen else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, len(NAMES))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = own.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")
