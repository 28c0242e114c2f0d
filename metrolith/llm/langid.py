"""Operator 8: the languages of a document as a mixture of character n-gram models.

Each language has an interpolated trigram model over letters, learnt from labelled documents. Its counts lie in hashed
tables of a fixed size (2 ** 18 places for trigrams, less for their contexts), so every trigram of every labelled text
counts, whatever the corpus's size; trigrams that share a place share their count, which is the only approximation. The
likelihoods of a document's words under all models enter an expectation-maximisation of the languages' proportions.
From the full set, languages are dropped as long as the penalised likelihood (Schwarz) rises: first at once all with
less than half a word, then the least one; the largest proportion left is the prediction. Documents of an Arrow batch
go through these steps together, as segments of one matrix.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget_words, small_batches, trim

_PLAIN = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BEYOND = re.compile("[̀-\U0010ffff]")  # from here on there are marks that belong to a word
UNKNOWN = "und"
HELD_WORDS, HELD_BYTES = 100_000, 16 << 20  # words, and bytes of their likelihoods, that a Python worker holds at most
TOGETHER = 50_000  # distinct words of documents that are solved together
TRI, PAIR, ONE = 18, 16, 14  # bits of the places of trigrams, of pairs and of single letters
SIZES = (1 << TRI, 1 << PAIR, 1 << PAIR, 1 << ONE)  # trigrams, first two, last two, middle letters
OFFSETS = tuple(sum(SIZES[:i]) for i in range(5))
COUNTERS = 16  # languages whose tables a task holds while it counts


def words_of(text: str | None) -> list[str]:
    """Runs of letters with their marks, in lower case."""
    if not text:
        return []
    low = text.lower()
    if not _BEYOND.search(low):
        found = _PLAIN.findall(low)
        if all(map(str.isalpha, found)):
            return found
    return _LETTERS.findall(low)


def remainder(id_col: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % k


def _mixed(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def places(words: list[str]) -> np.ndarray:
    """4 x trigrams: places in the four tables of the trigrams of ^word$, word after word; a word of n letters has n."""
    c = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    end = c == ord("$")
    i = np.flatnonzero(~end[:-2] & ~end[1:-1]) if len(c) > 2 else np.empty(0, np.int64)
    a, b, d = c[i], c[i + 1], c[i + 2]
    s = np.uint64(21)
    return np.stack([_mixed(((a << s | b) << s) + d * np.uint64(0x9E3779B97F4A7C15) + a, TRI), _mixed(a << s | b, PAIR) + OFFSETS[1], _mixed(b << s | d, PAIR) + OFFSETS[2], _mixed(b, ONE) + OFFSETS[3]])


def ngram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, place, n): how often the trigrams and contexts of each place occur in the words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        held: dict[str, np.ndarray] = {}
        waiting: dict[str, list[str]] = {}

        def count(lang: str) -> None:
            words = waiting.pop(lang)
            own = held.setdefault(lang, np.zeros(OFFSETS[4], np.int64))
            for a in range(0, len(words), 1 << 17):
                own += np.bincount(places(words[a : a + (1 << 17)]).ravel(), minlength=OFFSETS[4])

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(waiting):
                count(lang)
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "place", "n"])
            held.clear()

        for batch in batches:
            for t, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = words_of(t.as_py())
                if words:
                    if lang not in held and lang not in waiting and len(held.keys() | waiting.keys()) >= COUNTERS:
                        yield from flush()
                    own = waiting.setdefault(lang, [])
                    own += words
                    if len(own) > 20_000:
                        count(lang)
        yield from flush()

    labelled = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    return labelled.mapInArrow(run, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))


class Model:
    """Log likelihoods of words under each language; its size is 1.6 MB a language, whatever it has learnt from."""

    def __init__(self, langs: list[str], counts: np.ndarray, smoothing: float = 0.5) -> None:
        """counts: languages x places."""
        self.langs, self.smoothing = langs, smoothing
        self.counts = counts.astype(np.float32)
        self.size = int((counts[:, OFFSETS[3] :].sum(axis=0) > 0).sum()) + 1 if langs else 1
        self.words: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": {}, "rows": None}

    def _learn(self, words: list[str]) -> None:
        """Gives new words their places; a word's likelihoods are relative to its likeliest language's."""
        if self.rows is None:
            self.rows = np.empty((self.room, len(self.langs)), np.float32)
        for a in range(0, len(words), 4096):
            part = words[a : a + 4096]
            tri, first, last, middle = (self.counts[:, i] for i in places(part))
            s, weight = self.smoothing, self.smoothing * self.size * 0.2
            logs = np.log((tri + weight * (last + s) / (middle + s * self.size)) / (first + weight))
            starts = np.cumsum([0, *map(len, part[:-1])])
            total = np.add.reduceat(logs, starts, axis=1, dtype=np.float64).T
            at = len(self.words)
            self.rows[at : at + len(part)] = np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -60))
            self.words.update(zip(part, range(at, at + len(part)), strict=True))

    @property
    def room(self) -> int:
        return max(4096, min(HELD_WORDS, HELD_BYTES // (4 * len(self.langs))))

    def _likelihoods(self, words: list[str]) -> np.ndarray:
        known = self.words
        new = list(dict.fromkeys(w for w in words if w not in known))
        if new:
            if len(known) + len(new) > self.room:
                known.clear()
                half = self.room // 2
                if len(words) > half:  # more words than the table holds
                    return np.concatenate([self._likelihoods(words[a : a + half]) for a in range(0, len(words), half)])
                new = list(dict.fromkeys(words))
            self._learn(new)
        return self.rows[[known[w] for w in words]]

    @staticmethod
    def _em(like: np.ndarray, n: np.ndarray, doc: np.ndarray, share: np.ndarray, steps: int = 30) -> np.ndarray:
        """Proportions of all documents; doc: the document of each row of like, ascending; shares of zero stay so."""
        out, active = share.copy(), np.arange(len(share))
        for _ in range(steps):
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            mix = like * share[doc]
            mix *= (n / mix.sum(axis=1))[:, None]
            then = np.add.reduceat(mix, starts, axis=0)
            then /= then.sum(axis=1, keepdims=True)
            moved = np.abs(then - share).max(axis=1) >= 1e-4
            out[active], share = then, then
            if not moved.all():
                if not moved.any():
                    break
                rows = moved[doc]
                like, n, active, share = like[rows], n[rows], active[moved], share[moved]
                doc = (np.cumsum(moved) - 1)[doc[rows]]
        return out

    @staticmethod
    def _score(like: np.ndarray, n: np.ndarray, doc: np.ndarray, share: np.ndarray) -> np.ndarray:
        each = n * np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-300))
        return np.add.reduceat(each, np.flatnonzero(np.diff(doc, prepend=-1)))

    def _solved(self, like: np.ndarray, n: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Documents x languages: proportions after the selection of languages."""
        total = np.bincount(doc, n, docs)
        penalty = 0.5 * np.log(total + 1)
        share = self._em(like, n, doc, np.full((docs, len(self.langs)), 1 / len(self.langs)))
        score = self._score(like, n, doc, share)

        def without(todo: np.ndarray, gone: np.ndarray) -> np.ndarray:
            """Drops gone (documents x languages) of the documents todo where that pays; tells which."""
            rows = np.isin(doc, todo)
            own, sub = like[rows], np.searchsorted(todo, doc[rows])
            start = np.where((share[todo] > 0) & ~gone, np.maximum(share[todo], 1e-6), 0.0)
            then = self._em(own, n[rows], sub, start / start.sum(axis=1, keepdims=True))
            lower = self._score(own, n[rows], sub, then)
            good = lower >= score[todo] - penalty[todo] * (gone & (share[todo] > 0)).sum(axis=1)
            share[todo[good]], score[todo[good]] = then[good], lower[good]
            return good

        if len(self.langs) > 1:
            few = (share * total[:, None] < 0.5) & (share < share.max(axis=1, keepdims=True))
            todo = np.flatnonzero(few.any(axis=1))
            if len(todo):
                without(todo, few[todo])
            todo = np.arange(docs)
            while True:
                todo = todo[(share[todo] > 0).sum(axis=1) > 1]
                if not len(todo):
                    break
                least = np.where(share[todo] > 0, share[todo], np.inf).argmin(axis=1)
                todo = todo[without(todo, np.arange(len(self.langs)) == least[:, None])]
        return share

    def mixtures(self, texts: list[str | None]) -> list[dict[str, float]]:
        """For each text the selected languages with their proportions, adding up to 1; empty if there is no letter."""
        out: list[dict[str, float]] = [{} for _ in texts]
        held: list[tuple[int, Counter]] = []
        size = 0

        def solve() -> None:
            nonlocal size
            if held:
                like = self._likelihoods([w for _, c in held for w in c]).astype(np.float64)
                n = np.array([x for _, c in held for x in c.values()], np.float64)
                doc = np.repeat(np.arange(len(held)), [len(c) for _, c in held])
                for (i, _), share in zip(held, self._solved(like, n, doc, len(held)), strict=True):
                    out[i] = {self.langs[k]: float(share[k]) for k in np.flatnonzero(share)}
                held.clear()
                size = 0

        if self.langs:
            for i, t in enumerate(texts):
                counted = Counter(words_of(t))
                if counted:
                    held.append((i, counted))
                    size += len(counted)
                    if size >= TOGETHER:
                        solve()
            solve()
        return out

    def proportions(self, text: str | None) -> dict[str, float]:
        return self.mixtures([text])[0]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_model_mb: int = 512) -> Model:
    """Counts all rows with a text and a label. What reaches the driver is a fixed number of places for each label;
    labels whose tables would pass `max_model_mb` (over 300 of them) are an error, since a model must fit a worker."""
    small_batches(docs.sparkSession)
    counts = ngram_counts(docs, text_col, lang_col)
    table = counts.toArrow()
    langs = table.column("lang").combine_chunks().dictionary_encode() if table.num_rows else None
    if langs is None:
        return Model([], np.zeros((0, OFFSETS[4]), np.float32))
    names = langs.dictionary.to_pylist()
    if len(names) * OFFSETS[4] * 4 > max_model_mb << 20:
        raise ValueError(f"{len(names)} labels need more than {max_model_mb} MB")
    order = sorted(range(len(names)), key=lambda k: names[k])
    row = np.empty(len(names), np.int64)
    row[order] = np.arange(len(names))
    full = np.zeros((len(names), OFFSETS[4]), np.float32)
    full[row[langs.indices.to_numpy()], table.column("place").to_numpy()] = table.column("n").to_numpy()
    return Model([names[k] for k in order], full)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, languages): one row a row; score is the proportion of lang_pred.

    A null text, or one without a letter (digits such as a half or a Roman numeral's sign are none), is `und` with
    score 0 and no languages; so is any text if nothing was learnt. Texts of any length are read whole.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        own = shared.value
        for batch in batches:
            found = own.mixtures(batch.column(1).to_pylist())
            best = [max(x.items(), key=lambda kv: (kv[1], kv[0])) if x else (UNKNOWN, 0.0) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b for b, _ in best], pa.string()), pa.array([min(1.0, s) for _, s in best], pa.float64()), pa.array([list(x.items()) for x in found], pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "languages"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, lang_pred string, score double, languages map<string,double>")


def identify(docs: DataFrame, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) for every row; learnt only from rows outside the held-out fold.

    Rows with a null id are held out of no fold and teach nothing. Repeated rows count and answer each by itself. An
    empty table gives no row; columns of other names are ignored.
    """
    fold = remainder(id_col, folds)
    model = fit(docs.where(fold != held), text_col, lang_col)
    out = predict(docs, model, id_col, text_col)
    return out.select("doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that have no letter or no language with the proportion `least`; columns as they were.

    Null texts go, null ids are judged like any other and teach nothing, repeated rows are judged each by itself. Where
    no row has a label, nothing is learnt and only rows without a letter go. An empty table stays empty.
    """
    model = fit(docs.where(remainder(id_col, 4) != 2), text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        own = shared.value
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).to_pylist()
            sure = [max(x.values(), default=0.0) >= least for x in own.mixtures(texts)] if own.langs else [bool(words_of(t)) for t in texts]
            yield batch.filter(pa.array(sure, pa.bool_()))
        batch = texts = None
        trim()

    return docs.mapInArrow(run, docs.schema)
