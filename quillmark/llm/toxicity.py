"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has an interpolated Kneser-Ney model of words as
character sequences with boundary marks.  The top-order counts belong to the
class; below, both back off to the same continuation counts, pooled over all
labelled texts.  An expression too rare to tell the classes apart gets the same
probability from both and cancels in the ratio.  The log-likelihood ratio of a
word is the sum over its characters, and texts are compared by ratios divided by
length: over the whole text, over its most suspicious window and over its most
suspicious words, since a short insult in a long text is still one.  A logistic
map, fitted on labelled rows by cross-fitting, turns these into a score.

Counting, continuation counts and smoothing are DataFrame operations over all
labelled rows outside the held-out third.  Every n-gram and every history keeps its
own ratio.  Up to ``MAX_GRAMS`` n-grams the table is sent to the tasks, keyed by the
strings themselves; beyond that the distinct words of the texts are joined to it and
the texts to the words, with the same ratios.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.shared import carried, lean, materialize, restored

ORDER = 5
DISCOUNT = 0.75
#: Distinct n-grams up to which the ratios are sent to the tasks, about 60 bytes each; more are joined.
MAX_GRAMS = 1_000_000
WINDOW = 20
NOISE = 2.0
FEATURES = 7
START, END = "\x02", "\x03"
_WORD = re.compile(r"\w+")
_CACHE = 400_000
#: Models: fitted on both folds, on fold 0 and on fold 1.
_FITS = ("all", "f0", "f1")


def held_out():
    """True for the third of the documents whose labels are never read."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, order: int = ORDER) -> list[str]:
    """Each character with up to ``order - 1`` before it; shorter at the word's start only."""
    marked = START + word + END
    return [marked[max(0, i - order + 1) : i + 1] for i in range(1, len(marked))]


def points_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``grams_of`` all words, one after the other, as rows of ``ORDER`` code points with zeros
    behind; each gram's length; and where each word's grams start."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    marked = START + (END + START).join(words) + END
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(place)
    size = np.minimum(place[at] + 1, ORDER)
    span = np.arange(ORDER)
    points = np.where(span < size[:, None], codes[np.minimum((at - size + 1)[:, None] + span, len(codes) - 1)], 0)
    return points, size, np.cumsum(lengths - 1) - (lengths - 1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, list[int]] = {}

    def flush():
        counts = list(zip(*found.values(), strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found)), *[pa.array(c, pa.int64()) for c in counts]], names=["word", "c00", "c01", "c10", "c11"])

    for batch in batches:
        for text, toxic, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            at = 2 * fold + toxic
            for word in words_of(text.as_py() or ""):
                if (counts := found.get(word)) is None:
                    counts = found[word] = [0, 0, 0, 0]
                counts[at] += 1
            if len(found) >= 200_000:
                yield flush()
                found.clear()
    if found:
        yield flush()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, np.ndarray] = {}
        counts = np.stack([batch.column(i).to_numpy() for i in range(1, 5)], axis=1)
        for word, row in zip(batch.column(0).to_pylist(), counts, strict=True):
            for gram in grams_of(word):
                found[gram] = found[gram] + row if gram in found else row
        if found:
            summed = np.stack(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found)), *[pa.array(summed[:, i]) for i in range(4)]], names=["gram", "c00", "c01", "c10", "c11"])


_SUMS = [(c, f"sum({c}) as {c}") for c in ("c00", "c01", "c10", "c11")]
_WORDS_SCHEMA = "word string, c00 long, c01 long, c10 long, c11 long"


def word_counts(labelled: DataFrame) -> DataFrame:
    """``word`` and its count by fold and class, over all of ``labelled`` (text, toxic, fold)."""
    words = labelled.select("text", "toxic", "fold").mapInArrow(lean(_count_words), _WORDS_SCHEMA)
    return words.groupBy("word").agg(*[F.expr(x) for _, x in _SUMS])


def gram_counts(words: DataFrame) -> DataFrame:
    grams = words.mapInArrow(lean(_count_grams), _WORDS_SCHEMA.replace("word", "gram", 1))
    return grams.groupBy("gram").agg(*[F.expr(x) for _, x in _SUMS])


def shared_backoff(grams: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """``suffix, p``: interpolated Kneser-Ney from continuation counts of both classes.

    The continuation count of a string is the number of different characters seen
    before it.  Strings of length L come from those of length L + 1 without their
    first character, so each length is one grouping of the one above.
    """
    rest = F.expr("substring(gram, 2)")
    suffixes: dict[int, DataFrame] = {}
    above = grams.where(F.length("gram") == order).select("gram")
    for length in range(order - 1, 0, -1):
        found = above.select(rest.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        suffixes[length] = found
        tops = grams.where(F.length("gram") == length).select("gram")
        above = found.select("gram").unionByName(tops)
    history = Window.partitionBy(F.expr("substring(gram, 1, length(gram) - 1)"))
    tables, below = [], None
    for length in range(1, order):
        level = suffixes[length].withColumn("total", F.sum("n").over(history)).withColumn("kinds", F.count(F.lit(1)).over(history))
        if below is None:
            below = level.select("gram", (F.col("n") / F.col("total")).alias("p"))
        else:
            lower = below.select(F.col("gram").alias("suffix"), F.col("p").alias("p_below"))
            below = level.join(lower, rest == F.col("suffix")).select("gram", (
                (F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("p_below")) / F.col("total")
            ).alias("p"))
        below = materialize(below, f"kn-{length}")
        tables.append(below)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select(F.col("gram").alias("suffix"), "p")


def ratio_table(grams: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """``gram, history`` and per fit the log-ratio of the n-gram and that of its
    history's backoff weights, toxic over ordinary."""
    by_history = Window.partitionBy("history")
    rows = grams.withColumn("history", F.expr("substring(gram, 1, length(gram) - 1)"))
    counts = {
        "all": (F.col("c00") + F.col("c10"), F.col("c01") + F.col("c11")),
        "f0": (F.col("c00"), F.col("c01")), "f1": (F.col("c10"), F.col("c11")),
    }
    for fit, pair in counts.items():
        for y, c in enumerate(pair):
            rows = rows.withColumn(f"c_{fit}{y}", c)
            rows = rows.withColumn(f"t_{fit}{y}", F.sum(c).over(by_history)).withColumn(
                f"n_{fit}{y}", F.sum((c > 0).cast("long")).over(by_history))
    rows = rows.join(shared_backoff(grams), F.expr("substring(gram, 2)") == F.col("suffix"))
    out = [F.col("gram"), F.col("history")]
    for fit in _FITS:
        p, alpha = [], []
        for y in (0, 1):
            c, t, n = (F.col(f"{k}_{fit}{y}") for k in "ctn")
            p.append(F.when(t > 0, (F.greatest(c - discount, F.lit(0.0)) + discount * n * F.col("p")) / t).otherwise(F.col("p")))
            alpha.append(F.when(t > 0, discount * n / t).otherwise(F.lit(1.0)))
        out += [F.log(p[1] / p[0]).alias(f"r_{fit}"), F.log(alpha[1] / alpha[0]).alias(f"h_{fit}")]
    return rows.select(*out)


def features_of(x: np.ndarray, chars: int) -> list[float]:
    """Ratios by length, from the ratios of a text's words in order and their ``chars``: per
    character of the whole text; of the words' evidence, what is above ``NOISE``, per word of
    the best ``WINDOW`` words and of the text; and the mean of the 1, 2, 3 and 5 most
    suspicious words."""
    if not len(x):
        return [0.0] * FEATURES
    evidence = np.clip(x - NOISE, 0.0, None)
    size = min(WINDOW, len(x))
    window = np.convolve(evidence, np.ones(size), "valid").max() / size
    top = np.zeros(5)
    best = np.sort(evidence)[::-1][:5]
    top[: len(best)] = best
    return [float(x.sum() / (chars + len(x))), float(window), float(evidence.mean()), *(float(top[:k].mean()) for k in (1, 2, 3, 5))]


class Keyed:
    """Values by string of at most ``ORDER`` characters, in sorted arrays; missing strings have none.

    A string is looked up by its code points: the last three, 63 bits, give the place among
    the different endings, and that place with the first two, 62 bits, the place among all.
    """

    _PLACES = 1 << 20

    def __init__(self, keys: list[str] | np.ndarray, values: np.ndarray) -> None:
        if len(keys) >= self._PLACES:
            raise ValueError("too many strings for sorted arrays")
        first, last = self._halves(np.array(keys, f"U{ORDER}").view(np.uint32).reshape(-1, ORDER).astype(np.int64))
        self.endings, at = np.unique(last, return_inverse=True)
        keys = first * self._PLACES + at
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    @staticmethod
    def _halves(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return points[:, 0] << 21 | points[:, 1], points[:, 2] << 42 | points[:, 3] << 21 | points[:, 4]

    def get(self, points: np.ndarray, column: int) -> np.ndarray:
        """Values of one column, NaN for strings that have none; ``points`` has a row of code points for each."""
        if not len(self.keys) or not len(points):
            return np.full(len(points), np.nan)
        first, last = self._halves(points)
        ending = np.minimum(np.searchsorted(self.endings, last), len(self.endings) - 1)
        key = first * self._PLACES + ending
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (self.endings[ending] == last), self.values[at, column], np.nan)


class Ratios:
    """Log-likelihood ratio of words under one fit, from the ratios of n-grams and histories."""

    def __init__(self, gram: Keyed, history: Keyed, fit: str) -> None:
        self.gram, self.history, self.column, self.cache = gram, history, _FITS.index(fit), {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def _words(self, words: list[str]) -> np.ndarray:
        points, size, starts = points_of(words)
        r = self.gram.get(points, self.column)
        # an n-gram never seen: only the backoff weights of its history differ
        unseen = np.flatnonzero(np.isnan(r))
        if unseen.size:
            histories = points[unseen]
            histories[np.arange(len(unseen)), size[unseen] - 1] = 0
            r[unseen] = np.nan_to_num(self.history.get(histories, self.column))
        return np.add.reduceat(r, starts)

    def _learn(self, words: set[str]) -> None:
        if new := list(words.difference(self.cache)):
            self.cache.update(zip(new, self._words(new).tolist(), strict=True))

    def _known(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.cache.__getitem__, words), np.float64, len(words))

    def of(self, words: list[str]) -> np.ndarray:
        self._learn(set(words))
        return self._known(words)

    def features(self, texts: list[str | None]) -> list[list[float]]:
        """``features_of`` of each text; words that are new are looked up for many texts at once."""
        out = []
        for at in range(0, len(texts), 128):
            if len(self.cache) > _CACHE:
                self.cache.clear()
            lists = [words_of(t or "") for t in texts[at : at + 128]]
            self._learn(set().union(*lists))
            out += [features_of(self._known(words), sum(map(len, words))) for words in lists]
        return out


def _histories(table: DataFrame) -> DataFrame:
    return table.groupBy("history").agg(*[F.first(f"h_{f}").alias(f"h_{f}") for f in _FITS])


def _fetched(rows: DataFrame) -> Keyed:
    """A table whose first column is the key, on the driver."""
    found = rows.toArrow()
    keys = [np.array(c.to_pylist(), f"U{ORDER}") for c in found.column(0).chunks]
    values = np.stack([c.to_numpy() for c in found.columns[1:]], axis=1)
    return Keyed(np.concatenate(keys) if keys else np.empty(0, f"U{ORDER}"), values)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema({"__row": pa.int64(), "__fold": pa.int32(), "word": pa.string(), "at": pa.list_(pa.int32())})
    for batch in batches:
        out: list[tuple] = []
        for row, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            places: dict[str, list[int]] = {}
            for i, word in enumerate(words_of(text.as_py() or "")):
                places.setdefault(word, []).append(i)
            out += [(row, fold, word, at) for word, at in places.items()]
            if len(out) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)


def _grams_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(w, g) for w in batch.column(0).to_pylist() for g in grams_of(w)]
        yield pa.RecordBatch.from_pydict({"word": [w for w, _ in pairs], "gram": [g for _, g in pairs]})


def word_ratios(words: DataFrame, table: DataFrame) -> DataFrame:
    """``word`` and per fit its log-likelihood ratio ``x_``, by joins with the whole ratio table."""
    pairs = materialize(words.mapInArrow(lean(_grams_of_words), "word string, gram string"), "kn-word-grams")
    history = F.expr("substring(gram, 1, length(gram) - 1)")
    seen = pairs.select("gram").distinct().join(table.drop("history", *[f"h_{f}" for f in _FITS]), "gram", "left")
    values = seen.withColumn("history", history).join(_histories(table), "history", "left").select(
        "gram", *[F.coalesce(f"r_{f}", f"h_{f}", F.lit(0.0)).alias(f"x_{f}") for f in _FITS])
    return pairs.join(materialize(values, "kn-values"), "gram").groupBy("word").agg(*[F.sum(f"x_{f}").alias(f"x_{f}") for f in _FITS])


def joined_features(texts: DataFrame, table: DataFrame, value) -> DataFrame:
    """``__row, __x``: what ``Ratios.features`` gives, of texts (__row, __fold, text) that have a word.

    The ratio of a word is ``value``, of its ratios ``x_`` and of ``__fold``.
    """
    found = texts.select("__row", "__fold", "text").mapInArrow(lean(_occurrences), "__row long, __fold int, word string, at array<int>")
    found = materialize(found, "kn-occurrences")
    words = materialize(word_ratios(found.select("word").distinct(), table), "kn-word-ratios")
    placed = found.join(words, "word").withColumn("__value", value).groupBy("__row").agg(
        F.flatten(F.collect_list(F.expr("transform(at, i -> struct(i, __value as x))"))).alias("xs"),
        F.sum(F.length("word") * F.size("at")).alias("chars"))

    @F.pandas_udf("array<double>")
    def features(xs: pd.Series, chars: pd.Series) -> pd.Series:
        return pd.Series([features_of(np.asarray(x, np.float64), int(n)) for x, n in zip(xs, chars, strict=True)])

    return placed.select("__row", features(F.transform(F.array_sort("xs"), lambda s: s["x"]), "chars").alias("__x"))


def _logistic(x: np.ndarray, y: np.ndarray, toxic_weight: float, l2: float = 0.1, rounds: int = 50) -> np.ndarray:
    cost = np.where(y > 0, toxic_weight, 1.0)
    z = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (cost * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (cost * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    """Has ``ratios``, or a ``table`` of ratios to be joined, or neither: then the score is the prior."""

    def __init__(
        self, ratios: Ratios | None, scale: np.ndarray, weights: np.ndarray, prior: float, table: DataFrame | None = None
    ) -> None:
        self.ratios, self.scale, self.weights, self.prior, self.table = ratios, scale, weights, prior, table

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def scores(self, texts: list[str | None]) -> list[float]:
        return [self.prior] * len(texts) if self.ratios is None else [self.score_of(f) for f in self.ratios.features(texts)]

    def score_of(self, features) -> float:
        z = np.asarray(features) / self.scale
        return float(1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30))))


def train(
    docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, toxic_weight: float = 2.5, max_broadcast_rows: int = 2_000_000,
    max_grams: int = MAX_GRAMS,
) -> ToxicityModel:
    """Fit on all rows of ``docs`` that ``labels`` marks, outside the held-out third.

    ``fit_rows`` bounds the labelled rows that the logistic map is fitted on
    (those of smallest hashed id); counts use every row.  There a toxic row weighs
    ``toxic_weight`` ordinary ones.  Null labels are ignored;
    of repeated labels for an id the largest counts.  Labels are broadcast only up
    to ``max_broadcast_rows`` rows; beyond that both sides are shuffled by id.
    Beyond ``max_grams`` distinct n-grams the ratios stay a table that words are joined to.
    With labels of one class or none the model gives their share as every score.
    """
    marks = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = marks.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    if not n["n"] or not 0 < n["t"] < n["n"]:
        return ToxicityModel(None, np.ones(FEATURES), np.zeros(FEATURES + 1), float(n["t"] or 0) / max(1, n["n"]))
    side = F.broadcast(marks) if n["n"] <= max_broadcast_rows else marks
    labelled = docs.select(F.col("doc_id"), F.col("text")).join(side, "doc_id").withColumn(
        "fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int"))
    words = materialize(word_counts(labelled), "kn-words")
    table = materialize(ratio_table(materialize(gram_counts(words), "kn-grams")), "kn-ratios")
    share = min(1.0, fit_rows / n["n"])
    bound = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    sample = labelled.where(F.xxhash64(F.lit("fit"), "doc_id") <= F.lit(bound))
    ratios = None
    # a fold is scored by the model of the other
    if table.count() <= max_grams:
        gram, history = _fetched(table.select("gram", *[f"r_{f}" for f in _FITS])), _fetched(_histories(table))
        ratios = Ratios(gram, history, "all")
        folds = docs.sparkSession.sparkContext.broadcast((Ratios(gram, history, "f1"), Ratios(gram, history, "f0")))

        @F.pandas_udf("array<double>")
        def features(texts: pd.Series, fold: pd.Series) -> pd.Series:
            found: list = [None] * len(texts)
            for f in (0, 1):
                own = np.flatnonzero(fold.to_numpy() == f).tolist()
                for i, x in zip(own, folds.value[f].features([texts.iloc[i] for i in own]), strict=True):
                    found[i] = x
            return pd.Series(found)

        sample = sample.select(features("text", "fold").alias("x"), "toxic").toArrow()
    else:
        rows = materialize(sample.select(
            F.monotonically_increasing_id().alias("__row"), F.col("fold").alias("__fold"), "text", "toxic"), "kn-fit")
        other = F.when(F.col("__fold") == 0, F.col("x_f1")).otherwise(F.col("x_f0"))
        sample = rows.join(joined_features(rows, table, other), "__row", "left").select(
            F.coalesce("__x", F.array(*[F.lit(0.0)] * FEATURES)).alias("x"), "toxic").toArrow()
    x = np.array(sample.column("x").to_pylist(), np.float64).reshape(-1, FEATURES)
    y = np.array(sample.column("toxic").to_pylist(), np.float64)
    scale = np.maximum(x.std(axis=0), 1e-9) if len(x) else np.ones(FEATURES)
    weights = _logistic(x / scale, y, toxic_weight)
    return ToxicityModel(ratios, scale, weights, float(n["t"]) / n["n"], table if ratios is None else None)


def add_score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``row`` (all columns of ``docs`` as one struct) and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = carried(docs, text=F.col("text"))
    if model.table is not None:
        rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "kn-docs")
        x = joined_features(rows.select("__row", F.lit(0).alias("__fold"), "text"), model.table, F.col("x_all"))

        @F.pandas_udf("double")
        def score_of(xs: pd.Series) -> pd.Series:
            return pd.Series([shared.value.score_of([0.0] * FEATURES if f is None else f) for f in xs], dtype="float64")

        return rows.join(x, "__row", "left").select("row", score_of("__x").alias("score"))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()), dtype="float64")

    return rows.select("row", score("text").alias("score"))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Whole texts are scored, however long; null and empty ones get the score of a
    text without evidence.  Repeated rows get the same score each.  Extra columns
    are ignored.  A null doc_id is not held out and has no label.  An empty table
    gives an empty table; without labels every score is 0.
    """
    model = train(docs, labels)
    scored = add_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("row.doc_id", "score").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def below(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns."""
    return restored(add_score(docs, train(docs, labels)).where(F.col("score") < threshold))
