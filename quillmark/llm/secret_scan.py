"""Secret scans: fixed patterns plus a likelihood-ratio test of character models.

Two character Markov models of the same order, one trained on random strings and
one on ordinary identifiers, score what the patterns leave of every long token.
Log-likelihood ratios (random over ordinary) less a threshold are cumulated along
it, and the runs that gain most are secrets, so that a key is found inside a path
or an identifier too; so is a segment or token whose mean ratio reaches the
threshold.  Training samples are labelled rows ``(text, label)``;
``labelled_samples`` makes them: random strings over the usual key alphabets from a
seeded generator, and ordinary identifiers joined in the usual styles from general
roots and from words of the corpus itself (``corpus_words``).  ``plain_samples`` adds
numbers, dates and rules to the ordinary ones.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.shared import lean, materialize

#: The base patterns, in order of kind.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: An assignment has one of these, in some case.
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Characters of the shortest token, and of the shortest run in one.
SHORTEST = 20
#: A run's ends move over so many characters to the ends of its segment.
_SNAP = 3
_JOINS = "/_-+="
_WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{4,40}(?![A-Za-z0-9])")
_SEGMENT = re.compile(r"[A-Za-z0-9]{20,}={0,2}")

#: Roots of identifiers that are ordinary in any corpus; its own words come beside them.
ROOTS = (
    "account action address array auth backup batch block buffer build cache channel check client cluster code column "
    "command config connection content context control copy count create current data date default delete device "
    "document domain email engine entry error event export factory field file filter folder format function global "
    "graph group handler header history host image import index input instance item key label language layer length "
    "level limit list local log manager master memory message method metric model module name network number object "
    "option order output owner page parent path payload policy port process product profile project query queue "
    "record region release request resource response result route sample schema script search section server service"
).split()
#: The ordinary model is fitted on at most so many words of the corpus, from about so many of its documents (all, if
#: there are fewer); a word must be seen in so many batches of rows.
CORPUS_WORDS, SAMPLE_DOCS, SEEN = 20_000, 50_000, 2


def labelled_samples(n: int = 6_000, seed: int = 11, words: list[str] | None = None) -> list[tuple[str, int]]:
    """``n`` random strings (label 1) and ``n`` ordinary identifiers (label 0), every other one of the corpus's ``words``."""
    rng = random.Random(seed)
    alphabets = (
        string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.hexdigits[:16],
        string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "_-",
    )
    rows = [("".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 64))), 1) for i in range(n)]
    joins = ("_", "-", "/", "", "camel", "_upper")
    for i in range(n):
        of = words if words and i // len(joins) % 2 else ROOTS
        parts, style = rng.choices(of, k=rng.randint(2, 6)), joins[i % len(joins)]
        if style == "camel":
            text = parts[0] + "".join(w.title() for w in parts[1:])
        else:
            text = "_".join(parts).upper() if style == "_upper" else style.join(parts)
        if rng.random() < 0.3:
            text += str(rng.randint(0, 2030))
        rows.append((text, 0))
    return rows


def plain_samples(n: int = 450, seed: int = 12) -> list[tuple[str, int]]:
    """Numbers, dates and times, and rules of one or two characters, as label-0 samples."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            text = "".join(rng.choices(string.digits, k=rng.randint(4, 24)))
        elif i % 3 == 1:
            parts = [rng.randint(1900, 2099), *(rng.randint(0, 59) for _ in range(rng.randint(2, 5)))]
            text = rng.choice("-/_").join(f"{x:02d}" for x in parts)
        else:
            text = "".join(rng.choices(string.ascii_letters + string.digits + "+/_-----____", k=rng.randint(1, 2))) * rng.randint(4, 24)
        rows.append((text, 0))
    return rows


class MarkovPair:
    """Add-k smoothed character models of one order for both labels."""

    ALPHABET = string.ascii_letters + string.digits + "+/_-=."

    def __init__(self, order: int = 1, smooth: float = 0.3) -> None:
        self.order, self.smooth, self.size = order, smooth, len(self.ALPHABET) + 1
        self.code = {c: i + 1 for i, c in enumerate(self.ALPHABET)}
        self.ratio: np.ndarray | None = None

    def _codes(self, text: str) -> np.ndarray:
        return np.fromiter((self.code.get(c, 0) for c in text), np.int64, len(text))

    def _grams(self, text: str) -> np.ndarray:
        codes = np.concatenate([np.zeros(self.order, np.int64), self._codes(text)])
        grams = np.zeros(len(text), np.int64)
        for i in range(self.order + 1):
            grams = grams * self.size + codes[i : i + len(text)]
        return grams

    def fit(self, samples: list[tuple[str, int]]) -> MarkovPair:
        logs = []
        for label in (0, 1):
            counts = np.zeros(self.size ** (self.order + 1))
            for text, y in samples:
                if y == label:
                    np.add.at(counts, self._grams(text), 1)
            counts = counts.reshape(-1, self.size)
            # the order-0 model of the label backs the contexts up
            base = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * self.size)
            strength = self.smooth * self.size
            logs.append(np.log((counts + strength * base) / (counts.sum(1, keepdims=True) + strength)).reshape(-1))
        self.ratio = logs[1] - logs[0]
        return self

    def ratios(self, text: str) -> np.ndarray:
        """Log-likelihood ratio of each character."""
        return self.ratio[self._grams(text)]

    def score(self, text: str) -> float:
        """Mean log-likelihood ratio per character; 0 for the empty text."""
        return float(self.ratio[self._grams(text)].mean()) if text else 0.0


def corpus_words(docs: DataFrame, text_col: str = "text", limit: int = CORPUS_WORDS, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """Ordinary words of 4 ASCII letters or more from ``docs``, to fit the ordinary class on.

    A bounded sample, whatever the size of the corpus: of the documents of smallest hash,
    about ``sample_docs``, the words seen in ``SEEN`` batches of rows or more, which random
    strings are not; of these the ``limit`` ones of smallest hash.
    """
    def low(column, wanted: int, n: int):
        share = min(1.0, wanted / max(1, n))
        return F.lit(True) if share >= 1 else F.xxhash64(F.lit(text_col), column) <= F.lit(int(-(2**63) + share * (2**64 - 1)))

    def words(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = set()
                for text in batch.column(0).slice(at, 500):
                    found.update(_WORD.findall(text.as_py() or ""))
                yield pa.RecordBatch.from_pydict({"word": list(found)}, schema=pa.schema([("word", pa.string())]))

    sample = docs.select(F.col(text_col).alias("text")).where(low(F.col("text"), sample_docs, docs.count()))
    seen = sample.mapInArrow(lean(words), "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN)
    seen = materialize(seen.select("word"), "corpus-words")
    # a little more than is wanted, so that the smallest hashes are among them
    rows = seen.where(low(F.col("word"), limit + 4 * math.isqrt(limit), seen.count())).select("word", F.xxhash64(F.lit(text_col), "word").alias("rank")).collect()
    return [r["word"] for r in sorted(rows, key=lambda r: (r["rank"], r["word"]))[:limit]]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, kinds as numbers of KINDS."""
    spans = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        # a match that fails the length test still uses up its characters
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # maximal runs, so asking for 24 or more at once finds the same
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(spans)


def random_runs(text: str, model: MarkovPair, threshold: float) -> list[tuple[int, int]]:
    """(start, end) of the runs of ``SHORTEST`` characters or more that the models call random.

    A run starts where the cumulated ratio less ``threshold`` a character leaves zero, ends
    at the peak, and is over when the sum has lost twice what it takes to be a run.
    """
    if len(text) < SHORTEST:
        return []
    least = SHORTEST * threshold
    gains = model.ratios(text) - threshold
    if gains[gains > 0].sum() < least:
        return []
    runs, steps = [], gains.tolist()
    at = start = end = 0
    total = peak = 0.0

    def close():
        lo, hi = start, end
        while lo > 0 and start - lo <= _SNAP and text[lo - 1] not in _JOINS:
            lo -= 1
        while hi < len(text) and hi - end <= _SNAP and text[hi] not in _JOINS:
            hi += 1
        lo, hi = (start if start - lo > _SNAP else lo), (end if hi - end > _SNAP else hi)
        while hi < len(text) and text[hi] == "=":
            hi += 1
        if hi - lo >= SHORTEST and peak >= least:
            runs.append((lo, hi))

    while at < len(steps):
        total += steps[at]
        at += 1
        if total > peak:
            peak, end = total, at
        elif total <= 0 or total <= peak - 2 * least:
            close()
            # what followed the peak may start a run of its own
            at = start = end = end if peak > 0 else at
            total = peak = 0.0
    close()
    return runs


def random_parts(text: str, model: MarkovPair, threshold: float) -> list[tuple[int, int]]:
    """The random runs of ``text``; of the segments and the text that hold none of these, those of a mean ratio of ``threshold``."""
    if len(text) < SHORTEST:
        return []
    found = random_runs(text, model, threshold)
    for m in (*_SEGMENT.finditer(text), *re.finditer(".+", text)):
        if m.end() - m.start() >= SHORTEST and not any(s < m.end() and m.start() < e for s, e in found):
            if model.score(m.group()) >= threshold:
                found.append(m.span())
    return found


def model_spans(text: str, covered: list[tuple[int, int, int]], model: MarkovPair, threshold: float) -> list[tuple[int, int, int]]:
    """Runs in tokens, outside the base spans, that the models call random.

    Tokens and base spans both come in order, so one pass meets them.
    """
    merged: list[list[int]] = []
    for s, e, _ in sorted(covered):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    spans, i = [], 0
    for m in _TOKEN.finditer(text):
        at, pieces = m.start(), []
        while i < len(merged) and merged[i][1] <= at:
            i += 1
        j = i
        while j < len(merged) and merged[j][0] < m.end():
            pieces.append((at, merged[j][0]))
            at = merged[j][1]
            j += 1
        i = max(i, j - 1)
        for lo, hi in [*pieces, (at, m.end())]:
            spans += [(lo + s, lo + e, 3) for s, e in random_parts(text[lo:hi], model, threshold)]
    return spans


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans))


def default_model(words: list[str] | None = None) -> MarkovPair:
    """Fitted on samples that are made by rule, and on identifiers of the corpus's words."""
    plain = [(w, 0) for w in (words or [])[:3000] if len(w) >= 8]
    return MarkovPair().fit(labelled_samples(words=words) + plain_samples() + plain)


_SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
)


def scan_secrets(docs: DataFrame, model: MarkovPair | None = None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Secrets of every whole text.

    Returns ``doc_id``, the number of spans per kind, the hash of the base spans
    and all spans as ``kind:start:end`` in code points.  A null text has none; an
    empty text neither.  Repeated rows give repeated results.  Extra columns are
    ignored.  An empty table gives an empty table.  Memory is bounded by the longest
    text.  Without a ``model`` the ordinary one is fitted on the words of ``docs`` too,
    ``CORPUS_WORDS`` of them at most, from about ``SAMPLE_DOCS`` documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model(corpus_words(docs, text_col)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shared.value
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            while part := list(islice(rows, 1000)):
                out = []
                for doc_id, cell in part:
                    text = cell.as_py() or ""
                    base = base_spans(text)
                    more = model_spans(text, base, pair, threshold)
                    kinds = [k for _, _, k in base]
                    out.append((doc_id, kinds.count(0), kinds.count(1), kinds.count(2), len(more),
                                hashlib.sha256(_written(base).encode()).hexdigest(), _written(base + more)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 5 + [pa.string()] * 2, strict=True)],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(scan), _SCHEMA)
