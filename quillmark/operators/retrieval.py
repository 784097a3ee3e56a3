"""Ranking: BM25, dense, fusion, reranking, and the filters around them.

All take a ``queries`` side that is small by nature (a question set) and a
``chunks`` side of any size.  Ties always have a rule: (score desc, chunk_id asc).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from quillmark.functions.text import tokenize
from quillmark.session import written

K1, B, EPSILON = 1.5, 0.75, 0.25


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "chunk_id") -> DataFrame:
    """The k best rows per question with their rank."""
    best = Window.partitionBy("question_id").orderBy(F.col(score).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _terms(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.coalesce(tokenize(F.col("text")), F.array()).alias("terms"))


def bm25_weights(chunks: DataFrame, queries: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """``question_id, term, weight, avgdl``: what a term adds to a question's score, before the chunk's part.

    One aggregation over the chunks' distinct terms, with partial sums, writes the
    vocabulary: chunks per term; chunks and their lengths are counted along as the term
    '', which no text has.  Terms that more than half of the chunks hold get ``epsilon`` times the
    mean idf of all terms.  Repeated query terms count each time.
    """
    per_chunk = _terms(chunks).select(F.size("terms").cast("long").alias("dl"), F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit("")))).alias("term"))
    vocabulary = written(per_chunk.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("length")), "vocabulary")
    stats = vocabulary.where("term = ''").select(F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("avgdl"))
    idf = vocabulary.where("term <> ''").join(F.broadcast(stats)).withColumn(
        "raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = idf.agg((F.lit(epsilon) * F.avg("raw")).alias("floor"))
    asked = queries.select("question_id", F.explode(tokenize(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(
        F.count(F.lit(1)).alias("qtf"))
    raised = F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw"))
    return asked.join(idf, "term").join(F.broadcast(floor)).select("question_id", "term", (F.col("qtf") * raised).alias("weight"), "avgdl")


def bm25_scores(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """``question_id, chunk_id, score`` of all chunks that share a term with the question.

    Only tokens that some question asks for are grouped.  For the best chunks alone
    ``bm25_topk`` does without shuffling scores.
    """
    weights = bm25_weights(chunks, queries, epsilon)
    tokens = _terms(chunks).select("chunk_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    asked = queries.select(F.explode(tokenize(F.col("question"))).alias("term")).distinct()
    found = tokens.join(asked, "term", "left_semi").groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).join(weights, "term")
    score = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # rounded, so that the order of summation never decides between equal scores
    return found.groupBy("question_id", "chunk_id").agg(F.round(F.sum(score), 9).alias("score"))


class Best:
    """The k best rows of each question so far: score descending, then key."""

    def __init__(self, questions: int, k: int) -> None:
        self.k, self.floor = k, np.full(questions, -np.inf)
        self.question, self.score, self.key = np.empty(0, np.int64), np.empty(0), np.empty(0, object)

    def merge(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """``scores``: a row per key, a column per question."""
        order = np.argsort(keys, kind="stable")
        scores, keys = scores[order], keys[order]
        # Rows equal to the floor can only win by their keys, the first k of them.
        ties = scores == self.floor
        row, question = np.nonzero((scores > self.floor) | (ties & (np.cumsum(ties, axis=0) <= self.k)))
        if not row.size:
            return
        question = np.concatenate([self.question, question])
        score = np.concatenate([self.score, scores[row, question[len(self.question):]]])
        key = np.concatenate([self.key, keys[row]])
        order = np.lexsort((np.unique(key, return_inverse=True)[1], -score, question))
        question, score, key = question[order], score[order], key[order]
        place = np.arange(len(question)) - np.searchsorted(question, np.arange(len(self.floor)))[question]
        kept = place < self.k
        self.question, self.score, self.key = question[kept], score[kept], key[kept]
        last = self.question[place[kept] == self.k - 1]
        self.floor[last] = self.score[place[kept] == self.k - 1]


def _scan(chunks: DataFrame, ids: list, kind: str, k: int, scorer: Callable, rows: int = 512) -> DataFrame:
    """Each task's k best rows of ``chunks`` (chunk_id and one more column) per question."""

    def scan(batches):
        best = Best(len(ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                keys = np.array(part.column(0).to_pylist(), object)
                best.merge(scorer(part.column(1)), keys)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({
            "question_id": pd.Series([ids[q] for q in best.question], dtype=object), "chunk_id": best.key, "score": best.score}), schema=schema)

    schema = pa.schema([("question_id", to_arrow_type(_parse_datatype_string(kind))), ("chunk_id", pa.string()), ("score", pa.float64())])
    return chunks.mapInArrow(scan, f"question_id {kind}, chunk_id string, score double")


def _blocks(rows: list, block: int) -> list[list]:
    return [rows[at : at + block] for at in range(0, len(rows), block)] or [[]]


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int = 20, k1: float = K1, b: float = B, epsilon: float = EPSILON, block: int = 4096) -> DataFrame:
    """The k best chunks per question of all chunks; those without a common term have score 0.

    The question set goes to the tasks in blocks of ``block`` questions with the
    weights of their terms.  A task keeps k chunks per question, so what is shuffled
    depends neither on the number of chunks in a task nor on how common a term is.
    Scores are rounded to 9 places, so that equal ones tie.
    """
    spark, kind = chunks.sparkSession, queries.schema["question_id"].dataType.simpleString()
    asked: dict = {r["question_id"]: [] for r in queries.select("question_id").distinct().collect()}
    avgdl = 1.0
    for r in bm25_weights(chunks, queries, epsilon).toLocalIterator():
        asked[r["question_id"]].append((r["term"], r["weight"]))
        avgdl = r["avgdl"]
    words = chunks.select("chunk_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    found = []
    for ids in _blocks(list(asked), block):
        weights: dict[str, tuple[list, list]] = {}
        for i, question in enumerate(ids):
            for term, weight in asked[question]:
                at, w = weights.setdefault(term, ([], []))
                at.append(i)
                w.append(weight)
        shared = spark.sparkContext.broadcast({t: (np.array(i), np.array(w)) for t, (i, w) in weights.items()})
        found.append(_scan(words, ids, kind, k, _bm25_scorer(shared, len(ids), avgdl, k1, b)))
    return top_k(reduce(DataFrame.unionByName, found), k)


def _bm25_scorer(shared, questions: int, avgdl: float, k1: float, b: float):
    import re

    token = re.compile("[a-z0-9]+")

    def scores(texts) -> np.ndarray:
        out, weights = np.zeros((len(texts), questions)), shared.value
        for r, text in enumerate(texts):
            terms = token.findall(text.as_py())
            norm = k1 * (1 - b + b * len(terms) / avgdl)
            for term, tf in Counter(terms).items():
                if (hit := weights.get(term)) is not None:
                    out[r, hit[0]] += hit[1] * (tf * (k1 + 1) / (tf + norm))
        return np.round(out, 9)

    return scores


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int = 20, block: int = 4096) -> DataFrame:
    """The k chunks of largest inner product per question, exact.

    ``queries`` (question_id, embedding) go to the tasks in blocks; each task keeps k
    rows per question.  Questions and chunks without an embedding take no part.
    """
    spark, kind = chunks.sparkSession, queries.schema["question_id"].dataType.simpleString()
    rows = queries.where("embedding is not null").select("question_id", "embedding").collect()
    vectors = chunks.where("embedding is not null").select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    found = []
    for part in _blocks(rows, block):
        shared = spark.sparkContext.broadcast(np.array([r["embedding"] for r in part], np.float64).reshape(len(part), -1))
        found.append(_scan(vectors, [r["question_id"] for r in part], kind, k, _dense_scorer(shared)))
    return top_k(reduce(DataFrame.unionByName, found), k)


def _dense_scorer(shared):
    def scores(vectors) -> np.ndarray:
        x = vectors.flatten().to_numpy().reshape(len(vectors), -1)
        return x @ shared.value.T if len(shared.value) else np.empty((len(vectors), 0))

    return scores


def rrf_fuse(lexical: DataFrame, dense: DataFrame, k: int = 20, rrf_k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion.  Ties: lexical rank, then dense rank."""
    both = lexical.select("question_id", "chunk_id", F.col("rank").alias("lexical_rank"), F.lit(None).cast("int").alias("dense_rank")).unionByName(
        dense.select("question_id", "chunk_id", F.lit(None).cast("int").alias("lexical_rank"), F.col("rank").alias("dense_rank")))
    part = lambda c: F.coalesce(F.try_divide(F.lit(1.0), F.lit(rrf_k) + F.max(c)), F.lit(0.0))
    fused = both.groupBy("question_id", "chunk_id").agg(
        (part("lexical_rank") + part("dense_rank")).alias("score"), F.max("lexical_rank").alias("lexical_rank"), F.max("dense_rank").alias("dense_rank"))
    best = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("lexical_rank").asc_nulls_last(), F.col("dense_rank").asc_nulls_last())
    return fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hybrid_topk(chunks: DataFrame, queries: DataFrame, k: int = 20, rrf_k: int = 60) -> DataFrame:
    """Fusion over a pool of max(2k, 50) from either side."""
    pool = max(2 * k, 50)
    return rrf_fuse(bm25_topk(chunks, queries, pool), dense_topk(chunks, queries, pool), k, rrf_k)


def lexical_overlap(question: str, text: str) -> float:
    """Share of the question's distinct tokens in the text: the stand-in for a cross-encoder."""
    import re

    q = set(re.findall("[a-z0-9]+", (question or "").lower()))
    return len(q & set(re.findall("[a-z0-9]+", (text or "").lower()))) / len(q) if q else 0.0


def rerank(hits: DataFrame, scorer: Callable[[str, str], float] = lexical_overlap) -> DataFrame:
    """``hits`` (with question and text) in the order of the scorer; equal scores keep their order."""

    @F.pandas_udf("double")
    def scored(question: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([float(scorer(q, t)) for q, t in zip(question, text, strict=True)], dtype="float64")

    again = Window.partitionBy("question_id").orderBy(F.col("__s").desc(), F.col("rank"))
    return hits.withColumn("__s", scored("question", "text")).withColumn("rank", F.row_number().over(again)).withColumn(
        "score", F.col("__s")).drop("__s")


def superseded_ids(versions: DataFrame, register: DataFrame) -> DataFrame:
    """Old ids of which both ends are registered; chains are not followed."""
    known = register.select("doc_id").distinct()
    return (versions.join(known.select(F.col("doc_id").alias("old_id")), "old_id", "left_semi")
            .join(known.select(F.col("doc_id").alias("new_id")), "new_id", "left_semi").select("old_id").distinct())


def narrow(hits: DataFrame, k: int, trusted: DataFrame | None = None, superseded: DataFrame | None = None) -> DataFrame:
    """The first k hits after the filters, which thereby fill up from below."""
    if trusted is not None:
        hits = hits.join(trusted.select("doc_id").distinct(), "doc_id", "left_semi")
    if superseded is not None:
        hits = hits.join(superseded.select(F.col("old_id").alias("doc_id")).distinct(), "doc_id", "left_anti")
    again = Window.partitionBy("question_id").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)


def retrieve_context(chunks: DataFrame, queries: DataFrame, config, trusted: DataFrame | None = None, superseded: DataFrame | None = None) -> DataFrame:
    """Retrieval as a configuration asks for it: retrieve, rerank, filter, narrow."""
    if config.require_provenance and trusted is None:
        raise ValueError("this configuration needs the set of trusted documents")
    if config.exclude_superseded and superseded is None:
        raise ValueError("this configuration needs the set of superseded documents")
    k = config.top_k_retrieve
    hits = hybrid_topk(chunks, queries, k, config.rrf_k) if config.retrieval == "hybrid" else dense_topk(chunks, queries, k)
    hits = hits.select("question_id", "chunk_id", "score", "rank").join(chunks.select("chunk_id", "doc_id", "text", "cite_label"), "chunk_id")
    if config.rerank:
        hits = rerank(hits.join(queries.select("question_id", "question"), "question_id")).drop("question")
    return narrow(hits, config.top_k_context, trusted if config.require_provenance else None, superseded if config.exclude_superseded else None)


def snippets(hits: DataFrame, k: int = 8, width: int = 200) -> DataFrame:
    """First k hits with a one-line snippet, for reviewing whether an answer is unique."""
    return hits.where(F.col("rank") <= k).select("question_id", "rank", "chunk_id", F.substring(F.translate("text", "\n", " "), 1, width).alias("snippet"))


# ---- embedding ----

def hashing_embedding(text: str | None, dims: int = 64) -> list[float]:
    """Deterministic local stand-in for an embedding model: signed hashed tokens, unit length."""
    import re
    import zlib

    v = np.zeros(dims)
    for token in re.findall("[a-z0-9]+", (text or "").lower()):
        h = zlib.crc32(token.encode())
        v[h % dims] += 1.0 if h >> 31 else -1.0
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).tolist()


def embed(rows: DataFrame, text_col: str = "text", embedder: Callable[[str], list[float]] = hashing_embedding) -> DataFrame:
    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return texts.map(embedder)

    return rows.withColumn("embedding", vectors(text_col))
