"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

The reference-count table holds, for every distinct line key, the number of
documents that contain it.  Documents are inserted by adding their keys' counts
and deleted by subtracting them, so a deletion leaves exactly the state that
never had the document.  Keys whose count reaches the threshold are *blocked*;
they live in cuckoo filters, one per shard of the key space, which can drop a
key again when deletions take its count below the threshold.

Cleaning is the same at every size.  The distinct keys of each document are dealt
to their shards, each task with one shard's filter in memory.  Most keys end there;
what the filter lets through, blocked keys and a few others, is looked up in the
exact table, so the result is exact for any document, indexed or not.  Blocked keys
return to their documents by a join on a digest of document and text.  Keys so
common that they would make a shard uneven, at most ``HEAVY`` whatever the
input, are told to all tasks beforehand and dealt to no shard.

Keys are 128-bit xxh3 digests of the stripped, ASCII-lower-cased line; two keys
of a corpus of 1e12 lines agree by chance with probability below 1e-14.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.shared import carried, lean, materialize, restored, text_bytes

_FLUSH = 200_000
#: Keys with more than this share of all occurrences are told to every task; there are at most so many.
HEAVY = 20_000
#: Blocked keys in a filter, and keys probed against it, that a shard is meant for.
KEYS_PER_SHARD, PROBES_PER_SHARD = 1 << 16, 1 << 22


def line_key(line: bytes) -> bytes:
    """bytes.strip and bytes.lower know ASCII white space and letters only."""
    return line.strip().lower()


class CuckooFilter:
    """Buckets of four 32-bit fingerprints; each key has two possible buckets."""

    SLOTS = 4

    def __init__(self, buckets: int, table: np.ndarray | None = None) -> None:
        self.buckets = buckets
        self.table = np.zeros((buckets, self.SLOTS), np.uint32) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / (cls.SLOTS * 0.8))))))

    @staticmethod
    def _mix(fingerprint):
        """Spread a 32-bit fingerprint over the bucket numbers; the product fits 64 bits."""
        return (np.uint64(fingerprint) * np.uint64(0x9E3779B1)) >> np.uint64(16)

    def places(self, h1: np.ndarray, h2: np.ndarray):
        """Fingerprint and both buckets of each key, from its two 64-bit halves."""
        mask = np.uint64(self.buckets - 1)
        fingerprint = (h2.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        fingerprint[fingerprint == 0] = 1
        # The shard comes from h1's low bits, the bucket from its high ones.
        one = (h1.view(np.uint64) >> np.uint64(32)) & mask
        return fingerprint, one, one ^ (self._mix(fingerprint) & mask)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        fingerprint, one, two = self.places(h1, h2)
        f = fingerprint[:, None]
        return (self.table[one] == f).any(axis=1) | (self.table[two] == f).any(axis=1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if some key found no place; the filter must then be rebuilt larger."""
        mask, rng = self.buckets - 1, np.random.default_rng(7)
        for f, one, two in zip(*(x.tolist() for x in self.places(h1, h2)), strict=True):
            at, carried = one, f
            for kick in range(500):
                free = np.flatnonzero(self.table[at] == 0)
                if not free.size and not kick:
                    at = two
                    free = np.flatnonzero(self.table[at] == 0)
                if free.size:
                    self.table[at, free[0]] = carried
                    break
                slot = int(rng.integers(self.SLOTS))
                carried, self.table[at, slot] = int(self.table[at, slot]), carried
                at ^= int(self._mix(np.uint32(carried))) & mask
            else:
                return False
        return True

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for f, one, two in zip(*(x.tolist() for x in self.places(h1, h2)), strict=True):
            for at in (one, two):
                slot = np.flatnonzero(self.table[at] == f)
                if slot.size:
                    self.table[at, slot[0]] = 0
                    break


def _halves(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)


def _key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per key, summed over what the task has read."""
    found: dict[bytes, int] = {}

    def flush() -> pa.RecordBatch:
        halves = _halves(found)
        return pa.RecordBatch.from_arrays(
            [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(list(found.values()), pa.int64())],
            names=["h1", "h2", "n_docs"],
        )

    for batch in batches:
        for text in batch.column(0):
            keys = {line_key(x) for x in text.as_py().split(b"\n")}
            keys.discard(b"")
            for key in keys:
                digest = xxhash.xxh3_128_digest(key)
                found[digest] = found.get(digest, 0) + 1
            if len(found) >= _FLUSH:
                yield flush()
                found.clear()
    if found:
        yield flush()


def count_keys(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``h1, h2, n_docs`` of every non-empty line key in ``docs``."""
    lines = docs.select(text_bytes(text_col).alias("text")).mapInArrow(lean(_key_counts), "h1 long, h2 long, n_docs long")
    return lines.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))


def _build_filter(key, rows):
    h1, h2 = rows["h1"].to_numpy(np.int64), rows["h2"].to_numpy(np.int64)
    made = CuckooFilter.sized(len(rows))
    while not made.insert(h1, h2):
        made = CuckooFilter(made.buckets * 2)
    return pd.DataFrame({"shard": [key[0]], "buckets": [made.buckets], "cells": [made.table.tobytes()]})


def _update_filter(key, filters, changes):
    """Apply one shard's changes.  A filter that is full comes back without cells, to be rebuilt."""
    if not len(changes):
        return filters[["shard", "buckets", "cells"]]
    if len(filters):
        cells = np.frombuffer(filters["cells"].iloc[0], np.uint32).copy().reshape(-1, CuckooFilter.SLOTS)
        made = CuckooFilter(int(filters["buckets"].iloc[0]), cells)
    else:
        made = CuckooFilter.sized(len(changes))
    risen = changes["risen"].astype(bool)
    gone, new = changes[~risen], changes[risen]
    made.delete(gone["h1"].to_numpy(np.int64), gone["h2"].to_numpy(np.int64))
    fits = made.insert(new["h1"].to_numpy(np.int64), new["h2"].to_numpy(np.int64))
    return pd.DataFrame({"shard": [key[0]], "buckets": [made.buckets], "cells": [made.table.tobytes() if fits else b""]})


_FILTER_SCHEMA = "shard long, buckets long, cells binary"


def _document_keys(heavy):
    """``k1, k2, h1, h2``: a document and one of its distinct line keys."""

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = heavy.value
        for batch in batches:
            at, digests = [], []
            for r, text in enumerate(batch.column(2)):
                own = {xxhash.xxh3_128_digest(k) for k in {line_key(x) for x in text.as_py().split(b"\n")} if k} - common
                at += [r] * len(own)
                digests += own
            halves, at = _halves(digests), np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                names=["k1", "k2", "h1", "h2"])

    return keys_of


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that their shard's filter lets through; a shard's filter comes before its keys."""
    shard, made = None, None
    for batch in batches:
        shards, is_key = batch.column("shard").to_numpy(), batch.column("is_key").to_numpy()
        cuts = (np.flatnonzero((np.diff(shards) != 0) | (np.diff(is_key) != 0)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if lo == hi:
                continue
            if not is_key[lo]:
                cells = batch.column("cells")[lo].as_py()
                shard, made = shards[lo], CuckooFilter(
                    batch.column("buckets")[lo].as_py(), np.frombuffer(cells, np.uint32).reshape(-1, CuckooFilter.SLOTS))
            elif shards[lo] == shard:
                part = batch.slice(lo, hi - lo).select(["k1", "k2", "h1", "h2"])
                yield part.filter(pa.array(made.contains(part.column("h1").to_numpy(), part.column("h2").to_numpy())))


def _cleaner(heavy):
    @F.pandas_udf("n_lines long, n_dropped long, kept string")
    def cleaned(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
        rows, common = [], heavy.value
        for text, found in zip(texts, hits, strict=True):
            lines = bytes(text).split(b"\n")
            keys = [line_key(x) for x in lines]
            raw = b"" if found is None else np.asarray(found, "<i8").tobytes()
            own = {raw[i : i + 16] for i in range(0, len(raw), 16)}
            digests = {k: xxhash.xxh3_128_digest(k) for k in keys if k} if own or common else {}
            blocked = {k for k, d in digests.items() if d in own or d in common}
            kept = [x for x, k in zip(lines, keys, strict=True) if k not in blocked]
            rows.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])

    return cleaned


@dataclass(frozen=True)
class LineIndex:
    """State of the dedup.  Every method returns a new state; old ones stay valid.

    ``levels`` are tables of counts whose sum is the exact table: increments are added as
    tables of their own and merged into one when together they reach half of the first.
    """

    levels: tuple[DataFrame, ...]
    rows: tuple[int, ...]
    filters: DataFrame
    shards: int
    min_docs: int
    blocked: int
    per_shard: int = KEYS_PER_SHARD

    @property
    def counts(self) -> DataFrame:
        """``h1, h2, n_docs`` of every key that some document of the index holds."""
        if len(self.levels) == 1:
            return self.levels[0]
        return reduce(DataFrame.unionByName, self.levels).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")).where("n_docs > 0")

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, text_col: str = "text", keys_per_shard: int = KEYS_PER_SHARD) -> LineIndex:
        """Index of all of ``docs``.  ``shards`` follows the numbers of blocked keys and of all occurrences."""
        return cls._of(materialize(count_keys(docs, text_col), "line-counts"), min_docs, keys_per_shard)

    @classmethod
    def _of(cls, counts: DataFrame, min_docs: int, per_shard: int) -> LineIndex:
        blocked = F.col("n_docs") >= min_docs
        found = counts.agg(F.count(F.lit(1)).alias("n"), F.count_if(blocked).alias("blocked"), F.sum("n_docs").alias("all")).first()
        needed = max(16, found["blocked"] / per_shard, (found["all"] or 0) / PROBES_PER_SHARD)
        shards = 1 << math.ceil(math.log2(needed))
        filters = (
            counts.where(blocked).select("h1", "h2", F.col("h1").bitwiseAND(F.lit(shards - 1)).alias("shard"))
            .groupBy("shard").applyInPandas(_build_filter, _FILTER_SCHEMA)
        )
        return cls((counts,), (found["n"],), materialize(filters, "line-filters"), shards, min_docs, found["blocked"], per_shard)

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._change(count_keys(docs, text_col))

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Undo the insertion of ``docs``, which must be in the index with this text."""
        return self._change(count_keys(docs, text_col).withColumn("n_docs", -F.col("n_docs")))

    def _change(self, delta: DataFrame) -> LineIndex:
        delta = materialize(delta, "line-delta")
        before = reduce(DataFrame.unionByName, self.levels).join(delta.select("h1", "h2"), ["h1", "h2"], "left_semi")
        both = delta.select("h1", "h2", "n_docs", F.lit(0).cast("long").alias("old")).unionByName(
            before.select("h1", "h2", "n_docs", F.col("n_docs").alias("old")))
        m = self.min_docs
        merged = materialize(both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.sum("old").alias("old")), "line-change")
        found = merged.agg(
            F.count(F.lit(1)).alias("n"), F.min("n_docs").alias("least"),
            F.count_if(F.col("n_docs") >= m).alias("blocked"), F.count_if(F.col("old") >= m).alias("were")).first()
        if (found["least"] or 0) < 0:
            raise ValueError("a deleted document was not in the index")
        levels, rows = (*self.levels, delta), (*self.rows, found["n"])
        n_blocked = self.blocked + found["blocked"] - found["were"]
        if 2 * sum(rows[1:]) > rows[0] or n_blocked > 2 * self.shards * self.per_shard:
            merged_levels = LineIndex(levels, rows, self.filters, self.shards, m, n_blocked, self.per_shard).counts
            counts = materialize(merged_levels, "line-counts")
            if n_blocked > 2 * self.shards * self.per_shard:
                return self._of(counts, m, self.per_shard)  # into more shards
            levels, rows = (counts,), (counts.count(),)
        shard = F.col("h1").bitwiseAND(F.lit(self.shards - 1)).alias("shard")
        changed = merged.where((F.col("n_docs") >= m) != (F.col("old") >= m)).select("h1", "h2", shard, (F.col("n_docs") >= m).alias("risen"))
        filters = materialize(
            self.filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInPandas(_update_filter, _FILTER_SCHEMA), "line-filters")
        state = LineIndex(levels, rows, filters, self.shards, m, n_blocked, self.per_shard)
        full = filters.where(F.length("cells") == 0).select("shard")
        if full.limit(1).count():
            again = state.counts.where(F.col("n_docs") >= m).select("h1", "h2", shard).join(full, "shard", "left_semi").groupBy(
                "shard").applyInPandas(_build_filter, _FILTER_SCHEMA)
            filters = materialize(filters.where(F.length("cells") > 0).unionByName(again), "line-filters")
            state = replace(state, filters=filters)
        return state

    def clean(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``row`` (all columns of ``docs`` as one struct), ``n_lines, n_dropped, kept`` (the text without blocked lines).

        Exact for any document.  A null text counts as one empty line.
        """
        spark, counts = docs.sparkSession, self.counts
        all_uses = counts.agg(F.sum("n_docs")).first()[0] or 0
        limit = max(self.min_docs - 1, all_uses // HEAVY)
        common = counts.where(F.col("n_docs") > limit).where(F.col("n_docs") >= self.min_docs) if all_uses // HEAVY >= self.min_docs else None
        heavy = common.select("h1", "h2").toArrow() if common is not None else None
        known = set()
        if heavy is not None and heavy.num_rows:
            raw = np.stack([heavy.column(i).to_numpy() for i in (0, 1)], axis=1).astype("<i8").tobytes()
            known = {raw[i : i + 16] for i in range(0, len(raw), 16)}
        known = spark.sparkContext.broadcast(known)

        by = ["doc_id", text_col] if "doc_id" in docs.columns else [text_col]
        keyed = carried(docs, k1=F.xxhash64(F.lit(1), *by), k2=F.xxhash64(F.lit(2), *by), body=text_bytes(text_col))
        shard = F.col("h1").bitwiseAND(F.lit(self.shards - 1)).alias("shard")
        probes = keyed.select("k1", "k2", "body").mapInArrow(lean(_document_keys(known)), "k1 long, k2 long, h1 long, h2 long").select(
            shard, F.lit(1).alias("is_key"), "k1", "k2", "h1", "h2")
        dealt = self.filters.withColumn("is_key", F.lit(0)).unionByName(probes, allowMissingColumns=True)
        passed = dealt.repartition(self.shards, "shard").sortWithinPartitions("shard", "is_key").mapInArrow(
            lean(_probe), "k1 long, k2 long, h1 long, h2 long")
        blocked = counts.where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
        hits = passed.join(blocked, ["h1", "h2"], "left_semi").groupBy(F.col("k1").alias("hit_1"), F.col("k2").alias("hit_2")).agg(
            F.flatten(F.collect_list(F.array("h1", "h2"))).alias("hits"))
        joined = keyed.join(hits, (F.col("k1") == F.col("hit_1")) & (F.col("k2") == F.col("hit_2")), "left")
        return joined.select("row", _cleaner(known)("body", "hits").alias("clean")).select(
            "row", "clean.n_lines", "clean.n_dropped", "clean.kept")


def dedup_lines(docs: DataFrame, min_docs: int = 10, text_col: str = "text", keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """Build the index over ``docs`` and clean ``docs`` with it; columns as ``LineIndex.clean`` gives.

    A key is a line without ASCII white space at its ends and with A-Z lower-cased.
    Keys of one code point or more that ``min_docs`` rows or more contain lose all
    their lines.  Rows that repeat a document count as documents of their own.  A
    null or empty text is one empty line, which stays.  Texts are split whole,
    however long.  Columns may have any names.  An empty table gives an empty table.
    """
    return LineIndex.build(docs, min_docs, text_col, keys_per_shard).clean(docs, text_col)


def with_kept_lines(docs: DataFrame, cleaned: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with the cleaned text, and its length in ``n_chars`` if there is that column."""
    new = {text_col: F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return restored(cleaned, **{c: v for c, v in new.items() if c in docs.columns})


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
