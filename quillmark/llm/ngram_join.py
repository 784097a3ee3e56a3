"""N-gram Jaccard self-join of documents by MinHash banding.

1. Every document becomes a set of 64-bit hashes of word n-grams and a MinHash
   signature.  Documents with equal sets form a *class*; only one representative per
   class goes on, so thousands of copies cost one row.
2. Representatives are shuffled on band hashes.  A bucket's members are tested
   against its smallest one by their whole signatures; members that fail are tested
   against all others of the bucket, block by block.  Pairs whose signatures agree
   too little to reach the threshold end here, so buckets that meet by chance or over
   common passages join nothing.  What is left are edges, linear in the bucket.
3. The connected components of these edges say which sets are verified together.
   All pairs of a component are verified on their full n-gram sets, by blocked
   products of incidence matrices inside tasks: pairs are counted, never emitted.
   Blocks are bounded in rows and in n-grams, and components larger than a block are
   split into pairs of blocks, so no task holds more than two blocks.
4. Verified links give link counts, and their components the groups.

Bands and rows are chosen from the threshold and the target recall; so is the least
agreement of signatures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.components import components
from quillmark.llm.shared import carried, lean, materialize, parts_for, restored, split_join

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 80
#: Representatives and n-grams in a block.
BLOCK = 2048
BLOCK_GRAMS = 1 << 22


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, thus the fewest false candidates, that
    reach ``recall`` at ``threshold`` with at most ``max_hashes`` hashes."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("too few hashes for this recall")


def least_agreement(hashes: int, threshold: float = THRESHOLD, miss: float = 1e-5) -> int:
    """The most equal hashes that all but ``miss`` of the pairs of similarity ``threshold`` reach."""
    below = 0.0
    for equal in range(hashes + 1):
        below += math.comb(hashes, equal) * threshold**equal * (1 - threshold) ** (hashes - equal)
        if below > miss:
            return equal
    return hashes


def shingles(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams.

    Words are runs of anything but ASCII white space.  A text of fewer than n words
    has one n-gram, all its words; a text without words has none.
    """
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def set_digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


class Signer:
    def __init__(self, hashes: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(1, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = rng.integers(0, 2**63, hashes, dtype=np.uint64)

    def signature(self, grams: np.ndarray) -> np.ndarray:
        """The low halves of the MinHashes; none for the empty set."""
        if not grams.size:
            return np.empty(0, np.int32)
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), 4096):
            part = grams[at : at + 4096, None] * self.factors + self.offsets
            np.minimum(least, (part ^ (part >> np.uint64(31))).min(axis=0), out=least)
        return least.astype(np.uint32).view(np.int32)


def document_features(docs: DataFrame, hashes: int, ngram: int = NGRAM) -> DataFrame:
    """``doc_id, text_key, digest, n_grams, signature``; the digest is that of the whole n-gram set."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(hashes)
        for batch in batches:
            digests, sizes, signatures = [], [], []
            for text in batch.column(2):
                grams = shingles(text.as_py(), ngram)
                digests.append(set_digest(grams))
                sizes.append(len(grams))
                signatures.append(signer.signature(grams))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(signatures, pa.list_(pa.int32()))],
                names=["doc_id", "text_key", "digest", "n_grams", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), "text").mapInArrow(
        lean(features), "doc_id long, text_key binary, digest binary, n_grams long, signature array<int>")


def text_key():
    """A digest of the text; null and empty texts differ."""
    return F.unhex(F.md5(F.concat(F.lit("="), "text"))).alias("text_key")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(sets: list[np.ndarray], threshold: float, left: np.ndarray | None = None, columns: int = 4096):
    """Index pairs (i, j) with i < j whose sets' Jaccard similarity reaches the threshold.

    With ``left`` (a mask) only pairs of one masked and one unmasked set are
    compared.  Products of 0/1 incidence matrices, a block of n-grams at a time,
    give the exact sizes of all intersections.
    """
    sizes = np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    _, gram, uses = np.unique(flat, return_inverse=True, return_counts=True)
    shared = uses > 1  # others are in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[gram]
    owner, gram = owner[keep], number[gram[keep]]
    rows, cols = (np.arange(len(sets)),) * 2 if left is None else (np.flatnonzero(left), np.flatnonzero(~left))
    common = np.zeros((len(rows), len(cols)), np.float64)
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    for at in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(gram, [at, at + columns])
        block = np.zeros((len(sets), columns), np.float32)
        block[owner[lo:hi], gram[lo:hi] - at] = 1
        block = block[:, : max(1, int(gram[hi - 1]) - at + 1)]
        common += block[rows] @ block[cols].T
    union = sizes[rows][:, None] + sizes[cols][None, :] - common
    i, j = np.nonzero((common >= threshold * union - 1e-9) & (common > 0))
    i, j = rows[i], cols[j]
    if left is None:
        ahead = i < j
        return i[ahead], j[ahead]
    return i, j


def _bucket_edges(least: int, step: int = 256):
    """Edges of the pairs of a bucket, one of them failed against the hub, whose signatures agree enough."""

    def edges(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby("band", sort=False):
            part = part.sort_values("node")
            nodes, blocks = part["node"].to_numpy(np.int64), part["block"].to_numpy()
            signatures = np.array(part["signature"].tolist(), np.int32)
            failed = np.flatnonzero(part["failed"])
            split = part["lo"].iloc[0] != part["hi"].iloc[0]
            a, b = [], []
            for at in range(0, len(failed), step):
                mine = failed[at : at + step]
                equal = np.zeros((len(mine), len(nodes)), np.int16)
                for column in range(signatures.shape[1]):
                    equal += signatures[mine, column][:, None] == signatures[:, column]
                i, j = np.nonzero(equal >= least)
                i = mine[i]
                ok = (i != j) & (blocks[i] != blocks[j] if split else True)
                a.append(np.minimum(i, j)[ok])
                b.append(np.maximum(i, j)[ok])
            roots = _roots(len(nodes), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(nodes))
            moved = np.flatnonzero(roots != np.arange(len(nodes)))
            out.append(pd.DataFrame({"u": nodes[moved], "v": nodes[roots[moved]]}))
        return pd.concat(out)

    return edges


def candidate_edges(reps: DataFrame, bands: int, rows: int, least: int, block: int = 2 * BLOCK) -> DataFrame:
    """``u, v`` that connect every pair of ``reps`` (node, signature) which shares a band and agrees in ``least`` hashes.

    Signatures travel with distinct pairs of member and hub only, and with the members of
    the buckets in which some member failed; a bucket of these larger than ``block`` is
    split into pairs of blocks.
    """
    spark = reps.sparkSession
    hashes = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("signature", b * rows + 1, rows)))
    members = reps.where(F.size("signature") > 0).select("node", F.explode(hashes).alias("band"))
    hubs = members.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(members.join(hubs, "band").where("node <> hub"), "ngram-buckets")
    signature = reps.select(F.col("node").alias("of"), "signature")
    agree = F.aggregate(F.zip_with("signature", "theirs", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    pairs = (
        shared.select("node", "hub").distinct().join(signature, F.col("node") == F.col("of")).drop("of")
        .join(signature.withColumnRenamed("signature", "theirs"), F.col("hub") == F.col("of"))
        .select("node", "hub", (agree >= least).alias("passed"))
    )
    pairs = materialize(pairs, "ngram-stars")
    # Buckets with a member that failed: all their members but the hub, which has been compared.
    tested = shared.join(pairs, ["node", "hub"]).select("band", "node", (~F.col("passed")).alias("failed"))
    open_bands = tested.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.bool_or("failed").alias("open")).where("open and size > 1")
    again = materialize(tested.join(open_bands.select("band", "size"), "band"), "ngram-open")
    blocks = F.ceil(F.col("size") / block).cast("int")
    laid = again.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    laid = laid.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    parts = parts_for(again.count(), block, spark)
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("band"), F.lit(parts))).otherwise(F.xxhash64("band", lo, hi))
    dealt = laid.select("band", "node", "failed", "block", lo.alias("lo"), hi.alias("hi"), task.alias("task"), (F.col("blocks") > 1).alias("split"))
    compared = dealt.join(signature, F.col("node") == F.col("of")).drop("of").groupBy("split", "task").applyInPandas(
        _bucket_edges(least), "u long, v long")
    return pairs.where("passed").select(F.col("node").alias("u"), F.col("hub").alias("v")).unionByName(compared)


_LINKS = "node long, hub long, links long"


def _verifier(threshold: float, ngram: int):
    def verify(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby("root", sort=False):
            part = part.sort_values("node")
            sets, at = [], []
            for r, (text, digest) in enumerate(zip(part["text"], part["digest"], strict=True)):
                grams = shingles(text, ngram)
                if set_digest(grams) == bytes(digest):  # a repeated id may bring another text along
                    sets.append(grams)
                    at.append(r)
            part = part.iloc[at]
            once = ~part["node"].duplicated().to_numpy()
            part, sets = part[once], [s for s, o in zip(sets, once, strict=True) if o]
            if len(part) < 2:
                continue
            lo, hi = part["lo"].iloc[0], part["hi"].iloc[0]
            i, j = linked(sets, threshold, None if lo == hi else (part["block"] == lo).to_numpy())
            if not len(i):
                continue
            weight, nodes = part["copies"].to_numpy(np.int64), part["node"].to_numpy(np.int64)
            links = np.bincount(i, weight[j], len(nodes)) + np.bincount(j, weight[i], len(nodes))
            roots = _roots(len(nodes), i, j)
            some = np.flatnonzero(links)
            out.append(pd.DataFrame({"node": nodes[some], "hub": nodes[roots[some]], "links": links[some].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "hub": [], "links": []}, dtype="int64")

    return verify


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, ngram: int = NGRAM, recall: float = RECALL, **blocks) -> DataFrame:
    """Links of similarity ``threshold`` or more between the texts of ``docs``.

    Returns one row per row of ``docs``: ``doc_id, class_id, n_copies, n_links,
    group_id, kept``.  ``class_id`` is the smallest doc_id with the same n-gram
    set and ``n_copies`` the size of that class; ``n_links`` counts the other rows
    linked directly, copies included; ``group_id`` is the smallest doc_id
    reachable over links and ``kept`` marks its row.

    Null, empty and white-space texts have no n-grams; they form one class, equal
    but linked to nothing else.  Texts are compared whole.  Rows that repeat a
    doc_id stay rows of their own.  Null ids are never smallest unless alone.  An
    empty table gives an empty table.  Only doc_id and text are read; other columns,
    whatever their names, are ignored.
    """
    features, classes = _classes(docs, threshold, ngram, recall, **blocks)
    small = classes.withColumnRenamed("digest", "of").withColumn("uses", F.col("n_copies"))
    return split_join(features.select("doc_id", "digest"), "digest", small, "doc_id").select(
        "doc_id", "class_id", "n_copies", (F.col("links") + F.col("n_copies") - 1).alias("n_links"), "group_id",
        F.col("doc_id").eqNullSafe(F.col("group_id")).alias("kept"))


def _classes(
    docs: DataFrame, threshold: float, ngram: int, recall: float, block: int = BLOCK, block_grams: int = BLOCK_GRAMS,
) -> tuple[DataFrame, DataFrame]:
    """The rows' features, and ``digest, class_id, n_copies, links, root, group_id`` of every class."""
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall)
    features = materialize(document_features(docs, bands * rows, ngram), "ngram-features")
    # Nodes are numbered once, in the written table.
    reps = materialize(features.groupBy("digest").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n_grams").alias("n_grams"),
        F.first("signature").alias("signature")).withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    edges = candidate_edges(reps.select("node", "signature"), bands, rows, least_agreement(bands * rows, threshold))
    placed = components(edges).withColumnRenamed("node", "member")
    placed = materialize(reps.join(placed, F.col("node") == F.col("member")).select(
        "node", "root", "digest", "class_id", F.col("n_copies").alias("copies"), "n_grams"), "ngram-candidates")

    size = F.greatest(F.count(F.lit(1)) / block, F.sum("n_grams") / block_grams)
    sizes = placed.groupBy(F.col("root").alias("of")).agg(F.ceil(size).cast("int").alias("blocks"))
    total = placed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n_grams"), F.lit(0)).alias("grams")).first()
    parts = max(parts_for(total["rows"], block // 2, spark), math.ceil(total["grams"] / (block_grams // 2)))
    chosen = placed.join(sizes, F.col("root") == F.col("of")).drop("of").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    # Joined by shuffling at any size, so that small inputs foretell what large ones cost.
    with_text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        chosen.hint("merge"), F.col("doc_id").eqNullSafe(F.col("class_id")))
    dealt = with_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "root", "digest", "copies", "text", "block",
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(parts)))
        .otherwise(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))).alias("task"),
        (F.col("blocks") > 1).alias("split"))
    found = materialize(
        dealt.groupBy("split", "task").applyInPandas(_verifier(threshold, ngram), _LINKS), "ngram-links")

    counts = found.groupBy(F.col("node").alias("linked")).agg(F.sum("links").alias("links"))
    stars = components(found.select(F.col("node").alias("u"), F.col("hub").alias("v"))).select(
        F.col("node").alias("member"), "root")
    classes = (
        reps.select("node", "digest", "class_id", "n_copies")
        .join(counts, F.col("node") == F.col("linked"), "left").join(stars, F.col("node") == F.col("member"), "left")
        .select("digest", "class_id", "n_copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    )
    classes = materialize(classes, "ngram-groups")
    groups = classes.groupBy(F.col("root").alias("of")).agg(F.min("class_id").alias("group_id"), F.count(F.lit(1)).alias("uses"))
    found = split_join(classes, "root", groups, "digest").select("digest", "class_id", "n_copies", "links", "root", "group_id")
    return features, materialize(found, "ngram-result")


def one_per_group(docs: DataFrame, threshold: float = THRESHOLD, ngram: int = NGRAM, recall: float = RECALL, **blocks) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does.

    The row of the group's smallest doc_id stays, with all its columns.  Where rows
    repeat that id within the group, the one with the smallest digest of the text
    stays, and of rows equal in id and text any one.  Rows of one id whose texts are
    in different groups are judged each by its own.  Null, empty and white-space
    texts are one group.  A group of null ids only keeps one row.  Columns may have
    any names.  An empty table gives an empty table.
    """
    features, classes = _classes(docs, threshold, ngram, recall, **blocks)
    key = F.coalesce("text_key", F.lit(b""))
    best = (
        split_join(features, "digest", classes.select(F.col("digest").alias("of"), F.col("n_copies").alias("uses"), "root", "group_id"), "doc_id")
        .where(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy("root", "doc_id", key.alias("kept_key")).agg(F.count(F.lit(1)).alias("times"))
        .groupBy("root", "doc_id").agg(F.min(F.struct("kept_key", "times")).alias("best"))
        .select(F.col("doc_id").alias("kept_id"), "best.kept_key", "best.times")
    )
    best = materialize(best, "ngram-kept")
    rows = carried(docs, id=F.col("doc_id").cast("long"), key=F.coalesce(text_key(), F.lit(b"")))
    rows = rows.join(best, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    once = rows.where("times = 1").unionByName(rows.where("times > 1").dropDuplicates(["id", "key"]))
    return restored(once)
