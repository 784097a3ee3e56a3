"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside.

Exactly equal vectors of one label collapse into a class first, so thousands of
copies are one row.  Spherical k-means, trained on a bounded sample, gives every
class a home cell and further cells to be looked up in: those whose centroid is
nearly as close as the home's (``margin``), since a near-duplicate may have landed
there.  A cell with several times the intended rows is cut again by k-means on a
sample of its own, in a task of its own, so the number of cells follows the number of
classes although the first level has a bounded one.  Within a cell and label, products of blocks of unit vectors in double
precision find the pairs; they are counted where they are found, never emitted.
A pair that meets in two cells is counted in one of them.  Links become stars,
their connected components the groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.components import components
from quillmark.llm.shared import carried, lean, materialize, restored, split_join

THRESHOLD = 0.93
#: Parts that a cell of the first level may have.
_PARTS = 4096


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k unit centroids of the unit rows of ``x``; empty cells restart at the worst-served rows."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = x @ centroids.T
        home = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        empty = np.flatnonzero(np.bincount(home, minlength=k) == 0)
        if empty.size:
            sums[empty] = x[np.argsort(near.max(axis=1))[: empty.size]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors], np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _cell_links(threshold: float, step: int = 1024):
    def links(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cell, out = int(key[0]), []
        lo, hi = int(key[1]), int(key[2])
        for _, part in frame.groupby(["label", "dims"], sort=False):
            part = part.sort_values("node")
            if len(part) < 2:
                continue
            x = _unit(part["vector"])
            home = part["home"].to_numpy(np.int64)
            is_home = home == cell
            block = part["block"].to_numpy()
            homes, which = np.unique(home, return_inverse=True)
            position = {int(h): i for i, h in enumerate(homes)}
            sees = np.zeros((len(part), len(homes)), bool)  # row is also looked up in that home cell
            looked = [{int(c) for c in cells} for cells in part["cells"]]
            for r, cells in enumerate(looked):
                for c in cells:
                    if (p := position.get(c)) is not None:
                        sees[r, p] = True
            weight = part["copies"].to_numpy(np.int64)
            count = np.zeros(len(part), np.int64)
            edges_a, edges_b = [], []
            for at in range(0, len(part), step):
                i, j = np.nonzero(x[at : at + step] @ x.T >= threshold)
                i += at
                ok = i < j
                if lo != hi:
                    ok &= block[i] != block[j]
                i, j = i[ok], j[ok]
                # Pairs with both homes here belong here; a pair of two homes belongs to the
                # smaller one, if both rows are there.  Two guests belong here only if neither
                # is in the other's home and no smaller cell holds both.
                here = is_home[i] & is_home[j]
                one = is_home[i] ^ is_home[j]
                own, guest = np.where(is_home[i], i, j), np.where(is_home[i], j, i)
                guests = ~is_home[i] & ~is_home[j] & ~sees[i, which[j]] & ~sees[j, which[i]]
                for q in np.flatnonzero(guests):
                    guests[q] = cell == min(looked[i[q]] & looked[j[q]])
                ok = here | guests | (one & ((cell < home[guest]) | ~sees[own, which[guest]]))
                i, j = i[ok], j[ok]
                np.add.at(count, i, weight[j])
                np.add.at(count, j, weight[i])
                edges_a.append(i)
                edges_b.append(j)
            roots = _roots(len(part), np.concatenate(edges_a), np.concatenate(edges_b))
            nodes = part["node"].tolist()
            out += [(nodes[r], nodes[roots[r]], int(count[r])) for r in np.flatnonzero(count)]
        return pd.DataFrame(out, columns=["node", "hub", "links"])

    return links


def _trainer(seed: int):
    def train(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = _unit(frame["vector"])
        made = spherical_kmeans(x, min(int(frame["parts"].iloc[0]), len(x)), seed=seed)
        return pd.DataFrame({"cell": [int(key[0])], "k": [len(made)], "centroids": [made.ravel().tolist()]})

    return train


def _nearest(near: np.ndarray, margin: float, max_cells: int) -> tuple[np.ndarray, list[list[int]]]:
    """The closest centroid of each row, and the at most ``max_cells`` that are within ``margin`` of it."""
    home = near.argmax(axis=1)
    close = near >= near[np.arange(len(near)), home][:, None] - margin
    found = []
    for row, ok in zip(near, close, strict=True):
        at = np.flatnonzero(ok)
        found.append((at if len(at) <= max_cells else at[np.argsort(-row[at], kind="stable")[:max_cells]]).tolist())
    return home, found


def _leaf(cell, part=0):
    return cell * _PARTS + part


def _subdivided(margin: float, max_cells: int):
    """``node, home, leaves`` of rows in cells that are cut again; a cell's centroids come before its rows."""

    def subdivide(batches):
        cell, centroids = None, None
        for batch in batches:
            cells, is_row = batch.column("cell").to_numpy(), batch.column("is_row").to_numpy()
            cuts = (np.flatnonzero((np.diff(cells) != 0) | (np.diff(is_row) != 0)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                vectors = part.column("vector")
                if not is_row[lo]:
                    cell, flat = cells[lo], vectors[0].values.to_numpy()
                    centroids = flat.reshape(part.column("k")[0].as_py(), -1)
                    continue
                x, here = vectors.flatten().to_numpy().reshape(hi - lo, -1), int(cells[lo])
                home, found = np.zeros(hi - lo, np.int64), [[0]] * (hi - lo)
                if here == cell:  # otherwise no row of the cell was in the sample: it stays whole
                    home, found = _nearest(x / np.linalg.norm(x, axis=1, keepdims=True) @ centroids.T, margin, max_cells)
                of_home = part.column("home").to_numpy() == here
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(np.where(of_home, _leaf(here, home), 0), mask=~of_home),
                     pa.array([[_leaf(here, c) for c in f] for f in found], pa.list_(pa.int64()))],
                    names=["node", "home", "leaves"])

    return subdivide


def _subdivide(placed: DataFrame, cell_rows: int, sample_rows: int, margin: float, max_cells: int) -> DataFrame:
    """``placed`` with homes and cells numbered as leaves, large cells cut again."""
    spark = placed.sparkSession
    plain = placed.withColumn("home", _leaf(F.col("home"))).withColumn("cells", F.transform("cells", lambda c: _leaf(c)))
    sizes = placed.where("home >= 0").groupBy("home").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 4 * cell_rows).collect()
    if not sizes:
        return plain
    # One row per cell of the first level at most, which the sample bounds.
    parts = {r["home"]: min(math.ceil(r["size"] / cell_rows), sample_rows // 16, _PARTS) for r in sizes}
    large = F.broadcast(spark.createDataFrame(
        [(h, parts[h], min(1.0, 32 * parts[h] / n), math.ceil(n / (64 * cell_rows))) for h, n in ((r["home"], r["size"]) for r in sizes)],
        "large long, parts int, share double, tasks int"))
    sample = placed.join(large, F.col("home") == F.col("large")).where(
        F.pmod(F.xxhash64(F.lit("cells"), "node"), F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    trained = materialize(sample.select("home", "vector", "parts").groupBy("home").applyInPandas(
        _trainer(4), "cell long, k int, centroids array<double>"), "vector-centroids")
    looked = placed.select("node", "home", "vector", F.explode("cells").alias("cell")).join(large, F.col("cell") == F.col("large"))
    rows = looked.select("cell", F.pmod(F.xxhash64("node"), F.col("tasks").cast("long")).cast("int").alias("task"), F.lit(1).alias("is_row"),
                         "node", "home", F.lit(None).cast("int").alias("k"), "vector")
    centroids = trained.join(large, F.col("cell") == F.col("large")).select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("is_row"),
        F.lit(None).cast("string").alias("node"), F.lit(None).cast("long").alias("home"), "k", F.col("centroids").alias("vector"))
    dealt = rows.unionByName(centroids).repartition("cell", "task").sortWithinPartitions("cell", "task", "is_row")
    cut = dealt.mapInArrow(lean(_subdivided(margin, max_cells)), "node string, home long, leaves array<long>")
    small = placed.select("node", "home", F.explode("cells").alias("cell")).join(large, F.col("cell") == F.col("large"), "left_anti").select(
        "node", F.when(F.col("home") == F.col("cell"), _leaf(F.col("home"))).alias("home"), F.array(_leaf(F.col("cell"))).alias("leaves"))
    leaves = cut.unionByName(small).groupBy(F.col("node").alias("of")).agg(
        F.max("home").alias("home"), F.flatten(F.collect_list("leaves")).alias("cells"))
    return placed.drop("home", "cells").join(leaves, F.col("node") == F.col("of")).drop("of")


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, cell_rows: int = 1500, sample_rows: int = 32_768,
    margin: float = 0.12, max_cells: int = 24, block: int = 4096,
) -> DataFrame:
    """Links between vectors of equal label with cosine ``threshold`` or more.

    Input ``vec_id, embedding, label``; other columns are ignored.  Returns one row
    per input row: ``vec_id, n_links, component_id, kept``.

    A vector that is null, empty, all zero, or holds null or non-finite
    components, and one whose label is null, links with nothing.  Vectors of
    different lengths link with nothing of the other's length.  Copies of a vector
    link with each other.  Rows that repeat a vec_id each count as a vector.  An
    empty table gives an empty table.

    ``sample_rows`` bounds what a k-means is trained on (the classes of smallest
    hash); every class is then assigned.  The first level has up to ``sample_rows / 16``
    cells, each cut again if it holds four times ``cell_rows`` or more, so the cells of
    both levels follow the number of classes up to the square of that.  A class is
    looked up in at most ``max_cells`` cells of the first level and as many parts of
    each; recall is measured against brute force (README).  Cells larger than
    ``block`` are compared block by block, all pairs.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
        F.transform(e, lambda x: x.cast("double")).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(
        F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    node = F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(s), "label", "vector")) for s in (1, 2)])
    rows = rows.withColumn("node", F.when(usable, node))
    rows = materialize(rows, "vectors")
    classes = rows.where("node is not null").groupBy("node").agg(
        F.min("vec_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.first("label").cast("string").alias("label"),
        F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("dims", F.size("vector")), "vector-classes")

    n = classes.count()
    share = min(1.0, sample_rows / max(1, n))
    low_hash = F.pmod(F.xxhash64(F.lit("k-means"), "node"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = classes.where(low_hash | F.lit(share >= 1)).select("vector", "dims").toArrow()
    dims, train = 0, np.zeros((0, 0))
    if sample.num_rows:
        lengths, rows_of = np.unique(sample.column("dims").to_numpy(), return_counts=True)
        dims = int(lengths[rows_of.argmax()])
        own = sample.filter(pc.equal(sample.column("dims"), dims)).column("vector").combine_chunks()
        train = own.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        train = train / np.linalg.norm(train, axis=1, keepdims=True)
    k = max(1, min(math.ceil(n / cell_rows), len(train) // 16))
    centroids = spark.sparkContext.broadcast(spherical_kmeans(train, k) if len(train) else np.zeros((1, 1)))

    @F.pandas_udf("home long, cells array<long>")
    def assigned(vector: pd.Series, size: pd.Series) -> pd.DataFrame:
        homes, cells = [-1] * len(vector), [[-1]] * len(vector)
        at = np.flatnonzero(size.to_numpy() == dims)
        if at.size:
            home, found = _nearest(_unit(vector.iloc[at]) @ centroids.value.T, margin, max_cells)
            for r, h, f in zip(at.tolist(), home.tolist(), found, strict=True):
                homes[r], cells[r] = h, f
        return pd.DataFrame({"home": homes, "cells": cells})

    placed = materialize(
        classes.withColumn("at", assigned("vector", "dims")).select(
            "node", "label", "dims", "copies", "vector", "at.home", "at.cells"), "vector-cells")
    placed = _subdivide(placed, cell_rows, sample_rows, margin, max_cells)
    dealt = placed.select("*", F.explode("cells").alias("cell"))
    sizes = dealt.groupBy(F.col("cell").alias("of")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = dealt.join(sizes, F.col("cell") == F.col("of"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "node", "label", "dims", "copies", "vector", "home", "cells", "block", "cell",
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = materialize(
        dealt.groupBy("cell", "lo", "hi").applyInPandas(_cell_links(threshold), "node string, hub string, links long"),
        "vector-links")

    counts = found.groupBy(F.col("node").alias("linked")).agg(F.sum("links").alias("links"))
    stars = components(found.select(F.col("node").alias("u"), F.col("hub").alias("v"))).select(F.col("node").alias("member"), "root")
    whole = (
        classes.select(F.col("node").alias("class_node"), "rep_id", "copies")
        .join(counts, F.col("class_node") == F.col("linked"), "left").join(stars, F.col("class_node") == F.col("member"), "left")
        .withColumn("root", F.coalesce("root", "class_node"))
    )
    whole = materialize(whole, "vector-groups")
    groups = whole.groupBy(F.col("root").alias("of")).agg(F.min("rep_id").alias("component"), F.count(F.lit(1)).alias("uses"))
    whole = split_join(whole, "root", groups, "class_node").select(F.col("class_node").alias("of"), F.col("copies").alias("uses"), "copies", "links", "component")
    component = F.coalesce("component", "vec_id")
    return split_join(rows, "node", materialize(whole, "vector-components"), "vec_id").select(
        "vec_id",
        F.when(F.col("copies").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def one_per_group(vectors: DataFrame, **options) -> DataFrame:
    """The vectors that stay when each group keeps its representative; columns may have any names."""
    kept = near_duplicates(vectors, **options).where("kept").select(F.col("vec_id").alias("kept_id")).distinct()
    return restored(carried(vectors, id=F.col("vec_id").cast("long")).join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi"))
