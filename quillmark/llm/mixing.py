"""Mixing sources to target weights under a curriculum that changes with time.

Every source has a weight and a share of the mix.  Its weight schedule g(t) over
training time t in [0, 1] is linear with integral 1, so its cumulative token
demand is ``T * G(t)`` with ``G(t) = a*t + b*t*t/2``.  A source's documents,
in a fixed shuffled order, supply tokens 0..T; inverting the demand at the middle
of an occurrence's tokens gives the time at which it is consumed, and summing all
sources' demand up to that time gives its training position.  Occurrences are
then sorted by position with a range partitioning.

Prefix sums inside a source never put a source into one task: documents are
bucketed by the leading bits of their shuffle key, so offsets come from one small
row per (source, bucket) and running sums stay inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.shared import carried, materialize, parts_for, restored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Slope b of g(t) = 1 - b/2 + b*t for each weight: heavy sources fade, light ones rise.
SLOPES = {5: -0.8, 2: 0.0, 1: 0.8}
MAX_EPOCHS = 2
#: Documents that four buckets hold on average; running sums stay inside a bucket of a source.
_BUCKET_ROWS = 1_000_000


def word_count(column: str):
    """Number of maximal runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """Target words of each source: water-filling under the cap of ``max_epochs`` sizes.

    ``sized`` has ``source`` and ``size``.  Sources are taken by code point, null
    last.  Targets are ``min(cap, level * weight)`` with the level that makes them
    add up to ``share`` of all sizes, which is what resharing the excess by weight
    converges to.  Sources are ordered by ``cap / weight``; the first ones are
    full, and the level follows from what the full ones leave.  One row per
    source passes through these windows.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("__rank", rank).withColumn("weight", weight)
        .withColumn("__cap", F.col("source_size").cast("double") * max_epochs)
        .withColumn("__fills_at", F.col("__cap") / F.col("weight"))
    )
    every = Window.partitionBy()
    filling = Window.orderBy("__fills_at", "__rank").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("source_size").cast("double")).over(every) * share
    caps_before = F.coalesce(F.sum("__cap").over(filling), F.lit(0.0))
    weights_before = F.coalesce(F.sum("weight").over(filling), F.lit(0.0))
    level = (total - caps_before) / (F.sum("weight").over(every) - weights_before)
    levels = ranked.withColumn("__level", level)
    # the first source that does not fill up sets the level
    open_level = F.min(F.when(F.col("__level") <= F.col("__fills_at"), F.struct("__fills_at", "__rank", "__level"))).over(every)
    return levels.withColumn("__open", open_level).select(
        "source", "source_size", "weight",
        F.when(F.col("__open").isNull(), F.col("__cap"))
        .otherwise(F.least(F.col("__cap"), F.col("__open.__level") * F.col("weight"))).alias("target"),
    )


def mix(
    docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, slopes: dict[int, float] | None = None,
    seed: int = 17, carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often, and when in training, the mix reads each document.

    Returns ``doc_id, source, size, source_size, target, taken, occurrences`` and
    the columns of ``carry``.  ``occurrences`` is an array of ``(copy, words,
    time, position)``; ``taken`` is the sum of their words.

    A source passes over all its documents as often as its target allows; of the
    pass that the target ends, documents in shuffled order are taken until the
    target, the last one only in part, so each source meets its rounded target.
    The order is a hash of doc_id and text, so reruns agree whatever the
    partitioning.  Rows equal in both are interchangeable.

    Null sources form one source.  Null and empty texts have size 0 and are taken
    for 0 words with no occurrence.  A document longer than what is left of its
    source's target is cut there, like any other.  Extra columns are ignored.
    """
    slopes = SLOPES if slopes is None else slopes
    spark = docs.sparkSession
    keyed = docs.select(
        F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), word_count("text").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("__key"),
        # never null, so windows and joins share one partitioning
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__source"),
        *[F.col(c).alias(f"__carry_{i}") for i, c in enumerate(carry)],
    )
    sized = materialize(keyed, "mixing")
    buckets = 4 * parts_for(sized.count(), _BUCKET_ROWS, spark)
    bucket = F.floor((F.shiftrightunsigned("__key", 11).cast("double")) / float(1 << 53) * buckets).cast("int")
    # unsigned order of the key, which is the order of the buckets
    sized = sized.withColumn("__bucket", bucket).withColumn("__order", F.col("__key").bitwiseXOR(F.lit(-(1 << 63))))
    slope = F.coalesce(*[F.when(F.col("weight") == w, F.lit(float(b))) for w, b in slopes.items()], F.lit(0.0))
    targets = source_targets(sized, share, weights).withColumn("__b", slope).withColumn("__a", 1 - F.col("__b") / 2)
    every = Window.partitionBy()
    targets = (
        targets.withColumn("__sum_a", F.sum(F.col("target") * F.col("__a")).over(every))
        .withColumn("__sum_b", F.sum(F.col("target") * F.col("__b")).over(every))
    )
    earlier = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sized.groupBy("__source", "__bucket").agg(F.sum("size").alias("__in_bucket"))
        .withColumn("__before", F.coalesce(F.sum("__in_bucket").over(earlier), F.lit(0)))
    )
    targets = targets.withColumn("__source", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source", "weight")
    offsets = offsets.join(targets, "__source")
    inside = Window.partitionBy("__source", "__bucket").orderBy("__order", "doc_id", "size")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = sized.withColumn("__inside", running).join(offsets, ["__source", "__bucket"]).withColumn(
        "__prefix", F.col("__before") + F.col("__inside"))

    goal = F.round("target").cast("long")
    copies = F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))

    def occurrence(copy):
        start = copy * F.col("source_size") + F.col("__prefix")
        words = F.greatest(F.lit(0), F.least(F.col("size"), goal - start))
        middle = F.try_divide(start + words / 2, F.col("target"))
        a, b = F.col("__a"), F.col("__b")
        time = F.when(F.abs(b) < 1e-12, middle).otherwise((F.sqrt(F.greatest(a * a + 2 * b * middle, F.lit(0.0))) - a) / b)
        position = F.col("__sum_a") * time + F.col("__sum_b") * time * time / 2
        return F.struct(copy.cast("int").alias("copy"), words.cast("long").alias("words"), time.alias("time"), position.alias("position"))

    occurrences = F.filter(F.transform(copies, occurrence), lambda o: o["words"] > 0)
    return placed.withColumn("occurrences", occurrences).select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate("occurrences", F.lit(0).cast("long"), lambda s, o: s + o["words"]).alias("taken"),
        "occurrences", *[F.col(f"__carry_{i}").alias(c) for i, c in enumerate(carry)],
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per occurrence, range-sorted by training position."""
    rows = mixed.select("*", F.explode("occurrences").alias("__o")).drop("occurrences")
    return rows.select("*", "__o.copy", "__o.words", "__o.time", "__o.position").drop("__o").orderBy("position", "doc_id", "copy")


def whole_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix reads them, in training order, with all their columns.

    An occurrence cut by its source's target stays, whole, if half of the document or
    more is within it.  Null and empty texts, which have no words, are read not at all.
    Columns may have any names.  An empty table gives an empty table.
    """
    rows = carried(docs, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source"))
    mixed = mix(rows, carry=("row",), **options)
    halves = F.filter("occurrences", lambda o: 2 * o["words"] >= F.col("size"))
    return restored(training_order(mixed.withColumn("occurrences", halves)))
