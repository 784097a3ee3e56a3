"""Contiguous shards of equal bytes from global prefix sums.

Rows are dealt by range of ``id_col`` into partitions; each partition's total
is summed; the cumulative sums of these totals (one row per partition) give
every partition's offset; a running sum inside a partition plus its offset is
the row's global byte prefix; shard boundaries are equal cuts of that prefix.
Only ids, sizes and checksums are shuffled unless further columns are carried.
DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.shared import materialize, shuffle_partitions


def balanced_shards(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_shards: int = 16,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Assign every row to one of ``n_shards`` contiguous shards of near-equal bytes.

    Returns ``id, size, text_crc32, shard, slot`` and the columns of ``carry``
    under their own names; other columns of ``df``, whatever their names, are
    ignored.  ``size`` is the text's UTF-8 bytes plus 1.

    * Order: ``id_col`` ascending, nulls first, then checksum and size.  Rows
      that agree in all three are interchangeable; each gets a slot of its own.
    * A null or empty text has size 1 and checksum 0.
    * A row goes where its first byte falls, so a shard's bytes differ from
      the even share by less than one row; one very long text stays whole.
    * Fewer rows than shards leave some shards empty; an empty table gives none.
    """
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    sized = df.select(
        F.col(id_col).alias("__id"),
        (F.octet_length(body) + 1).cast("long").alias("__size"),
        F.crc32(body).alias("__crc"),
        *[F.col(c).alias(f"__carry_{i}") for i, c in enumerate(carry)],
    )
    order = ["__id", "__crc", "__size"]
    # The write fixes which row is in which partition.
    ranged = materialize(
        sized.repartitionByRange(shuffle_partitions(df.sparkSession), *order)
        .withColumn("__part", F.spark_partition_id()),
        "sharding",
    )
    # One row per partition, so these windows stay small at any input size.
    by_part = Window.orderBy("__part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = ranged.groupBy("__part").agg(
        F.sum("__size").alias("__bytes"), F.count(F.lit(1)).alias("__rows")
    ).select(
        "__part",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes_before"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
        F.sum("__bytes").over(everything).alias("__total"),
    )
    inside = Window.partitionBy("__part").orderBy(*order)
    placed = (
        ranged.join(F.broadcast(offsets), "__part")
        .withColumn("__upto", F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__row", F.col("__rows_before") + F.row_number().over(inside) - 1)
        .withColumn("__start", F.col("__bytes_before") + F.col("__upto") - F.col("__size"))
        .withColumn("__shard", F.expr(f"cast(__start * {n_shards} div __total as int)"))
    )
    first = placed.groupBy("__shard").agg(F.min("__row").alias("__first"))
    return placed.join(F.broadcast(first), "__shard").select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.col("__shard").alias("shard"),
        (F.col("__row") - F.col("__first")).alias("slot"),
        *[F.col(f"__carry_{i}").alias(c) for i, c in enumerate(carry)],
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, rows in slot order inside each file."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
