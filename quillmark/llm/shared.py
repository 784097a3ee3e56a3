"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.session import delete_folder, scratch_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage: a lost executor costs a reread, never a recomputation, and
    whatever depends on the written rows sees the same rows each time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_table = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    delete_folder(table.sparkSession, table.scratch_table)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(rows: int, rows_per_part: int, spark: SparkSession) -> int:
    """Number of partitions of about ``rows_per_part`` rows, as many as the
    session's shuffle partitions at least."""
    return max(shuffle_partitions(spark), math.ceil(rows / rows_per_part), 1)


def carried(df: DataFrame, **columns) -> DataFrame:
    """``columns`` beside each row as one struct, so that no name of the row can meet ours.

    ``restored`` gives the row's columns back.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.struct(F.lit(0).alias("none"))
    return df.select(row.alias("row"), *[c.alias(n) for n, c in columns.items()])


def restored(df: DataFrame, **replaced) -> DataFrame:
    """The columns of ``carried`` rows, those of ``replaced`` with new values."""
    names = df.schema["row"].dataType.names
    return df.select(*[replaced[c].alias(c) if c in replaced else F.col("row").getField(c).alias(c) for c in names])


#: Keys with more than this share of all rows are common; their rows go to so many tasks.
COMMON, SPLITS = 1000, 64


def split_join(rows: DataFrame, key: str, small: DataFrame, salt: str, least: int = 1000, common: int = COMMON) -> DataFrame:
    """``rows`` left-joined to ``small`` on ``key == of``, common keys split over many tasks.

    ``small`` has one row per key: ``of``, how many rows ``uses`` it, and values, which
    ``rows`` gets.  Rows of a common key are dealt by ``salt`` and meet copies of its row.
    Fewer than ``common`` keys can be common, so their list is sent to all tasks.
    """
    total = small.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("n")).first()["n"]
    often = F.col("uses") > max(least, total // common)
    names = F.broadcast(small.where(often).select(F.col("of").alias("common")))
    split = F.when(F.col("common").isNull(), 0).otherwise(F.pmod(F.xxhash64(salt), F.lit(SPLITS))).cast("int")
    copies = small.select("*", F.explode(F.sequence(F.lit(0), F.when(often, SPLITS - 1).otherwise(0))).alias("copy")).drop("uses")
    dealt = rows.join(names, F.col(key) == F.col("common"), "left").withColumn("split", split)
    return dealt.join(copies, (F.col(key) == F.col("of")) & (F.col("split") == F.col("copy")), "left").drop("common", "split", "of", "copy")


def lean(batches_to_batches):
    """A function for ``mapInArrow`` that gives Arrow's free memory back when its task ends.

    Python workers outlive their tasks; what they hold on to would be missing for the next stage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from batches_to_batches(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def text_bytes(column: str):
    """The column's UTF-8 bytes; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))
