"""The outcome log as a stream: files of rows in, the last row per cell out.

"Late" means a lower ``seq``, never an event time, so there is no watermark; the
state is the table of last rows, bounded by configurations times questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.gridlog import last_wins
from quillmark.session import delete_folder

KEYS = ("config_id", "question_id")


def upsert(spark: SparkSession, batch: DataFrame, state_path: str, version: int) -> None:
    """Fold a micro-batch into the state.  Every version is a folder of its own, written
    whole before the next one starts, so a repeated batch rewrites the same folder."""
    old = f"{state_path}/v={version - 1}"
    rows = batch
    if version > 0:
        rows = spark.read.schema(batch.schema).parquet(old).unionByName(batch)
    last_wins(rows, KEYS).drop("first_seq").select(*batch.columns).write.mode("overwrite").parquet(f"{state_path}/v={version}")
    # The version before is what a repeat of this batch reads; those before it nothing reads.
    delete_folder(spark, f"{state_path}/v={version - 2}")


def follow(spark: SparkSession, path: str, schema: str, state_path: str, checkpoint: str) -> int:
    """Process all files that have arrived since the last call; the state's version."""
    stream = spark.readStream.schema(schema).json(path).where(F.col("seq").isNotNull())
    last = {"v": -1}

    def fold(batch: DataFrame, epoch: int) -> None:
        upsert(spark, batch, state_path, epoch)
        last["v"] = epoch

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return last["v"]
