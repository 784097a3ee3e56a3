"""Writers: log and grade appends, registers, tables, and a read-through reply cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quillmark.session import cut


def append_rows(rows: DataFrame, path: str) -> None:
    """Append rows or grades as JSON lines through Spark's commit protocol."""
    rows.write.mode("append").option("ignoreNullFields", "true").json(path)


def save_json_object(members: DataFrame, path: str) -> None:
    """``members`` (key, value as JSON text) as one JSON object with sorted keys, a line each.

    The lines are sorted and written by one task, as a file of one object must be; the
    driver holds none of them.
    """
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    last = members.agg(F.max("key").alias("last"))
    comma = F.when(F.col("key") == F.col("last"), "").otherwise(",")
    lines = members.join(F.broadcast(last)).select(F.lit(1).alias("part"), "key", F.concat(F.lit("  "), quoted(F.col("key")), F.lit(": "), F.col("value"), comma).alias("value"))
    ends = members.sparkSession.createDataFrame([(0, "", "{"), (2, "", "}")], "part int, key string, value string")
    lines.unionByName(ends).coalesce(1).sortWithinPartitions("part", "key").select("value").write.mode("overwrite").option("lineSep", "\n").text(path)


def save_register(register: DataFrame, path: str) -> None:
    """The register of documents, one member per id."""
    save_json_object(register.select(F.col("doc_id").alias("key"), F.to_json(F.struct("doc_id", "source", "file", "sha256")).alias("value")), path)


def save_versions(versions: DataFrame, path: str) -> None:
    save_json_object(versions.select(F.col("old_id").alias("key"), F.regexp_extract(F.to_json(F.array("new_id")), r"(?s)^\[(.*)\]$", 1).alias("value")), path)


def audit_sheet(rows: DataFrame) -> DataFrame:
    """Rows to be labelled by hand: what the labeller reads, the rule, and blanks to fill in."""
    premise = F.coalesce(F.col("category"), F.lit("")) == "false_premise"
    return rows.select(
        "config_id", "question_id", F.coalesce("category", F.lit("")).alias("category"), "question",
        F.when(premise, F.col("notes")).otherwise(F.col("expected_answer_summary")).alias("reference"),
        F.when(premise, "false premise: right if it rejects the premise").otherwise("right if the facts are stated, complete or not").alias("grading_rule"),
        "answer", *[F.lit("").alias(c) for c in ("human_verdict", "labeller", "note")])


def append_audit_sheet(sheet: DataFrame, path: str) -> None:
    append_rows(sheet, path)


def write_report(text: str, spark: SparkSession, path: str) -> None:
    """A report's text as a file, through Spark's file systems."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def build_register(files: DataFrame) -> DataFrame:
    """``files``: doc_id, source, file, content.  Two files of one id are an error."""
    out = files.select("doc_id", "source", "file", F.sha2(F.col("content"), 256).alias("sha256"))
    twice = out.groupBy("doc_id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ids of more than one file: {[r['doc_id'] for r in twice]}")
    return out


def markdown_table(df: DataFrame, max_rows: int = 1000) -> str:
    """A report table; more rows than fit a report are an error, not cut off."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError("too many rows for a report")
    lines = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def cached_replies(requests: DataFrame, cache: DataFrame, call: Column) -> tuple[DataFrame, DataFrame]:
    """``requests`` (cache_key, ...) with ``reply``, and the replies to add to the cache.

    ``call`` is evaluated for keys that the cache lacks, once per key.
    """
    missing = requests.dropDuplicates(["cache_key"]).join(cache.select("cache_key"), "cache_key", "left_anti")
    new = cut(missing.select("cache_key", call.alias("reply")))
    known = cache.select("cache_key", "reply").unionByName(new)
    return requests.join(known, "cache_key"), new


def replies_through(requests: DataFrame, path: str, call: Column) -> DataFrame:
    """``cached_replies`` with the cache in a folder: what it lacks is called and added to it."""
    spark = requests.sparkSession
    try:
        cache = spark.read.schema("cache_key string, reply string").parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        cache = spark.createDataFrame([], "cache_key string, reply string")
    out, new = cached_replies(requests, cache, call)
    out = cut(out)  # before the cache it reads grows
    new.write.mode("append").parquet(path)
    return out
