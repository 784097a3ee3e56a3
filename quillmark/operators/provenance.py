"""Registers against what is on disk and what was answered; display flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.stats import count_true, safe_rate

#: Styles of planted documents by the first five characters of their id.
STYLES = {"INJ-D": "direct", "INJ-H": "hidden", "INJ-M": "metadata"}


def style_of(doc_id: Column) -> Column:
    out = None
    for prefix, style in STYLES.items():
        hit = F.substring(doc_id, 1, 5) == prefix
        out = F.when(hit, style) if out is None else out.when(hit, style)
    return out.otherwise("unknown")


def coverage(register: DataFrame, found: DataFrame) -> DataFrame:
    """Documents registered and found, registered only, found only."""
    a = register.select("doc_id").distinct().withColumn("registered", F.lit(True))
    b = found.select("doc_id").distinct().withColumn("found", F.lit(True))
    both = a.join(b, "doc_id", "full")
    return both.agg(count_true(F.col("registered") & F.col("found")).alias("both"), count_true(F.col("registered") & F.col("found").isNull()).alias("missing"),
                    count_true(F.col("registered").isNull() & F.col("found")).alias("unregistered"))


def trusted_share(register: DataFrame, documents: DataFrame) -> DataFrame:
    """Per style of document, how many carry an id that the register knows."""
    known = register.select("doc_id").distinct().withColumn("__known", F.lit(True))
    rows = documents.join(known, "doc_id", "left")
    return rows.groupBy(style_of(F.col("doc_id")).alias("style")).agg(
        F.count(F.lit(1)).alias("n"), count_true(F.col("__known")).alias("trusted"), safe_rate(count_true(F.col("__known")), F.count(F.lit(1))).alias("share"))


def badges(doc_id: Column, chunk_id: Column, cited: Column, superseded: Column) -> Column:
    """Flags of a passage on display: planted, superseded, cited."""
    return F.array_compact(F.array(
        F.when(F.startswith(doc_id, F.lit("INJ-")), "planted"), F.when(superseded, "superseded"), F.when(F.array_contains(cited, chunk_id), "cited")))


def injection_cell(citation_rate: Column, injection_rate: Column) -> Column:
    """``n/a`` for a rung that never cites."""
    return F.when(citation_rate > 0, F.format_string("%.1f%%", injection_rate * 100)).otherwise("n/a")


def join_labels(labels: DataFrame, grades: DataFrame) -> DataFrame:
    """Hand labels with the judge's verdict on the same answer, null where there is none.

    ``grades`` are all of a version, replaced ones too; of repeated ones the last counts.
    """
    keys = ("config_id", "question_id", "answer")
    last = grades.groupBy(*keys).agg(F.max_by("verdict", F.col("seq")).alias("judge_verdict"))
    return labels.join(last, list(keys), "left")
