"""A training corpus from the documents table, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import line_dedup, mixing, ngram_join, packing, toxicity
from quillmark.llm.queries import tokenizer_path
from quillmark.llm.shared import materialize
from quillmark.session import read_table

TOXIC_AT = 0.7
LINE_DOCS = 10


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below the threshold.

    Null and empty texts score low and stay; long texts are scored whole; repeated
    rows score alike.  Without labels nothing is rejected.  Columns of any name stay;
    an empty table gives an empty table.
    """
    return toxicity.below(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TOXIC_AT)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that LINE_DOCS documents or more share.

    A null text becomes the empty one; empty lines stay; texts are split whole.
    Repeated rows count as documents of their own, so LINE_DOCS copies empty each
    other.  Columns of any name stay, n_chars is counted anew; an empty table gives an
    empty table.
    """
    return line_dedup.with_kept_lines(docs, line_dedup.dedup_lines(docs, LINE_DOCS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates.

    Null, empty and white-space texts are one group; of repeated rows one stays;
    texts of one id in different groups are judged each by its own.  Texts are compared
    whole.  Columns of any name stay; an empty table gives an empty table.
    """
    return ngram_join.one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix reads them, in training order.

    Null sources are one source.  Texts without words are not read.  Long documents
    are read whole if half is within the target.  Repeated rows are documents of their
    own, in a fixed order.  Columns of any name stay; an empty table gives an empty
    table.
    """
    return mixing.whole_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in training sequences.

    The rows' order in their files is the training order of the stage before: it
    comes out as ``position``, and pieces of one length fill sequences in that order.
    A null or empty text is one piece, its end id; long texts are cut into pieces;
    repeated rows are packed once each.  Other columns, whatever their names, are
    ignored; an empty table gives an empty table.
    """
    return packing.pack_documents(docs, tokenizer_path(), keep_ids=False, position=packing.file_order())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack),
]

#: Scores, tokens and packing are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
