"""Answering a question set under one configuration.

Models are plain functions with deterministic local stand-ins.  Their calls sit in
pandas UDFs over exactly the rows that need one: gates split the rows first, since
a UDF inside a conditional would run for every row.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import stats
from quillmark.functions.text import (
    CITATION,
    REFUSAL,
    citation_ids,
    drop_sentences,
    is_refusal,
    parse_answerability,
    parse_grade,
    parse_verdict,
    split_claims,
)
from quillmark.operators.retrieval import lexical_overlap, retrieve_context
from quillmark.session import cut

_TOKEN = re.compile("[a-z0-9]+")


def extractive_answer(question: str, excerpts: list[tuple[str, str]], cite: bool, sample: int = 0) -> str:
    """The sentence of the excerpts that shares most words with the question."""
    asked = set(_TOKEN.findall(question.lower()))
    best = (0, 0, "", "")
    for i, (chunk_id, text) in enumerate(excerpts):
        for sentence in re.split(r"(?<=\.)\s+|\n", text):
            score = len(asked & set(_TOKEN.findall(sentence.lower())))
            if (score, -i) > (best[0], best[1]):
                best = (score, -i, sentence.strip(), chunk_id)
    if best[0] < 2:
        return REFUSAL
    return best[2].rstrip(".") + (f" [{best[3]}]." if cite else ".")


def lexical_verdict(claim: str, excerpt: str) -> str:
    share = lexical_overlap(re.sub(CITATION, "", claim), excerpt)
    return "SUPPORTED" if share >= 0.8 else "PARTIAL" if share >= 0.4 else "UNSUPPORTED"


def lexical_answerability(question: str, excerpts: list[tuple[str, str]]) -> str:
    share = max((lexical_overlap(question, t) for _, t in excerpts), default=0.0)
    return "ANSWERABLE" if share >= 0.6 else "PARTIAL" if share >= 0.3 else "UNANSWERABLE"


def lexical_grade(reference: str, answer: str) -> str:
    share = lexical_overlap(reference, answer)
    return "CORRECT" if share >= 0.6 else "PARTIAL" if share >= 0.3 else "INCORRECT"


@dataclass(frozen=True)
class Models:
    """What a run calls; replies are parsed, so free text is fine."""

    generate: Callable[[str, list[tuple[str, str]], bool, int], str] = extractive_answer
    verify: Callable[[str, str], str] = lexical_verdict
    answerable: Callable[[str, list[tuple[str, str]]], str] = lexical_answerability
    rerank: Callable[[str, str], float] = lexical_overlap
    judge: Callable[[str, str], str] = lexical_grade


#: How a reply that could not be had begins; the rest is the reason.
FAULT = "\x00"


def guarded(call: Callable[..., str]) -> Callable[..., str]:
    """``call`` with failures as replies, so that one question's failure stays its own."""

    def reply(*args) -> str:
        try:
            return call(*args)
        except Exception as error:  # a model may fail in any way; the row says how
            return FAULT + (str(error) or type(error).__name__)[:500]

    return reply


def fault_in(reply: Column) -> Column:
    return F.when(F.startswith(reply, F.lit(FAULT)), F.substring(reply, 2, 500))


def contexts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per question with its hits in rank order."""
    found = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "score", "text", "cite_label"))).alias("hits"))
    return queries.join(found, "question_id", "left").withColumn("hits", F.coalesce("hits", F.array()))


def format_excerpts(hits: Column) -> Column:
    block = lambda h: F.concat(F.lit("["), h["chunk_id"], F.lit("] ("), h["cite_label"], F.lit(")\n"), h["text"])
    return F.array_join(F.transform(hits, block), "\n\n")


def cited_hits(text: Column, hits: Column) -> Column:
    """Citations of the text that are in its context, each once, in order of first mention."""
    ids = F.array_distinct(citation_ids(text))
    known = F.filter(ids, lambda i: F.exists(hits, lambda h: h["chunk_id"] == i))
    label = lambda i: F.get(F.filter(hits, lambda h: h["chunk_id"] == i), F.lit(0))["cite_label"]
    return F.transform(known, lambda i: F.struct(i.alias("chunk_id"), label(i).alias("cite_label")))


def _pairs(hits) -> list[tuple[str, str]]:
    return [(h["chunk_id"], h["text"]) for h in hits]


def generate(rows: DataFrame, config, models: Models, samples: int = 1) -> DataFrame:
    """``rows`` with ``samples`` drafts each (column ``drafts``)."""
    cite, call = config.require_citations, models.generate

    @F.pandas_udf("array<string>")
    def drafts(question: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([[call(q, _pairs(h), cite, i) for i in range(samples)] for q, h in zip(question, hits, strict=True)])

    return rows.withColumn("drafts", drafts("question", "hits"))


def verify_claims(rows: DataFrame, models: Models) -> DataFrame:
    """``question_id, verdicts, verify_fault``: one verdict per (claim, source), and why one could not be had.

    A source outside the context is UNKNOWN without a call.
    """
    claims = rows.select("question_id", "hits", F.posexplode(split_claims("text")).alias("pos", "c")).select(
        "question_id", "pos", "c.claim_text", "c.chunk_id",
        F.get(F.filter("hits", lambda h: h["chunk_id"] == F.col("c.chunk_id")), F.lit(0))["text"].alias("excerpt"))
    call = models.verify

    @F.pandas_udf("string")
    def reply(claim: pd.Series, excerpt: pd.Series) -> pd.Series:
        return pd.Series([call(c, e) for c, e in zip(claim, excerpt, strict=True)])

    known = claims.where("excerpt is not null").withColumn("reply", reply("claim_text", "excerpt")).withColumn("verdict", parse_verdict(F.col("reply")))
    unknown = claims.where("excerpt is null").withColumn("reply", F.lit("")).withColumn("verdict", F.lit("UNKNOWN"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "claim_text", "chunk_id", "verdict")))
    return known.unionByName(unknown).groupBy("question_id").agg(F.transform(
        ordered, lambda v: F.struct(v["claim_text"].alias("claim_text"), v["chunk_id"].alias("chunk_id"), v["verdict"].alias("verdict"))).alias("verdicts"),
        F.min(fault_in(F.col("reply"))).alias("verify_fault"))


def groundedness(verdicts: Column) -> Column:
    n = F.size(verdicts)
    good = F.size(F.filter(verdicts, lambda v: v["verdict"] == "SUPPORTED"))
    return F.when(n == 0, 1.0).otherwise(F.try_divide(good.cast("double"), n))


def all_supported(verdicts: Column) -> Column:
    return F.forall(verdicts, lambda v: v["verdict"] == "SUPPORTED")


def drop_unsupported(text: Column, verdicts: Column) -> Column:
    """The text without sentences that no cited source supports."""
    names = lambda only: F.array_distinct(F.transform(F.filter(verdicts, only), lambda v: v["claim_text"]))
    return drop_sentences(text, F.array_except(names(lambda v: F.lit(True)), names(lambda v: v["verdict"] == "SUPPORTED")))


def sample_agreement(drafts: Column) -> Column:
    """Agreement of several drafts by what they cite."""
    refused = F.transform(drafts, is_refusal)
    overlap = stats.pairwise_jaccard(F.transform(drafts, lambda d: F.array_distinct(citation_ids(d))))
    return stats.agreement_score(F.forall(refused, lambda r: r), F.exists(refused, lambda r: r), overlap)


_VERDICTS = "array<struct<claim_text:string,chunk_id:string,verdict:string>>"
_CITATIONS = "array<struct<chunk_id:string,cite_label:string>>"


def answer_questions(
    queries: DataFrame, chunks: DataFrame, config, models: Models | None = None,
    trusted: DataFrame | None = None, superseded: DataFrame | None = None, keep_errors: bool = False,
) -> DataFrame:
    """Answers of all questions under one configuration, as rows of the log.

    With ``keep_errors`` a failing call makes its question's row an error row (column
    ``error``, no answer); otherwise it fails the job.

    Without hits a question is refused and no model is called.  With the
    answerability gate a question below the threshold is refused before anything is
    generated; the composite gate samples several drafts, verifies the first, and
    may then replace it by the refusal.  Citations are those of the draft.
    """
    models = models or Models()
    if keep_errors:
        models = replace(models, generate=guarded(models.generate), verify=guarded(models.verify), answerable=guarded(models.answerable))
    by_gate = config.abstain and config.confidence_source == "answerability"
    by_composite = config.abstain and not by_gate
    if by_composite and (config.verifier == "off" or not config.require_citations):
        raise ValueError("the composite gate needs verified citations")
    hits = retrieve_context(chunks, queries, config, trusted, superseded)
    rows = contexts(queries, hits).withColumns({"gate": F.lit(None).cast("string"), "gate_fault": F.lit(None).cast("string")})
    none = F.size("hits") == 0
    refused, rest = rows.where(none), rows.where(~none)
    if by_gate:
        call = models.answerable

        @F.pandas_udf("string")
        def reply(question: pd.Series, hits: pd.Series) -> pd.Series:
            return pd.Series([call(q, _pairs(h)) for q, h in zip(question, hits, strict=True)])

        # Written out once: both branches read the verdicts, no question is judged twice.
        rest = cut(rest.withColumn("gate", reply("question", "hits")))
        rest = rest.withColumn("gate_fault", fault_in(F.col("gate"))).withColumn("gate", parse_answerability(F.col("gate")))
        low = stats.should_abstain(stats.answerability(F.col("gate")), config.abstain_threshold)
        refused, rest = refused.unionByName(rest.where(low)), rest.where(~low)
    rest = generate(rest, config, models, config.agreement_samples if by_composite else 1)
    rest = rest.withColumn("draft_fault", F.get(F.array_compact(F.transform("drafts", fault_in)), F.lit(0)))
    rest = rest.withColumn("text", F.when(F.col("draft_fault").isNull(), F.get("drafts", F.lit(0))).otherwise(""))
    cites = cited_hits(F.col("text"), F.col("hits")) if config.require_citations else F.array().cast(_CITATIONS)
    rest = rest.withColumn("citations", cites).withColumn("abstained", is_refusal(F.col("text")))
    if config.verifier != "off":
        rest = cut(rest)
        rest = rest.join(verify_claims(rest, models), "question_id", "left").withColumn("verdicts", F.coalesce("verdicts", F.array().cast(_VERDICTS)))
    else:
        rest = rest.withColumns({"verdicts": F.array().cast(_VERDICTS), "verify_fault": F.lit(None).cast("string")})
    signals = [F.lit(None).cast("double").alias(c) for c in ("retrieval", "groundedness", "agreement", "composite")]
    if by_composite:
        r = stats.retrieval_confidence(F.transform("hits", lambda h: h["score"]))
        rest = rest.withColumn("retrieval", r).withColumn("groundedness", groundedness(F.col("verdicts"))).withColumn(
            "agreement", sample_agreement(F.col("drafts"))).withColumn(
            "composite", stats.composite(F.col("retrieval"), F.col("groundedness"), F.col("agreement")))
        low = stats.should_abstain(F.col("composite"), config.abstain_threshold)
    else:
        rest = rest.select("*", *signals)
        low = F.lit(False)
    text = drop_unsupported(F.col("text"), F.col("verdicts")) if config.verifier == "drop_unsupported" else F.col("text")
    rest = rest.withColumn("answer", F.when(low, REFUSAL).otherwise(text)).withColumn("abstained", low | F.col("abstained"))
    rest = rest.withColumn("error", F.coalesce("gate_fault", "draft_fault", "verify_fault"))
    refused = refused.select("*", F.lit(REFUSAL).alias("answer"), F.lit(True).alias("abstained"), F.array().cast(_CITATIONS).alias("citations"),
                             F.array().cast(_VERDICTS).alias("verdicts"), F.col("gate_fault").alias("error"), *signals)
    names = ["question_id", "question", "answer", "abstained", "citations", "verdicts", "gate", "retrieval", "groundedness", "agreement", "composite", "hits", "error"]
    both = rest.select(*names).unionByName(refused.select(*names))
    score = F.when(F.col("gate").isNotNull(), stats.answerability(F.col("gate")))
    failed = F.col("error").isNotNull()
    return both.select(
        "question_id", F.lit(config.id).alias("config_id"), F.when(~failed, F.col("answer")).alias("answer"), F.when(~failed, F.col("abstained")).alias("abstained"),
        "citations", "verdicts", *(["error"] if keep_errors else []),
        F.transform("hits", lambda h: h["doc_id"]).alias("retrieved_doc_ids"), F.transform("hits", lambda h: h["chunk_id"]).alias("retrieved_chunk_ids"),
        "retrieval", "groundedness", "agreement", score.alias("answerability"), F.coalesce(score, "composite").alias("composite"))


def grade_pending(rows: DataFrame, grades: DataFrame, models: Models | None = None, version: str = "v2") -> DataFrame:
    """Grades for gradeable rows without one for this very answer; equal answers to a
    question are judged once."""
    from quillmark.functions.text import grade_cache_key
    from quillmark.operators.gridlog import gradeable
    from quillmark.operators.metrics import grade_for

    call = (models or Models()).judge
    todo = grade_for(rows, grades).where(gradeable() & F.col("verdict").isNull()).withColumn(
        "__key", grade_cache_key(F.col("question_id"), F.col("answer")))
    reference = F.when(F.col("category") == "false_premise", F.col("notes")).otherwise(F.col("expected_answer_summary"))

    @F.pandas_udf("string")
    def reply(reference: pd.Series, answer: pd.Series) -> pd.Series:
        return pd.Series([call(r, a) for r, a in zip(reference, answer, strict=True)])

    judged = todo.select("__key", reference.alias("r"), "answer").dropDuplicates(["__key"]).select(
        "__key", parse_grade(reply("r", "answer")).alias("verdict"))
    return todo.drop("verdict").join(judged, "__key").select(
        "question_id", "config_id", "verdict", "answer", F.lit(version).alias("judge_version"))
