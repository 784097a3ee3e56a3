"""Whole runs: the pending cells of the grid, and the report over its log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.stats import pct
from quillmark.operators import gridlog as g
from quillmark.operators import metrics as m
from quillmark.operators.answers import Models, answer_questions
from quillmark.operators.provenance import style_of
from quillmark.plans.config import PARSER_VERSION, RunConfig, fingerprint, rung_name
from quillmark.session import cut
from quillmark.sources.readers import with_confidence
from quillmark.sources.writers import append_rows, markdown_table


def run_grid(
    questions: DataFrame, chunks: DataFrame, configs: list[RunConfig], done: DataFrame, path: str, models: Models | None = None,
    trusted: DataFrame | None = None, superseded: DataFrame | None = None, includes_injected: bool = False, stop_after: int = 3,
) -> list[str]:
    """Answer what is not done, one rung at a time, appending to the log; ids of failed rungs.

    ``questions`` has id, question, category, expected_answerable, embedding.  A question
    for which a model fails gets an error row, so that a rerun finds it pending; the others
    of its rung get their answers.  A rung of which all questions fail is a failed one,
    and so is one that fails before its models are called; after ``stop_after`` failed
    rungs in a row the run stops.
    """
    failed, streak = [], 0
    tag = "inj" if includes_injected else "clean"
    for config in configs:
        one = questions.sparkSession.createDataFrame([(config.id, fingerprint(config), config.cites)], "config_id string, config_fingerprint string, cites boolean")
        todo = g.pending_work(questions, one, done, tag).select(F.col("question_id").alias("id"))
        asked = questions.join(todo, "id", "left_semi").withColumnRenamed("id", "question_id")
        stamp = {"config_fingerprint": F.lit(fingerprint(config)), "parser_version": F.lit(PARSER_VERSION), "corpus_includes_injected": F.lit(includes_injected)}
        facts = asked.select("question_id", "category", "expected_answerable")
        try:
            rows = answer_questions(asked, chunks, config, models, trusted, superseded, keep_errors=True)
            parts = ("retrieval", "groundedness", "agreement", "answerability", "composite")
            rows = rows.withColumn("confidence", F.when(F.col("composite").isNotNull(), F.struct(*parts))).drop(*parts)
            rows = cut(rows.join(facts, "question_id").withColumns(stamp))  # no model is called twice
            append_rows(rows, path)
            found = rows.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors")).first()
            lost = 0 < found["n"] == found["errors"]
        except Exception as error:  # retrieval or a ranking model; the rows say how
            append_rows(facts.withColumns({"config_id": F.lit(config.id), "error": F.lit(str(error)[:500]), **stamp}), path)
            lost = True
        streak = streak + 1 if lost else 0
        if lost:
            failed.append(config.id)
        if streak >= stop_after:
            break
    return failed


def report(rows: DataFrame, grades: DataFrame, old_ids: DataFrame, base: str = "D") -> str:
    """Markdown of the report: every table is an aggregate of a few rows per configuration.

    Rows from outside (fingerprint ``external:...``) stand beside the rung ``base`` over the
    same questions.  Planted documents are broken down by style too.
    """
    rows = with_confidence(rows) if "confidence" in rows.columns else rows
    graded = m.grade_for(rows, grades).cache()
    outside = F.coalesce(F.startswith(F.col("config_fingerprint"), F.lit("external:")), F.lit(False))
    frontier = m.frontier_pair(graded.where((F.col("config_id") == base) & ~outside), graded.where(outside))
    styles = graded.where(F.size("injection_doc_ids") > 0).select("question_id", style_of(F.get("injection_doc_ids", F.lit(0))).alias("style")).distinct()
    outcomes = m.injection_outcomes(graded)
    ladder = m.ladder_table(graded).select(
        rung_name(F.col("config_id")).alias("rung"), pct(F.col("coverage"), F.col("n")).alias("coverage"), pct(F.col("error_floor"), F.col("answered")).alias("error floor"),
        m.accuracy_cell(F.col("accuracy"), F.col("graded"), F.col("due"), F.col("accuracy_half")).alias("accuracy")).orderBy("rung")
    rounded = lambda df: df.select(*[F.round(c, 3).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
    sections = {
        "Ladder": ladder, "Planted documents": rounded(m.injection_table(graded).orderBy("config_id")),
        "Planted documents by style": rounded(m.injection_summary(m.outcome_styles(outcomes, styles), "style").orderBy("style")),
        "Answers that obeyed": m.landed(outcomes).select(rung_name(F.col("config_id")).alias("rung"), "question_id", F.array_join("signatures", ", ").alias("signatures")),
        "From outside": rounded(frontier.orderBy("side")),
        "Gate": rounded(m.gate_outcomes(graded).orderBy(F.desc("answerability"))),
        "Confidence": rounded(m.confidence_correlation(graded).orderBy("component")), "Why wrong": rounded(m.why_wrong(graded, old_ids).orderBy("config_id")),
        "Verdicts": rounded(m.verdict_counts(graded).orderBy("config_id", F.desc("n"))),
    }
    text = "\n\n".join(f"## {name}\n\n{markdown_table(df)}" for name, df in sections.items())
    graded.unpersist()
    return text + "\n"
