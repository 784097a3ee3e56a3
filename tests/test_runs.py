import pytest
from pyspark.sql import functions as F

from quillmark.operators import gridlog, provenance, retrieval
from quillmark.operators.answers import Models, grade_pending
from quillmark.plans import adapters, prompts
from quillmark.plans.config import configs_table, ladder
from quillmark.plans.run import report, run_grid
from quillmark.sources import readers, writers


def corpus(spark):
    df = spark.createDataFrame([("a-0001", "a", "the notice period is four weeks"), ("b-0001", "b", "leave is twenty seven days")], "chunk_id string, doc_id string, text string")
    return retrieval.embed(df.withColumn("cite_label", F.col("chunk_id")))


def asked(spark):
    q = spark.createDataFrame([("q1", "how long is the notice period", "factual", True), ("q2", "zebra crossing rules", "unanswerable", False)],
                              "id string, question string, category string, expected_answerable boolean")
    return retrieval.embed(q, "question")


def test_grid_runs_what_is_pending_and_reports(spark, tmp_path):
    path = str(tmp_path / "log")
    configs = [ladder()[0], ladder()[4]]
    nothing = spark.createDataFrame([], "config_id string, question_id string, config_fingerprint string, corpus_tag string")
    assert run_grid(asked(spark), corpus(spark), configs, nothing, path) == []
    rows = readers.load_rows(spark, path)
    assert rows.count() == 4
    done = gridlog.completed(rows, configs_table(spark, configs))
    assert gridlog.pending_work(asked(spark), configs_table(spark, configs), done, "clean").count() == 0
    questions = spark.createDataFrame([("q1", "factual", True, "q", ["a"], [], "four weeks notice period", "")],
                                      "id string, category string, expected_answerable boolean, question string, expected_doc_ids array<string>, injection_doc_ids array<string>, expected_answer_summary string, notes string")
    full = gridlog.attach_expectations(gridlog.drop_stale(rows, configs_table(spark, configs)), questions)
    empty = spark.createDataFrame([], "config_id string, question_id string, verdict string, answer string, seq long")
    grades = grade_pending(full, empty)
    assert {r["verdict"] for r in grades.collect()} == {"CORRECT"} and grades.count() == 2
    text = report(full, grades, spark.createDataFrame([], "old_id string"))
    assert "## Ladder" in text and "| A · dense retrieval | " in text
    assert "## Planted documents by style" in text and "## From outside" in text
    writers.write_report(text, spark, str(tmp_path / "report"))
    assert "".join(x.read_text() for x in (tmp_path / "report").glob("part-*")).startswith("## Ladder")


def test_one_failing_question_leaves_the_others_answers(spark, tmp_path):
    def fails_once(question, excerpts, cite, sample):
        if question.startswith("zebra"):
            raise RuntimeError("quota")
        return "four weeks."

    path = str(tmp_path / "log")
    nothing = spark.createDataFrame([], "config_id string, question_id string, config_fingerprint string, corpus_tag string")
    assert run_grid(asked(spark), corpus(spark), [ladder()[0]], nothing, path, Models(generate=fails_once)) == []
    rows = {r["question_id"]: r for r in readers.load_rows(spark, path).collect()}
    assert rows["q1"]["answer"] == "four weeks." and rows["q1"]["error"] is None
    assert rows["q2"]["answer"] is None and rows["q2"]["error"] == "quota"


def test_prompts_ask_the_models(spark):
    seen = []
    models = prompts.remote_models(lambda p: seen.append(p) or "an answer", lambda p: seen.append(p) or "SUPPORTED")
    assert models.generate("why", [("a-0001", "because")], True, 0) == "an answer" and models.verify("c", "e") == "SUPPORTED"
    models.answerable("why", [("a-0001", "because")])
    models.judge("ref", "ans")
    assert "[a-0001]\nbecause" in seen[0] and "why" in seen[0] and "Excerpt:\ne" in seen[1] and len(seen) == 4


def test_failed_rungs_leave_error_rows(spark, tmp_path):
    def broken(*_):
        raise RuntimeError("quota")

    path = str(tmp_path / "log")
    nothing = spark.createDataFrame([], "config_id string, question_id string, config_fingerprint string, corpus_tag string")
    assert run_grid(asked(spark), corpus(spark), [ladder()[0]] * 3, nothing, path, Models(generate=broken), stop_after=2) == ["A", "A"]
    rows = readers.load_rows(spark, path)
    assert rows.where("error is not null").count() == 2
    assert gridlog.completed(rows, configs_table(spark, [ladder()[0]])).count() == 0


def test_provenance(spark):
    reg = spark.createDataFrame([("a",), ("b",), ("INJ-D1",)], "doc_id string")
    found = spark.createDataFrame([("a",), ("INJ-D1",), ("INJ-H2",)], "doc_id string")
    assert tuple(provenance.coverage(reg, found).first()) == (2, 1, 1)
    assert {r["style"]: r["share"] for r in provenance.trusted_share(reg, found).collect()} == {"unknown": 1.0, "direct": 1.0, "hidden": 0.0}
    df = spark.createDataFrame([("INJ-1", "c", ["c"], True, 0.0)], "d string, c string, cited array<string>, old boolean, rate double")
    assert df.select(provenance.badges(F.col("d"), F.col("c"), F.col("cited"), F.col("old"))).first()[0] == ["planted", "superseded", "cited"]
    assert df.select(provenance.injection_cell(F.col("rate"), F.col("rate"))).first()[0] == "n/a"


def test_labels_join_on_text(spark):
    labels = spark.createDataFrame([("A", "q", "x", "CORRECT"), ("A", "q", "y", "CORRECT")], "config_id string, question_id string, answer string, human_verdict string")
    grades = spark.createDataFrame([("A", "q", "x", "PARTIAL", 1), ("A", "q", "x", "INCORRECT", 2)], "config_id string, question_id string, answer string, verdict string, seq long")
    assert {r["answer"]: r["judge_verdict"] for r in provenance.join_labels(labels, grades).collect()} == {"x": "INCORRECT", "y": None}


def test_register_is_saved(spark, tmp_path):
    reg = spark.createDataFrame([("b", "s", "f", "2"), ("a", "s", "f", "1")], "doc_id string, source string, file string, sha256 string")
    writers.save_register(reg, str(tmp_path / "r"))
    assert {r["doc_id"] for r in readers.load_register(spark, str(tmp_path / "r")).collect()} == {"a", "b"}


def test_backoff_and_limits():
    waits, calls = [], iter([adapters.RemoteError("x", 503), adapters.RemoteError("please try again in 1m2.5s", 429), adapters.RemoteError("x", 429, "7")])

    def call():
        for e in calls:
            raise e
        return "ok"

    assert adapters.with_backoff(call, waits.append) == "ok"
    assert all(least <= w <= least + 1 for w, least in zip(waits, (1, 62.5, 7), strict=True))
    with pytest.raises(adapters.RemoteError):
        adapters.with_backoff(lambda: (_ for _ in ()).throw(adapters.RemoteError("no", 400)), waits.append)
    slept, now = [], [0.0]
    limiter = adapters.RateLimiter(30, 2, lambda: now[0], slept.append)
    limiter.wait()
    limiter.wait()
    assert slept == [4.0]
