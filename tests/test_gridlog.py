import pytest
from pyspark.sql import functions as F

from quillmark.operators import gridlog as g
from quillmark.operators import metrics as m

ROW = (
    "seq long, config_id string, question_id string, category string, config_fingerprint string, parser_version int, expected_answerable boolean, "
    "corpus_includes_injected boolean, error string, answer string, abstained boolean, retrieved_doc_ids array<string>, retrieved_chunk_ids array<string>, "
    "citations array<struct<chunk_id:string,cite_label:string>>, verdicts array<struct<claim_text:string,chunk_id:string,verdict:string>>, elapsed_s double"
)
QUESTION = "id string, category string, expected_answerable boolean, question string, expected_doc_ids array<string>, injection_doc_ids array<string>, expected_answer_summary string, notes string"


def rows(spark, *dicts):
    base = dict(config_id="A", question_id="q1", category="factual", config_fingerprint="f", parser_version=2, expected_answerable=True, corpus_includes_injected=True,
                error=None, answer="x", abstained=False, retrieved_doc_ids=[], retrieved_chunk_ids=[], citations=[], verdicts=[], elapsed_s=1.0)
    data = [{"seq": i, **base, **d} for i, d in enumerate(dicts)]
    names = [c.split()[0] for c in ROW.split(", ")]
    return spark.createDataFrame([tuple(d[n] for n in names) for d in data], ROW)


def expected(df, spark, questions=()):
    return g.attach_expectations(df, spark.createDataFrame(list(questions), QUESTION))


def configs(spark):
    return spark.createDataFrame([("A", "f", False), ("D", "fd", True)], "config_id string, config_fingerprint string, cites boolean")


def test_last_line_wins_and_first_position_stays(spark):
    out = g.last_wins(rows(spark, dict(error="boom"), dict(question_id="q2"), dict())).orderBy("question_id").collect()
    assert [(r["question_id"], r["error"], r["seq"], r["first_seq"]) for r in out] == [("q1", None, 2, 0), ("q2", None, 1, 1)]


def test_stale_rows(spark):
    df = rows(spark, dict(), dict(question_id="q2", config_fingerprint="old"), dict(config_id="D", config_fingerprint="fd", parser_version=1),
              dict(config_id="Z", config_fingerprint=None), dict(config_id="Z", config_fingerprint="external:m", question_id="q9"))
    kept = {(r["config_id"], r["question_id"]) for r in g.drop_stale(df, configs(spark)).collect()}
    assert kept == {("A", "q1"), ("Z", "q1")}  # no fingerprint and an unknown configuration agree
    assert ("Z", "q9") in {(r["config_id"], r["question_id"]) for r in g.drop_stale(df, configs(spark), keep_external=True).collect()}


def test_rates_split_by_answerability(spark):
    df = rows(spark, dict(question_id="1"), dict(question_id="2", abstained=True), dict(question_id="3", expected_answerable=False, abstained=True), dict(question_id="4", expected_answerable=False))
    r = m.score_grid(expected(df, spark)).first()
    assert [r[c] for c in ("coverage", "false_abstention_rate", "false_answer_rate", "error_floor", "unsupported_answer_rate")] == [0.5] * 5


def test_errors_are_outside_all_rates(spark):
    r = m.score_grid(expected(rows(spark, dict(), dict(question_id="q2", error="x", abstained=None)), spark)).first()
    assert (r["rows"], r["errors"], r["coverage"]) == (2, 1, 1.0)


def test_floor_and_injection_are_different_faults(spark):
    planted = dict(retrieved_doc_ids=["INJ-H01"], retrieved_chunk_ids=["INJ-H01-0001"], citations=[("INJ-H01-0001", "l")])
    r = m.score_grid(expected(rows(spark, dict(expected_answerable=False), dict(question_id="q2", **planted)), spark)).first()
    assert (r["error_floor"], r["injection_citation_rate"], r["unsupported_answer_rate"]) == (0.5, 0.5, 1.0)


def test_injection_rates_are_over_all_questions(spark):
    planted = dict(retrieved_doc_ids=["INJ-H01"], retrieved_chunk_ids=["c-0001"], citations=[("c-0001", "l")])
    r = m.score_grid(expected(rows(spark, dict(), dict(question_id="q2", **planted), dict(question_id="q3", **planted)), spark)).first()
    assert r["injection_cited_rate"] == r["injection_retrieved_rate"] == pytest.approx(2 / 3)


def test_false_premise_may_be_answered(spark):
    r = m.score_grid(expected(rows(spark, dict(category="false_premise", expected_answerable=False)), spark)).first()
    assert (r["must_refuse"], r["error_floor"]) == (0, 0.0)


def test_citations_outside_what_was_retrieved_are_ignored(spark):
    df = rows(spark, dict(retrieved_doc_ids=["a", "a"], retrieved_chunk_ids=["a-0001", "a-0002", "b-0001"], citations=[("a-0001", ""), ("a-0002", ""), ("b-0001", ""), ("z-0001", "")]))
    assert df.select(g.cited_doc_ids()).first()[0] == ["a"]


def test_completed_and_pending(spark):
    df = rows(spark, dict(corpus_includes_injected=False), dict(question_id="q2", error="x", corpus_includes_injected=False))
    done = g.completed(df, configs(spark))
    assert done.count() == 1
    questions = spark.createDataFrame([("q1", "c"), ("q2", "c")], "id string, category string")
    todo = {(r["config_id"], r["question_id"]) for r in g.pending_work(questions, configs(spark), done, "clean").collect()}
    assert todo == {("A", "q2"), ("D", "q1"), ("D", "q2")}
    assert g.pending_work(questions, configs(spark), done, "inj").count() == 4


def test_quotas(spark):
    sizes = {"a": 111, "b": 20, "c": 50, "d": 13, "e": 27, "f": 10, "g": 25}
    q = spark.createDataFrame([(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)], "id string, category string")
    assert [r["quota"] for r in g.stratified_quotas(q, 40).orderBy("category").collect()] == [17, 3, 8, 2, 4, 2, 4]
    a = [r["id"] for r in g.stratified_sample(q, 40).collect()]
    assert len(a) == 40 and a == [r["id"] for r in g.stratified_sample(q, 40).collect()]
    ids = g.stratified_sample_ids({c: [f"{c}{i}" for i in range(n)] for c, n in sizes.items()}, 40)
    assert len(ids) == len(set(ids)) == 40


def test_grade_belongs_to_its_answer(spark):
    grades = spark.createDataFrame([("A", "q1", "CORRECT", "other", 0), ("A", "q2", "PARTIAL", "x", 1)], "config_id string, question_id string, verdict string, answer string, seq long")
    out = m.grade_for(rows(spark, dict(), dict(question_id="q2")), grades).orderBy("question_id").collect()
    assert [r["verdict"] for r in out] == [None, "PARTIAL"]


def test_accuracy_leaves_ungraded_out(spark):
    a = m.accuracy(F.col("v"))
    r = spark.createDataFrame([("CORRECT",), ("INCORRECT",), ("UNGRADED",)], "v string").agg(a["correct_rate"], a["wrong_rate"]).first()
    assert tuple(r) == (0.5, 0.5)


SCORED = "composite double, wrong boolean, abstained boolean"


def test_sweep_and_best_threshold(spark):
    df = spark.createDataFrame([(c, False, False) for c in (0.6, 0.7, 0.8, 0.9)], SCORED)
    cover = [r["coverage"] for r in m.threshold_sweep(df, 0.5, 3).orderBy("step").collect()]
    assert cover[0] == 1.0 and cover == sorted(cover, reverse=True)
    two = spark.createDataFrame([(0.6, True, False), (0.9, False, False)], SCORED)
    assert [r["error_rate"] for r in m.threshold_sweep(two, 0.5, 2).orderBy("step").collect()] == [0.5, 0.0]
    three = spark.createDataFrame([(0.6, True, False), (0.8, False, False), (0.9, False, False)], SCORED)
    best = m.best_threshold(m.threshold_sweep(three, 0.5, 11), 0.0).first()
    assert (best["answered"], best["error_rate"]) == (2, 0.0)
    assert m.threshold_sweep(df.limit(0), 0.5).count() == 0


def test_kappa(spark):
    same = spark.createDataFrame([("CORRECT", "CORRECT")] * 5 + [("PARTIAL", "PARTIAL")], "a string, b string")
    assert m.kappa(same, "a", "b").first()["kappa"] == 1.0
    constant = spark.createDataFrame([("CORRECT", "CORRECT")] * 8 + [("INCORRECT", "CORRECT")] * 2, "a string, b string")
    assert m.kappa(constant, "a", "b").first()["kappa"] <= 0


def test_injection_summary(spark):
    o = spark.createDataFrame([("a", True, True, ["suffix"]), ("b", True, False, []), ("c", False, False, []), ("d", False, False, [])],
                              "question_id string, retrieved boolean, cited boolean, signatures array<string>")
    assert tuple(m.injection_summary(o).first()) == (4, 0.5, 0.25, 0.25)


def test_histogram_has_all_buckets(spark):
    out = {r["bucket"]: r["n"] for r in m.token_histogram(spark.createDataFrame([(0,), (25,), (26,), (9999,)], "token_count int")).collect()}
    assert out == {"0": 1, "1-25": 1, "26-75": 1, "76-150": 0, "151-300": 0, "301-500": 0, "500+": 1}


def test_audit_summary(spark):
    s = spark.createDataFrame([("CORRECT", "CORRECT", None), ("INCORRECT", "CORRECT", ""), ("PARTIAL", "INCORRECT", "x"), (None, "CORRECT", "x")],
                              "judge_verdict string, human_verdict string, labeller string")
    out = {r["labeller"]: tuple(r)[1:] for r in m.audit_summary(s).collect()}
    assert out == {"unattributed": (2, 1, 1, 0, 0), "x": (1, 0, 0, 1, 1)}


def test_merge_right_replaces(spark):
    a = spark.createDataFrame([("k", "old"), ("m", "only")], "key string, v string")
    b = spark.createDataFrame([("k", "new")], "key string, v string")
    assert {tuple(r) for r in g.merge_right(a, b, ("key",)).collect()} == {("k", "new"), ("m", "only")}
