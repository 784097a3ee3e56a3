import math

import pytest
from pyspark.sql import functions as F

from quillmark.operators import metrics as m
from quillmark.operators import retrieval as r
from quillmark.operators.answers import Models, answer_questions, drop_unsupported, groundedness
from quillmark.plans.config import RunConfig, ladder

DOCS = [("a-0001", "a", "the cat sat"), ("b-0001", "b", "the dog ran far away"), ("c-0001", "c", "a cat and a dog")]


def chunks(spark):
    df = spark.createDataFrame(DOCS, "chunk_id string, doc_id string, text string")
    return r.embed(df.withColumn("cite_label", F.col("chunk_id")))


def asked(spark, *texts):
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "question_id string, question string")
    return r.embed(df, "question")


def test_bm25_by_hand(spark):
    n, avgdl = 3, (3 + 5 + 5) / 3
    idf = lambda df: math.log(n - df + 0.5) - math.log(df + 0.5)
    vocabulary = {"the": 2, "cat": 2, "sat": 1, "dog": 2, "ran": 1, "far": 1, "away": 1, "a": 1, "and": 1}
    floor = 0.25 * sum(map(idf, vocabulary.values())) / len(vocabulary)
    part = lambda df, tf, dl: (idf(df) if idf(df) >= 0 else floor) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    got = {x["chunk_id"]: x["score"] for x in r.bm25_scores(chunks(spark), asked(spark, "cat sat cat unknown")).collect()}
    assert got == {"a-0001": pytest.approx(2 * part(2, 1, 3) + part(1, 1, 3)), "c-0001": pytest.approx(2 * part(2, 1, 5))}


def test_top_k_is_filled_with_zero_scores(spark):
    out = r.bm25_topk(chunks(spark), asked(spark, "sat", "nothing here"), 3)
    assert [x["n"] for x in out.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).collect()] == [3, 3]
    none = out.where("question_id = '1'").orderBy("rank").collect()
    assert [(x["chunk_id"], x["score"]) for x in none] == [("a-0001", 0.0), ("b-0001", 0.0), ("c-0001", 0.0)]


def test_dense_finds_the_same_text(spark):
    out = r.dense_topk(chunks(spark), asked(spark, "the dog ran far away"), 2).orderBy("rank").collect()
    assert out[0]["chunk_id"] == "b-0001" and out[0]["score"] == pytest.approx(1.0)


def test_fusion_ties_go_to_the_lexical_side(spark):
    s = "question_id string, chunk_id string, rank int"
    out = r.rrf_fuse(spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], s), spark.createDataFrame([("q", "z", 1), ("q", "y", 2)], s), 3).orderBy("rank").collect()
    assert [x["chunk_id"] for x in out] == ["y", "x", "z"]


def test_filters_come_before_narrowing(spark):
    hits = spark.createDataFrame([("q", f"c{i}", "bad" if i % 2 else "good", i) for i in range(1, 9)], "question_id string, chunk_id string, doc_id string, rank int")
    out = r.narrow(hits, 3, trusted=spark.createDataFrame([("good",)], "doc_id string")).orderBy("rank").collect()
    assert [(x["chunk_id"], x["rank"]) for x in out] == [("c2", 1), ("c4", 2), ("c6", 3)]


def test_superseded_needs_both_ends(spark):
    v = spark.createDataFrame([("old-a", "new-a"), ("old-b", "new-b")], "old_id string, new_id string")
    reg = spark.createDataFrame([("old-a",), ("new-a",), ("old-b",)], "doc_id string")
    assert [x[0] for x in r.superseded_ids(v, reg).collect()] == ["old-a"]


def test_rerank_keeps_order_of_equals(spark):
    hits = spark.createDataFrame([("q", "c1", 1, "cat", "none"), ("q", "c2", 2, "cat", "a cat"), ("q", "c3", 3, "cat", "zip")],
                                 "question_id string, chunk_id string, rank int, question string, text string")
    assert [x["chunk_id"] for x in r.rerank(hits).orderBy("rank").collect()] == ["c2", "c1", "c3"]


def test_missing_sets_are_an_error(spark):
    for c in (RunConfig("X", require_provenance=True), RunConfig("X", exclude_superseded=True)):
        with pytest.raises(ValueError):
            r.retrieve_context(chunks(spark), asked(spark, "cat"), c)


def test_gate_refuses_before_generating(spark, tmp_path):
    def never(*_):
        raise AssertionError("generated for a refused question")

    gated = RunConfig("G", require_citations=True, abstain=True, confidence_source="answerability", abstain_threshold=0.75)
    out = answer_questions(asked(spark, "zebra xylophone"), chunks(spark), gated, Models(generate=never, answerable=lambda q, h: "UNANSWERABLE")).collect()
    assert out[0]["abstained"] and out[0]["answerability"] == 0.0 and out[0]["citations"] == []


def test_ladder_answers_with_stubs(spark):
    one = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    none = spark.createDataFrame([], "old_id string")
    for config in (ladder()[0], ladder()[3], ladder()[5], ladder()[9]):
        row = answer_questions(asked(spark, "the dog ran far away"), chunks(spark), config, None, one, none).first()
        assert row["config_id"] == config.id and not row["abstained"], config.id
        assert bool(row["citations"]) == config.require_citations


def test_composite_gate_needs_a_verifier(spark):
    with pytest.raises(ValueError):
        answer_questions(asked(spark, "x"), chunks(spark), RunConfig("F", abstain=True))


V = "array<struct<claim_text:string,chunk_id:string,verdict:string>>"


def test_a_sentence_with_one_good_source_stays(spark):
    df = spark.createDataFrame([("One [a-0001, b-0001]. Two [c-0001].", [("One [a-0001, b-0001].", "a-0001", "SUPPORTED"), ("One [a-0001, b-0001].", "b-0001", "UNSUPPORTED"), ("Two [c-0001].", "c-0001", "PARTIAL")])], f"t string, v {V}")
    out = df.select(drop_unsupported(F.col("t"), F.col("v")).alias("t"), groundedness(F.col("v")).alias("g")).first()
    assert out["t"] == "One [a-0001, b-0001]." and out["g"] == pytest.approx(1 / 3)


def test_ranking_quality(spark):
    hits = spark.createDataFrame([("q1", "d1", 1), ("q1", "d2", 2), ("q2", "d9", 1)], "question_id string, doc_id string, rank int")
    rel = spark.createDataFrame([("q1", "d2"), ("q2", "d3")], "question_id string, doc_id string")
    assert tuple(m.ranking_quality(hits, rel, 5, ["doc_id"]).first()) == (2, 0.0, 0.5, 0.25)


def test_evidence(spark):
    hits = spark.createDataFrame([("q", 1, "The  Rate\nis 5")], "question_id string, rank int, text string")
    ev = spark.createDataFrame([("q", 0, "rate is 5"), ("q", 1, "absent"), ("q", 1, "the rate"), ("q", 2, "absent")], "question_id string, part_idx int, phrasing string")
    assert tuple(m.evidence_recall(hits, ev, 5).first()) == ("q", 3, 2)
