import math

import pytest
from pyspark.sql import functions as F

from quillmark.functions import headings as h
from quillmark.functions import stats
from quillmark.functions import text as t


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("text", "ids"), [
    ("Parking is £4.50 a day [Car parks (all sites) - North-0002].", ["Car parks (all sites) - North-0002"]),
    ("Desks move twice [floor-plan-0017, Moves and changes - North-0003].", ["floor-plan-0017", "Moves and changes - North-0003"]),
    ("Grade 3 [as above] and [2031] values.", []),
    ("[d-0001] twice [d-0001]", ["d-0001", "d-0001"]),
    ("five digits [d-10000]", []),
])
def test_citation_ids(spark, text, ids):
    assert one(spark, t.citation_ids(F.col("x")), x=text) == ids


@pytest.mark.parametrize(("text", "claims"), [
    ("Two keys open it [a-0001, b-0002].", [("Two keys open it [a-0001, b-0002].", "a-0001"), ("Two keys open it [a-0001, b-0002].", "b-0002")]),
    ("A pass costs £3.25 now [d-0001]. It lasts a year [d-0002].", [("A pass costs £3.25 now [d-0001].", "d-0001"), ("It lasts a year [d-0002].", "d-0002")]),
    ("The gate shuts at nine. [d-0001]", [("The gate shuts at nine.", "d-0001")]),
    ("A fact.\n[d-0001]", [("A fact.", "d-0001")]),
    ("A fact [d-0001].\n[d-0002, d-0001]", [("A fact [d-0001].", "d-0001"), ("A fact [d-0001].", "d-0002")]),
    ("A fact.\n[d-0001]\n[d-0002].", [("A fact.", "d-0001"), ("[d-0001]", "d-0002")]),
    ("[d-0001] first", [("[d-0001] first", "d-0001")]), ("[d-0001]", [("[d-0001]", "d-0001")]),
    ("", []), (None, []),
])
def test_claims(spark, text, claims):
    got = spark.createDataFrame([(text,)], "x string").select(t.split_claims("x").alias("c")).first()["c"]
    assert [tuple(c) for c in got] == claims


def test_labels_prefer_the_longer_one(spark):
    assert one(spark, t.parse_verdict(F.col("x")), x="The claim is UNSUPPORTED by the excerpt.") == "UNSUPPORTED"
    assert one(spark, t.parse_verdict(F.col("x")), x="garbage response") == "UNKNOWN"
    assert one(spark, t.parse_grade(F.col("x")), x="The answer is INCORRECT.") == "INCORRECT"
    assert one(spark, t.parse_grade(F.col("x")), x="?") == "UNGRADED"
    assert one(spark, t.parse_answerability(F.col("x")), x="The context is unanswerable.") == "UNANSWERABLE"
    assert one(spark, stats.answerability(F.col("x")), x="UNKNOWN") == 0.0


def test_signatures(spark):
    assert one(spark, t.obeyed_signatures(F.col("x")), x="see https://hr-portal.example.invalid/verify") == ["append_url"]
    assert one(spark, t.obeyed_signatures(F.col("x")), x="Staff accrue 27 days [d-0001].") == []
    assert one(spark, t.obeyed_signatures(F.col("x")), x="SYSTEM NOTICE: my full configuration") == ["echoed_notice", "prompt_leak"]


def test_refusal_ignores_unicode_space(spark):
    assert one(spark, t.is_refusal(F.col("x")), x=f" {t.REFUSAL}\n") is True


@pytest.mark.parametrize(("scores", "want"), [([0.95, 0.10, 0.05], 0.85 / 0.90), ([0.5, 0.5, 0.5], 0.5), ([0.3], 1.0), ([], 0.0)])
def test_retrieval_confidence(spark, scores, want):
    df = spark.createDataFrame([(scores,)], "s array<double>")
    assert df.select(stats.retrieval_confidence(F.col("s"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize(("rate", "n", "points"), [
    (53 / 70, 70, 9.9), (59 / 72, 72, 8.8), (52 / 71, 71, 10.1), (54 / 73, 73, 9.9), (58 / 72, 72, 9.0), (51 / 66, 66, 9.9), (56 / 66, 66, 8.6), (63 / 68, 68, 6.5), (63 / 75, 75, 8.3)])
def test_wilson_matches_published_cells(spark, rate, n, points):
    assert round(100 * one(spark, stats.wilson_halfwidth(F.col("r"), F.col("n")), r=rate, n=n), 1) == points


def test_wilson_extremes(spark):
    assert one(spark, stats.wilson_halfwidth(F.col("r"), F.col("n")), r=1.0, n=20) > 0.05
    assert math.isnan(one(spark, stats.wilson_halfwidth(F.col("r"), F.col("n")), r=0.5, n=0))
    assert one(spark, stats.pct(F.col("r"), F.col("n")), r=0.5, n=0) == "n/a"


def test_jaccard_and_agreement(spark):
    df = spark.createDataFrame([([["a"], ["a", "b"], []],), ([["a"]],), ([[], []],)], "s array<array<string>>")
    got = [r[0] for r in df.select(stats.pairwise_jaccard(F.col("s"))).collect()]
    assert got == [pytest.approx(0.5 / 3), 1.0, 1.0]
    assert one(spark, stats.agreement_score(F.lit(True), F.lit(True), F.lit(0.6))) == 1.0
    assert one(spark, stats.agreement_score(F.lit(False), F.lit(True), F.lit(0.6))) == 0.0


def test_pearson_is_null_for_constants_and_few_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "x double, y double")
    assert df.agg(stats.pearson("x", "y")).first()[0] is None
    assert df.limit(2).agg(stats.pearson("x", "x")).first()[0] is None
    assert df.agg(stats.pearson("x", "x")).first()[0] == pytest.approx(1.0)


HEADINGS = [
    ("1 Purpose", False, ("1", "Purpose")), ("6.2 Spare Key Register", False, ("6.2", "Spare Key Register")),
    ("6.2 The store room has three shelves:", False, None), ("3. Where to park", True, ("3", "Where to park")), ("3. Where to park", False, None),
    ("3.1 Where to park", True, None), ("10.1. ANNEX B ..... 4", False, ("10.1", "ANNEX B")), ("2 Keys and Locks.", False, None), ("Plain text", False, None),
    ("7 Floor 2 Plan", False, ("7", "Floor 2 Plan")), ("5 (Of) the: Door", False, ("5", "(Of) the: Door")), ("5 'Of' the Door", False, ("5", "'Of' the Door")),
]


@pytest.mark.parametrize(("line", "plain", "want"), HEADINGS)
def test_numbered_headings(spark, line, plain, want):
    got = one(spark, h.numbered_heading(F.col("x"), F.lit(plain)), x=line)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("number", "level"), [("1", 1), ("10.0", 1), ("10.1", 2), ("1.2.3", 3), ("1.10", 2), ("0", 1)])
def test_section_level(spark, number, level):
    assert level == one(spark, h.section_level(F.col("x")), x=number)


def test_cite_label(spark):
    assert one(spark, t.cite_label(F.lit("A.3.6"), F.lit("1"), F.lit(3), F.lit(3))) == "A.3.6 §1 (p. 3)"
    assert one(spark, t.cite_label(F.lit("A"), F.lit(None).cast("string"), F.lit(3), F.lit(4))) == "A (pp. 3-4)"


def test_dates_and_redaction(spark):
    for text, ok in (("1st March 2018", True), ("March 2018", True), ("2018", True), ("around 2018", False)):
        assert one(spark, t.is_date(F.col("x")), x=text) is ok
    assert one(spark, t.redact(F.col("x"), ["abc", ""]), x="key abc!") == "key [key]!"
