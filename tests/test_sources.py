import json

import pytest
from pyspark.sql import functions as F

from quillmark.sources import readers, writers
from quillmark.streaming import log


def test_jsonl_last_wins_and_missing_grades(spark, tmp_path):
    p = tmp_path / "rows.jsonl"
    p.write_text("\n".join(json.dumps(x) for x in (
        {"question_id": "q", "config_id": "A", "error": "x"}, {"question_id": "q", "config_id": "A", "answer": "ok"})) + "\n\n")
    rows = readers.load_rows(spark, str(p)).collect()
    assert [(r["answer"], r["error"]) for r in rows] == [("ok", None)]
    assert readers.load_grades(spark, str(tmp_path / "absent.jsonl")).count() == 0


def test_grade_versions(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    p.write_text("\n".join(json.dumps(x) for x in (
        {"question_id": "q", "config_id": "A", "verdict": "CORRECT", "answer": "a"},
        {"question_id": "q", "config_id": "A", "verdict": "PARTIAL", "answer": "a", "judge_version": "v2"},
        {"question_id": "q", "config_id": "A", "verdict": "INCORRECT", "answer": "a", "judge_version": "v2"})))
    assert [r["verdict"] for r in readers.load_grades(spark, str(p)).collect()] == ["INCORRECT"]
    assert [r["verdict"] for r in readers.load_grades(spark, str(p), "v1").collect()] == ["CORRECT"]
    assert readers.load_all_grades(spark, str(p)).count() == 2


def test_register_versions_evidence(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"A": {"doc_id": "A", "source": "s", "file": "f", "sha256": "x"}}))
    (tmp_path / "v.json").write_text(json.dumps({"old": "new"}))
    (tmp_path / "e.json").write_text(json.dumps({"_about": "note", "q": ["one", ["two", "zwei"]]}))
    reg = readers.load_register(spark, str(tmp_path / "r.json"))
    assert tuple(reg.first()) == ("A", "s", "f", "x")
    assert tuple(readers.load_versions(spark, str(tmp_path / "v.json")).first()) == ("old", "new")
    assert {tuple(r) for r in readers.load_evidence(spark, str(tmp_path / "e.json")).collect()} == {("q", 0, "one"), ("q", 1, "two"), ("q", 1, "zwei")}
    more = reg.unionByName(reg.select(F.lit('b "q"').alias("doc_id"), "source", "file", "sha256"))
    writers.save_register(more, str(tmp_path / "saved"))
    saved = "".join(p.read_text() for p in (tmp_path / "saved").glob("part-*"))
    assert list(json.loads(saved)) == ["A", 'b "q"'] and json.loads(saved)["A"] == {"doc_id": "A", "source": "s", "file": "f", "sha256": "x"}
    assert readers.load_register(spark, str(tmp_path / "saved")).count() == 2


def test_pages_with_any_parser(spark, tmp_path):
    (tmp_path / "Doc One.pdf").write_bytes(b"cover\fbody\f")
    (tmp_path / "x.txt").write_bytes(b"no")
    out = readers.load_pages(spark, str(tmp_path), "s", lambda b: [x or None for x in b.decode().split("\f")], first_page=2).collect()
    assert [(r["doc_id"], r["page_num"], r["text"]) for r in out] == [("Doc%20One", 2, "body"), ("Doc%20One", 3, "")] or [
        (r["doc_id"], r["page_num"], r["text"]) for r in out] == [("Doc One", 2, "body"), ("Doc One", 3, "")]


def test_register_of_one_id_twice(spark):
    df = spark.createDataFrame([("a", "s", "f1", bytearray(b"1")), ("a", "s", "f2", bytearray(b"2"))], "doc_id string, source string, file string, content binary")
    with pytest.raises(ValueError):
        writers.build_register(df)


def test_result_files_and_append(spark, tmp_path):
    for n in ("clean.jsonl", "clean-grades.jsonl", ".hidden.jsonl"):
        (tmp_path / n).write_text("{}\n")
    assert [r["name"] for r in readers.result_files(spark, str(tmp_path)).collect()] == ["clean"]
    df = spark.createDataFrame([("q", None)], "question_id string, error string")
    writers.append_rows(df, str(tmp_path / "out"))
    writers.append_rows(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_markdown_and_cache(spark):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    assert writers.markdown_table(df) == "| x | y |\n| --- | --- |\n| a | 1 |"
    req = spark.createDataFrame([("k1", "p"), ("k2", "q"), ("k2", "q")], "cache_key string, prompt string")
    cache = spark.createDataFrame([("k1", "cached")], "cache_key string, reply string")
    out, new = writers.cached_replies(req, cache, F.upper("prompt"))
    assert sorted(r["reply"] for r in out.collect()) == ["Q", "Q", "cached"] and new.count() == 1


def test_stream_upserts_by_seq(spark, tmp_path):
    src, state, ck = (str(tmp_path / x) for x in ("in", "state", "ck"))
    schema = "seq long, config_id string, question_id string, answer string"
    spark.createDataFrame([(2, "A", "q", "second"), (1, "A", "q", "late"), (3, "B", "q", "b")], schema).write.json(src)
    v = log.follow(spark, src, schema, state, ck)
    spark.createDataFrame([(0, "A", "q", "older"), (9, "B", "q", "newest")], schema).write.mode("append").json(src)
    v = log.follow(spark, src, schema, state, ck)
    out = {(r["config_id"], r["answer"]) for r in spark.read.parquet(f"{state}/v={v}").collect()}
    assert out == {("A", "second"), ("B", "newest")}
