"""Readers: append-only logs, registers, version maps, evidence, and documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = (
    "question_id string, category string, config_id string, config_fingerprint string, parser_version int, "
    "expected_answerable boolean, corpus_includes_injected boolean, error string, answer string, abstained boolean, "
    "retrieved_doc_ids array<string>, retrieved_chunk_ids array<string>, "
    "citations array<struct<chunk_id:string,cite_label:string>>, "
    "verdicts array<struct<claim_text:string,chunk_id:string,verdict:string>>, "
    "confidence struct<retrieval:double,groundedness:double,agreement:double,weights:map<string,double>,"
    "verdict:string,answerability:double,composite:double>, elapsed_s double"
)
GRADES = "question_id string, config_id string, verdict string, answer string, judge_version string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files with ``seq``, their place: order is meaning in a log.

    Large files are split.  The place is the file's name, the offset of the split, and a
    number that grows along a split, since a task reads a split from its start to its end;
    it orders the lines but does not count them.  Blank lines are skipped.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(place.alias("seq"), "value")
    return lines.where(F.trim("value") != "").select("seq", F.from_json("value", schema).alias("r")).select("seq", "r.*")


def with_confidence(rows: DataFrame) -> DataFrame:
    """The parts of ``confidence`` as columns of their own, as scorecards read them."""
    parts = ("retrieval", "groundedness", "agreement", "answerability", "composite")
    return rows.withColumns({p: F.col(f"confidence.{p}") for p in parts if p not in rows.columns})


def load_rows(spark: SparkSession, path: str) -> DataFrame:
    """The log's last row per (config, question)."""
    from quillmark.operators.gridlog import last_wins

    return with_confidence(last_wins(json_lines(spark, path, ROWS)))


def load_all_grades(spark: SparkSession, path: str, version: str = "v2") -> DataFrame:
    """All grades of a judge version, replaced ones too; a missing file has none."""
    try:
        rows = json_lines(spark, path, GRADES)
    except Exception as e:  # the reader's own exception for a path that is not there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], f"seq struct<file:string,block:long,line:long>, {GRADES}")
    return rows.where(F.coalesce("judge_version", F.lit("v1")) == version)


def load_grades(spark: SparkSession, path: str, version: str = "v2") -> DataFrame:
    """The last grade per (config, question) within the version."""
    from quillmark.operators.gridlog import last_wins

    return last_wins(load_all_grades(spark, path, version))


def rows_and_grades(spark: SparkSession, rows_path: str, grades_path: str, configs: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report's input: current rows and those from outside, with their expectations."""
    from quillmark.operators.gridlog import attach_expectations, drop_stale

    rows = drop_stale(load_rows(spark, rows_path), configs, keep_external=True)
    return attach_expectations(rows, questions), load_grades(spark, grades_path)


def _json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def load_register(spark: SparkSession, path: str) -> DataFrame:
    return _json_map(spark, path, "struct<doc_id:string,source:string,file:string,sha256:string>").select(
        F.col("key").alias("doc_id"), "value.source", "value.file", "value.sha256")


def load_versions(spark: SparkSession, path: str) -> DataFrame:
    return _json_map(spark, path, "string").select(F.col("key").alias("old_id"), F.col("value").alias("new_id"))


def load_evidence(spark: SparkSession, path: str) -> DataFrame:
    """``question_id, part_idx, phrasing``; a part may list phrasings.  Keys that start with an
    underscore are notes."""
    parts = _json_map(spark, path, "string").where(~F.startswith(F.col("key"), F.lit("_")))
    listed = parts.select(F.col("key").alias("question_id"), F.posexplode(F.from_json("value", "array<string>")).alias("part_idx", "p"))
    phrasings = F.coalesce(F.when(F.startswith(F.col("p"), F.lit("[")), F.from_json("p", "array<string>")), F.array("p"))
    return listed.select("question_id", "part_idx", F.explode(phrasings).alias("phrasing"))


def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names of a folder's log files: JSON lines, neither grades nor hidden."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder).select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("name"))
    return files.where(~F.endswith(F.col("name"), F.lit("-grades")) & ~F.startswith(F.col("name"), F.lit("."))).orderBy("name")


PageParser = Callable[[bytes], Iterable[str | None]]


def pdf_pages(content: bytes) -> Iterable[str | None]:
    """Texts of a PDF's pages, if a PDF library is installed."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        yield from (p.extract_text() for p in pdf.pages)


def load_pages(
    spark: SparkSession, folder: str, source: str, parser: PageParser = pdf_pages, glob: str = "*.pdf", first_page: int = 1,
    references: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, source, page_num, text`` of all files of a folder.

    The id is the reference on the file's cover sheet, where ``references`` (path, doc_ref)
    has one that is not empty, or else the file's stem.  ``first_page=2`` leaves a cover
    sheet out.  A page without text is empty.
    """
    from quillmark.operators.cover import document_id

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")

    def pages(batches):
        for batch in batches:
            rows = [(path, i, text or "") for path, content in batch.itertuples(index=False) for i, text in enumerate(parser(content), 1)]
            yield pd.DataFrame(rows, columns=["path", "page_num", "text"])

    read = files.mapInPandas(pages, "path string, page_num int, text string").where(F.col("page_num") >= first_page)
    if references is None:
        read = read.withColumn("doc_ref", F.lit(None).cast("string"))
    else:
        read = read.join(references.select("path", "doc_ref"), "path", "left")
    return read.select(document_id(F.col("doc_ref"), F.col("path")).alias("doc_id"), F.lit(source).alias("source"), "page_num", "text")


def union_corpora(*parts: DataFrame) -> DataFrame:
    """Corpora one after the other, ``ordinal`` telling which."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("ordinal", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def pdf_links(html: Column, heading: str, base: str) -> Column:
    """Absolute links to PDFs between a heading and the next h2 or h3, each once, in order."""
    after = F.regexp_extract(html, r"(?is)<h[1-6][^>]*>[^<]*" + heading + r"[^<]*</h[1-6]>(.*?)(?=<h[23]\b|\z)", 1)
    hrefs = F.regexp_extract_all(after, F.lit(r"(?i)<a\b[^>]*?href=[\"']([^\"']+)[\"']"), F.lit(1))
    root = "/".join(base.split("/")[:3])
    absolute = F.transform(hrefs, lambda u: F.when(u.rlike("^https?://"), u).when(F.startswith(u, F.lit("/")), F.concat(F.lit(root), u))
                           .otherwise(F.concat(F.lit(base.rsplit("/", 1)[0] + "/"), u)))
    return F.array_distinct(F.filter(absolute, lambda u: F.lower(F.regexp_replace(u, r"[?#].*$", "")).endswith(".pdf")))


def clean_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def fetched_files(links: DataFrame, existing: DataFrame, fetch: Callable[[str], bytes | None]) -> DataFrame:
    """``file, url, content`` of linked documents that are not there yet.

    ``links`` has ``url``, ``existing`` the names ``file`` of the files there are.  ``fetch``
    is any function from a url to its bytes, null where it failed; bodies that do not begin
    like a PDF are left out.  Each url is fetched once.
    """
    name = clean_filename(F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]*)$", 1))
    todo = links.select("url").distinct().select(name.alias("file"), "url").join(existing.select("file").distinct(), "file", "left_anti")

    @F.pandas_udf("binary")
    def body(urls: pd.Series) -> pd.Series:
        return urls.map(fetch)

    found = todo.withColumn("content", body("url"))
    return found.where(F.col("content").isNotNull() & (F.substring("content", 1, 4) == F.lit(b"%PDF")))
