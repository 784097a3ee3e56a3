"""Registered queries: the library's operators over views of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import headings as h
from quillmark.functions import stats
from quillmark.functions import text as t
from quillmark.operators import gridlog as g
from quillmark.operators import metrics as m
from quillmark.operators import retrieval as r
from quillmark.operators import sections as s
from quillmark.plans.oracles import SQL
from quillmark.plans.views import view, with_views
from quillmark.session import read_table
from quillmark.sources.readers import union_corpora

FLAGSHIP = "context_filtered"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def _last(spark, d) -> DataFrame:
    return g.last_wins(view(spark, d, "v_rows"))


def _current(spark, d, external: bool = False) -> DataFrame:
    return g.drop_stale(_last(spark, d), view(spark, d, "v_config"), external)


def _expected(spark, d) -> DataFrame:
    return g.attach_expectations(_current(spark, d), view(spark, d, "v_questions"))


def _grades(spark, d, version: str = "v2") -> DataFrame:
    return g.last_wins(view(spark, d, "v_grades").where(F.coalesce("judge_version", F.lit("v1")) == version))


def _graded(spark, d) -> DataFrame:
    return m.grade_for(_expected(spark, d), _grades(spark, d))


# ---- log ----

@query
def load_rows_last_wins(spark, d):
    return _last(spark, d).select("config_id", "question_id", "seq", "first_seq", "answer", "error")


@query
def drop_stale(spark, d):
    return _current(spark, d).select("config_id", "question_id", "seq", "config_fingerprint")


@query
def stale_counts(spark, d):
    return g.mark_stale(_last(spark, d), view(spark, d, "v_config")).groupBy("config_id").agg(
        F.count_if("stale").alias("dropped"), F.count_if(~F.col("stale")).alias("kept"))


@query
def rows_and_external(spark, d):
    return _current(spark, d, True).groupBy("config_id").agg(F.count(F.lit(1)).alias("n"))


@query
def attach_expectations(spark, d):
    return _expected(spark, d).select(
        "config_id", "question_id", "category", F.array_join("expected_doc_ids", ",").alias("expected"),
        F.array_join("injection_doc_ids", ",").alias("planted"), "expected_answer_summary", "notes", "question")


@query
def row_flags(spark, d):
    return _expected(spark, d).select(
        "config_id", "question_id", g.answered().alias("answered"), g.must_refuse().alias("must_refuse"),
        (g.answered() & g.must_refuse()).alias("answers_the_unanswerable"),
        (g.answered() & (g.must_refuse() | g.cites_injection())).alias("unsupported"), g.gradeable().alias("gradeable"))


@query
def cited_docs(spark, d):
    return _last(spark, d).select("config_id", "question_id", F.array_join(g.cited_doc_ids(), ",").alias("cited"),
                                  g.cites_injection().alias("cites_planted"), g.retrieved_injection().alias("retrieved_planted"))


@query
def completed(spark, d):
    return g.completed(view(spark, d, "v_rows"), view(spark, d, "v_config"))


@query
def pending_work(spark, d):
    c = view(spark, d, "v_config")
    return g.pending_work(view(spark, d, "v_questions"), c, g.completed(view(spark, d, "v_rows"), c), "clean")


@query
def stratified_quota(spark, d):
    return g.stratified_quotas(view(spark, d, "v_questions"), 40)


@query
def cache_keys(spark, d):
    rows = _last(spark, d)
    tag = t.corpus_tag(F.col("corpus_includes_injected"))
    return rows.select(
        "config_id", "question_id", t.row_cache_key(F.col("config_id"), F.coalesce("config_fingerprint", F.lit("none")), tag, F.col("question_id")).alias("row_key"),
        t.grade_cache_key(F.col("question_id"), F.coalesce("answer", F.lit(""))).alias("grade_key"),
        t.claim_cache_key(F.col("config_id"), F.coalesce("answer", F.lit("")), F.get("retrieved_chunk_ids", F.lit(0))).alias("claim_key"))


@query
def audit_candidates(spark, d):
    """First gradeable row per question, before any sampling."""
    rows = _expected(spark, d).where(g.gradeable())
    return rows.groupBy("question_id").agg(F.min_by("config_id", F.col("first_seq")).alias("config_id"), F.min("first_seq").alias("first_seq"))


@query
def merge_grades(spark, d):
    a, b = _grades(spark, d, "v1"), _grades(spark, d, "v2")
    return g.merge_right(a, b, ("config_id", "question_id")).select("config_id", "question_id", "verdict", "judge_version")


# ---- scorecards ----

@query
def score_grid(spark, d):
    out = m.score_grid(_expected(spark, d))
    ints = [c for c, k in out.dtypes if k in ("string", "bigint")]
    return out.select(*ints, *_r6(*[c for c in out.columns if c not in ints]))


@query
def error_floor_curve(spark, d):
    return m.coverage_error_points(m.score_grid(_expected(spark, d))).select("config_id", *_r6("coverage", "error_floor"))


@query
def median_latency(spark, d):
    return m.score_grid(_expected(spark, d)).select("config_id", *_r6("median_latency"))


@query
def verdict_counts(spark, d):
    return m.verdict_counts(_current(spark, d)).select("config_id", "verdict", "n", *_r6("share"))


@query
def wilson(spark, d):
    rows = _expected(spark, d).where(g.succeeded()).groupBy("config_id").agg(
        F.count(F.lit(1)).alias("n"), stats.safe_rate(stats.count_true(g.answered()), F.count(F.lit(1))).alias("rate"))
    return rows.select("config_id", "n", *_r6("rate"), F.round(stats.wilson_halfwidth(F.col("rate"), F.col("n")), 6).alias("half"))


@query
def grades_accuracy(spark, d):
    a = m.accuracy(F.col("verdict"))
    return _grades(spark, d).groupBy("config_id").agg(a["graded"].alias("graded"), F.round(a["correct_rate"], 6).alias("correct_rate"),
                                                      F.round(a["wrong_rate"], 6).alias("wrong_rate"))


@query
def grade_text_join(spark, d):
    return _graded(spark, d).select("config_id", "question_id", "verdict")


@query
def ladder_table(spark, d):
    return m.ladder_table(_graded(spark, d)).select(
        "config_id", "n", "answered", "due", "graded", *_r6("coverage", "error_floor", "accuracy", "coverage_half"))


@query
def injection_table(spark, d):
    return m.injection_table(_graded(spark, d)).select(
        "config_id", "asked", "graded", *_r6("retrieved", "cited", "cited_of_answers", "only_planted", "obeyed", "accuracy"))


@query
def injection_outcomes(spark, d):
    return m.injection_outcomes(_expected(spark, d)).groupBy("config_id", "worst").agg(F.count(F.lit(1)).alias("n"))


@query
def injection_by_style(spark, d):
    """Summary by the category that stands in for the style of the planted document."""
    rows = _expected(spark, d)
    o = m.injection_outcomes(rows).join(rows.select("config_id", "question_id", "category"), ["config_id", "question_id"])
    return m.injection_summary(o, "category").select("category", "asked", *_r6("retrieved_rate", "cited_rate", "obeyed_rate"))


@query
def gate_outcomes(spark, d):
    return m.gate_outcomes(_graded(spark, d))


@query
def why_wrong(spark, d):
    old = view(spark, d, "v_versions").select("old_id")
    return m.why_wrong(_graded(spark, d), old).select("config_id", "wrong", *_r6("had_document", "cited_old"))


@query
def frontier_pair(spark, d):
    rows = _graded(spark, d)
    base, other = rows.where("config_id = 'V-view'"), rows.where("config_id = 'E-error'")
    return m.frontier_pair(base, other).select("side", "n", "graded", *_r6("refused_answerable", "answered_must_refuse", "cites", "accuracy"))


@query
def paired_wins(spark, d):
    return m.paired_wins(_graded(spark, d), "V-view", "E-error")


@query
def confidence_corr(spark, d):
    return m.confidence_correlation(_graded(spark, d)).select("component", "n", *_r6("r"))


@query
def separation(spark, d):
    return m.separation(m.scored(_graded(spark, d))).select("component", "n_right", "n_wrong", *_r6("mean_right", "mean_wrong", "gap"))


@query
def threshold_sweep(spark, d):
    return m.threshold_sweep(m.scored(_graded(spark, d)), 0.25).select("step", "answered", "total", *_r6("threshold", "coverage", "error_rate"))


@query
def best_threshold(spark, d):
    points = m.threshold_sweep(m.scored(_graded(spark, d)), 0.25)
    return m.best_threshold(points, 0.7).select("step", "answered", *_r6("threshold", "coverage"))


@query
def kappa(spark, d):
    return m.kappa(view(spark, d, "v_labels"), "human", "judge").select("n", *_r6("observed", "expected", "kappa"))


@query
def confusion(spark, d):
    return m.confusion(view(spark, d, "v_labels"), "human", "judge", ["CORRECT", "PARTIAL", "INCORRECT"])


@query
def composite_abstain(spark, d):
    rows = _current(spark, d).where("composite is not null and retrieval is not null")
    c = stats.composite(F.col("retrieval"), F.col("composite"), F.lit(0.5))
    return rows.select("config_id", "question_id", F.round(c, 6).alias("signal"), stats.should_abstain(F.round(c, 6), 0.5).alias("abstain"))


@query
def groundedness(spark, d):
    from quillmark.operators.answers import all_supported
    from quillmark.operators.answers import groundedness as grounded

    return _last(spark, d).select("config_id", "question_id", F.round(grounded(F.col("verdicts")), 6).alias("groundedness"),
                                  all_supported(F.col("verdicts")).alias("all_supported"))


@query
def jaccard_agreement(spark, d):
    """Agreement of what a question's rows cite, over all configurations."""
    rows = _last(spark, d).groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("config_id", g.cited_doc_ids().alias("cited")))).alias("x"))
    return rows.select("question_id", F.round(stats.pairwise_jaccard(F.transform("x", lambda x: x["cited"])), 6).alias("overlap"))


# ---- text ----

@query
def tokenize(spark, d):
    docs = read_table(spark, f"{d}/documents.parquet")
    tokens = t.tokenize(F.col("text"))
    return docs.select("doc_id", F.size(tokens).alias("n"), F.md5(F.array_join(tokens, " ").cast("binary")).alias("digest"),
                       t.count_tokens(F.col("text")).alias("words"))


@query
def citation_ids(spark, d):
    return view(spark, d, "v_answers").select("conv_id", "turn", F.array_join(t.citation_ids(F.col("text")), "|").alias("ids"))


@query
def claim_sentences(spark, d):
    claims = view(spark, d, "v_answers").select("conv_id", "turn", F.posexplode(t.split_claims("text")).alias("pos", "c"))
    return claims.select("conv_id", "turn", "pos", "c.chunk_id", "c.claim_text")


@query
def parse_verdict(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    text = F.concat(F.lit("it is "), F.element_at(F.array(*map(F.lit, ("supported", "unsupported", "partial", "incorrect", "unanswerable", "?"))),
                                                  (F.col("o_orderkey") % 6 + 1).cast("int")), F.lit(" by "), F.col("o_orderpriority"))
    return orders.select("o_orderkey", t.parse_verdict(text).alias("verdict"), t.parse_grade(text).alias("grade"), t.parse_answerability(text).alias("answerability"))


@query
def signatures(spark, d):
    rows = _last(spark, d)
    found = t.obeyed_signatures(F.concat(F.coalesce("answer", F.lit("")), F.when(F.col("seq") % 40 == 0, " see https://x.invalid/a").otherwise("")))
    return rows.select("config_id", "question_id", F.array_join(found, ",").alias("signatures"))


@query
def cite_labels(spark, d):
    chunks = view(spark, d, "v_chunks")
    section = F.when(F.col("row_id") % 3 == 0, (F.col("row_id") % 10).cast("string"))
    start = (F.col("row_id") % 9 + 1).cast("int")
    return chunks.select("chunk_id", t.cite_label(F.col("doc_id"), section, start, start + (F.col("row_id") % 2).cast("int")).alias("label"))


# ---- corpus ----

@query
def boilerplate(spark, d):
    return s.boilerplate(view(spark, d, "v_pages"))


@query
def stripped_pages(spark, d):
    pages = s.strip_boilerplate(view(spark, d, "v_pages"))
    return pages.select("doc_id", "page_num", F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def toc_pages(spark, d):
    pages = view(spark, d, "v_pages")
    page = F.when(F.col("page_num") % 7 == 0, F.concat(F.lit("\n  Contents \n"), F.col("text"))).otherwise(F.col("text"))
    return pages.select("doc_id", "page_num", h.is_contents_page(page).alias("is_toc"))


@query
def numbered_headings(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet")
    name = F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_name")).otherwise(F.col("p_name"))
    line = F.concat((F.col("p_size") % 9 + 1).cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("."), (F.col("p_size") % 4).cast("string"))).otherwise(""),
                    F.lit(" "), name)
    found = h.numbered_heading(line, F.col("p_partkey") % 5 == 0)
    return parts.select("p_partkey", found["section_no"].alias("section_no"), found["heading"].alias("heading"),
                        h.section_level(found["section_no"]).alias("level"))


@query
def section_level(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(
        F.col("l_linenumber").cast("string"), F.lit("."), (F.col("l_suppkey") % 5).cast("string"),
        F.when(F.col("l_partkey") % 2 == 0, ".0").otherwise("")).alias("section_no")).groupBy("section_no").agg(F.count(F.lit(1)).alias("n"))
    return items.select("section_no", "n", h.section_level(F.col("section_no")).alias("level"))


@query
def token_histogram(spark, d):
    docs = read_table(spark, f"{d}/documents.parquet")
    return m.token_histogram(docs.select(t.count_tokens(F.col("text")).alias("token_count")))


@query
def document_chunks(spark, d):
    """The section machine over pages with numbered lines put in."""
    pages = view(spark, d, "v_pages")
    text = F.concat(F.col("page_num").cast("string"), F.lit(". Part Heading\n"), F.col("text"))
    return s.with_labels(s.chunk_documents(pages.withColumn("text", text)))


@query
def union_corpora_counts(spark, d):
    chunks = view(spark, d, "v_chunks")
    planted = chunks.where("row_id % 10 = 0").withColumn("doc_id", F.concat(F.lit("INJ-"), F.col("doc_id")))
    return union_corpora(chunks, planted).groupBy("ordinal", "doc_id").agg(F.count(F.lit(1)).alias("n"))


# ---- retrieval ----

def _vectors(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id"), F.col("embedding"))
    return e


def _embedded_chunks(spark, d):
    """All chunks; the vector of the same number, where there is one."""
    return view(spark, d, "v_chunks").join(_vectors(spark, d), F.col("row_id") == F.col("vec_id"), "left").withColumn("cite_label", F.col("chunk_id"))


def _embedded_questions(spark, d):
    return view(spark, d, "v_questions_text").join(_vectors(spark, d), F.col("question_id") == F.col("vec_id"), "left")


@query
def bm25_topk(spark, d):
    return r.bm25_topk(view(spark, d, "v_chunks"), view(spark, d, "v_questions_text"), 20).select("question_id", "rank", "chunk_id", *_r6("score"))


@query
def dense_topk(spark, d):
    return r.dense_topk(_embedded_chunks(spark, d), _embedded_questions(spark, d), 20).select("question_id", "rank", "chunk_id", *_r6("score"))


@query
def rrf_fuse(spark, d):
    return r.hybrid_topk(_embedded_chunks(spark, d), _embedded_questions(spark, d), 20).select("question_id", "rank", "chunk_id", *_r6("score"))


@query
def context_filtered(spark, d):
    """BM25 and dense ranks fused, unregistered and superseded documents left out, six passages."""
    chunks = _embedded_chunks(spark, d)
    hits = r.hybrid_topk(chunks, _embedded_questions(spark, d), 20).select("question_id", "chunk_id", "rank", "score")
    hits = hits.join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    register = view(spark, d, "v_register")
    old = r.superseded_ids(view(spark, d, "v_versions"), register)
    return r.narrow(hits, 6, register, old).select("question_id", "rank", "chunk_id", "doc_id", *_r6("score"))


@query
def superseded_ids(spark, d):
    return r.superseded_ids(view(spark, d, "v_versions"), view(spark, d, "v_register"))


@query
def retrieval_confidence(spark, d):
    hits = r.dense_topk(_embedded_chunks(spark, d), _embedded_questions(spark, d), 6)
    scores = hits.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    return scores.select("question_id", F.round(stats.retrieval_confidence(F.col("scores")), 6).alias("confidence"))


@query
def recall_mrr(spark, d):
    """Are a question's vector neighbours of its own label?"""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    chunks = e.select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("chunk_id"), "embedding", "label")
    dims = F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)])
    asked = e.groupBy("label").agg(dims.alias("embedding")).select(F.col("label").alias("question_id"), "embedding")
    hits = r.dense_topk(chunks, asked, 10).join(chunks.select("chunk_id", "label"), "chunk_id")
    relevant = asked.select("question_id", F.col("question_id").alias("label"))
    return m.ranking_quality(hits, relevant, 5, ["label"]).select("questions", *_r6("top1", "hit_at_k", "mrr"))


@query
def evidence_recall(spark, d):
    chunks = view(spark, d, "v_chunks")
    hits = r.bm25_topk(chunks, view(spark, d, "v_questions_text"), 10).join(chunks.select("chunk_id", "text"), "chunk_id")
    evidence = view(spark, d, "v_questions_text").select("question_id", F.lit(0).alias("part_idx"), F.col("question").alias("phrasing"))
    return m.evidence_recall(hits, evidence, 10)


@query
def register_tamper(spark, d):
    docs = read_table(spark, f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("content"))
    files = docs.where("cast(doc_id as int) % 9 <> 4").select(F.col("doc_id").alias("file"), "content")
    register = docs.select("doc_id", F.col("doc_id").alias("file"), F.when(F.expr("cast(doc_id as int) % 11 = 3"), "00").otherwise(F.sha2("content", 256)).alias("sha256"))
    return m.find_tampering(register, files)


@query
def pdf_links(spark, d):
    from quillmark.sources.readers import clean_filename
    from quillmark.sources.readers import pdf_links as links

    pages = read_table(spark, f"{d}/pages.parquet")
    html = F.concat(F.lit("<h2>Policies</h2><a href='/a%d:x.pdf'>"), F.col("page_id").cast("string"), F.lit("</a><a href='b.PDF?x=1'></a><h2>Other</h2><a href='c.pdf'></a>"))
    found = links(html, "Policies", "https://x.example/docs/index.html")
    return pages.select("page_id", F.array_join(found, "|").alias("links"), clean_filename(F.get(found, F.lit(0))).alias("file"))


@query
def ladder_answers(spark, d):
    """All questions under the last rung, with the local stand-in models."""
    from quillmark.operators.answers import answer_questions
    from quillmark.plans.config import ladder

    register = view(spark, d, "v_register")
    return answer_questions(_embedded_questions(spark, d), _embedded_chunks(spark, d), ladder()[-1], None, register,
                            r.superseded_ids(view(spark, d, "v_versions"), register))


def queries() -> dict[str, Query]:
    from quillmark.plans import catalog_extra

    return _QUERIES | catalog_extra.QUERIES


def oracle_sql() -> dict[str, str]:
    from quillmark.plans import catalog_extra

    return {name: with_views(sql) for name, sql in (SQL | catalog_extra.SQL).items()}
