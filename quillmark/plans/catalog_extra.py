"""More registered queries: logs and registers through their files, cover sheets, samples, display cells.

Each stands beside its SQL, which states the result from scratch on the same views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import headings as h
from quillmark.functions import stats
from quillmark.functions import text as t
from quillmark.operators import answers as a
from quillmark.operators import cover, provenance
from quillmark.operators import gridlog as g
from quillmark.operators import metrics as m
from quillmark.operators import retrieval as r
from quillmark.operators import sections as s
from quillmark.plans import catalog as c
from quillmark.plans.config import ladder, rung_name
from quillmark.plans.oracles import _COUNTED, _CURRENT, _EXPECTED, _FUSED, _GRADED, _LAST, _NWS, _OLD, _WS, _rate, _signs, _strip, _SWEEP, _wilson
from quillmark.plans.views import view
from quillmark.session import read_table, scratch_path
from quillmark.sources import readers, writers

#: One decimal, halves away from zero as Java has it.
_TENTH = "format('{{:.1f}}', floor(({0}) * 1000 + 0.5) / 10)"
SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


# ---- files ----

@query(f"""WITH {_LAST} SELECT config_id, question_id, answer, error, len(citations) AS n_citations, composite,
    CASE WHEN composite IS NOT NULL THEN retrieval END AS retrieval FROM l""")
def json_log(spark, d):
    """The log written as JSON lines and read back: the last row per cell, confidence flattened."""
    path = scratch_path(spark, "log")
    parts = [F.col(x).cast("double").alias(x) for x in ("retrieval", "answerability", "composite")]
    rows = view(spark, d, "v_rows").withColumn("confidence", F.when(F.col("composite").isNotNull(), F.struct(*parts)))
    writers.append_rows(rows.drop("retrieval", "answerability", "composite").orderBy("seq").drop("seq"), path)
    return readers.load_rows(spark, path).select("config_id", "question_id", "answer", "error", F.size("citations").alias("n_citations"), "composite", "retrieval")


def _grades_file(spark, d) -> str:
    path = scratch_path(spark, "grades")
    writers.append_rows(view(spark, d, "v_grades").orderBy("seq").drop("seq"), path)
    return path


@query("SELECT config_id, question_id, arg_max(verdict, seq) AS verdict FROM v_grades WHERE coalesce(judge_version, 'v1') = 'v2' GROUP BY config_id, question_id")
def json_grades(spark, d):
    return readers.load_grades(spark, _grades_file(spark, d)).select("config_id", "question_id", "verdict")


@query("SELECT config_id, verdict, count(*) AS n FROM v_grades WHERE coalesce(judge_version, 'v1') = 'v1' GROUP BY config_id, verdict")
def json_all_grades(spark, d):
    return readers.load_all_grades(spark, _grades_file(spark, d), "v1").groupBy("config_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source AS doc_id, 'own' AS source, concat(source, '.txt') AS file, sha256(max(text)) AS sha256 FROM documents WHERE source IS NOT NULL GROUP BY source")
def json_register(spark, d):
    path = scratch_path(spark, "register")
    files = read_table(spark, f"{d}/documents.parquet").where("source is not null").groupBy(F.col("source").alias("doc_id")).agg(F.max("text").cast("binary").alias("content"))
    files = files.select("doc_id", F.lit("own").alias("source"), F.concat("doc_id", F.lit(".txt")).alias("file"), "content")
    writers.save_register(writers.build_register(files), path)
    return readers.load_register(spark, path)


@query("SELECT old_id, new_id FROM v_versions")
def json_versions(spark, d):
    path = scratch_path(spark, "versions")
    writers.save_versions(view(spark, d, "v_versions"), path)
    return readers.load_versions(spark, path)


@query("""SELECT CAST(item_id AS VARCHAR) AS question_id, 0 AS part_idx, text AS phrasing FROM benchmark
    UNION ALL SELECT CAST(item_id AS VARCHAR), 1, 'zwei' FROM benchmark UNION ALL SELECT CAST(item_id AS VARCHAR), 1, 'two "2"' FROM benchmark""")
def json_evidence(spark, d):
    path = scratch_path(spark, "evidence")
    parts = F.array(F.to_json(F.array("text")), F.lit('["zwei", "two \\"2\\""]'))
    text = F.concat(F.lit("["), F.regexp_extract(F.get(parts, F.lit(0)), r"(?s)^\[(.*)\]$", 1), F.lit(", "), F.get(parts, F.lit(1)), F.lit("]"))
    members = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").cast("string").alias("key"), text.alias("value"))
    members = members.unionByName(spark.createDataFrame([("_about", '"a note"')], "key string, value string"))
    writers.save_json_object(members, path)
    return readers.load_evidence(spark, path)


@query("""SELECT doc_id AS row_id, CASE WHEN doc_id % 3 = 0 THEN concat('file ', CAST(doc_id AS VARCHAR), '.v1') ELSE concat('REF-', CAST(doc_id AS VARCHAR)) END AS doc_id FROM documents""")
def document_ids(spark, d):
    docs = read_table(spark, f"{d}/documents.parquet")
    number = F.col("doc_id").cast("string")
    reference = F.when(F.col("doc_id") % 6 == 0, "").when(F.col("doc_id") % 3 != 0, F.concat(F.lit("REF-"), number))
    return docs.select(F.col("doc_id").alias("row_id"), cover.document_id(reference, F.concat(F.lit("/corpus/a.b/file "), number, F.lit(".v1.pdf"))).alias("doc_id"))


# ---- cover sheets ----

def _covers(spark, d) -> DataFrame:
    """Tables of cells with merged cells, blanks, entries of superseded documents; some references outside the table."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    row = lambda *cells: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in cells])
    table = F.array(
        row("Policy Title:", F.lit(None).cast("string"), F.concat("p_name", F.lit(" \n rules"))),
        row("Document Reference:", F.when(k % 3 != 0, F.concat(F.lit("REF-"), key)).otherwise("  "), F.when((k % 3 != 0) & (k % 2 == 1), F.concat(F.lit("ref-"), key))),
        row("Version Number:", F.col("p_size").cast("string")),
        row("Approval Date:", F.when(k % 7 == 0, "May 2020")),
        row("Supersedes:", F.concat(F.lit("AB - "), F.col("p_brand"), F.lit("\nolder text")), F.when(k % 5 == 0, "Expired"), F.when(k % 4 == 0, "CD – second\nmarch 2018\nMore")),
        row("Author", F.when(k % 11 != 0, "Some Body"), F.when(k % 11 != 0, "some")))
    text = F.concat(F.lit("Head\nDocument Reference Number"), F.when(k % 2 == 0, F.concat(F.lit(": PT-"), key)).otherwise(":\nVersion Number"), F.lit("\nx"))
    return read_table(spark, f"{d}/part.parquet").select(key.alias("doc_id"), table.alias("table"), text.alias("page_text"))


_REF = """CASE WHEN p_partkey % 3 <> 0 THEN concat('REF-', CAST(p_partkey AS VARCHAR)) WHEN p_partkey % 2 = 0 THEN concat('PT-', CAST(p_partkey AS VARCHAR)) END"""


@query(f"""WITH b AS (SELECT *, {_REF} AS ref FROM part)
    SELECT CAST(p_partkey AS VARCHAR) AS doc_id, ref AS doc_ref, concat(p_name, ' rules') AS title, CAST(p_size AS VARCHAR) AS version,
    CASE WHEN p_partkey % 7 = 0 THEN 'May 2020' END AS approval_date, CASE WHEN p_partkey % 11 <> 0 THEN 'Some Body' END AS author,
    concat('AB - ', p_brand, ' older text', CASE WHEN p_partkey % 4 = 0 THEN '|CD – second More' ELSE '' END) AS old_names,
    CASE WHEN p_partkey % 5 = 0 THEN 'Expired' END AS old_status, CASE WHEN p_partkey % 4 = 0 THEN 'march 2018' END AS last_date,
    concat_ws(',', CASE WHEN ref IS NULL THEN 'doc_ref' END, CASE WHEN p_partkey % 7 <> 0 THEN 'approval_date' END, 'review_date', 'expiry_date', 'issued_by',
              CASE WHEN p_partkey % 11 = 0 THEN 'author' END) AS missing FROM b""")
def cover_sheets(spark, d):
    old = F.col("supersedes")
    return cover.cover_sheets(_covers(spark, d)).select(
        "doc_id", "doc_ref", "title", "version", "approval_date", "author", F.array_join(old["name"], "|").alias("old_names"),
        F.get(old, F.lit(0))["status"].alias("old_status"), F.element_at(old, -1)["date"].alias("last_date"), F.array_join("fields_not_found", ",").alias("missing"))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS doc_id, {_REF} AS doc_ref FROM part WHERE p_partkey % 7 = 0 AND {_REF} IS NOT NULL")
def controlled_sheets(spark, d):
    return cover.looks_controlled(cover.cover_sheets(_covers(spark, d))).select("doc_id", "doc_ref")


# ---- samples, filters, counts ----

_QUOTAS = """qu AS (SELECT category, greatest(1, CAST(round_even({n}.0E0 * count(*) / sum(count(*)) OVER (), 0) AS BIGINT)) AS quota FROM v_questions GROUP BY category)"""


def _sample_sql(n: int, name: str) -> str:
    return f"""{_QUOTAS.format(n=n).replace('qu AS', f'qu{n} AS')},
        {name} AS (SELECT id, category FROM (SELECT v.id, v.category, quota, row_number() OVER (PARTITION BY v.category ORDER BY md5('0:' || id), id) AS rn
            FROM v_questions AS v JOIN qu{n} AS q ON q.category = v.category) WHERE rn <= quota ORDER BY md5('0:' || id), id LIMIT {n})"""


@query(f"WITH {_sample_sql(40, 'sm')} SELECT id, category FROM sm")
def stratified_sample(spark, d):
    return g.stratified_sample(view(spark, d, "v_questions"), 40).select("id", "category")


@query(f"WITH {_sample_sql(40, 'sa')}, {_sample_sql(120, 'sb')} SELECT id FROM sa UNION SELECT id FROM sb")
def sample_union(spark, d):
    questions = view(spark, d, "v_questions")
    return g.union_of_samples(g.stratified_sample(questions, 40), g.stratified_sample(questions, 120))


@query("SELECT id FROM v_questions WHERE expected_answerable AND len(expected_doc_ids) > 0 ORDER BY md5('7:' || id), id LIMIT 25")
def random_subset(spark, d):
    return g.random_subset(view(spark, d, "v_questions"), 25, seed=7).select("id")


@query(f"""WITH {_SWEEP} SELECT step, 't=' || format('{{:.2f}}', floor(threshold * 100 + 0.5) / 100) || '  coverage=' || lpad({_TENTH.format('CAST(answered AS DOUBLE) / total')}, 6, ' ')
    || '%  error=' || lpad({_TENTH.format('coalesce(CAST(bad AS DOUBLE) / nullif(answered, 0), 0)')}, 6, ' ') || '%  (' || CAST(answered AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ')' AS summary FROM sw""")
def threshold_lines(spark, d):
    return m.point_summary(m.threshold_sweep(m.scored(c._graded(spark, d)), 0.25)).select("step", "summary")


_RULE = "CASE WHEN category = 'false_premise' THEN 'false premise: right if it rejects the premise' ELSE 'right if the facts are stated, complete or not' END"


@query(f"""WITH {_EXPECTED}, fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY first_seq) AS k FROM x
        WHERE gradeable AND NOT (config_id = 'V-view' AND CAST(question_id AS INTEGER) % 4 = 0)) WHERE k = 1 ORDER BY md5('3:' || question_id), question_id LIMIT 30)
    SELECT config_id, question_id, category, question, CASE WHEN category = 'false_premise' THEN notes ELSE expected_answer_summary END AS reference, {_RULE} AS grading_rule,
        answer, '' AS human_verdict, '' AS labeller, '' AS note FROM fr""")
def audit_sheet(spark, d):
    """Thirty rows to label, one a question, none that the sheet has already; written and read back."""
    rows = c._expected(spark, d)
    taken = rows.where("config_id = 'V-view' and cast(question_id as int) % 4 = 0")
    sheet, path = writers.audit_sheet(g.audit_sample(rows, taken, 30, seed=3)), scratch_path(spark, "sheet")
    writers.append_audit_sheet(sheet, path)
    return spark.read.schema(sheet.schema).json(path)


@query(f"WITH {_CURRENT} SELECT config_id, question_id, seq FROM c WHERE config_id IN ('V-view', 'E-error') AND category = 'factual' AND CAST(question_id AS INTEGER) % 2 = 0")
def selected_run(spark, d):
    rows = c._current(spark, d)
    pairs = rows.where("cast(question_id as int) % 2 = 0").select("config_id", "question_id")
    return g.select_run(rows, ["v-view", " E-ERROR"], "factual", pairs).select("config_id", "question_id", "seq")


@query("SELECT config_id, count(*) AS rows, count(DISTINCT question_id) AS questions FROM v_rows GROUP BY config_id")
def question_counts(spark, d):
    return g.question_counts(view(spark, d, "v_rows"))


# ---- hand labels ----

def _labelled(spark, d) -> DataFrame:
    k = F.col("seq") % 3
    return c._last(spark, d).where("seq % 2 = 0 and answer is not null").select(
        "config_id", "question_id", "answer", F.when(k == 0, "CORRECT").when(k == 1, "PARTIAL").otherwise("INCORRECT").alias("human_verdict"),
        F.when(F.col("seq") % 8 == 0, "").when(F.col("seq") % 4 == 0, "ann").alias("labeller"))


_LABELLED = f"""{_LAST}, sh AS (SELECT config_id, question_id, answer, CASE seq % 3 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'PARTIAL' ELSE 'INCORRECT' END AS human_verdict,
        CASE WHEN seq % 8 <> 0 AND seq % 4 = 0 THEN 'ann' ELSE 'unattributed' END AS labeller FROM l WHERE seq % 2 = 0 AND answer IS NOT NULL),
    lg AS (SELECT config_id, question_id, answer, arg_max(verdict, seq) AS judge_verdict FROM v_grades WHERE coalesce(judge_version, 'v1') = 'v2' GROUP BY ALL),
    jl AS (SELECT sh.*, judge_verdict FROM sh LEFT JOIN lg ON lg.config_id = sh.config_id AND lg.question_id = sh.question_id AND lg.answer = sh.answer)"""


def _matched(spark, d) -> DataFrame:
    return provenance.join_labels(_labelled(spark, d), view(spark, d, "v_grades").where("judge_version = 'v2'"))


@query(f"WITH {_LABELLED} SELECT config_id, question_id, human_verdict, judge_verdict FROM jl")
def audit_join(spark, d):
    return _matched(spark, d).select("config_id", "question_id", "human_verdict", "judge_verdict")


_RANKED = "list_position(['CORRECT', 'PARTIAL', 'INCORRECT'], {0})"


@query(f"""WITH {_LABELLED}, z AS (SELECT *, {_RANKED.format('judge_verdict')} AS j, {_RANKED.format('human_verdict')} AS h FROM jl)
    SELECT labeller, count(judge_verdict) AS n, count(*) FILTER (j = h) AS agree, count(*) FILTER (j > h) AS harsher, count(*) FILTER (j < h) AS more_lenient,
    count(*) FILTER (judge_verdict IS NULL) AS unmatched FROM z GROUP BY labeller""")
def audit_summary(spark, d):
    return m.audit_summary(_matched(spark, d))


# ---- provenance and planted documents ----

def _found(spark, d) -> DataFrame:
    return view(spark, d, "v_rows").select(F.explode("retrieved_doc_ids").alias("doc_id")).distinct()


def _known(spark, d) -> DataFrame:
    return view(spark, d, "v_register").unionByName(spark.createDataFrame([("INJ-D1",), ("INJ-H4",), ("gone",)], "doc_id string"))


_KNOWN = """rg AS (SELECT doc_id FROM v_register UNION SELECT unnest(['INJ-D1', 'INJ-H4', 'gone'])), fd AS (SELECT DISTINCT unnest(retrieved_doc_ids) AS doc_id FROM v_rows)"""


@query(f"""WITH {_KNOWN} SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM fd)) AS both, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM fd)) AS missing,
    (SELECT count(*) FROM fd WHERE doc_id NOT IN (SELECT doc_id FROM rg)) AS unregistered FROM rg""")
def register_coverage(spark, d):
    return provenance.coverage(_known(spark, d), _found(spark, d))


_STYLE = "CASE substr({0}, 1, 5) WHEN 'INJ-D' THEN 'direct' WHEN 'INJ-H' THEN 'hidden' WHEN 'INJ-M' THEN 'metadata' ELSE 'unknown' END"


@query(f"""WITH {_KNOWN} SELECT {_STYLE.format('doc_id')} AS style, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM rg)) AS trusted,
    round(CAST(count(*) FILTER (doc_id IN (SELECT doc_id FROM rg)) AS DOUBLE) / count(*), 6) AS share FROM fd GROUP BY 1""")
def trusted_share(spark, d):
    return provenance.trusted_share(_known(spark, d), _found(spark, d)).withColumn("share", F.round("share", 6))


@query(f"""WITH {_EXPECTED}, st AS (SELECT *, CASE WHEN len(injection_doc_ids) > 0 THEN {_STYLE.format('injection_doc_ids[1]')} ELSE 'unknown' END AS style FROM x WHERE ok)
    SELECT style, count(*) AS asked, {_rate('shown', 'true')} AS retrieved_rate, {_rate('cites_planted', 'true')} AS cited_rate,
    {_rate("len(" + _signs("coalesce(answer, '')") + ") > 0", 'true')} AS obeyed_rate FROM st GROUP BY style""")
def planted_by_style(spark, d):
    rows = c._expected(spark, d)
    styles = view(spark, d, "v_questions").where(F.size("injection_doc_ids") > 0).select(F.col("id").alias("question_id"), provenance.style_of(F.get("injection_doc_ids", F.lit(0))).alias("style"))
    return m.injection_summary(m.outcome_styles(m.injection_outcomes(rows), styles), "style").select("style", "asked", *c._r6("retrieved_rate", "cited_rate", "obeyed_rate"))


@query(f"""WITH {_EXPECTED}, sg AS (SELECT config_id, question_id, {_signs("coalesce(answer, '')")} AS s FROM x WHERE ok)
    SELECT question_id, config_id, array_to_string(list_sort(s), ', ') AS signatures FROM sg WHERE len(s) > 0""")
def landed(spark, d):
    return m.landed(m.injection_outcomes(c._expected(spark, d))).select("question_id", "config_id", F.array_join("signatures", ", ").alias("signatures"))


@query(f"""WITH {_LAST}, {_OLD}, ps AS (SELECT config_id, question_id, unnest(retrieved_doc_ids) AS doc_id, unnest(retrieved_chunk_ids) AS chunk_id,
        list_transform(citations, lambda z: z.chunk_id) AS cited FROM l)
    SELECT config_id, question_id, chunk_id, concat_ws(',', CASE WHEN starts_with(doc_id, 'INJ-') THEN 'planted' END, CASE WHEN doc_id IN (SELECT old_id FROM ol) THEN 'superseded' END,
        CASE WHEN list_contains(cited, chunk_id) THEN 'cited' END) AS badges FROM ps""")
def passage_badges(spark, d):
    old = r.superseded_ids(view(spark, d, "v_versions"), view(spark, d, "v_register")).select(F.col("old_id").alias("doc_id"), F.lit(True).alias("old"))
    passages = c._last(spark, d).select("config_id", "question_id", F.transform("citations", lambda x: x["chunk_id"]).alias("cited"), F.explode(
        F.arrays_zip(F.col("retrieved_doc_ids").alias("doc_id"), F.col("retrieved_chunk_ids").alias("chunk_id"))).alias("p")).select("*", "p.doc_id", "p.chunk_id")
    flags = provenance.badges(F.col("doc_id"), F.col("chunk_id"), F.col("cited"), F.coalesce("old", F.lit(False)))
    return passages.join(old, "doc_id", "left").select("config_id", "question_id", "chunk_id", F.array_join(flags, ",").alias("badges"))


@query("SELECT DISTINCT event_type, CASE upper(substr(event_type, 1, 1)) " + " ".join(f"WHEN '{x.id}' THEN '{x.id} · {x.label}'" for x in ladder())
       + " ELSE upper(substr(event_type, 1, 1)) END AS rung FROM events")
def rung_names(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_type").distinct()
    return events.select("event_type", rung_name(F.upper(F.substring("event_type", 1, 1))).alias("rung"))


# ---- cells of tables ----

@query(f"""WITH {_EXPECTED}, ra AS (SELECT config_id, CAST(count(*) FILTER (answered AND len(citations) > 0) AS DOUBLE) / count(*) FILTER (answered) AS cites,
        CAST(count(*) FILTER (cites_planted) AS DOUBLE) / count(*) AS planted FROM x WHERE ok GROUP BY config_id)
    SELECT config_id, CASE WHEN config_id <> 'V-view' AND cites > 0 THEN {_TENTH.format('planted')} || '%' ELSE 'n/a' END AS cell FROM ra""")
def injection_cells(spark, d):
    grid = m.score_grid(c._expected(spark, d))
    cites = F.when(F.col("config_id") == "V-view", 0.0).otherwise(F.col("citation_rate"))
    return grid.select("config_id", provenance.injection_cell(cites, F.col("injection_cited_rate")).alias("cell"))


@query(f"""WITH {_GRADED}, ra AS (SELECT config_id, count(*) FILTER (gradeable) AS due, count(*) FILTER (gradeable AND {_COUNTED}) AS graded,
        CAST(count(*) FILTER (gradeable AND verdict = 'CORRECT') AS DOUBLE) / nullif(count(*) FILTER (gradeable AND {_COUNTED}), 0) AS p FROM y WHERE ok AND NOT starts_with(config_id, 'D-') GROUP BY config_id),
    tx AS (SELECT *, {_TENTH.format('p')} || '% ±' || {_TENTH.format(_wilson('p', 'CAST(graded AS DOUBLE)'))} AS t FROM ra)
    SELECT config_id, CASE WHEN graded = 0 THEN concat('graded 0/', CAST(due AS VARCHAR)) WHEN graded < due THEN concat(t, ' (graded ', CAST(graded AS VARCHAR), '/', CAST(due AS VARCHAR), ')') ELSE t END AS cell FROM tx""")
def accuracy_cells(spark, d):
    return m.ladder_table(c._graded(spark, d)).select(
        "config_id", m.accuracy_cell(F.col("accuracy"), F.col("graded"), F.col("due"), F.col("accuracy_half")).alias("cell"))


@query(f"""WITH {_EXPECTED}, ra AS (SELECT config_id, CAST(count(*) FILTER (answered) AS DOUBLE) / count(*) AS p, CAST(count(*) AS DOUBLE) AS n FROM x WHERE ok GROUP BY config_id)
    SELECT config_id, CASE WHEN config_id = 'E-error' THEN 'n/a' ELSE {_TENTH.format('p')} || '% ±' || {_TENTH.format(_wilson('p', 'n'))} END AS cell FROM ra""")
def percent_cells(spark, d):
    n = F.when(F.col("config_id") == "E-error", 0).otherwise(F.col("n"))
    rows = c._expected(spark, d).where(g.succeeded()).groupBy("config_id").agg(F.count(F.lit(1)).alias("n"), stats.safe_rate(stats.count_true(g.answered()), F.count(F.lit(1))).alias("rate"))
    return rows.select("config_id", stats.pct(F.col("rate"), n).alias("cell"))


# ---- texts ----

@query(f"""WITH {_LAST} SELECT config_id, question_id, concat('[', retrieved_chunk_ids[1], '] (', retrieved_doc_ids[1], ')', chr(10), coalesce(answer, ''), chr(10), chr(10),
    '[', retrieved_chunk_ids[2], '] (', retrieved_doc_ids[2], ')', chr(10), category) AS excerpts FROM l""")
def excerpt_texts(spark, d):
    hit = lambda i, text: F.struct(F.get("retrieved_chunk_ids", F.lit(i)).alias("chunk_id"), F.get("retrieved_doc_ids", F.lit(i)).alias("cite_label"), text.alias("text"))
    hits = F.array(hit(0, F.coalesce("answer", F.lit(""))), hit(1, F.col("category")))
    return c._last(spark, d).select("config_id", "question_id", a.format_excerpts(hits).alias("excerpts"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'first,third' ELSE 'first' END AS labels FROM v_answers""")
def cited_labels(spark, d):
    """Citations that are in the context, once each, in order of mention."""
    hit = lambda i, label: F.struct(i.alias("chunk_id"), F.lit(label).alias("cite_label"))
    own = F.concat(F.lit("chunk "), (F.col("conv_id") % 7).cast("string"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    other = F.when(F.col("conv_id") % 2 == 0, "other-0002").otherwise("absent-0002")
    cited = a.cited_hits(F.concat("text", F.lit(" Again ["), own, F.lit("].")), F.array(hit(F.lit("none-0009"), "second"), hit(other, "third"), hit(own, "first")))
    return view(spark, d, "v_answers").select("conv_id", "turn", F.array_join(cited["cite_label"], ",").alias("labels"))


@query("""SELECT o_orderkey, o_orderkey % 4 = 0 AS refuses, CASE o_orderkey % 4 WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.5E0 ELSE 0.0E0 END AS answerability,
    concat('key [key] of ', CAST(o_orderkey AS VARCHAR)) AS redacted, o_orderkey % 5 IN (0, 1, 2) AS is_date,
    CASE WHEN o_orderkey % 4 = 0 THEN 1.0E0 WHEN o_orderkey % 4 = 1 THEN 0.0E0 ELSE 0.25E0 END AS agreement FROM orders""")
def small_functions(spark, d):
    k = F.col("o_orderkey")
    pick = lambda n, *items: F.element_at(F.array(*map(F.lit, items)), (k % n + 1).cast("int"))
    return spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", t.is_refusal(pick(4, f" {t.REFUSAL}\n", t.REFUSAL[:-1], "", "No. " + t.REFUSAL)).alias("refuses"),
        stats.answerability(pick(4, "ANSWERABLE", "PARTIAL", "UNANSWERABLE", "UNKNOWN")).alias("answerability"),
        t.redact(F.concat(F.lit("key s3cr3t of "), k.cast("string")), ["", "s3cr3t"]).alias("redacted"),
        t.is_date(pick(5, "1st May 1999", "march 2018", "2018", "in 2018", "32 Moon 2018")).alias("is_date"),
        stats.agreement_score(k % 4 == 0, k % 4 <= 1, F.lit(0.25)).alias("agreement"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN concat('p-claim', CAST(turn AS VARCHAR)) ELSE concat('p-c', substr(sha256(concat('d-0001', chr(10), text)), 1, 12)) END AS key FROM v_answers""")
def claim_keys(spark, d):
    rows = view(spark, d, "v_answers")
    return rows.select("conv_id", "turn", t.numbered_claim_key(F.lit("p"), F.when(F.col("conv_id") % 3 == 0, F.col("turn")), F.col("text"), F.lit("d-0001")).alias("key"))


@query(f"""WITH ln AS (SELECT doc_id, {_strip("unnest(string_split(CASE WHEN page_num % 13 = 0 THEN '2.1 Part' || chr(10) || text ELSE text END, chr(10)))")} AS line FROM v_pages)
    SELECT doc_id, bool_or(regexp_matches(line, '^[0-9]+(\\.[0-9]+)+\\.?{_WS}+[^ ]')) AS dotted FROM ln GROUP BY doc_id""")
def dotted_documents(spark, d):
    pages = view(spark, d, "v_pages")
    return s.dotted_numbering(pages.withColumn("text", F.concat(F.when(F.col("page_num") % 13 == 0, "2.1 Part\n").otherwise(""), F.col("text"))))


@query(r"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || CASE p_partkey % 3 WHEN 0 THEN ' and' WHEN 1 THEN '.' ELSE ' ..... 12' END AS line FROM part)
    SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 <> 1 AND len(string_split(line, ' ')) <= 8 AS is_title FROM p""")
def title_lines(spark, d):
    k = F.col("p_partkey")
    line = F.concat(F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.when(k % 3 == 0, " and").when(k % 3 == 1, ".").otherwise(" ..... 12"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", h.is_heading_shaped(line, h.UNNUMBERED_WORDS).alias("is_title"))


@query(f"""WITH {_FUSED} SELECT fr.question_id, CAST(fr.rank AS INTEGER) AS rank, fr.chunk_id, substr(replace(k.text, chr(10), ' '), 1, 200) AS snippet
    FROM fr JOIN v_chunks AS k USING (chunk_id) WHERE fr.rank <= 8""")
def uniqueness_snippets(spark, d):
    chunks = c._embedded_chunks(spark, d)
    hits = r.hybrid_topk(chunks, c._embedded_questions(spark, d), 20).select("question_id", "chunk_id", "rank").join(chunks.select("chunk_id", "text"), "chunk_id")
    return r.snippets(hits)


# ---- the section machine, where SQL can follow it ----

_PAGES = """pg AS (SELECT doc_id, page_num, lead(page_num) OVER (PARTITION BY doc_id ORDER BY page_num) AS following,
        array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: {line}), chr(10)) AS body FROM v_pages)"""


@query(f"""WITH {_PAGES.format(line=_strip("concat('x', CAST(page_num AS VARCHAR), '-', CAST(i - 1 AS VARCHAR), ' ', l)"))},
    se AS (SELECT doc_id, page_num, page_num % 3 <> 0 AS last_of_page, CAST(page_num AS VARCHAR) AS section_no, 'Section Heading' AS trail, body AS text, following, 1 AS part FROM pg
        UNION ALL SELECT doc_id, page_num, true, concat(CAST(page_num AS VARCHAR), '.1'), 'Section Heading > Sub Part', concat('xsub ', CAST(page_num AS VARCHAR), ' body'), following, 0 FROM pg WHERE page_num % 3 = 0)
    SELECT concat(doc_id, '-', lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_num, part) AS VARCHAR), 4, '0')) AS chunk_id, section_no, trail,
        page_num AS page_start, CASE WHEN last_of_page THEN coalesce(following, page_num) ELSE page_num END AS page_end, md5(text) AS digest,
        CAST(len(regexp_extract_all(text, '{_NWS}+')) AS INTEGER) AS token_count FROM se""")
def section_chunks(spark, d):
    """Pages that open a numbered section each; every third has a part within it, which comes first."""
    pages, page = view(spark, d, "v_pages"), F.col("page_num").cast("string")
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("x"), page, F.lit("-"), i.cast("string"), F.lit(" "), x)), "\n")
    part = F.when(F.col("page_num") % 3 == 0, F.concat(F.lit("\n"), page, F.lit(".1 Sub Part\nxsub "), page, F.lit(" body"))).otherwise("")
    chunks = s.chunk_documents(pages.withColumn("text", F.concat(page, F.lit(" Section Heading\n"), body, part)))
    return chunks.select("chunk_id", "section_no", F.array_join("heading_trail", " > ").alias("trail"), "page_start", "page_end",
                         F.md5(F.col("text").cast("binary")).alias("digest"), "token_count")


@query("SELECT CAST(item_id % 7 AS VARCHAR) AS cache_key, CASE WHEN item_id % 7 < 3 THEN 'cached' ELSE concat('called ', CAST(item_id % 7 AS VARCHAR)) END AS reply, count(*) AS n FROM benchmark GROUP BY ALL")
def cached_calls(spark, d):
    """Three replies are in the cache; the others are called once a key, and then the cache has them."""
    path = scratch_path(spark, "replies")
    spark.createDataFrame([(str(k), "cached") for k in range(3)], "cache_key string, reply string").write.parquet(path)
    requests = spark.read.parquet(f"{d}/benchmark.parquet").select((F.col("item_id") % 7).cast("string").alias("cache_key"))
    writers.replies_through(requests, path, F.concat(F.lit("called "), "cache_key"))
    again = writers.replies_through(requests, path, F.lit("called twice"))
    return again.groupBy("cache_key", "reply").agg(F.count(F.lit(1)).alias("n"))


def _stub_fetch(url: str) -> bytes | None:
    number = int("".join(x for x in url.rsplit("/", 1)[1] if x.isdigit()) or 0)
    return None if number % 5 == 0 else (b"%PDF-" if number % 5 < 4 else b"<html>") + url.encode()


@query("""SELECT concat('p_', CAST(page_id AS VARCHAR), '.pdf') AS file, CAST(octet_length(encode(concat('%PDF-', 'https://x.example/a/p:', CAST(page_id AS VARCHAR), '.pdf?v=', CAST(page_id % 5 AS VARCHAR)))) AS INTEGER) AS bytes
    FROM pages WHERE page_id % 3 <> 0 AND CAST(concat(CAST(page_id AS VARCHAR), CAST(page_id % 5 AS VARCHAR)) AS BIGINT) % 5 IN (1, 2, 3)""")
def fetched_pdfs(spark, d):
    """Links that are not there yet, through a stand-in for the network."""
    pages, number = read_table(spark, f"{d}/pages.parquet"), F.col("page_id").cast("string")
    links = pages.select(F.concat(F.lit("https://x.example/a/p:"), number, F.lit(".pdf?v="), (F.col("page_id") % 5).cast("string")).alias("url"))
    there = pages.where("page_id % 3 = 0").select(F.concat(F.lit("p_"), number, F.lit(".pdf")).alias("file"))
    found = readers.fetched_files(links.unionByName(links), there, _stub_fetch)
    return found.select("file", F.octet_length("content").alias("bytes"))
