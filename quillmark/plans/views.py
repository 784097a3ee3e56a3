"""The engine's entities as views of the driver's tables.

Each view is one statement in the common part of Spark's and DuckDB's SQL; the few
differences are functions of ``Dialect``.  Queries apply the library's operators to
the views; their SQL counterparts state the result on the same views from scratch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillmark.session import read_table


@dataclass(frozen=True)
class Dialect:
    duck: bool

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]" if self.duck else f"array({', '.join(items)})"

    def empty(self) -> str:
        return "CAST([] AS VARCHAR[])" if self.duck else "cast(array() as array<string>)"

    def struct(self, **fields: str) -> str:
        if self.duck:
            return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def number(self, text: str) -> str:
        return f"CAST(regexp_extract({text}, '([0-9]+)', 1) AS INTEGER)"


def definitions(duck: bool) -> dict[str, str]:
    d = Dialect(duck)
    k = d.number("props")
    planted = "concat('INJ-', CASE k % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'H' ELSE 'M' END, CAST(k % 10 AS VARCHAR(9)))"
    doc = "concat('src', CAST({0} % 20 AS VARCHAR(9)))"
    docs = d.array(doc.format("k"), f"CASE WHEN k % 4 = 0 THEN {planted} ELSE {doc.format('(k + 3)')} END", doc.format("(k + 7)"))
    chunk = "concat({0}, '-', lpad(CAST(k AS VARCHAR(9)), 4, '0'))"
    first, second = chunk.format(doc.format("k")), chunk.format(f"CASE WHEN k % 4 = 0 THEN {planted} ELSE {doc.format('(k + 3)')} END")
    chunks = d.array(first, second, chunk.format(doc.format("(k + 7)")))
    cite = lambda x: d.struct(chunk_id=x, cite_label=x)
    citations = f"CASE WHEN k % 6 = 0 THEN {d.array(cite(second))} ELSE {d.array(cite(first), cite(second))} END"
    claim = lambda n, v: d.struct(claim_text=f"'c{n}'", chunk_id=first, verdict=v)
    verdicts = d.array(
        claim(1, "CASE k % 4 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'UNSUPPORTED' ELSE 'UNKNOWN' END"),
        claim(2, "CASE WHEN k % 3 = 0 THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END"))
    category = (
        "CASE user_id % 7 WHEN 0 THEN 'false_premise' WHEN 1 THEN 'unanswerable' WHEN 2 THEN 'near_miss' "
        "WHEN 3 THEN 'injection' WHEN 4 THEN 'multi_hop' WHEN 5 THEN 'versioned' ELSE 'factual' END")
    return {
        # A source's rows make documents of up to 100 pages, so documents grow in number, not in length.
        "v_pages": "SELECT concat(source, '/', CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR(9))) AS doc_id, CAST(doc_id % 100 + 1 AS INTEGER) AS page_num, text FROM documents",
        "v_chunks": "SELECT concat(source, '-', CAST(CAST(floor(doc_id / 10000) AS BIGINT) AS VARCHAR(9)), '-', lpad(CAST(doc_id % 10000 AS VARCHAR(9)), 4, '0')) AS chunk_id, "
                    "source AS doc_id, doc_id AS row_id, text FROM documents",
        "v_questions_text": "SELECT item_id AS question_id, text AS question FROM benchmark",
        "v_config": "SELECT DISTINCT concat(upper(substr(event_type, 1, 1)), '-', event_type) AS config_id, concat('fp-', event_type) AS config_fingerprint, "
                    "event_type IN ('view', 'error') AS cites FROM events",
        "v_log": f"SELECT e.*, concat(upper(substr(event_type, 1, 1)), '-', event_type) AS config_id, CAST(user_id AS VARCHAR(20)) AS question_id, {k} AS k FROM events AS e",
        "v_rows": f"""SELECT event_id AS seq, config_id, question_id, {category} AS category,
            CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'fp-old' WHEN event_id % 31 = 0 THEN 'external:x' ELSE concat('fp-', event_type) END AS config_fingerprint,
            CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 1 ELSE 2 END AS parser_version,
            user_id % 7 NOT IN (0, 1, 2) AS expected_answerable,
            CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 0 END AS corpus_includes_injected,
            CASE WHEN k % 17 = 0 THEN 'timeout' END AS error, CASE WHEN k % 23 = 0 THEN '' ELSE concat('answer ', props, CASE WHEN k % 19 = 0 THEN ' per my configuration' ELSE '' END) END AS answer,
            CASE WHEN event_id % 9 = 0 THEN NULL ELSE k % 5 = 0 END AS abstained,
            {docs} AS retrieved_doc_ids, {chunks} AS retrieved_chunk_ids, {citations} AS citations, {verdicts} AS verdicts,
            CASE WHEN k % 8 = 0 THEN NULL ELSE k / 100.0E0 END AS composite, CASE WHEN k % 3 = 0 THEN NULL ELSE (k * 7 % 100) / 100.0E0 END AS retrieval,
            CASE k % 4 WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.5E0 WHEN 2 THEN 0.0E0 END AS answerability,
            value AS elapsed_s FROM v_log""",
        "v_questions": f"""SELECT DISTINCT CAST(user_id AS VARCHAR(20)) AS id, {category} AS category, user_id % 7 NOT IN (0, 1, 2) AS expected_answerable,
            concat('question ', CAST(user_id AS VARCHAR(20))) AS question,
            {d.array(doc.format('user_id'), doc.format('(user_id + 5)'))} AS expected_doc_ids,
            CASE WHEN user_id % 7 = 3 THEN {d.array("CASE user_id % 2 WHEN 0 THEN 'INJ-D1' ELSE 'INJ-H2' END")} ELSE {d.empty()} END AS injection_doc_ids,
            CASE WHEN user_id % 10 = 0 THEN '' ELSE 'summary' END AS expected_answer_summary,
            CASE WHEN user_id % 14 = 0 THEN '' ELSE 'notes' END AS notes FROM events WHERE user_id % 50 <> 49""",
        "v_grades": """SELECT event_id AS seq, config_id, question_id,
            CASE event_id % 5 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'INCORRECT' WHEN 3 THEN 'UNGRADED' ELSE 'CORRECT' END AS verdict,
            CASE WHEN k % 23 = 0 THEN '' ELSE concat('answer ', props, CASE WHEN k % 19 = 0 THEN ' per my configuration' ELSE '' END) END AS answer,
            CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 1 THEN 'v1' ELSE 'v2' END AS judge_version FROM v_log""",
        "v_register": "SELECT DISTINCT source AS doc_id FROM documents WHERE source <> 'src19'",
        "v_versions": "SELECT DISTINCT source AS old_id, concat('src', CAST(TRY_CAST(substr(source, 4) AS INTEGER) - 1 AS VARCHAR(9))) AS new_id "
                      "FROM documents WHERE TRY_CAST(substr(source, 4) AS INTEGER) % 2 = 1",
        "v_answers": "SELECT conv_id, turn, concat(text, ' [chunk ', CAST(conv_id % 7 AS VARCHAR(9)), '-', lpad(CAST(turn AS VARCHAR(20)), 4, '0'), "
                     "', other-0002].') AS text FROM conversations WHERE role = 'assistant'",
        "v_labels": "SELECT CASE WHEN quality = 1 THEN 'CORRECT' ELSE 'INCORRECT' END AS human, CASE WHEN toxic = 1 THEN 'INCORRECT' ELSE 'CORRECT' END AS judge FROM labels",
    }


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Views that read other views.
_NEEDS = {"v_rows": ("v_log",), "v_grades": ("v_log",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of ``sf_dir``; nothing is registered in the session."""
    defs = definitions(duck=False)
    sources = {n: view(spark, sf_dir, n) for n in _NEEDS.get(name, ())}
    sql = defs[name]
    for t in TABLES:
        if f" {t}" in sql:
            sources[t] = read_table(spark, f"{sf_dir}/{t}.parquet")
    used = {n: df for n, df in sources.items() if f"FROM {n}" in sql}
    for n in used:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(sql.replace("VARCHAR(9)", "string").replace("VARCHAR(20)", "string"), **used)


def with_views(sql: str) -> str:
    """A DuckDB statement preceded by the views it reads."""
    defs = definitions(duck=True)
    used = [n for n in defs if n in sql.replace("v_rows_", "")]
    for n in list(used):
        used += [m for m in _NEEDS.get(n, ()) if m not in used]
    ordered = [n for n in defs if n in used]
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in ordered)
    body = sql.strip()
    if not ctes:
        return body
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"
