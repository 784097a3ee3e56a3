"""The append-only log of (configuration, question) outcomes.

Rows carry ``seq``, their place in the log.  Joins against configurations,
questions and version maps are against dimensions bounded by their own files,
so Spark chooses their strategy by size; nothing here is forced to broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.plans.config import PARSER_VERSION

PLANTED = "INJ-"


def last_wins(rows: DataFrame, keys: tuple[str, ...] = ("config_id", "question_id"), seq: str = "seq") -> DataFrame:
    """The last row per key, with ``first_seq``, where the key was first seen.

    One aggregation with partial maxima, so a key with very many rows is one row
    per task before the shuffle.
    """
    whole = F.struct(F.col(seq), *[F.col(c) for c in rows.columns if c not in (*keys, seq)])
    out = rows.groupBy(*keys).agg(F.max_by(whole, F.col(seq)).alias("__row"), F.min(seq).alias("first_seq"))
    return out.select(*keys, "__row.*", "first_seq")


def is_current_parse(cites: Column, parser_version: Column) -> Column:
    return ~F.coalesce(cites, F.lit(False)) | (F.coalesce(parser_version, F.lit(1)) >= PARSER_VERSION)


def mark_stale(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """Add ``stale``: another fingerprint than the configuration's current one, or an old parse.

    A row without a fingerprint of an unknown configuration is not stale.
    """
    known = configs.select(F.col("config_id").alias("__cfg"), F.col("config_fingerprint").alias("__fp"), F.col("cites").alias("__cites"))
    return rows.join(known, F.col("config_id") == F.col("__cfg"), "left").withColumn(
        "stale", ~(F.col("config_fingerprint").eqNullSafe(F.col("__fp")) & is_current_parse(F.col("__cites"), F.col("parser_version")))
    ).drop("__cfg", "__fp", "__cites")


def drop_stale(rows: DataFrame, configs: DataFrame, keep_external: bool = False) -> DataFrame:
    """Rows of current configurations.  With ``keep_external``, rows whose fingerprint starts
    with ``external:`` stay too."""
    keep = ~F.col("stale")
    if keep_external:
        keep = keep | F.coalesce(F.startswith(F.col("config_fingerprint"), F.lit("external:")), F.lit(False))
    return mark_stale(rows, configs).where(keep).drop("stale")


def attach_expectations(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Left join with the questions; unknown ids get empty expectations.

    Of questions that repeat an id the last one (by ``q_seq``, if given) counts.
    ``category`` and ``expected_answerable`` stay as the row recorded them.
    """
    names = ("expected_doc_ids", "injection_doc_ids", "expected_answer_summary", "notes", "question")
    if "q_seq" in questions.columns:
        questions = last_wins(questions, ("id",), "q_seq")
    q = questions.select(F.col("id").alias("__id"), *[F.col(n).alias(f"__{n}") for n in names])
    empty = {n: F.array().cast("array<string>") if n.endswith("_ids") else F.lit("") for n in names}
    joined = rows.drop(*names).join(q, F.col("question_id") == F.col("__id"), "left")
    return joined.select(*[c for c in rows.columns if c not in names], *[F.coalesce(f"__{n}", empty[n]).alias(n) for n in names])


def answered() -> Column:
    return ~F.coalesce(F.col("abstained"), F.lit(False))


def must_refuse() -> Column:
    return ~F.coalesce(F.col("expected_answerable"), F.lit(False)) & (F.coalesce(F.col("category"), F.lit("")) != "false_premise")


def cited_doc_ids() -> Column:
    """Documents of the cited chunks, by position in what was retrieved; other citations are ignored."""
    pairs = F.arrays_zip(F.col("retrieved_chunk_ids").alias("c"), F.col("retrieved_doc_ids").alias("d"))
    cited = F.transform("citations", lambda x: x["chunk_id"])
    both = F.filter(pairs, lambda p: p["c"].isNotNull() & p["d"].isNotNull() & F.array_contains(cited, p["c"]))
    return F.array_sort(F.array_distinct(F.transform(both, lambda p: p["d"])))


def any_planted(ids: Column) -> Column:
    return F.coalesce(F.exists(ids, lambda d: F.startswith(d, F.lit(PLANTED))), F.lit(False))


def cites_injection() -> Column:
    return any_planted(cited_doc_ids())


def retrieved_injection() -> Column:
    return any_planted(F.col("retrieved_doc_ids"))


def succeeded() -> Column:
    return F.col("error").isNull()


def gradeable() -> Column:
    text = F.coalesce(F.col("answer"), F.lit(""))
    premise = F.coalesce(F.col("category"), F.lit("")) == "false_premise"
    has = F.when(premise, F.coalesce(F.col("notes"), F.lit("")) != "").otherwise(
        F.coalesce(F.col("expected_answerable"), F.lit(False)) & (F.coalesce(F.col("expected_answer_summary"), F.lit("")) != ""))
    return succeeded() & answered() & (text != "") & has


def completed(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """Distinct (config, question, fingerprint, corpus tag) with any success of a current parse."""
    from quillmark.functions.text import corpus_tag

    cites = configs.select(F.col("config_id").alias("__cfg"), F.col("cites").alias("__cites"))
    ok = rows.join(cites, F.col("config_id") == F.col("__cfg"), "left").where(
        succeeded() & is_current_parse(F.col("__cites"), F.col("parser_version")))
    return ok.select("config_id", "question_id", "config_fingerprint", corpus_tag(F.col("corpus_includes_injected")).alias("corpus_tag")).distinct()


def pending_work(questions: DataFrame, configs: DataFrame, done: DataFrame, tag: str) -> DataFrame:
    """Cells of the grid that are not done.  The grid is the product of two dimensions and
    is the work list itself: configurations are rungs, a handful."""
    ids = F.array_sort(F.collect_set(F.struct("config_id", "config_fingerprint")))
    rungs = configs.agg(ids.alias("__rungs"))
    cells = questions.select(F.col("id").alias("question_id")).join(F.broadcast(rungs)).select(
        "question_id", F.explode("__rungs").alias("r")).select("r.config_id", "question_id", "r.config_fingerprint")
    todo = cells.join(done.where(F.col("corpus_tag") == tag), ["config_id", "question_id", "config_fingerprint"], "left_anti")
    return todo.withColumn("corpus_tag", F.lit(tag))


def stratified_quotas(questions: DataFrame, n: int) -> DataFrame:
    """``category, size, quota``: the share of n rounded half to even, one at least."""
    sizes = questions.groupBy("category").agg(F.count(F.lit(1)).alias("size"))
    total = F.sum("size").over(Window.partitionBy())
    return sizes.withColumn("quota", F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("size") / total).cast("long")))


def drawn(seed: int, key: str) -> list[Column]:
    """Sort order of a seeded draw: reruns agree on any partitioning, and other engines can draw the same."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.col(key)]


def random_subset(questions: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n answerable questions that name a document, or all if there are fewer."""
    able = F.coalesce(F.col("expected_answerable"), F.lit(False)) & (F.size("expected_doc_ids") > 0)
    return questions.where(able).orderBy(*drawn(seed, "id")).limit(n)


def union_of_samples(*samples: DataFrame) -> DataFrame:
    """Questions of any of the samples, each once."""
    ids = reduce(DataFrame.unionByName, [s.select("id") for s in samples])
    return ids.distinct()


def select_run(rows: DataFrame, config_ids: list[str] | None = None, category: str | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Rows of some configurations (ids in either case), of a category, and of listed (config, question) pairs.

    Each is optional; a list that matches no row is an error of the caller's, seen as no rows.
    """
    if config_ids is not None:
        rows = rows.where(F.upper("config_id").isin(*{c.strip().upper() for c in config_ids}))
    if category is not None:
        rows = rows.where(F.col("category") == category)
    if pairs is not None:
        rows = rows.join(pairs.select("config_id", "question_id").distinct(), ["config_id", "question_id"], "left_semi")
    return rows


def question_counts(rows: DataFrame) -> DataFrame:
    """Rows and different questions per configuration."""
    return rows.groupBy("config_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("question_id").alias("questions"))


def stratified_sample(questions: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Up to n questions by category quota, chosen by seeded hash; reruns agree."""
    order = drawn(seed, "id")
    pick = Window.partitionBy("category").orderBy(*order)
    quotas = stratified_quotas(questions, n).select(F.col("category").alias("__c"), "quota")
    chosen = questions.withColumn("__rn", F.row_number().over(pick)).join(quotas, F.col("category").eqNullSafe(F.col("__c"))).where("__rn <= quota")
    return chosen.drop("__rn", "__c", "quota").orderBy(*order).limit(n)


def stratified_sample_ids(ids_by_category: dict[str, list[str]], n: int, seed: int = 0) -> list[str]:
    """The same quotas with the standard library's generator, for lists that fit the driver."""
    import random

    rng, total = random.Random(seed), sum(map(len, ids_by_category.values()))
    picked = []
    for _, ids in sorted(ids_by_category.items()):
        quota = max(1, round(n * len(ids) / total))
        picked += rng.sample(ids, min(quota, len(ids)))
    rng.shuffle(picked)
    return picked[:n]


def audit_sample(rows: DataFrame, taken: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """First gradeable row per question that is not taken yet, n of them by seeded hash."""
    open_rows = rows.where(gradeable()).join(taken.select("config_id", "question_id"), ["config_id", "question_id"], "left_anti")
    whole = F.struct(*open_rows.columns)
    first = open_rows.groupBy("question_id").agg(F.min_by(whole, F.col("first_seq")).alias("r")).select("r.*")
    return first.orderBy(*drawn(seed, "question_id")).limit(n)


def merge_right(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Union in which a key of ``right`` replaces the same key of ``left``."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti").unionByName(right, allowMissingColumns=True)
