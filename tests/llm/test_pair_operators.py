"""Joins, searches and archives against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.llm import embedding_dedup, ngram_join, topk, warc
from quillmark.llm.components import components
from quillmark.session import scratch_path

CLASH = ("node", "root", "hub", "links", "class_id", "block", "copies", "u", "v", "score", "payload", "code")


def clash(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def roots(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(7, 7), (1, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    want = roots(400, real)
    assert got == {n: want[n] for e in real for n in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- n-gram join ----

def near_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        rows.append((len(rows), " ".join(rng.choices(words, k=rng.randint(30, 80)))))
    base = rng.choices(words, k=60)
    for i in range(70):  # a group whose members differ
        w = list(base)
        w[rng.randrange(60)] = f"n{i}"
        rows.append((len(rows), " ".join(w)))
    for _ in range(30):
        rows.append((len(rows), rows[3][1]))  # exact copies
    rows += [(len(rows), "one two three"), (len(rows) + 1, "one two three"), (len(rows) + 2, "one  two\nthree"), (len(rows) + 3, None), (len(rows) + 4, ""), (len(rows) + 5, " \n")]
    rows.append((9999, "long " + " ".join(words) * 3))
    return rows


def jaccard_truth(rows, t=0.8):
    sets = []
    for _, x in rows:
        w = (x or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for j in range(len(sets)) for i in range(j)
             if sets[i] == sets[j] or (sets[i] & sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9)]
    return pairs


@pytest.mark.parametrize("blocks", [{}, {"block": 16}, {"block_grams": 1000}])
def test_ngram_join_like_brute_force(spark, blocks):
    """In one block per component, and split into pairs of blocks."""
    rows = near_texts()
    out = {r["doc_id"]: r for r in ngram_join.jaccard_join(clash(spark.createDataFrame(rows, "doc_id long, text string")), **blocks).collect()}
    pairs = jaccard_truth(rows)
    links = Counter(i for p in pairs for i in p)
    group = roots(len(rows), pairs)
    for k, (d, _) in enumerate(rows):
        assert out[d]["n_links"] == links[k], (d, rows[k][1])
        assert out[d]["group_id"] == rows[group[k]][0]
        assert out[d]["kept"] == (group[k] == k)


def test_one_document_of_each_group_stays(spark):
    rows = near_texts() + [(0, near_texts()[0][1]), (None, "a null id with its own text here")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = ngram_join.one_per_group(df)
    assert kept.columns == df.columns
    group = roots(len(near_texts()), jaccard_truth(near_texts()))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({near_texts()[g][0] for g in group})
    assert kept.where("doc_id is null").count() == 1


def test_rows_of_one_id_are_judged_each_by_its_own(spark):
    a, b = "one two three four five six seven", "red orange yellow green blue indigo violet"
    rows = [(0, b, 7), (1, a, 8), (1, b, 9)]
    kept = ngram_join.one_per_group(spark.createDataFrame(rows, "doc_id long, text string, `key` int"))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(0, b), (1, a)]
    # of one id twice in a group one row stays, of the same row twice too
    rows = [(4, a, 1), (4, a, 1), (4, a + " ", 2), (5, a, 3), (6, "", 4), (7, None, 5)]
    kept = ngram_join.one_per_group(spark.createDataFrame(rows, "doc_id long, text string, kept_id int"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 6] and kept.columns == ["doc_id", "text", "kept_id"]


@pytest.mark.parametrize("block", [1000, 8])
def test_candidates_connect_all_pairs_of_a_bucket_that_agree(spark, block):
    """Members that fail against the hub still meet each other and the others of the bucket."""
    rng = np.random.default_rng(11)
    rows, bands = 4, 18
    signatures = rng.integers(0, 1 << 30, (90, rows * bands))
    for i in range(90):  # all share band 0; families of 9 agree in most other hashes, with drift along the family
        signatures[i, :rows] = 5
        if i % 9:
            signatures[i, rows:] = np.where(rng.random(68) < 0.93, signatures[i - 1, rows:], signatures[i, rows:])
    least = ngram_join.least_agreement(rows * bands)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(signatures)], "node long, signature array<int>")
    edges = [(r["u"], r["v"]) for r in ngram_join.candidate_edges(table, bands, rows, least, block).collect()]
    agree = [(i, j) for j in range(90) for i in range(j) if (signatures[i] == signatures[j]).sum() >= least]
    assert roots(90, edges) == roots(90, agree) and len(set(roots(90, agree))) >= 10
    assert 40 <= least <= 44


def test_ngram_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_join(df).count() == 0 and ngram_join.one_per_group(df).count() == 0


def test_bands_reach_the_recall():
    b, r = ngram_join.choose_bands()
    assert 1 - (1 - 0.8**r) ** b >= 0.9999 and b * r <= 80


# ---- embeddings ----

def vectors(seed=6):
    rng = np.random.default_rng(seed)
    rows = [(i, v.tolist(), int(i % 4)) for i, v in enumerate(rng.normal(size=(250, 16)))]
    base = rng.normal(size=(6, 16))
    for i in range(120):
        rows.append((1000 + i, (base[i % 6] + rng.normal(0, 0.12, 16)).tolist(), i % 3))
    rows += [(2000 + i, rows[0][1], 0) for i in range(20)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] + [1.0] * 15, 1), (3003, rows[1][1], None), (3004, [1.0, 2.0], 1), (3005, [2.0, 4.0], 1),
             (3006, [None] + [1.0] * 15, 1), (3007, [float("inf")] + [1.0] * 15, 1), (3008, [], 1), (3009, [3 * x for x in rows[1][1]], 1)]
    return rows


@pytest.mark.parametrize("options", [{}, {"cell_rows": 25, "block": 16}, {"cell_rows": 6, "sample_rows": 64}])
def test_embedding_links_like_brute_force(spark, options):
    rows = vectors()
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), **options).collect()}
    ok = [k for k, (_, v, y) in enumerate(rows) if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in ok}
    pairs = [(i, j) for j in ok for i in ok if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    links, group = Counter(i for p in pairs for i in p), roots(len(rows), pairs)
    assert len(out) == len(rows)
    found = sum(out[rows[k][0]]["n_links"] for k in range(len(rows)))
    assert all(out[rows[k][0]]["n_links"] <= links[k] for k in range(len(rows)))
    assert found >= 0.99 * sum(links.values())
    if found == sum(links.values()):
        assert all(out[rows[k][0]]["component_id"] == rows[group[k]][0] for k in range(len(rows)))
    assert all(r["kept"] == (r["component_id"] == i) for i, r in out.items())


def test_embeddings_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(df).count() == 0
    only = spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [r["n_links"] for r in embedding_dedup.near_duplicates(only).collect()] == [0, 0]
    assert embedding_dedup.one_per_group(only).count() == 2


# ---- top-k ----

def test_topk_like_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 20)))]
    rows += [(500 + i, rows[0][1]) for i in range(8)] + [(600, None), (601, [None] * 20), (602, [float("nan")] * 20), (650, [1.0, 1.0]), (651, [1.0, 1.0])]
    codes = topk.quantized(clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    asked = codes.where("vec_id % 50 = 0")
    for block in (4096, 3):
        got = defaultdict(list)
        for r in topk.top_k(codes, asked, 5, block).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        ok = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if v and None not in v and np.isfinite(v).all()}
        for q in (i for i in ok if i % 50 == 0):
            best = sorted((-int(ok[q] @ ok[i]), i) for i in ok if i != q and len(ok[i]) == len(ok[q]))[:5]
            assert got[q] == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert topk.top_k(codes.limit(0), asked.limit(0)).count() == 0


def test_topk_ties_of_vectors_without_components(spark):
    rows = spark.range(1, 5001).select(F.col("id").alias("vec_id"), F.array().cast("array<float>").alias("embedding"))
    codes = topk.quantized(rows)
    got = defaultdict(list)
    for r in topk.top_k(codes, codes.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert len(got) == 100 and all(v == [(i, 0) for i in range(1, 6)] for v in got.values())


def test_topk_of_large_components_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (v * 10.0 ** rng.integers(0, 12)).tolist()) for i, v in enumerate(rng.normal(size=(200, 6)))]
    rows += [(300, [1e30] * 6), (301, [-1e30] * 6), (302, [1e30] * 6)]
    codes = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    code = {r["vec_id"]: r["code"] for r in codes.collect()}
    got = defaultdict(list)
    for r in topk.top_k(codes, codes.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    for q, found in got.items():
        dot = lambda i: min(max(sum(x * y for x, y in zip(code[q], code[i], strict=True)), -(1 << 63)), (1 << 63) - 1)
        assert found == sorted((-dot(i), i) for i in code if i != q)[:5]


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_topk_bounds_drop_rows_and_lose_nothing(spread):
    """10,000 rows in one task, in descending id order with ties; spread means let coarse bounds decide."""
    rng = np.random.default_rng(6)
    codes = np.floor(64 * (rng.normal(size=(10_000, 64)) / 8 + spread * rng.normal(size=(10_000, 1)) / 8)).astype(np.int64)
    codes[5000:5040] = codes[0]
    ids = np.arange(10_000)[::-1].copy()
    block = topk.QueryBlock(ids[::50], codes[::50], 5)
    block.update(ids, codes)
    found = defaultdict(list)
    for r in block.result().to_pylist():
        found[r["query_id"]].append((-r["score"], r["vec_id"]))
    for q, code in zip(ids[::50].tolist(), codes[::50], strict=True):
        scores = codes @ code
        order = [i for i in np.lexsort((ids, -scores))[:6] if ids[i] != q][:5]
        assert found[q] == [(-int(scores[i]), int(ids[i])) for i in order]
    assert block.pairs == 10_000 * 200 and block.scored < block.pairs * (0.5 if spread else 1)


def test_bounds_hold():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(50, 30)), rng.normal(size=(60, 30))
    exact, last = a @ b.T, None
    for level in topk.LEVELS:
        bound = topk.segment_statistics(a, level) @ topk.segment_statistics(b, level).T
        assert (bound >= exact - 1e-9).all()
        assert last is None or (bound <= last + 1e-9).all() or level > 1
        last = bound


# ---- WARC ----

@pytest.mark.parametrize(("sent", "compressed"), [(warc.MAX_SENT, True), (0, True), (0, False)])
def test_archives_round_trip(spark, monkeypatch, sent, compressed):
    """Originals sent to the tasks and joined, with common digests split."""
    monkeypatch.setattr(warc, "_LEAST", 1)
    long = "<p>é" * 100
    rows = [(3, "http://a/", long), (1, "http://b/\r\nWARC-Type: forged", long), (2, None, long), (1, "http://b2/", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""),
            (8, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 20), (None, "u", long), (None, "u", "z" * 200), (9, "u", "y" * 300_000)]
    pages = clash(spark.createDataFrame(rows, "page_id long, url string, html string"))
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.archive_records(pages, sent=sent), path, compressed=compressed, records_per_file=2)
    out = warc.resolve_revisits(warc.read_archives(spark, path)).collect()
    headers = warc.resolve_revisits(warc.read_archives(spark, path, with_payload=False), sent).drop("payload").collect()
    assert Counter(r["payload_bytes"] for r in headers) == Counter(r["payload_bytes"] for r in out)
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(files) >= 6
    for content in files if compressed else ():  # a member holds one record, whole, or nothing
        members = []
        while content:
            unzip = zlib.decompressobj(wbits=31)
            members.append(unzip.decompress(content))
            content = unzip.unused_data
        assert members[1::2] == [b""] * (len(members) // 2) and all(m.startswith(b"WARC/1.1") and m.endswith(b"\r\n\r\n") for m in members[::2])
    assert Counter((r["page_id"], bytes(r["payload"]).decode()) for r in out) == Counter((p, h or "") for p, _, h in rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in out)
    assert kinds == Counter([(1, "response", None)] * 2 + [(2, "revisit", 1), (3, "revisit", 1), (None, "revisit", 1), (None, "response", None)] + [(i, "response", None) for i in (4, 5, 6, 7, 8, 9)])
    assert all(r["payload_digest"] == hashlib.sha256(bytes(r["payload"])).hexdigest() and r["payload_bytes"] == len(r["payload"]) for r in out)


def test_archives_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_records(pages).count() == 0
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.archive_records(pages), path, records_per_file=warc.records_for(pages))
    assert warc.resolve_revisits(warc.read_archives(spark, path)).count() == 0


def test_plain_and_gzip_members():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    for data in (record * 3, gzip.compress(record * 3), gzip.compress(record) * 3):
        assert [b for _, b in warc.parse_warc(data)] == [b"ab\r\n"] * 3
    with pytest.raises(ValueError):
        list(warc.parse_warc(record[:-8]))


def test_guests_of_a_cell_are_linked_once():
    """Two rows that only meet outside their homes are counted in the smallest cell they share."""
    rows = [("a", "x", 2, 1, [1.0, 0.0], 1, [1, 3, 5], 0), ("b", "x", 2, 1, [1.0, 0.01], 2, [2, 3, 5], 0), ("c", "x", 2, 1, [1.0, 0.02], 3, [1, 3], 0)]
    names = ["node", "label", "dims", "copies", "vector", "home", "cells", "block"]
    links = Counter()
    for cell in (1, 2, 3, 5):
        part = pd.DataFrame([r for r in rows if cell in r[6]], columns=names)
        for r in embedding_dedup._cell_links(0.93)((cell, 0, 0), part).itertuples():
            links[r.node] += r.links
    assert links == {"a": 2, "b": 2, "c": 2}


def test_recall_with_several_cells_at_64_dimensions(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 64))
    x = np.vstack([x, x[:400] + rng.normal(size=(400, 64)) * rng.uniform(0.05, 0.38, size=(400, 1))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = int((unit @ unit.T >= 0.93).sum()) - len(x)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    for options in ({"cell_rows": 100}, {"cell_rows": 40, "sample_rows": 128}):  # the second cuts its cells again
        got = sum(r["n_links"] for r in embedding_dedup.near_duplicates(df, **options).collect())
        assert want > 300 and 0.99 * want <= got <= want
