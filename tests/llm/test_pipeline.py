"""The corpus pipeline, stage by stage, on small planted tables."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillmark.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def planted(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(240):
        body = " ".join(rng.choices(words, k=40))
        if i % 6 == 0:
            body += " frunk zilgup frunk zilgast"
        rows.append((i, f"Shared header line\n{body}", "en", f"s{i % 3}"))
        labels.append((i, 1, int(i % 6 == 0)))
    clean = next(r for r in rows if r[0] == 7)
    rows += [(1000 + i, clean[1], "en", "s0") for i in range(5)] + [(2000, None, "en", None), (2001, "", "en", "s1")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows, labels


def test_stages(spark, tmp_path):
    rows, labels = planted(spark, tmp_path)
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS
    toxic = {i for i, _, y in labels if y}
    after = {r["doc_id"] for r in seen["toxicity"]}
    assert len(toxic & after) <= 0.1 * len(toxic)
    assert len({i for i, _, y in labels if not y} - after) <= 3
    lines = {r["doc_id"]: r["text"] for r in seen["line_dedup"]}
    assert set(lines) == after and not any("Shared header" in t for t in lines.values())
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"])
    kept = {r["doc_id"] for r in seen["ngram_jaccard_join"]}
    assert 7 in kept and not any(1000 + i in kept for i in range(5))
    assert {i for i in after if i < 1000} <= kept
    mixed = [r["doc_id"] for r in seen["source_mix"]]
    assert set(mixed) <= kept and all(mixed.count(i) <= 2 for i in set(mixed))
    texts = {r["doc_id"]: r["text"] for r in seen["ngram_jaccard_join"]}
    assert all(r["text"] == texts[r["doc_id"]] for r in seen["source_mix"])
    packed = [r["doc_id"] for r in seen["best_fit_packing"] if r["piece"] == 0]
    assert sorted(packed) == sorted(mixed)


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()  # noqa: E731  (ASCII texts)
    uses = Counter(k for _, text, *_ in rows for k in {key(x) for x in (text or "").split("\n")} if k)
    return [(i, "\n".join(x for x in (text or "").split("\n") if not key(x) or uses[key(x)] < 10), source) for i, text, source in rows]


def brute_groups(rows):
    sets = []
    for _, text, _ in rows:
        w = text.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    kept = []
    for i, (doc_id, *_) in enumerate(rows):
        group, todo = {i}, [i]
        while todo:
            a = todo.pop()
            near = [b for b in range(len(rows)) if b not in group and (sets[a] == sets[b] or (
                sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9))]
            group.update(near)
            todo += near
        if doc_id == min(rows[b][0] for b in group):
            kept.append(rows[i])
    return kept


def brute_mix(rows):
    """Copies of each document that the mix reads: targets by resharing, then whole documents in hashed order."""
    def shuffled(doc_id, text):
        h = xxhash.xxh64_intdigest(struct.pack("<i", 17), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), h)
        return xxhash.xxh64_intdigest(text.encode(), h)

    by_source = defaultdict(list)
    for doc_id, text, source in rows:
        by_source[source].append((shuffled(doc_id, text), doc_id, len(text.split())))
    names = sorted((s for s in by_source if s is not None)) + ([None] if None in by_source else [])
    size = {s: sum(n for *_, n in by_source[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(size.values()), set(names)
    while left > 1e-6 and free:
        total, share = sum(weight[s] for s in free), left
        for s in list(free):
            part = min(share * weight[s] / total, 2 * size[s] - target[s])
            target[s] += part
            left -= part
            if target[s] >= 2 * size[s] - 1e-9:
                free.remove(s)
    out = Counter()
    for s in names:
        goal, at = int(np.floor(target[s] + 0.5)), 0
        for _ in range(2):
            for _, doc_id, n in sorted(by_source[s]):
                words = max(0, min(n, goal - at))
                at += n
                if words and 2 * words >= n:
                    out[doc_id] += 1
    return out


def test_stages_like_brute_force(spark, tmp_path):
    """Given what the first stage keeps, the rows of the last one, exactly."""
    planted(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).select("doc_id", "text", "source").collect()
    rows = brute_groups(brute_lines([tuple(r) for r in first]))
    copies, text = brute_mix(rows), {i: t for i, t, _ in rows}
    tokenizer, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for doc_id, n in copies.items():
        ids = tokenizer.encode(text[doc_id], add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or min(1024, len(ids)), len(ids), 1024), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
            want[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += n
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    filled = defaultdict(list)
    for r in out:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        ends = [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts) + 1)]
        assert [at for at, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    total = sum(r["length"] for r in out)
    assert len(filled) <= 1.05 * total / 1024 + 1


def test_training_order_reaches_the_sequences(spark, tmp_path):
    planted(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    mixed = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    mixed.write.parquet(str(tmp_path / "mixed"))
    order = [r["doc_id"] for r in mixed.collect()]
    out = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "mixed")), str(tmp_path)).collect()
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["position"]) if r["piece"] == 0] == order
    by_length = defaultdict(list)
    for r in out:
        by_length[r["length"]].append((r["position"], r["sequence_id"]))
    assert all([q for _, q in sorted(x)] == sorted(q for _, q in x) for x in by_length.values())


def test_stages_keep_columns_of_any_name_and_stand_nothing(spark, tmp_path):
    rows, _ = planted(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = ["__kept", "__kept_id", "__doc_0", "__toxicity", "__row", "row", "score", "key", "id", "k1", "position", "kept", "clean.n"]
    odd = docs
    for n in names:
        odd = odd.withColumn(n, F.lit(f"own {n}"))
    odd = odd.unionByName(odd.where("doc_id = 7")).unionByName(odd.where("doc_id = 8").withColumn("text", F.expr("repeat('w1 w2 w3 ', 20000)")))
    assert odd.count() == len(rows) + 2
    for k, table in enumerate((odd, odd.limit(0))):
        table.write.parquet(str(tmp_path / f"odd-{k}"))
        table = spark.read.parquet(str(tmp_path / f"odd-{k}"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            if name != "best_fit_packing":
                assert out.columns == [*COLUMNS, *names]
                assert out.where(" or ".join(f"`{n}` <> 'own {n}'" for n in names)).count() == 0
            assert (out.count() > 0) == (k == 0)


def test_run_is_the_stages(spark, tmp_path):
    planted(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
