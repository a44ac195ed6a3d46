"""Fits against brute force, and the queries as they are registered, on the smallest tables."""

import random
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrel.llm import langid, quality, queries
from sparrel.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def _jobs(spark, what):
    """Jobs that a call ran, and the most tasks of one stage."""
    sc, group = spark.sparkContext, f"g{random.random()}"
    out = []

    def work():
        sc.setJobGroup(group, "counted")
        out.append(what())

    thread = threading.Thread(target=work)
    thread.start()
    thread.join()
    tracker = sc.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    tasks = [i.numTasks for s in stages if (i := tracker.getStageInfo(s))]
    return out[0], len(tracker.getJobIdsForGroup(group)), max(tasks)


def test_language_fit_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "Ab c!", "x" * 50, "é ü"]) if i % 9 == 0 else " ".join(rng.choice("la ba ra ko mi".split()) for _ in range(rng.randrange(1, 40))), rng.choice(["aa", "bb", "c c", None])) for i in range(200)]
    rows.append((500, "very long " * 60_000, "bb"))
    docs = spark.createDataFrame(rows, DOCS + ", lang string").repartition(5)
    model = langid.fit_languages(docs, buckets=1 << 10)
    learnt = [(t, x) for _, t, x in rows if t is not None and x is not None]
    assert model.languages == ("aa", "bb", "c c")
    want = np.zeros((1 << 10, 3))
    for t, x in learnt:
        for bucket, _ in langid.grams([t], 1 << 10):
            np.add.at(want[:, model.languages.index(x)], bucket, 1)
    want += 0.5
    assert np.allclose(model.table, np.log(want / want.sum(0)), atol=1e-5)
    assert np.allclose(model.prior, [np.log(np.mean([x == y for _, y in learnt])) for x in model.languages])


def test_many_languages(spark):
    """More languages than the former cap of 256, each with letters of its own."""
    rows = [(k * 4 + j, "".join(chr(0x4E00 + 7 * k + rng.randrange(7)) for _ in range(30)), f"l{k:03d}") for k in range(300) for j, rng in ((j, random.Random(k * 4 + j)) for j in range(4))]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    model = langid.fit_languages(docs)
    assert len(model.languages) == 300 and model.table.size <= langid.CELLS
    got = {r.doc_id: r.lang_pred for r in langid.with_language(docs, model).collect()}
    assert np.mean([got[i] == x for i, _, x in rows]) > 0.99
    assert langid.buckets_for(256, 1 << 15) == 1 << 15 and langid.buckets_for(257, 1 << 15) == 1 << 14
    assert langid.buckets_for(8192, 1 << 15) == langid.buckets_for(10**6, 1 << 15) == langid.LEAST_BUCKETS


def test_language_fit_runs_few_wide_jobs(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some text here").alias("text"), F.lit("en").alias("lang")).repartition(24)
    docs.count()
    _, jobs, tasks = _jobs(spark, lambda: langid.fit_languages(docs, sample=100))
    assert jobs <= 12 and tasks == 24


def test_languages_ties_long_texts_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "ab", "y"), (2, "ab", "x")], DOCS + ", lang string")
    model = langid.fit_languages(docs)
    odd = spark.createDataFrame([(1, "ab", "old", 7), (1, "ab", "old", 7), (2, "ab " * 500_000, None, 8)], DOCS + ", lang_pred string, lang_score int")
    got = langid.with_language(odd, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["x", "x", "x"] and got[0].lang_score == pytest.approx(0.5)  # a tie: the first by name
    assert odd.columns == ["doc_id", "text", "lang_pred", "lang_score"] and len(got[0]) == 4


def _isotonic(x, y):
    """Least squares by the min-max formula, over sorted places."""
    order = np.argsort(x, kind="stable")
    y = y[order]
    n = len(y)
    means = [[y[a : b + 1].mean() if a <= b else 0 for b in range(n)] for a in range(n)]
    return x[order], np.array([max(min(means[a][b] for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def test_quality_fit_and_scores_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(160):
        text = " ".join("".join(rng.choice(["an", "the", "ri", "on"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60)))
        label = rng.random() < 0.6
        rows.append((i, text.upper() + "!" if not label and rng.random() < 0.8 else text + ".", int(label)))
    rows.append((900, "Word after word. " * 40_000, 1))
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS).repartition(5)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, dims=16)

    part = {r.doc_id: r.c for r in labels.select("doc_id", (F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(5)) == 0).alias("c")).collect()}
    x = np.array([quality.statistics(t) for _, t, _ in rows])
    y, held = np.array([float(q) for *_, q in rows]), np.array([part[i] for i, *_ in rows])
    z = np.clip((x - x[~held].mean(0)) / np.maximum(x[~held].std(0), 1e-6), -6, 6)
    f = np.hstack([np.cos(z @ model.directions + model.phases) * np.sqrt(2 / 16), np.ones((len(z), 1))])
    fit = f[~held]
    # ridge as least squares with rows that pull the weights (not the constant) to zero
    pull = np.sqrt(1e-3 * len(fit) / 16)
    more = np.hstack([np.eye(16) * pull, np.zeros((16, 1))])
    weights = np.linalg.lstsq(np.vstack([fit, more]), np.append(y[~held], np.zeros(16)), rcond=None)[0]
    assert np.allclose(weights, model.weights, atol=1e-6)
    knots, levels = _isotonic((f @ weights)[held], y[held])
    # without the prior of half a row, pooled blocks are those of the min-max formula
    blocks = {}
    for k, v in zip(knots, levels, strict=True):
        blocks.setdefault(round(v, 9), []).append(k)
    assert len(model.knots) == 2 * len(blocks) and np.allclose(model.knots, [e for b in blocks.values() for e in (b[0], b[-1])], atol=1e-6)
    want = np.maximum.accumulate([(v * len(b) + 0.5) / (len(b) + 1) for v, b in blocks.items() for _ in range(2)])
    assert np.allclose(model.levels, want, atol=1e-6)
    got = {r.doc_id: r.score for r in quality.with_quality(docs, model).collect()}
    assert np.allclose([got[i] for i, *_ in rows], np.clip(np.interp(f @ weights, model.knots, model.levels), 0, 1), atol=1e-6)


COLUMNS = {
    "op1_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op2_quality": "doc_id held_out score predicted",
    "op3_language": "doc_id held_out lang_pred score",
    "op4_html": "page_id url text n_chars",
    "op5_urls": "page_id host path rule verdict score",
    "op6_jaccard": "doc_id n_shingles component_id",
    "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10_embeddings": "vec_id n_links component_id kept",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    """Contract columns, a row for each row (but for pieces), and the folds."""
    of = "embeddings" if "embeddings" in name else "pages" if "pages" in COLUMNS[name] or "page_id" in COLUMNS[name] else "documents"
    rows = queries.QUERIES[name](spark, SF)
    assert rows.columns == COLUMNS[name].split()
    got, source = rows.collect(), table(spark, SF, of)
    key = rows.columns[0]
    ids = sorted(r[key] for r in got if name != "op8_packing" or r.piece == 0)
    assert ids == sorted(r[key] for r in source.select(key).collect())
    fold = {"op2_quality": (4, 2), "op3_language": (5, 0)}.get(name)
    if fold:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in got)
        assert all(0 <= r.score <= 1 for r in got)
    if name == "op2_quality":
        assert all(r.predicted == (r.score >= 0.7) for r in got)
    if name == "op3_language":
        lang = {r.doc_id: (r.lang, r.text) for r in source.collect()}
        known = {x for x, _ in lang.values()}
        assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in lang[r.doc_id][1] or "")) and r.lang_pred in known | {"und"} for r in got)
    if name == "op8_packing":
        assert all(1 <= r.length <= 2048 and r.offset + r.length <= 2048 for r in got)
    if name == "op10_embeddings":
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_chat_query(spark):
    got = queries.op9_chat(spark, SF)
    turns = table(spark, SF, "conversations")
    assert got.count() >= turns.count() and set("conv_id".split()) <= set(got.columns)
