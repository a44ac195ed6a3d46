import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrel.llm import langid, media, quality
from sparrel.llm.queries import _remainder

DOCS = "doc_id long, text string"


def test_png_round_trip_with_all_filters():
    rng = np.random.default_rng(1)
    for rows in (1, 2, 40):
        payload = rng.integers(0, 256, 192 * rows, dtype=np.uint8).tobytes()
        smooth = (np.arange(192 * rows) // 7 % 256).astype(np.uint8).tobytes()
        for p in (payload, smooth):
            for filters in ((0,), (1,), (2,), (3,), (4,), (0, 1, 2), (0, 1, 2, 3, 4)):
                assert media.png_decode(media.png_encode(p, filters=filters, part=100)).tobytes() == p


def test_damaged_png_is_refused():
    good = media.png_encode(b"x" * 192)
    for at in range(len(good)):
        with pytest.raises(media.MediaError):
            media.png_decode(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
    for cut in range(len(good) - 1):
        with pytest.raises(media.MediaError):
            media.png_decode(good[:cut])
    with pytest.raises(media.MediaError):
        media.png_encode(b"")


def test_cosine_hash_follows_the_image_not_its_noise():
    rng = np.random.default_rng(2)
    image = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8), int))[:, :, None].repeat(3, 2)
    near = np.clip(image + rng.integers(-2, 3, image.shape), 0, 255)
    bits = lambda x: np.unpackbits(np.frombuffer(media.cosine_hash(x), np.uint8))
    assert (bits(image) != bits(near)).sum() <= 6
    assert (bits(image) != bits(rng.integers(0, 256, image.shape))).sum() > 12
    assert media.cosine_hash(np.full((1, 64, 3), 32)) == b"\x80" + bytes(7)


def test_media_digests(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "long " * 300_000, "a"]
    rows = {r.doc_id: r for r in media.media_digests(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and len(r.feature) == 16
    same = lambda r: r[1:]
    assert same(rows[0]) == same(rows[1]) and same(rows[2]) == same(rows[7])
    assert media.media_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_media_columns_keep_others_and_replace_clashes(spark):
    df = spark.createDataFrame([(1, "t", "old", 5)], "id long, text string, media string, `a b` int")
    stored = media.attach_png(df)
    back = media.read_png(stored.withColumn("hash", F.lit("old")))
    row = back.first().asDict()
    assert row["payload"].rstrip() == b"t" and row["a b"] == 5 and row["id"] == 1 and len(row["hash"]) == 8
    assert media.read_png(spark.createDataFrame([(None,)], "media binary")).first().asDict() == {"payload": None, "hash": None}


def _words(rng, n, syllables):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def _quality_rows(n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        text = _words(rng, rng.randrange(30, 80), ["an", "the", "ri", "on"]).capitalize() + "."
        junk = i % 4 == 0
        rows.append((i, " | ".join(text.upper().split()) if junk else text, int(not junk)))
    return rows


def test_quality_separates_held_out_rows(spark):
    rows = _quality_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, _remainder(4) != 2)
    got = {r.doc_id: r for r in quality.with_quality(docs, model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == rows[i][2] for i in held]) > 0.98
    again = quality.fit_quality(docs.repartition(7), labels, _remainder(4) != 2)
    assert np.allclose(again.weights, model.weights)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (1, None, "x")], DOCS + ", score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(docs, none)
    assert [r.score for r in quality.with_quality(docs, model).collect()] == [0.5] * 4
    odd = spark.createDataFrame([(1, None), (2, 7), (None, 1), (2, 1)], "doc_id long, quality int")
    assert quality.with_quality(docs, quality.fit_quality(docs, odd)).count() == 4
    assert quality.with_quality(docs.limit(0), model).count() == 0


def test_isotonic_is_the_least_squares_fit():
    x, y = np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0])
    knots, levels = quality.isotonic(x, y)
    assert (np.diff(levels) >= 0).all() and knots.tolist() == sorted(knots)
    assert np.allclose(np.interp([1, 2, 3], knots, levels), 1.5 / 4)  # pooled, with the prior of half a row


def test_statistics_of_nothing():
    assert not quality.statistics(None).any() and not quality.statistics("").any()
    assert np.isfinite(quality.statistics(" \n")).all() and np.isfinite(quality.statistics("!")).all()


def test_languages(spark):
    rng = random.Random(4)
    kinds = {"aa": ["ba", "ko", "mi"], "bb": ["ßü", "cht", "ver"], "cc": ["ção", "que", "lh"]}
    rows = [(i, _words(rng, rng.randrange(3, 40), kinds[k := "aa bb cc".split()[i % 3]]), k) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    model = langid.fit_languages(docs, _remainder(5) != 0)
    got = {r.doc_id: r for r in langid.with_language(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[i].lang_pred == k for i, _, k in held]) > 0.97
    # brute force of the scores, text by text
    for i, t, _ in rows[:20]:
        total = model.prior.copy()
        for bucket, _ in langid.grams([t], len(model.table)):
            total += model.table[bucket].sum(0, dtype=float)
        p = np.exp(total - total.max())
        assert got[i].lang_score == pytest.approx(p.max() / p.sum())


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 %$", "en"), (4, "abc", None), (5, "x", "en"), (5, "x", "en")]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    got = [(r.doc_id, r.lang_pred) for r in langid.with_language(docs, langid.fit_languages(docs)).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en"), (5, "en")]
    empty = docs.limit(0)
    assert [r.lang_pred for r in langid.with_language(docs, langid.fit_languages(empty)).collect()] == ["und"] * 6
    assert langid.with_language(empty, langid.fit_languages(docs)).count() == 0


def test_grams_do_not_depend_on_the_batch():
    texts = ["Abc d", "", "é1é", None, "zz"]
    whole = {}
    for bucket, own in langid.grams(texts, 1 << 15):
        for b, o in zip(bucket.tolist(), own.tolist(), strict=True):
            whole.setdefault(o, []).append(b)
    for i, t in enumerate(texts):
        alone = [b for bucket, _ in langid.grams([t], 1 << 15) for b in bucket.tolist()]
        assert sorted(alone) == sorted(whole.get(i, []))
    assert json.dumps(sorted(whole)) == "[0, 2, 4]"
