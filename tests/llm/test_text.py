import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrel.llm import bpe, jaccard, packing
from sparrel.llm.common import components
from sparrel.llm.shingles import shingle_set

DOCS = "doc_id long, text string"


def words_of(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]


def brute_set(text, size=5):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute_components(rows, percent=80):
    sets = [brute_set(t) for _, t in rows]
    comp = {i: i for i, _ in rows if i is not None}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(rows[a][0]), root(rows[b][0])
                comp[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbÉé \t\n\x0b\x85\u00a0\u2003", max_size=60))
def test_shingles(text):
    assert len(shingle_set(text.encode())) == len(brute_set(text))


def test_shingles_tell_texts_apart():
    sets = [shingle_set(t.encode()) for t in ("a b c d e f", "A  b\nc d E f", "a b c d e g", "ab c d e f x", "a", "a b", "", " \n")]
    assert (sets[0] == sets[1]).all() and len(np.intersect1d(sets[0], sets[2])) == 1
    assert [len(s) for s in sets] == [2, 2, 2, 2, 1, 1, 0, 0]


def test_divide_skip_against_brute_force():
    rng = random.Random(2)
    for percent in (50, 80, 100):
        for _ in range(60):
            base = [rng.sample(range(60), rng.randrange(1, 25)) for _ in range(6)]
            sets = [sorted({x if rng.random() > 0.1 else rng.randrange(60) for x in rng.choice(base)}) for _ in range(25)]
            arrays = [np.array(s, dtype=np.uint64) for s in sets]
            index = jaccard.Index(arrays)
            for skip in (0.001, 0.03, 100):
                q = rng.choice(range(25))
                want = [i for i, s in enumerate(sets) if 100 * len({*s} & {*sets[q]}) >= percent * len({*s} | {*sets[q]})]
                assert sorted(index.search(arrays[q], percent, skip)) == want


def test_merge_skip_counts():
    lists = [[1, 3, 5], [1, 5], [5, 9], [2, 5, 9]]
    assert dict(jaccard.merge_skip(lists, 2)) == {1: 2, 5: 4, 9: 2} and dict(jaccard.merge_skip(lists, 4)) == {5: 4}
    assert list(jaccard.merge_skip([], 1)) == []


def test_prefix_of_any_order_meets_links():
    rng = np.random.default_rng(3)
    rank = rng.integers(0, 4, jaccard.SLOTS).astype(np.uint16)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 40), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 62, 2, dtype=np.uint64)]))
        overlap = len(np.intersect1d(a, b))
        if 100 * overlap >= 80 * (len(a) + len(b) - overlap):
            pa, pb = jaccard.prefix(a, rank, 80), jaccard.prefix(b, rank, 80)
            shared = len(np.intersect1d(pa, pb))
            others = max(-(-80 * len(a) // 100), -(-80 * len(b) // 100)) - 1
            assert shared >= 1 and shared >= jaccard.occurrences(len(a), len(b), 80) - others
            assert overlap >= jaccard.occurrences(len(a), len(b), 80)


def near(spark, rows):
    got = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice((1, 4, 5, 20, 60)))] + passage * (rng.random() < 0.4) for _ in range(n // 5)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((1000 - i, " ".join(words) if rng.random() < 0.9 else "\n".join(words).upper()))
    return rows


@pytest.mark.parametrize("short", [64, 3])
def test_near_duplicates_against_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "BLOCK", 512 if short == 64 else 4)
    rows = corpus(short, 240) + [(2000, None), (2001, ""), (2002, " \n"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A B c d e  f")]
    assert near(spark, rows) == brute_components(rows)


def test_texts_under_one_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(5, a), (5, b), (5, c), (5, c), (2, a + " more"), (3, "and " + b), (9, c + " too"), (7, ""), (7, "one two three four five six"), (None, a)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    want = [(5, 26, 2), (2, 27, 2), (5, 26, 3), (3, 27, 3), (5, 26, 5), (5, 26, 5), (9, 27, 5), (7, 0, 7), (7, 2, 7), (None, 26, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_large_group_of_near_copies_and_a_common_passage(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:40] + [f"y{i}_{k}" for k in range(9)])) for i in range(150)]
    assert near(spark, rows) == brute_components(rows)


@pytest.mark.parametrize("hot", [2, 9])
def test_lists_dealt_out_lose_no_link(spark, monkeypatch, hot):
    """Lists in parts, centres of parts, blocks by prefixes: the same components."""
    monkeypatch.setattr(jaccard, "SHORT", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "SPREAD", 2)
    monkeypatch.setattr(jaccard, "PART", 2)
    rng = random.Random(hot)
    base = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(base[:k] + [f"x{rng.randrange(30)}"] + base[k + 1 :])) for i in range(120) for k in [rng.randrange(40)]]
    rows += [(500 + i, " ".join(base[:30] + [f"y{i % 40}_{k}" for k in range(9)])) for i in range(80)]
    rows += [(900 + i, t) for i, (_, t) in enumerate(corpus(hot, 60))]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS), hot=hot).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_sketch_is_sized_by_the_corpus_and_counts_all(spark):
    assert jaccard.slots_for(0) == jaccard.slots_for(262_144) == jaccard.SLOTS
    assert jaccard.slots_for(262_145) == 2 * jaccard.SLOTS and jaccard.slots_for(10**12) == jaccard.MOST_SLOTS
    docs = spark.createDataFrame([(i, "one common passage of six words here" if i % 2 else f"{i} b c d e") for i in range(600)], DOCS).repartition(70)
    sets, rank = jaccard.scan(docs, 5, jaccard.SLOTS)
    assert sets.count() == 600
    common = jaccard.shingle_set(b"one common passage of six words here")
    assert set(rank[jaccard._slot(common, len(rank))].tolist()) == {round(np.log2(300) * 6)}


def test_near_duplicates_ignore_other_columns(spark):
    rows = [(1, "a b c d e f", 9, 9, "x"), (2, "a b c d e f", 8, 8, "y"), (3, "g h i j k l", 7, 7, None)]
    docs = spark.createDataFrame(rows, DOCS + ", n_shingles int, component_id int, id string")
    got = jaccard.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1), (2, 2, 1), (3, 2, 3)]


def test_near_duplicates_of_nothing(spark):
    assert near(spark, [(1, None)]) == [(1, 0, 1)]
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(5)
    words = [f"{rng.randrange(10**9)}" for _ in range(120_000)]
    other = list(words)
    other[::100] = ["z"] * len(other[::100])
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "short text of six words here")]
    assert near(spark, rows) == brute_components(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (1, 9), (9, 4)] + [(200, rng.randrange(201, 260)) for _ in range(80)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and {got[k] for k in (1, 9, 4)} == {1} and 5 not in got
    assert {v for k, v in got.items() if k >= 200} == {200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


PARTS = ["a", "Z", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "日本", "😀", "1", "²", "<|endoftext|>", "\u00a0", "--", "!!", "\x00", "\u0301", "the", "ing", "\ufeff", "<|endo", "\r\n", "\x1c"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), st.text(max_size=40)))
def test_bpe_is_the_librarys(text):
    from tokenizers import Tokenizer

    one = bpe.load(bpe.default_path())
    tokenizer = test_bpe_is_the_librarys.__dict__.setdefault("library", Tokenizer.from_file(bpe.default_path()))
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert one.encode(text) == ids and one.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False) == text
    assert packing._encoding(bpe.default_path()).encode(text, allowed_special="all") == ids


def test_bpe_long_pieces_and_small_cache(library):
    small = bpe.Bpe(bpe.default_path(), cache=4)
    for text in ("a" * 20_000, " " * 3000, "the quick brown fox jumps over the lazy dog " * 20):
        assert small.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(small.known) <= 4


def test_bpe_columns(spark, library):
    texts = [None, "", "Hello <|endoftext|> wörld", "x " * 50_000, "Hello <|endoftext|> wörld"]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], DOCS + ", ids string")
    coded = bpe.encode(docs)
    back = {r.doc_id: r.text for r in bpe.decode(coded).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    for r in bpe.round_trip(docs).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids == "old"
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0)).count() == 0


def check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing(spark, library):
    rng = random.Random(7)
    texts = [None, "", "word " * 5000, "word " * 2047, "word " * 2048] + ["w " * rng.choice((3, 40, 40, 40, 600, 1400)) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[7])], DOCS)
    cut = packing.pieces(docs).cache()
    rows = packing.pack(cut).collect()
    assert len(rows) == cut.count()
    parts = {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted(parts[i], key=lambda r: r.piece)[:: 2 if i == 7 else 1]
        assert sum((list(r.ids) for r in mine), []) == ids
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
        assert all(r.length == 2048 for r in mine[1:]) and [r.piece for r in mine] == list(range(len(mine)))
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    bound = -(-sum(r.length for r in rows) // 2048)
    assert check_packing(rows, 2048) <= bound * 1.03 + 1
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def test_packing_of_long_white_space(spark, library):
    texts = [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "x" + " \u00a0" * 600_000 + "\ny <|endoftext|>" + "\t" * 1_100_000 + "<|endoftext|> z", "é " + " " * 1_200_000 + " é\x1c" + "\r\n" * 150_000 + "!"]
    docs = spark.createDataFrame([*enumerate(texts)], DOCS)
    got = {}
    for r in packing.pieces(docs).orderBy("doc_id", "piece").toLocalIterator():
        got.setdefault(r.doc_id, []).extend(r.ids)
    for i, t in enumerate(texts):
        assert got[i] == library.encode(t, add_special_tokens=False).ids + [0], i


@pytest.mark.parametrize("safe", [1, 2, 3])
def test_ids_do_not_depend_on_where_white_space_is_cut(library, monkeypatch, safe):
    monkeypatch.setattr(packing, "SAFE_RUN", safe)
    rng, encoding = random.Random(safe), packing._encoding(bpe.default_path())
    for _ in range(2000):
        text = "".join(rng.choice(PARTS + [" ", "\n", "   ", "\u2028", "\x85", "\u3000", "\u200b"]) for _ in range(rng.randrange(25)))
        assert packing.token_ids(encoding, text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_plan_uses_every_piece_once():
    rng = random.Random(11)
    for size, n in ((2048, 400), (64, 2000), (16, 50), (10, 0)):
        for spread in (1, 3):
            histogram = Counter(min(size, max(1, int(rng.expovariate(spread / size)) + 1)) for _ in range(n))
            used = packing.plan(dict(histogram), size)
            pieces = Counter()
            for bin_, k in used:
                assert sum(bin_) <= size and k > 0
                for a in bin_:
                    pieces[a] += k
            assert pieces == histogram
            total = sum(a * k for a, k in histogram.items())
            assert sum(k for _, k in used) <= -(-total // size) * 1.05 + 1


def test_fit_counts_is_non_negative_least_squares():
    found = [(3, 5), (5,), (1, 3)]
    x = packing.fit_counts(found, {1: 4, 3: 10, 5: 9}, sweeps=500)
    assert (x >= 0).all()
    a = np.array([[0, 0, 1], [1, 0, 1], [1, 1, 0]])
    gradient = a.T @ (a @ x - np.array([4, 10, 9]))
    assert np.all(gradient > -1) and np.all(np.abs(gradient[x > 0]) < 1)


def test_pack_refuses_what_does_not_fit(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long"), size=8)


def test_packing_clashing_columns_empty_table_and_long_texts(spark):
    from pyspark.sql import functions as F

    words = " ".join(f"word{i}" for i in range(9000))  # over 25 KB
    docs = spark.createDataFrame([(1, words, 5, "x"), (2, None, 6, "y"), (3, " " * 250_000 + "end", 7, None), (2, "", 8, "z")], DOCS + ", offset int, sequence_id string")
    cut = packing.pieces(docs)
    packed = packing.pack(cut.drop("ids").withColumn("offset", F.lit("old")).withColumn("sequence_id", F.lit("old")))
    rows = packed.collect()
    assert len(rows) == cut.count() and dict(packed.dtypes)["offset"] == "bigint"
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.pieces(docs.limit(0), ids=False)).count() == 0
