import numpy as np
import pytest

from sparrel.llm import chat, embeddings

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    def good(r):
        return r[0] is not None and r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    x = {k: np.array(r[1], dtype=np.float32).astype(float) / np.linalg.norm(np.array(r[1], dtype=np.float32).astype(float)) for k, r in enumerate(rows) if good(r)}
    links, comp = {k: set() for k in range(len(rows))}, {k: k for k in range(len(rows))}
    for a in x:
        for b in x:
            if a != b and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= cosine:
                links[a].add(b)
    for k in comp:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        comp[k] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted(((rows[k][0], len(links[k]), comp[k], rows[k][0] is not None and rows[k][0] == comp[k]) for k in range(len(rows))), key=str)


def made(seed, n, groups, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(groups)] + rng.normal(size=dim) * rng.choice([0, 0.03, 0.1])
        rows.append((int(i * 3 % 1009), [float(x) for x in v], int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("block", [1024, 7])
def test_near_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = made(block, 300, 25)
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [float("inf")] * 16, 1), (2004, rows[0][1], None), (2005, [1.0, None] + [1.0] * 14, 1), (None, rows[0][1], rows[0][2]), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [], 1), rows[1], rows[1]]
    odd += [(2010, [x * 1e18 for x in rows[0][1]], rows[0][2]), (2011, [x * 1e-18 for x in rows[0][1]], rows[0][2])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows + odd, VECTORS)).collect()
    want = brute(rows + odd)
    have = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str)
    close = sum(a[1] for a in have) / sum(b[1] for b in want)
    assert len(have) == len(want) and close >= 0.99
    assert sum(a == b for a, b in zip(have, want, strict=True)) >= 0.97 * len(want)
    by = {r.vec_id: r for r in got}
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in (2000, 2001, 2002, 2003, 2004, 2005, 2008))


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):  # pairs at cosine 0.9805
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.9805 * a + np.sqrt(1 - 0.9805**2) * b
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, c.tolist(), 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, VECTORS)).agg({"n_links": "sum"}).first()[0]
    assert got >= 0.98 * 800


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(1, None, None)], VECTORS)).first().kept


TURNS = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    out = []
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        for me in {r[2] or "" for r in turns}:
            text = ""
            for _, turn, role, said in turns:
                role, said = role or "", said or ""
                head = "<|im_start|>" + ("assistant" if role == me else f"user name={role}") + "\n"
                segment = head + said + "<|im_end|>\n"
                lo, hi = (len(text) + len(head), len(text) + len(segment) - 1) if role == me else (len(text), len(text))
                out.append((conv, me, turn, role, "assistant" if role == me else "user", segment, role == me, len(text), lo, hi))
                text += segment
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [256, 2])
def test_rotation(spark, block):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 2, "ann", None), (1, 2, "ann", None), (1, 5, None, "é😀"), (2, 0, "ann", ""), (None, None, "x", "a"), (None, 3, "y", "b"), (3, -4, "a", "neg"), (3, -1, "b", "t")]
    rows += [(9, i, "abc"[i % 3], "t" * (i % 11)) for i in range(60)]
    got = chat.rotate(spark.createDataFrame([(*r, "extra") for r in rows], TURNS + ", segment string"), block=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute_chat(rows)
    for r in chat.dialogues(got).collect():
        mine = [x for x in brute_chat(rows) if (x[0], x[1]) == (r.conv_id, r.perspective)]
        whole = "".join(x[5] for x in sorted(mine, key=lambda x: x[7]))
        assert r.text == whole and all(whole[m.start : m.end].endswith("<|im_end|>") for m in r.masks)
    assert chat.rotate(spark.createDataFrame([], TURNS)).count() == 0


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.001], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None), (5, [2.0, 0.0], "a")]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id, r.kept) for r in got] == [(2, 1, True), (2, 1, False), (0, 3, True), (0, 4, True), (2, 1, False)]


def test_recall_measure_and_other_columns(spark):
    from sparrel.llm import recall

    rows = [(*r, "x", 7, 8) for r in made(4, 200, 12)] + [(5000, None, 1, None, None, None)]
    vectors = spark.createDataFrame(rows, VECTORS + ", kept string, n_links int, key int")
    found, there = recall.recall(vectors)
    want = sum(r[1] for r in brute([r[:3] for r in rows]))
    assert there == want and found >= 0.99 * there
    assert embeddings.near_duplicates(vectors).columns == ["vec_id", "n_links", "component_id", "kept"]
    assert recall.recall(vectors.limit(0)) == (0, 0)


def test_units_of_two_blocks_count_as_one_block_does():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x[20:45] = x[0] + rng.normal(size=(25, 8)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, n, keys = np.arange(60) * 10, rng.integers(1, 4, 60), rng.integers(0, 2, (60, 3))
    hit = (x @ x.T >= 0.98) & ~np.eye(60, dtype=bool)
    for t in range(3):
        for s in range(t):
            hit &= keys[:, None, s] != keys[None, :, s]
        whole = embeddings._unit((ids, n, x, keys), None, t, 0.98)
        got = dict(zip(whole[0].tolist(), whole[2].tolist(), strict=True)) if whole else {}
        assert got == {int(ids[i]): int(c) for i, c in enumerate(hit @ n) if c}
        parts = {}
        for a, b in ((slice(0, 30), None), (slice(30, 60), None), (slice(0, 30), slice(30, 60))):
            unit = embeddings._unit(tuple(c[a] for c in (ids, n, x, keys)), b and tuple(c[b] for c in (ids, n, x, keys)), t, 0.98)
            for i, _, c in zip(*unit, strict=True) if unit else ():
                parts[int(i)] = parts.get(int(i), 0) + int(c)
        assert parts == got


def test_dialogues_long_null_and_repeated(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i} " * (2000 if i == 7 else 1)) for i in range(300)]
    rows += [(2, 1, None, None), (2, 1, None, None), (None, None, None, None), (3, 0, "a", ""), (3, 0, "a", "")]
    got = chat.rotate(spark.createDataFrame(rows, TURNS))
    assert got.where("conv_id = 1").count() == 600  # each of two speakers in turn is the assistant
    assert got.where("conv_id = 3").count() == 2 and chat.rotate(spark.createDataFrame([], TURNS)).count() == 0
