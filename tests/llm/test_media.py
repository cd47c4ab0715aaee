"""Recall of the image index by kind of edit, against the comparison of every pair, and hostile tables."""

import numpy as np

from lodestone.llm import media as M

EDITS = {
    "crop": lambda x: x[9:-4, 5:-11],
    "half": lambda x: x[20:88, 24:92],
    "turn": lambda x: np.rot90(x) * 0.7 + 10,
    "smaller": lambda x: M.resize(x[None], 1.4)[0] * 0.9 + 20,
    "smaller by a level": lambda x: M.resize(x[None], 1.2)[0],
}


def pictures(n):
    return M.rendered(np.random.default_rng(2).normal(0, 0.3, (n, 64)).tolist())


def test_recall_by_kind(spark):
    pics = pictures(40)
    rows = [(i, M.pgm(x)) for i, x in enumerate(pics)]
    for k, f in enumerate(EDITS.values(), 1):
        rows += [(1000 * k + i, M.pgm(f(x))) for i, x in enumerate(pics)]
    got = {r.media_id: r.component_id for r in M.copies(spark.createDataFrame(rows, "media_id long, image binary")).collect()}
    points = {i: np.frombuffer(p, M.POINT) for (i, _), p in zip(rows, M.describe([b for _, b in rows]), strict=True)}
    for k, kind in enumerate(EDITS, 1):
        true = [i for i in range(40) if M.consensus(points[i], points[1000 * k + i]) >= M.MIN_INLIERS]
        assert len(true) >= 38, kind  # the comparison itself knows the edit
        assert sum(got[i] == got[1000 * k + i] for i in true) >= 0.9 * len(true), kind
    # what the index links is what comparing every pair links, if not all of it
    assert all(c % 1000 == i % 1000 for i, c in got.items())


def test_a_large_picture_and_a_part_of_it(spark):
    big = np.kron(np.ones((2, 3)), pictures(1)[0])[:150, :260] * 0.5 + np.concatenate([np.concatenate(pictures(6)[3 * r : 3 * r + 3], axis=1) for r in range(2)])[:150, :260] * 0.5
    rows = [(1, M.pgm(big)), (2, M.pgm(big[40:120, 90:180])), (3, M.pgm(pictures(9)[8]))]
    got = {r.media_id: r.component_id for r in M.copies(spark.createDataFrame(rows, "media_id long, image binary")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_many_near_copies_share_entries(spark, monkeypatch):
    """More copies than a block holds, and unlike pictures in the same entries: the labels are those of comparing every pair."""
    monkeypatch.setattr(M, "BLOCK", 4)
    pics = pictures(6)
    rows = [(100 * k + j, M.pgm(x * (0.6 + 0.02 * j) + j)) for k, x in enumerate(pics) for j in range(15)]
    got = {r.media_id: r.component_id for r in M.copies(spark.createDataFrame(rows, "media_id long, image binary")).collect()}
    assert all(got[i] == i // 100 * 100 for i, _ in rows)


def test_star_runs_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = sorted((int(k), int(r)) for k, r in zip(rng.integers(0, 40, 300), rng.integers(0, 12, 300), strict=True))
    want = []
    for k in sorted({k for k, _ in rows}):
        reps = sorted({r for q, r in rows if q == k})
        want += [(k, reps[0], r, i) for i, r in enumerate(reps[1:], 1)]
    for step in (1, 3, 7, 300):
        parts = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[s : s + step]], pa.int64()), pa.array([r for _, r in rows[s : s + step]], pa.int64())], names=["key", "rep"]) for s in range(0, 300, step)]
        got = [tuple(x.values()) for b in M._star(parts) for x in b.to_pylist()]
        assert got == want


def test_hostile_images(spark):
    pic = M.pgm(pictures(1)[0])
    rows = [(1, None, "a", 1), (2, b"", "b", 2), (3, b"P5 9 9 255\n", None, 3), (None, b"x", "c", 4), (4, b"P5 2 2 255\n1234", "d", 5), (7, pic, "e", 6), (7, pic, "e", 6), (7, b"other", "f", 7), (8, pic, "g", 8), (None, pic, None, None)]
    df = spark.createDataFrame(rows, "media_id long, image binary, hash string, points long")
    got = sorted(((r.media_id, r.class_id, r.n_class, r.component_id) for r in M.copies(df).collect()), key=str)
    assert got == sorted([(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 3), (None, None, 1, None), (4, 4, 1, 4), (7, 7, 3, 7), (7, 7, 3, 7), (7, 7, 1, 7), (8, 7, 3, 7), (None, None, 1, None)], key=str)
    assert M.copies(df.limit(0)).count() == 0
    assert M.media_from_embeddings(spark.createDataFrame([(None, None), (3, []), (13, [0.5, None])], "vec_id long, embedding array<float>")).count() == 5


def close_by_hand(rows, block):
    """What _close has to give, entry by entry."""
    near = lambda x, y: (x ^ y).bit_count() <= M.NEAR_BITS
    pairs, stay = set(), set()
    for k in {r[0] for r in rows}:
        of = [r for r in rows if r[0] == k]
        pairs |= {(k, of[0][1], r) for _, r, w in of[1:] if r != of[0][1] and near(w, of[0][2])}
        stay |= {(k, r, w) for i, (_, r, w) in enumerate(of[1:], 1) if len(of) > block or any(i != j and r != q and near(w, x) for j, (_, q, x) in enumerate(of[1:], 1))}
    return pairs, stay


def test_close_images_of_entries_over_batches(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 62, 5)]
    size = [int(x) for x in rng.integers(1, 14, 40)]
    rows = sorted((k, int(rng.integers(0, 30)), base[rng.integers(0, 5)] ^ int(rng.integers(0, 1 << 9))) for k, n in enumerate(size) for _ in range(n))
    for block in (4, 512):
        monkeypatch.setattr(M, "BLOCK", block)
        for step in (1, 3, 7, 1000):
            parts = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[s : s + step]], pa.int64()) for c in range(3)], names=["key", "rep", "sketch"]) for s in range(0, len(rows), step)]
            got = [tuple(x.values()) for b in M._close(parts) for x in b.to_pylist()]
            assert ({g[:3] for g in got if g[2] is not None}, {(g[0], g[1], g[3]) for g in got if g[2] is None}) == close_by_hand(rows, block), (block, step)


def test_unlike_pictures_that_share_entries_make_few_rows():
    """Five times the pictures: what is written for the blocks and the pairs stays near what their copies need."""
    import pyarrow as pa

    made = []
    for n in (300, 1500):
        vectors = np.random.default_rng(6).normal(0, 0.125, (n, 64)).tolist()
        points = [np.frombuffer(x, M.POINT)["bits"] for x in M.describe([M.pgm(x) for x in M.rendered(vectors)])]
        key, sketch = (x.ravel() for x in M.keys(np.concatenate(points)))
        rep = np.tile(np.repeat(np.arange(n), [len(p) for p in points]), M.TABLES)
        order = np.lexsort((rep, key))
        made.append(sum(b.num_rows for b in M._close([pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (key, rep, sketch)], names=["key", "rep", "sketch"])])))
    assert made[1] <= n // 5  # they are no copies; sharing an entry alone would give some thousands of rows
