"""Every link of the n-gram join, against all pairs."""

import re

import numpy as np
from compare import assert_same

from lodestone.llm import queries as Q
from lodestone.llm.ngram_join import jaccard_components, jaccard_links, near_duplicates

WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return {r[0]: sum(i != j and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, (r, a) in enumerate(zip(rows, sets, strict=True))}


def test_links_within_a_component(spark, sf_dir, duck):
    rng = np.random.default_rng(8)
    rows = [(1, None), (2, "one"), (3, "One"), (4, "")]
    for k in range(8):
        text = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for j in range(50):  # more than a node's leaves, near but not equal, with some exact copies
            w = list(text)
            w[(5 * (j % 45)) % 150] = f"edit{j % 45}"
            rows.append((1000 * (k + 1) + j, " ".join(w[: 150 - j % 12])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_links(df)
    want = brute(rows)
    assert {r.doc_id: r.n_links for r in got.collect()} == want and max(want.values()) > 40
    assert sorted(map(tuple, got.drop("n_links").collect())) == sorted(map(tuple, jaccard_components(df).collect()))
    assert_same(Q.op10_ngram_links(spark, sf_dir), duck.sql(Q.LINKS_SQL))


def test_the_tree_leaves_every_link_and_prunes_the_rest():
    from lodestone.llm import ngram_join as N

    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, int(rng.integers(5, 900)), dtype=np.uint64)
        for _ in range(5):
            edit = base.copy()
            k = int(len(edit) * rng.uniform(0, 0.3))
            edit[:k] = rng.integers(0, 2**63, k, dtype=np.uint64)
            sets.append(np.unique(edit))
    n = np.array([len(x) for x in sets])
    bits = np.zeros((len(sets), N.BITS), bool)
    for k, x in enumerate(sets):
        bits[k, (x >> np.uint64(54)).astype(int)] = True
    bits = np.packbits(bits, axis=1).view(np.uint64)
    comp = rng.integers(0, 3, len(sets))
    real = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (n[i] + n[j] - both)}
    tree = N.Tree(np.arange(len(sets)), n, bits, comp)
    assert len(tree.levels) > 3 and len(tree.levels[-1]["lo"]) == 1
    i, j, room = N.dual_traversal(tree, tree, 80, False)
    got = {tuple(sorted(p)) for p in zip(tree.order[i].tolist(), tree.order[j].tolist(), strict=True)}
    assert len(got) == len(i) and real <= got and len(got) < 0.2 * len(sets) ** 2 / 2
    half = np.arange(len(sets)) % 2 == 0
    a, b = N.Tree(np.flatnonzero(half), n, bits, comp), N.Tree(np.flatnonzero(~half), n, bits, comp)
    i, j, _ = N.dual_traversal(a, b, 80, True)
    got = {tuple(sorted(p)) for p in zip(a.order[i].tolist(), b.order[j].tolist(), strict=True)}
    assert {(i, j) for i, j in real if (i - j) % 2 and comp[i] != comp[j]} <= got and all(comp[i] != comp[j] for i, j in got)


def components_of_ids(rows):
    """doc_id -> smallest doc_id reachable, where an id with several texts is one node."""
    sets = [set(zip(*(w[k:] for k in range(5)))) if len(w := WORD.findall((t or "").lower())) >= 5 else {tuple(w)} if w else set() for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in zip(rows, sets, strict=True):
        for y, b in zip(rows, sets, strict=True):
            if a and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(x[0]), find(y[0])))
                root[high] = low
    return [find(i) for i, _ in rows]


def test_an_id_with_several_texts_is_one_node(spark):
    rng = np.random.default_rng(21)
    a, b, c = (" ".join(f"{x}{k}" for k in rng.integers(0, 9000, 200)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (4, c), (1, "short one"), (9, "short ONE"), (5, None), (5, c + " end"), (5, a + " and much")]
    rows += [(int(i), f"{(a, b, c)[k % 3]} tail{k}" if k % 4 else f"own text {k} of five words") for k, i in enumerate(rng.integers(20, 40, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(zip((i for i, _ in rows), (len(set(zip(*(w[k:] for k in range(5)))) or {tuple(w)} if (w := WORD.findall((t or "").lower())) else []) for _, t in rows), components_of_ids(rows), strict=True))
    got = jaccard_links(df).collect()
    assert [w for w in want if w[1]] == sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.n_shingles)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3, 9)} == {1}
    assert sorted(r.n_links for r in got) == sorted(brute_rows(rows))
    kept = near_duplicates(df).collect()
    worded = [r.doc_id for r in kept if r.text]
    assert len(worded) == len(set(worded)) and set(worded) == {c for c, (_, t) in zip(components_of_ids(rows), rows, strict=True) if t}


def brute_rows(rows):
    sets = [set(zip(*(w[k:] for k in range(5)))) if len(w := WORD.findall((t or "").lower())) >= 5 else {tuple(w)} if w else set() for _, t in rows]
    return [sum(i != j and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]


def test_overlaps_of_blocks():
    from lodestone.llm import ngram_join as N

    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 20_000, int(k), dtype=np.uint64)) for k in rng.integers(0, 9000, 40)]
    got = N.overlaps(sets[:25], sets[10:])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[10:]] for x in sets[:25]]
