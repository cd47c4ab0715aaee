"""Merkle manifest against a plain version."""

import hashlib
import zlib

from lodestone.llm.merkle import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos long, tree string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)))


def climbed(nodes):
    """The levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][s : s + 8])) for s in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    for m in levels[:-1]:
        s = i - i % 8
        yield "".join(m[s:i]), "".join(m[i + 1 : s + 8])
        i //= 8


def plain(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        kept = leaf(r, r[4])
        trees.setdefault(r[2], []).append((r[0], kept, leaf(r, r[4] and r[4].translate(lower)) if tampered else kept))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    levels = {n: climbed([x[1] for x in trees[n]]) for n in names}
    trunk = climbed([levels[n][-1][0] for n in names])
    root, out = trunk[-1][0], []
    for k, n in enumerate(names):
        for i, (doc, kept, changed) in enumerate(trees[n]):
            sides = [*path(levels[n], i), *path(trunk, k)]
            fold = changed
            for a, b in sides:
                fold = sha(a + fold + b)
            out.append((doc, kept, levels[n][-1][0], root, sha("".join(a + b for a, b in sides)), fold, fold == root))
    return sorted(map(repr, out))


def rows():
    out = [(k, f"s{k % 3}" if k % 7 else None, ("en", "de", None, "zz")[min(3, k % 10)] if k % 10 < 4 else "en", k * 3 if k % 5 else None, f"Text {'É' * (k % 4)} {k}" if k % 13 else (None, "")[k % 2]) for k in range(700)]
    out += [(3, "again", "en", 1, "Other"), (3, "again", "en", 1, "other"), (None, None, None, None, None), (None, None, "fr", None, "Alone"), (8, "s", "en", 1, "A" * 50_000)]
    return out + [(5000 + k, None, f"l{k:03}", None, "Many languages") for k in range(75)]


def test_rounds_against_plain_version(spark):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows()], SCHEMA)
    want = plain(rows())
    for fan_levels in (1, 2, 4):  # blocks of 8, 64 and 4,096 leaves: several rounds, and one
        got = manifest(df, fan_levels=fan_levels).collect()
        assert sorted(map(repr, map(tuple, got))) == want
    assert {r.verified for r in got} == {True, False}
    assert all(r.verified == (r.folded_root == r.root) for r in got)


def test_lone_leaf_and_empty_table(spark):
    one = [(1, "s", "en", 4, "lone")]
    assert sorted(map(repr, map(tuple, manifest(spark.createDataFrame([(*one[0], 0, "x")], SCHEMA)).collect()))) == plain(one)
    empty = manifest(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
