"""Merkle manifest of a table: one tree for each language, and one over their roots.

Every row is a leaf, the SHA-256 of its fields. A tree's leaves are numbered in order
and cut into aligned blocks of FAN**LEVELS. A task holds a block as one contiguous
numpy matrix of 64-byte hex digests; each level is the matrix reshaped by the fanout
and hashed row by row, and the siblings of leaf i at a level are the rows from
i // FAN * FAN on, without i. The blocks' roots are the leaves of the next round, so a
tree of n leaves takes log(n) / log(FAN**LEVELS) rounds and no task sees more than one
block at a time. On the way down each block gets the siblings of its root, level by
level; the last round puts them behind those inside the block.

Leaves are numbered by range partitions and the partitions' counts, so a language that
holds most rows is still in many tasks.

Defined cases: a null field is ``-``; null languages are a tree of their own, the first;
null doc_ids come first in their tree and are never tampered with; rows that repeat a
doc_id are leaves of their own, in the order of their digests (equal rows have equal
digests, so any order gives the same tree, but their proofs differ); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, runs, small, written

FAN = 8
#: Levels that are computed inside a block.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Hex SHA-256 of the fields, each as its byte count, a colon and its value, ``-`` for null."""
    spelt = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*spelt).cast("binary"), 256)


def lower_az(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df (written) with ``pos``, the row's place in its group from 0, and ``n``, the group's rows. Ordered by range partitions; only their counts meet."""
    at = F.monotonically_increasing_id()
    dealt = written(df.repartitionByRange(*[F.asc_nulls_first(c) for c in (group, *order)]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in (group, *order)]).withColumn("_at", at), "ordered")
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    of_group = Window.partitionBy("_group")  # a row for each partition that the group is in
    before = F.coalesce(F.sum("_c").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.select("_group", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_c").over(of_group).alias("n")), "order-counts")
    on = dealt[group].eqNullSafe(counts["_group"]) & (F.shiftright(dealt["_at"], 33) == counts["_part"])
    return dealt.join(small(counts), on).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_group", "_part", "_shift")


def hashed(level: np.ndarray) -> np.ndarray:
    """The level above a matrix of hex digests: every FAN rows (the last run may have fewer) become their hash."""
    sha, data = hashlib.sha256, level.tobytes()
    size = FAN * 64
    return np.frombuffer("".join(sha(data[s : s + size]).hexdigest() for s in range(0, len(data), size)).encode(), np.uint8).reshape(-1, 64)


def block_levels(leaves: np.ndarray, n: int, fan_levels: int) -> list[np.ndarray]:
    """All levels of a block, its leaves first and its root last. A tree of more than one block is climbed ``fan_levels`` levels, another one to its root."""
    levels, whole = [leaves], n <= FAN**fan_levels
    while len(levels[-1]) > 1 if whole else len(levels) <= fan_levels:
        levels.append(hashed(levels[-1]))
    return levels


def siblings(levels: list[np.ndarray], i: int) -> tuple[list[bytes], list[bytes]]:
    """What stands left and right of leaf i in its run, for each level up to the block's root."""
    left, right = [], []
    for m in levels[:-1]:
        start = i - i % FAN
        left.append(m[start:i].tobytes())
        right.append(m[i + 1 : start + FAN].tobytes())
        i //= FAN
    return left, right


def folded(leaf: bytes, left: list[bytes], right: list[bytes]) -> str:
    """The root that a leaf and its siblings give."""
    for a, b in zip(left, right, strict=True):
        leaf = hashlib.sha256(a + leaf + b).hexdigest().encode()
    return leaf.decode()


def _matrix(t: pa.Table) -> np.ndarray:
    return np.frombuffer("".join(t["leaf"].to_pylist()).encode(), np.uint8).reshape(-1, 64)


def block_roots(fan_levels: int):
    """Runs of one (tree, block), ordered by pos: (tree, block, root)."""

    def run(batches):
        for t in runs(batches, 2):
            top = block_levels(_matrix(t), t["n"][0].as_py(), fan_levels)[-1]
            yield pa.RecordBatch.from_arrays([t["tree"][:1].combine_chunks(), t["block"][:1].combine_chunks(), pa.array([top.tobytes().decode()])], names=["tree", "block", "root"])

    return run


PATHS = "tree long, pos long, above_left array<string>, above_right array<string>, top string"


def node_paths(fan_levels: int):
    """Runs of one (tree, block) with the siblings above the block: each node's siblings up to the top, for the round below."""

    def run(batches):
        for t in runs(batches, 2):
            levels = block_levels(_matrix(t), t["n"][0].as_py(), fan_levels)
            up_left, up_right, top = (t[c][0].as_py() for c in ("above_left", "above_right", "top"))
            sides = [siblings(levels, i) for i in range(t.num_rows)]
            lists = [pa.array([[x.decode() for x in s[k]] + up for s in sides], pa.list_(pa.string())) for k, up in ((0, up_left), (1, up_right))]
            yield pa.RecordBatch.from_arrays([t["tree"].combine_chunks(), t["pos"].combine_chunks(), *lists, pa.array([top] * t.num_rows)], names=["tree", "pos", "above_left", "above_right", "top"])

    return run


def leaf_proofs(fan_levels: int):
    """Runs of one (tree, block) of documents: their proofs, and the roots that the tampered leaves fold to."""

    def run(batches):
        sha = hashlib.sha256
        for t in runs(batches, 2):
            levels = block_levels(_matrix(t), t["n"][0].as_py(), fan_levels)
            up_left, up_right, top, subroot = (t[c][0].as_py() for c in ("above_left", "above_right", "top", "subroot"))
            up_left, up_right = [x.encode() for x in up_left], [x.encode() for x in up_right]
            up = b"".join(x + y for x, y in zip(up_left, up_right, strict=True))
            proofs, roots = [], []
            for i, changed in enumerate(t["changed"].to_pylist()):
                left, right = siblings(levels, i)
                proofs.append(sha(b"".join(x + y for x, y in zip(left, right, strict=True)) + up).hexdigest())
                roots.append(folded(changed.encode(), left + up_left, right + up_right))
            m = t.num_rows
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks(), t["leaf"].combine_chunks(), pa.array([subroot] * m), pa.array([top] * m), pa.array(proofs), pa.array(roots), pa.array(np.array(roots) == top)],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return run


def _blocked(nodes: DataFrame, fan_levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FAN**fan_levels}"))


def _with_above(nodes: DataFrame, above: DataFrame, fan_levels: int) -> DataFrame:
    """nodes with their blocks, and each block's row of ``above`` at its first node (null at the others)."""
    first = above.withColumn("pos", F.col("block") * FAN**fan_levels).drop("block")
    return _blocked(nodes.join(small(first), ["tree", "pos"], "left"), fan_levels)


def climb(nodes: DataFrame, fan_levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of trees (tree, pos, n, leaf): the nodes of every round, the first included, and the roots (tree, root)."""
    rounds = [nodes]
    while True:
        most = rounds[-1].agg(F.max("n")).first()[0] or 0
        dealt = _blocked(rounds[-1].select("tree", "pos", "n", "leaf"), fan_levels)
        rows = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").select("tree", "block", "n", "leaf")
        up = written(rows.mapInArrow(block_roots(fan_levels), "tree long, block long, root string"), "block-roots")
        if most <= FAN**fan_levels:
            return rounds, up.select("tree", "root")
        sizes = up.groupBy("tree").agg(F.count("*").alias("n"))
        rounds.append(written(up.select("tree", F.col("block").alias("pos"), F.col("root").alias("leaf")).join(sizes, "tree"), "round"))
        forget(up)


def descend(rounds: list[DataFrame], top: DataFrame, fan_levels: int) -> DataFrame:
    """(tree, block, above_left, above_right, top) of the first round's blocks, from those of the trees' roots (tree, above_left, above_right, top)."""
    above = top.withColumn("block", F.lit(0).cast("long"))
    for nodes in reversed(rounds[1:]):
        rows = _with_above(nodes, above, fan_levels).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").select("tree", "block", "pos", "n", "leaf", "above_left", "above_right", "top")
        above = written(rows.mapInArrow(node_paths(fan_levels), PATHS), "paths").withColumnRenamed("pos", "block")
    return above


def manifest(docs: DataFrame, tamper: Column | None = None, tampered_text: Column | None = None, fan_levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Where ``tamper`` holds, folded_root starts from the leaf of the row with
    ``tampered_text`` for its text (lower-cased A-Z, if not given); elsewhere from the
    leaf itself. verified tells whether it equals the root.
    """
    text = F.col("text")
    kept = digest(*(F.col(c) for c in FIELDS))
    if tamper is None:
        tamper = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    other = digest(*(F.col(c) for c in FIELDS[:-1]), lower_az(text) if tampered_text is None else tampered_text)
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("lang").alias("tree_name"), "lang", "n_chars", "text")
    leaves = written(leaves.select("doc_id", "tree_name", kept.alias("leaf"), F.when(tamper, other).alias("changed")), "digests")
    leaves = numbered(leaves, "tree_name", ["doc_id", "leaf", "changed"])
    names = numbered(leaves.where("pos = 0").select("tree_name", F.lit(0).alias("one")), "one", ["tree_name"]).select(F.col("tree_name").alias("_name"), F.col("pos").alias("tree"))
    names = written(names, "trees")
    leaves = written(leaves.join(small(names), F.col("tree_name").eqNullSafe(F.col("_name"))).select("tree", "pos", "n", "doc_id", "leaf", F.coalesce("changed", "leaf").alias("changed")), "leaves")
    rounds, subroots = climb(leaves, fan_levels)
    count = subroots.count()
    if not count:
        return leaves.select("doc_id", "leaf", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.col("leaf").alias("proof_sha256"), F.col("leaf").alias("folded_root"), F.lit(True).alias("verified"))
    # the tree over the languages' roots: its leaves are the subroots, in their order
    trunk = written(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"), F.col("root").alias("leaf")), "subroots")
    trunk_rounds, root = climb(trunk, fan_levels)
    none = F.array().cast("array<string>")
    start = root.select("tree", none.alias("above_left"), none.alias("above_right"), F.col("root").alias("top"))
    stem = descend(trunk_rounds, start, fan_levels)
    rows = _with_above(trunk, stem, fan_levels).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").select("tree", "block", "pos", "n", "leaf", "above_left", "above_right", "top")
    trees = written(rows.mapInArrow(node_paths(fan_levels), PATHS).select(F.col("pos").alias("tree"), "above_left", "above_right", "top"), "trunk")
    above = descend(rounds, trees, fan_levels).join(subroots.withColumnRenamed("root", "subroot"), "tree")
    blocks = written(above, "blocks")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # hashing costs more than the bytes tell
    dealt = _with_above(leaves, blocks, fan_levels).repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "pos").select("tree", "block", "n", "doc_id", "leaf", "changed", "above_left", "above_right", "top", "subroot")
    return dealt.mapInArrow(leaf_proofs(fan_levels), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest_sql(levels: int = 7, trunk: int = 2) -> str:
    """The same rows in plain SQL, for trees of up to 8**levels leaves and 8**trunk languages: each level is a grouping of the one below."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = " || ".join(field(c) for c in FIELDS)
    changed = " || ".join(field(c) for c in (*FIELDS[:-1], lower))
    octets = "list_transform(range(0, length(doc_id::VARCHAR)::BIGINT), lambda i: ascii(substr(doc_id::VARCHAR, (i + 1)::BIGINT, 1))::BIGINT)"
    steps = [
        f"""
l0 AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce('+' || lang, '-') AS tree, sha256({leaf}) AS leaf,
  CASE WHEN xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8))) % 3 = 0 THEN sha256({changed}) ELSE sha256({leaf}) END AS changed
  FROM documents, table_of),
a0 AS (SELECT row_id, doc_id, tree, leaf, changed, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos FROM l0),
n0 AS (SELECT tree, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM a0),
p0 AS (SELECT row_id, tree, pos, leaf, changed AS fold, '' AS proof FROM a0)"""
    ]
    for k in range(levels + trunk):
        if k == levels:  # the subroots become one tree
            steps.append(f"""
m AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree <> '-', encode(tree)) - 1 AS pos, h, count(*) OVER () AS n, tree AS was FROM n{k}),
p AS (SELECT row_id, '' AS tree, m.pos, leaf, fold, proof, m.h AS subroot FROM p{k} JOIN m ON m.was = p{k}.tree)""")
        node, path = (f"n{k}", f"p{k}") if k != levels else ("m", "p")
        sub = ", subroot" if k >= levels else ""
        steps.append(f"""
g{k} AS (SELECT tree, pos // 8 AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM {node} GROUP BY 1, 2),
n{k + 1} AS (SELECT tree, run AS pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 7) // 8 AS n FROM g{k}),
p{k + 1} AS (SELECT row_id, x.tree, x.pos // 8 AS pos, leaf,
  CASE WHEN n = 1 THEN fold ELSE sha256(array_to_string(hs[:x.pos % 8], '') || fold || array_to_string(hs[x.pos % 8 + 2:], '')) END AS fold,
  CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(hs[:x.pos % 8], '') || array_to_string(hs[x.pos % 8 + 2:], '') END AS proof{sub}
  FROM {path} x JOIN g{k} ON g{k}.tree = x.tree AND g{k}.run = x.pos // 8)""")
    last = levels + trunk
    return f"""
WITH table_of AS (SELECT list(c ORDER BY n) AS crc FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS t(n))),
{",".join(steps)}
SELECT doc_id, p{last}.leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified
FROM p{last} JOIN a0 USING (row_id), n{last}
"""
