"""N-gram Jaccard self-join over word shingles with signature trees.

1. One Arrow pass gives every document its shingle count, a 128-bit hash of the
   shingle set, banded minhash keys and a bitmap. Equal sets become one class.
2. The documents of one band key are the leaves of a signature tree, ordered by size
   and bitmap: a node holds the OR of its leaves' bitmaps and the range of their sizes,
   FAN nodes make one of the next level, up to one root. A pair of nodes is pruned when
   the largest overlap that its bitmaps and sizes allow is under the least that a link
   needs.
3. First round: each leaf gets, of the pairs that a traversal of its tree with itself
   leaves, the one with the largest possible overlap, and that with the tree's first
   leaf. The best of either kind over all of a document's trees are tested exactly.
4. Second round: what the links so far leave in different components of a tree is
   searched by dual traversal, everything that its bounds leave is tested. Large trees
   are dealt in blocks, and only leaves outside a tree's largest component against all.
5. Pairs are tested on the exact shingle sets; components of all links are found by
   label spreading. A doc_id with several sets links their classes.

That is enough for components. ``jaccard_links`` counts every link as well: links stay
inside a component, so each component's classes become trees of their own, two blocks
of them meet in one task, and what a dual traversal leaves is tested on the sets that
came along. Only numbers of links leave the task, never the pairs of a group.

Band keys come from 32 bands of 4 minhashes: a pair at exactly 0.8 shares no band
with probability (1 - 0.8**4)**32 < 5e-8. All other steps are exact.

Defined cases: null or wordless text has an empty set (n_shingles 0) and is its
own component; a row with null doc_id is counted but linked with nothing and has
component_id null; rows that repeat a doc_id count as one node, whatever their texts
(each is returned with its own n_shingles and class_id), so their sets' classes share a
component; n_links counts rows; other columns of the input are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as T
from .shared import components, cross_blocks, forget, runs, small, spread, written

BANDS, ROWS = 32, 4
BITS = 1024
#: Leaves on either side of one traversal.
BLOCK = 512
#: Children of a node.
FAN = 8
#: Pairs that one document is tested against in one task.
PARTNERS = 1000
#: Shingles on either side of a block in which links are counted, and columns of one matrix product.
BLOCK_SHINGLES, COLUMNS = 1 << 21, 4096

_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, laid end to end, and where each text's begin. A text with fewer words has its whole sequence as one shingle."""
    words = T.Words(texts, lower=True)
    h = words.hashes()
    s, at = T.shingles(words, h, width)
    cut = np.searchsorted(words.doc[at], np.arange(len(texts) + 1))
    sets = []
    for i, n in enumerate(words.count):
        if n >= width:
            sets.append(np.unique(s[cut[i] : cut[i + 1]]))
        elif n:
            w = h[words.first[i] : words.first[i + 1]]
            sets.append(T.mix((w * T._BYTE[8 : 8 + n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            sets.append(s[:0])
    first = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    return np.concatenate(sets) if sets else s[:0], first


def set_sums(tok: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set that stand for it (0 for an empty one)."""
    s1, s2 = np.zeros(len(first) - 1, np.uint64), np.zeros(len(first) - 1, np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        s1[full], s2[full] = np.add.reduceat(T.mix(tok), first[full]), np.add.reduceat(T.mix(tok ^ T.U64(0x5555555555555555)), first[full])
    return s1, s2


FEATURES = "doc_id long, n long, s1 long, s2 long, bands array<long>, bits binary"


def features(width: int):
    def run(batches):
        for cut, texts in T.pieces(batches, most=1 << 19):
            tok, first = shingle_sets(texts, width)
            n = np.diff(first)
            full = np.flatnonzero(n)
            s1, s2 = set_sums(tok, first)
            bands = np.zeros((len(n), BANDS), np.uint64)
            bits = np.zeros((len(n), BITS), bool)
            if len(full):
                seg = first[:-1][full]
                mins = np.empty((BANDS * ROWS, len(full)), np.uint64)
                for k in range(BANDS * ROWS):
                    mins[k] = np.minimum.reduceat((((tok ^ _XOR[k]) * _MUL[k]) >> T.U64(32)).astype(np.uint32), seg)
                for b in range(BANDS):
                    key = np.full(len(full), b + 1, np.uint64)
                    for k in range(ROWS):
                        key = T.mix(key * T.U64(0x9E3779B97F4A7C15) + mins[b * ROWS + k])
                    bands[full, b] = key
                bits[np.repeat(np.arange(len(n)), n), (tok >> T.U64(54)).astype(np.int64)] = True
            packed = np.packbits(bits, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)), pa.array(bands[full].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([cut.column(cut.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists, pa.array([x.tobytes() for x in packed], pa.binary())], names=["doc_id", "n", "s1", "s2", "bands", "bits"])

    return run


def set_rows(width: int):
    def run(batches):
        for cut, texts in T.pieces(batches, most=1 << 19):
            tok, first = shingle_sets(texts, width)
            sums = [pa.array(x.view(np.int64)) for x in set_sums(tok, first)]
            toks = pa.array([tok[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.large_binary()).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([cut.column(cut.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(np.diff(first)), *sums, toks], names=["doc_id", "n", "s1", "s2", "toks"])

    return run


def needed(na, nb, percent: int):
    """The least intersection of sets of these sizes that links them: 100 i >= percent (na + nb - i)."""
    return -(-percent * (na + nb) // (100 + percent))


def compare(percent: int):
    def run(batches):
        for batch in batches:
            ids, ta, tb = batch.column(0).to_numpy(), batch.column(2), batch.column(3)
            hit, last, left = [], None, None
            for i in range(batch.num_rows):
                if ids[i] != last:
                    last, left = ids[i], np.frombuffer(ta[i].as_buffer(), np.uint64)
                right = np.frombuffer(tb[i].as_buffer(), np.uint64)
                at = np.searchsorted(left, right)
                both = int((left[np.minimum(at, len(left) - 1)] == right).sum()) if len(left) else 0
                if both >= needed(len(left), len(right), percent):
                    hit.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit, pa.int64())), batch.column(1).take(pa.array(hit, pa.int64()))], names=["a", "b"])

    return run


class Tree:
    """A signature tree. Level 0 has the leaves, the last level one root; a level has arrays lo, hi (sizes), extra, bits and c0, c1 (components).

    ``extra`` is how many shingles hide behind an already set bit: the overlap of two
    sets is at most the bits that they share plus the smaller of their extras.
    """

    def __init__(self, leaf: np.ndarray, n: np.ndarray, bits: np.ndarray, comp: np.ndarray):
        self.order = leaf[np.lexsort((bits[leaf, 0], n[leaf]))]
        n, bits, comp = n[self.order], bits[self.order], comp[self.order]
        self.levels = [dict(lo=n, hi=n, extra=n - np.bitwise_count(bits).sum(1, dtype=np.int64), bits=bits, c0=comp, c1=comp)]
        merge = dict(lo=np.minimum, hi=np.maximum, extra=np.maximum, bits=np.bitwise_or, c0=np.minimum, c1=np.maximum)
        while len(self.levels[-1]["lo"]) > 1:
            below = self.levels[-1]
            at = np.arange(0, len(below["lo"]), FAN)
            self.levels.append({k: f.reduceat(below[k], at, axis=0) for k, f in merge.items()})

    def level(self, k: int) -> dict:
        return self.levels[min(k, len(self.levels) - 1)]

    def children(self, k: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of level k - 1 under nodes of level k, as a matrix, and which of its places are filled."""
        if k >= len(self.levels):  # a lower tree waits for the other one at its root
            return node[:, None], np.ones((len(node), 1), bool)
        kids = node[:, None] * FAN + np.arange(FAN)
        return kids, kids < len(self.levels[k - 1]["lo"])


def possible(x: dict, i: np.ndarray, y: dict, j: np.ndarray, percent: int, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """The largest overlap of sets under node i of a level and node j of another, and whether a link is possible. ``apart``: only between different components."""
    room = np.empty(len(i), np.int64)
    for s in range(0, len(i), 1 << 14):
        p, q = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
        room[s : s + (1 << 14)] = np.bitwise_count(x["bits"][p] & y["bits"][q]).sum(1, dtype=np.int64)
    room = np.minimum(room + np.minimum(x["extra"][i], y["extra"][j]), np.minimum(x["hi"][i], y["hi"][j]))
    lo_x, lo_y = x["lo"][i], y["lo"][j]
    ok = (room >= needed(lo_x, lo_y, percent)) & (100 * y["hi"][j] >= percent * lo_x) & (100 * x["hi"][i] >= percent * lo_y)
    if apart:
        ok &= (x["c0"][i] != x["c1"][i]) | (y["c0"][j] != y["c1"][j]) | (x["c0"][i] != y["c0"][j])
    return room, ok


def dual_traversal(a: Tree, b: Tree, percent: int, apart: bool):
    """Pairs of leaves (numbers in a's and b's order) that the bounds leave, and their largest overlaps. With a tree and itself each pair comes once."""
    same = a is b
    top = max(len(a.levels), len(b.levels)) - 1
    i = j = np.zeros(1, np.int64)
    if not len(a.order) or not len(b.order):
        return i[:0], j[:0], i[:0]
    room, ok = possible(a.level(top), i, b.level(top), j, percent, apart)
    i, j, room = i[ok], j[ok], room[ok]
    for k in range(top, 0, -1):
        out = []
        for s in range(0, len(i), 4096):  # a bounded number of pairs of nodes at a time
            x, fx = a.children(k, i[s : s + 4096])
            y, fy = b.children(k, j[s : s + 4096])
            keep = (fx[:, :, None] & fy[:, None, :]).ravel()
            p = np.broadcast_to(x[:, :, None], (*x.shape, y.shape[1])).ravel()[keep]
            q = np.broadcast_to(y[:, None, :], (len(x), x.shape[1], y.shape[1])).ravel()[keep]
            if same:
                up = p < q if k == 1 else p <= q
                p, q = p[up], q[up]
            room, ok = possible(a.level(k - 1), p, b.level(k - 1), q, percent, apart)
            out.append((p[ok], q[ok], room[ok]))
        i, j, room = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (i[:0], j[:0], room[:0])
    if same and top == 0:
        i, j, room = i[:0], j[:0], room[:0]
    return i, j, room


def _leaves(t: pa.Table):
    n, comp, rep = (t[c].to_numpy() for c in ("n", "comp", "rep"))
    bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(len(n), BITS // 64)
    return n, comp, rep, bits


def first_pairs(percent: int):
    """For runs of one (key, i): each leaf's best pair in its tree (kind 0) and the one with the tree's first leaf (kind 1), as (rep, kind, room, other). The first leaf is in every block of its key."""

    def run(batches):
        for t in runs(batches, 2):
            n, comp, rep, bits = _leaves(t)
            tree = Tree(np.arange(len(n)), n, bits, comp)
            i, j, room = dual_traversal(tree, tree, percent, False)
            x, y = tree.order[i], tree.order[j]
            last = np.flatnonzero(np.diff(np.append(y[by := np.lexsort((room, y))], -1)))
            best = by[last]
            head = np.flatnonzero((rep[x] == t["head"][0].as_py()) | (rep[y] == t["head"][0].as_py()))
            for kind, pick in ((0, best), (1, head)):
                a, b = rep[x[pick]], rep[y[pick]]
                if kind:  # the first leaf is the other one
                    swap = b == t["head"][0].as_py()
                    a, b = np.where(swap, b, a), np.where(swap, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(np.full(len(b), kind)), pa.array(room[pick]), pa.array(a)], names=["rep", "kind", "room", "other"])

    return run


def tree_pairs(percent: int):
    """Runs of rows with one (key, i, j) are the leaves of one pair of blocks: the pairs (a, b) of different components that dual traversal leaves."""

    def run(batches):
        for t in runs(batches, 3):
            n, comp, rep, bits = _leaves(t)
            side = t["side"].to_numpy()
            if (side == 0).all() or (side == 1).all():
                continue
            left, right = (Tree(np.flatnonzero(side == k), n, bits, comp) for k in (0, 1))
            i, j, _ = dual_traversal(left, right, percent, True)
            a, b = rep[left.order[i]], rep[right.order[j]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all sets on the left with all on the right: products of 0/1 matrices, some columns at a time."""
    total = np.zeros((len(left), len(right)), np.float32)
    known = np.intersect1d(np.concatenate(left), np.concatenate(right))
    places = []
    for sets in (left, right):
        tok, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(known, tok), max(0, len(known) - 1))
        both = known[at] == tok if len(known) else np.zeros(len(tok), bool)
        order = np.argsort(at[both], kind="stable")
        places.append((at[both][order], row[both][order]))
    for s in range(0, len(known), COLUMNS):
        sides = []
        for (at, row), n in zip(places, (len(left), len(right)), strict=True):
            lo, hi = np.searchsorted(at, (s, s + COLUMNS))
            m = np.zeros((n, min(COLUMNS, len(known) - s)), np.float32)
            m[row[lo:hi], at[lo:hi] - s] = 1
            sides.append(m)
        total += sides[0] @ sides[1].T
    return total.astype(np.int64)


def link_counts(percent: int):
    """Runs of one (key, i, j) are two blocks of a component's classes, or one block with itself: for each class the rows of the others that it links with, as (rep, w)."""

    def run(batches):
        for t in runs(batches, 3):
            n, comp, rep, bits = _leaves(t)
            side, rows = t["side"].to_numpy(), t["n_class"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t["toks"].to_pylist()]
            left = Tree(np.flatnonzero(side == 0), n, bits, comp)
            same = t["i"][0].as_py() == t["j"][0].as_py()
            right = left if same else Tree(np.flatnonzero(side == 1), n, bits, comp)
            if not len(left.order) or not len(right.order):
                continue
            i, j, _ = dual_traversal(left, right, percent, False)
            both = overlaps([sets[x] for x in left.order], [sets[x] for x in right.order])
            p, q = left.order[i], right.order[j]
            linked = both[i, j] >= needed(n[p], n[q], percent)
            p, q = p[linked], q[linked]
            w = np.bincount(p, rows[q], len(n)) + np.bincount(q, rows[p], len(n))
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(w[at].astype(np.int64))], names=["rep", "w"])

    return run


def class_sets(docs: DataFrame, picked: DataFrame, width: int) -> DataFrame:
    """(rep, toks): the exact shingle sets of the picked classes (rep, low, n, s1, s2), each read from a row with its smallest doc_id and just this set."""
    texts = docs.join(small(picked.select(F.col("low").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = texts.mapInArrow(set_rows(width), "doc_id long, n long, s1 long, s2 long, toks binary").withColumnRenamed("doc_id", "low")
    return sets.join(small(picked), ["low", "n", "s1", "s2"]).select("rep", "toks").dropDuplicates(["rep"])  # rows of one class have the same set


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose exact shingle sets are similar enough; only the texts in a pair are read into sets, and an ``a`` of many pairs is dealt to several tasks."""
    pairs = written(pairs, "pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "ids")
    picked = written(classes.join(small(ids), "rep", "left_semi").select("rep", "low", "n", "s1", "s2"), "picked")
    sets = written(class_sets(docs, picked, width), "sets")
    share = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")), "shares")
    heads = sets.join(small(share.withColumnRenamed("a", "rep")), "rep").select(F.col("rep").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("toks").alias("ta"))
    dealt = pairs.join(small(share), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    rows = dealt.join(sets.select(F.col("rep").alias("b"), F.col("toks").alias("tb")), "b").join(heads, ["a", "part"])
    links = written(rows.select("a", "b", "ta", "tb").mapInArrow(compare(percent), "a long, b long"), "links")
    forget(ids, picked, sets, share)
    return links


def links_of_classes(docs: DataFrame, classes: DataFrame, label: DataFrame, width: int, percent: int) -> DataFrame:
    """(rep, w): the rows of other classes that a class links with, by the components of classes (id, component)."""
    in_components = classes.select("rep", "low", "n", "s1", "s2", "n_class", F.col("f.bits").alias("bits")).join(label.select(F.col("id").alias("rep"), F.col("component").alias("key")), "rep")
    leaves = written(in_components, "linked")
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sized = leaves.groupBy("key").agg(blocks.alias("nb"))
    placed = leaves.join(class_sets(docs, leaves.select("rep", "low", "n", "s1", "s2"), width), "rep").join(small(written(sized, "sized")), "key")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")))
    # a leaf goes to every pair of blocks that its own is in
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), F.when(F.col("block") <= o, 0).otherwise(1).alias("side")))
    cols = ["rep", F.col("key").alias("comp"), "n", "n_class", "bits", "toks"]
    dealt = placed.select("key", F.explode(pairs).alias("s"), *cols).select("key", "s.i", "s.j", "s.side", "rep", "comp", "n", "n_class", "bits", "toks")
    return spread(dealt, "key", "i", "j").mapInArrow(link_counts(percent), "rep long, w long").groupBy("rep").agg(F.sum("w").alias("w"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_id (smallest doc_id with the same set), n_class (rows with that set)."""
    return _joined(docs, width, percent, False)


def jaccard_links(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """jaccard_components and n_links: the other rows whose sets are similar enough, the ones with the same set among them."""
    return _joined(docs, width, percent, True)


def same_ids(members: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes of members (doc_id, rep) that share a doc_id: from the first of them to each other."""
    several = written(members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a"), "several")
    return members.select("doc_id", F.col("rep").alias("b")).join(small(several), "doc_id").where("a <> b").select("a", "b").distinct()


def _joined(docs: DataFrame, width: int, percent: int, links: bool) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    feats = written(docs.mapInArrow(features(width), FEATURES), "features")
    known = feats.where("n > 0 and doc_id is not null")
    # a class is a set, with a number of its own: several sets may share their smallest doc_id
    classes = known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_class"), F.min(F.struct("doc_id", "bands", "bits")).alias("f"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = classes.select("rep", "n", F.col("f.bands").alias("bands"), F.col("f.bits").alias("bits"))
    entries = reps.select("rep", "n", F.explode("bands").alias("key"))
    keys = written(entries.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("head")).where("m > 1"), "keys")
    shared = written(entries.join(small(keys), "key"), "shared")
    signs = reps.select("rep", "bits")
    # first round: blocks of a tree's leaves, its first leaf in each of them
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    block = F.when(F.col("rep") == F.col("head"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), blocks).cast("int")))
    rooted = shared.join(signs, "rep").select("key", F.explode(block).alias("i"), "head", "rep", F.col("rep").alias("comp"), "n", "bits")
    best = spread(rooted, "key", "i").mapInArrow(first_pairs(percent), "rep long, kind long, room long, other long")
    best = best.groupBy("rep", "kind").agg(F.max(F.struct("room", "other")).alias("x")).select(F.least("rep", "x.other").alias("a"), F.greatest("rep", "x.other").alias("b")).distinct()
    first = written(best, "first")
    near = verified(docs, classes, first, width, percent)
    label = components(near, "first")
    placed = shared.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("key", "m", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    # second round: a tree within one component adds nothing to the components
    dealt = cross_blocks(written(placed, "placed"), ["rep", "n"], BLOCK).join(signs, "rep").select("key", "i", "j", "side", "rep", "comp", "n", "bits")
    found = spread(dealt, "key", "i", "j").mapInArrow(tree_pairs(percent), "a long, b long").distinct().join(first, ["a", "b"], "left_anti")
    more = verified(docs, classes, found, width, percent)
    members = written(known.select("doc_id", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select("doc_id", "rep"), "members")
    edges = near.union(more)
    label = components(edges.union(same_ids(members)), "all")
    forget(shared, keys)
    grouped = classes.select("n", "rep", "low", "n_class").join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lowest = written(grouped.groupBy("component").agg(F.min("low").alias("component_id")), "lowest")
    final = grouped.join(lowest, "component").select("rep", F.col("n").alias("n_shingles"), "component_id", F.col("low").alias("class_id"), "n_class")
    alone = feats.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_class"))
    if links:
        counts = links_of_classes(docs, classes, components(edges, "links"), width, percent)
        final = final.join(counts, "rep", "left").withColumn("n_links", F.col("n_class") - 1 + F.coalesce("w", F.lit(0))).drop("w")
        alone = alone.withColumn("n_links", F.lit(0).cast("long"))
    final = written(final, "final")
    return members.join(small(final), "rep").drop("rep").unionByName(alone)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one document of each component does (the smallest doc_id); null ids and empty sets stay, and of several rows with words that repeat the doc_id the least."""
    gone = written(jaccard_components(docs, width, percent).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(small(gone), "doc_id", "left_anti")
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()
    twice = written(kept.where(worded).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    cols = docs.columns
    least = kept.where(worded).join(small(twice), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in cols))).alias("r"))
    others = kept.where(~F.coalesce(worded, F.lit(False))).unionByName(kept.where(worded).join(small(twice), "doc_id", "left_anti"))
    return others.select(*(F.col(f"`{c}`") for c in cols)).unionByName(least.select(*(F.col(f"r.`{c}`").alias(c) for c in cols)))
