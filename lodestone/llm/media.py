"""Copies of images found by local descriptors: crops, turns, smaller versions and changes of light.

1. Each image gets corners on a pyramid of scales, and for each corner 256 binary
   tests on a smoothed patch that is turned to the corner's own direction.
2. Equal bytes are one class. A class's descriptors are entered in Hamming tables, one
   for each fixed set of KEY_BITS tests: equal bits there are one entry. With it goes a
   sketch of SKETCH_BITS other tests; two descriptors of an entry are close if their
   sketches differ in at most NEAR_BITS.
3. In each table entry every image is paired with the first one, if they are close there.
   Of the others only those stay that are close to another one (in an entry of more than
   BLOCK all stay). Pairs are compared; those close ones of an entry that then are in
   different components are paired too, in blocks, so no entry ends up in one task and no
   pair inside a component is made. Unlike pictures that share an entry by chance so leave
   the work before any row is made of them.
4. A pair of images is a copy if enough matched corners agree on one similarity
   transform (scale, turn and shift).

Steps 1 and 2 are an index: recall is measured against the comparison of step 4 over all
pairs (tests/llm/test_media.py), by kind of edit. Nothing else is left out.

Images are binary PGM (P5) or PPM (P6) with up to 255 levels.

Defined cases: null, empty and unreadable images have no corners and link with
nothing, but equal bytes still share a class; images without corners likewise; a
row with null id is returned with null class; rows that repeat an id count as one
image (of different ones the first by hash is compared) and each is returned; other
columns are ignored; an empty table gives no rows. Images of any size are read whole.
"""

from __future__ import annotations

import re
from functools import partial
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cross_blocks, forget, runs, small, spread, written

#: Fixed parameters of the detector: levels of the pyramid and their step, strongest corners kept of each cell of so many pixels a side, patch radius, tests.
LEVELS, FACTOR, PER_CELL, CELL, RADIUS, TESTS = 5, 1.2, 4, 32, 9, 256
#: Directions of a corner are rounded to so many.
TURNS = 64
#: Corners of a patch may differ in so many tests.
MAX_BITS = 56
#: Hamming tables, the tests that are a table's key, those of its sketch, and how many of these may differ.
TABLES, KEY_BITS, SKETCH_BITS, NEAR_BITS = 6, 48, 64, 6
#: A copy has so many corners that agree.
MIN_INLIERS = 8
#: Places may be off by so many pixels, and this share of the distance.
TOLERANCE = 2.5
#: Corners on either side of one comparison of a table entry.
BLOCK = 512


def _tests() -> np.ndarray:
    """Pairs of places (x, y, x, y) in a disc, for each direction: TURNS x TESTS x 4."""
    rng, places = np.random.default_rng(4), np.zeros((0, 2))
    while len(places) < 2 * TESTS:
        p = rng.normal(0, RADIUS / 2.2, (4 * TESTS, 2))
        places = np.concatenate((places, p[(p**2).sum(1) <= RADIUS**2]))
    p = places[: 2 * TESTS].reshape(TESTS, 2, 2)
    t = 2 * np.pi * np.arange(TURNS) / TURNS
    cos, sin = np.cos(t)[:, None, None], np.sin(t)[:, None, None]
    x, y = cos * p[None, :, :, 0] - sin * p[None, :, :, 1], sin * p[None, :, :, 0] + cos * p[None, :, :, 1]
    return np.stack((x, y), 3).astype(np.float32)


_TEST = _tests()
_y, _x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_disc = (_x**2 + _y**2) <= RADIUS**2
_dx, _dy = _x[_disc].astype(np.int32), _y[_disc].astype(np.int32)
_HEAD = re.compile(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s")


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels as float32, or None if the bytes are no image of the known kinds."""
    m = _HEAD.match(data or b"")
    if not m or not 0 < int(m[4]) <= 255:
        return None
    w, h, planes = int(m[2]), int(m[3]), 1 if m[1] == b"5" else 3
    if w * h == 0 or len(data) - m.end() < w * h * planes:
        return None
    x = np.frombuffer(data, np.uint8, w * h * planes, m.end()).reshape(h, w, planes)
    return x.astype(np.float32).mean(2)


def pgm(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    return b"P5 %d %d 255\n" % (w, h) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def resize(x: np.ndarray, factor: float) -> np.ndarray:
    """A stack of images made smaller by a factor, bilinear."""
    h, w = max(1, int(x.shape[1] / factor)), max(1, int(x.shape[2] / factor))

    def places(n, old):
        p = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
        lo = np.minimum(p.astype(int), max(0, old - 2))
        return lo, np.minimum(lo + 1, old - 1), (p - lo).astype(np.float32)

    a, b, t = places(h, x.shape[1])
    x = x[:, a] * (1 - t)[None, :, None] + x[:, b] * t[None, :, None]
    a, b, t = places(w, x.shape[2])
    return x[:, :, a] * (1 - t) + x[:, :, b] * t


def _blur(x: np.ndarray) -> np.ndarray:
    """Both directions by the binomial weights 1, 4, 6, 4, 1."""
    for axis in (1, 2):
        p = np.pad(x, [(2, 2) if k == axis else (0, 0) for k in range(3)], "edge")
        n = x.shape[axis]
        at = lambda d: p[:, d : d + n] if axis == 1 else p[:, :, d : d + n]  # noqa: B023, E731
        x = at(0) + at(4)
        near = at(1) + at(3)
        near *= 4
        x += near
        np.multiply(at(2), 6, out=near)
        x += near
        x *= 1 / 16
    return x


def _ring(r: np.ndarray, edge: int) -> np.ndarray:
    """Whether each place is a maximum of its eight neighbours, ``edge`` pixels off the border."""
    inner = r[:, edge:-edge, edge:-edge]
    top = inner > 1.0
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dx or dy:
                near = r[:, edge + dy : r.shape[1] - edge + dy, edge + dx : r.shape[2] - edge + dx]
                top &= (inner > near) if (dy, dx) < (0, 0) else (inner >= near)
    return top


def corners(stack: np.ndarray):
    """For a stack of images of one size: (image, x, y, scale, angle, 32 descriptor bytes) of the strongest PER_CELL corners of each cell of each image.

    Cells are counted in pixels of the image, so a larger picture has more corners and a
    part of it the same ones as before. Corners of all levels compete before any is described.
    """
    level, scale, edge = stack, 1.0, RADIUS + 2
    smooths, found = [], []
    for k in range(LEVELS):
        if min(level.shape[1:]) < 2 * edge + 1:
            break
        smooth = _blur(level)
        gy, gx = smooth.copy(), smooth.copy()
        gy[:, 1:-1] = (smooth[:, 2:] - smooth[:, :-2]) / 2
        gx[:, :, 1:-1] = (smooth[:, :, 2:] - smooth[:, :, :-2]) / 2
        gy[:, [0, -1]], gx[:, :, [0, -1]] = 0, 0
        a, b, c = _blur(gx * gx), _blur(gx * gy), _blur(gy * gy)
        r = a * c - b * b - 0.05 * (a + c) ** 2
        i, y, x = np.nonzero(_ring(r, edge))
        y, x = y + edge, x + edge
        smooths.append(smooth)
        # the top of the parabola through a maximum and its neighbours, in either direction
        top = r[i, y, x]
        part = [(lo - hi) / np.minimum(-1e-9, 2 * (lo + hi - 2 * top)) for lo, hi in ((r[i, y, x - 1], r[i, y, x + 1]), (r[i, y - 1, x], r[i, y + 1, x]))]
        found.append((np.full(len(i), k), i, x, y, np.full(len(i), scale), top, *(np.clip(v, -0.5, 0.5) for v in part)))
        level, scale = resize(level, FACTOR), scale * FACTOR
    if not found:
        z = np.zeros(0)
        return z.astype(int), z, z, z, z, np.zeros((0, TESTS // 8), np.uint8)
    k, i, x, y, scale, r, dx, dy = (np.concatenate(v) for v in zip(*found, strict=True))
    px, py = (x + dx + 0.5) * scale - 0.5, (y + dy + 0.5) * scale - 0.5
    across = -(-max(stack.shape[1:]) // CELL)
    cell = ((i * LEVELS + k) * across + y // CELL) * across + x // CELL
    order = np.lexsort((-r, cell))
    rank = np.arange(len(order)) - np.searchsorted(cell[order], cell[order])
    keep = np.sort(order[rank < PER_CELL])
    k, i, x, y, scale, px, py, dx, dy = (v[keep] for v in (k, i, x, y, scale, px, py, dx, dy))
    angle, bits = np.zeros(len(k)), np.zeros((len(k), TESTS // 8), np.uint8)
    for lv, smooth in enumerate(smooths):
        of = np.flatnonzero(k == lv)
        wide = np.int32(smooth.shape[2])
        flat, at = np.ascontiguousarray(smooth, np.float32).ravel(), ((i[of] * smooth.shape[1] + y[of]) * smooth.shape[2] + x[of]).astype(np.int64)
        patch = flat[at[:, None] + (_dy * wide + _dx)]
        angle[of] = np.arctan2(patch @ _dy.astype(np.float32), patch @ _dx.astype(np.float32))
        turn = np.rint(angle[of] / (2 * np.pi) * TURNS).astype(int) % TURNS
        tx, ty = _TEST[turn, ..., 0] + dx[of, None, None].astype(np.float32), _TEST[turn, ..., 1] + dy[of, None, None].astype(np.float32)
        fx, fy = np.floor(tx), np.floor(ty)
        tx -= fx
        ty -= fy
        q = at[:, None, None] + (fy.astype(np.int32) * wide + fx.astype(np.int32))
        up, down = flat[q] * (1 - tx) + flat[q + 1] * tx, flat[q + wide] * (1 - tx) + flat[q + wide + 1] * tx
        value = up * (1 - ty) + down * ty
        bits[of] = np.packbits(value[..., 0] < value[..., 1], axis=1)
    order = np.argsort(i, kind="stable")
    return tuple(v[order] for v in (i, px, py, scale, angle, bits))


#: A corner in a row of bytes: x, y, scale, angle as float32, then the descriptor.
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "u1", TESTS // 8)])


def describe(images: list[bytes | None]) -> list[bytes]:
    """The corners of each image, as packed POINT rows."""
    grey = [decode(x) for x in images]
    shapes: dict[tuple, list[int]] = {}
    for k, g in enumerate(grey):
        if g is not None:
            shapes.setdefault(g.shape, []).append(k)
    out = [b""] * len(images)
    for shape, of in shapes.items():
        for lo in range(0, len(of), step := max(1, (1 << 17) // (shape[0] * shape[1]))):
            part = of[lo : lo + step]
            i, x, y, scale, angle, bits = corners(np.stack([grey[k] for k in part]))
            p = np.zeros(len(i), POINT)
            for name, v in zip(POINT.names, (x, y, scale, angle, bits), strict=True):
                p[name] = v
            for k, s, e in zip(part, np.searchsorted(i, range(len(part))), np.searchsorted(i, range(len(part)), "right"), strict=True):
                out[k] = p[s:e].tobytes()
    return out


def consensus(a: np.ndarray, b: np.ndarray) -> int:
    """The largest number of matched corners that agree on one similarity transform from a to b."""
    if not len(a) or not len(b):
        return 0
    d = np.bitwise_count(a["bits"].view(np.uint64)[:, None] ^ b["bits"].view(np.uint64)[None]).sum(2, dtype=np.int32)
    best = d.argmin(1)
    p = np.flatnonzero(d[np.arange(len(a)), best] <= MAX_BITS)
    if len(p) < MIN_INLIERS:
        return 0
    za, zb = a["x"][p] + 1j * a["y"][p], b["x"][best[p]] + 1j * b["y"][best[p]]
    # every match proposes a transform by its corners' scales and directions; all are tried
    m = (b["scale"][best[p]] / a["scale"][p]) * np.exp(1j * (b["angle"][best[p]] - a["angle"][p]))
    most = 0
    for k in range(len(p)):
        off = np.abs(m[k] * (za - za[k]) + zb[k] - zb)
        ok = off <= TOLERANCE * max(1.0, abs(m[k])) + 0.08 * np.abs(zb - zb[k])
        if ok.sum() >= 3:  # refit on those that agree, then count anew
            x, y = za[ok] - za[ok].mean(), zb[ok] - zb[ok].mean()
            s = (np.conj(x) * y).sum() / max(1e-9, (np.abs(x) ** 2).sum())
            off = np.abs(s * (za - za[ok].mean()) + zb[ok].mean() - zb)
            ok = off <= TOLERANCE * max(1.0, abs(s))
            if 0.2 < abs(s) < 5:  # different places on both sides
                most = max(most, min(len(np.unique(np.rint(za[ok]))), len(np.unique(best[p][ok]))))
    return most


FEATURES = "id long, hash string, points binary, n_points long"


def _features(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            cut = b.slice(lo, 256)
            got = describe(cut.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(2), pa.array(got, pa.binary()), pa.array([len(x) // POINT.itemsize for x in got], pa.int64())], names=["id", "hash", "points", "n_points"])


_rng = np.random.default_rng(5)
_ORDER = [_rng.permutation(TESTS) for _ in range(TABLES)]


def keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each TABLES x corners: the table's number and the bits of its key's tests; the bits of its sketch's."""
    each = np.unpackbits(bits, axis=1)
    out, sketch = np.zeros((2, TABLES, len(bits)), np.int64)
    for t, of in enumerate(_ORDER):
        raw = np.zeros((len(bits), 8), np.uint8)
        raw[:, : KEY_BITS // 8] = np.packbits(each[:, of[:KEY_BITS]], axis=1)
        out[t] = raw.view("<i8")[:, 0] + (t << KEY_BITS)
        sketch[t] = np.ascontiguousarray(np.packbits(each[:, of[KEY_BITS : KEY_BITS + SKETCH_BITS]], axis=1)).view("<i8")[:, 0]
    return out, sketch


def _entries(batches):
    """(key, rep, sketch) for each corner and table."""
    for b in (batch.slice(lo, 256) for batch in batches for lo in range(0, batch.num_rows, 256)):
        ids = b.column(0).to_numpy()
        points = [np.frombuffer(x.as_buffer(), POINT) for x in b.column(1)]
        own = np.repeat(ids, [len(p) for p in points])
        for k, w in zip(*keys(np.concatenate([p["bits"] for p in points])), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(own), pa.array(w)], names=["key", "rep", "sketch"])


def _star(batches):
    """(key, head, rep, i) for the images of each key, in order, but for the first one (the head), from rows sorted by key and rep."""
    key = head = last = None
    i = 0
    for b in batches:
        k, r = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(k):
            continue
        fresh = np.concatenate(([key is None or k[0] != key], k[1:] != k[:-1]))
        again = np.concatenate(([not fresh[0] and r[0] == last], (r[1:] == r[:-1]) & ~fresh[1:]))
        start = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1  # -1: the run that began in an earlier batch
        heads = np.concatenate((r[start], [0 if head is None else head]))[group]
        seen = np.cumsum(~again)
        base = np.concatenate((seen[start], [-i]))[group]
        number = seen - base
        keep = ~fresh & ~again
        yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(heads[keep]), pa.array(r[keep]), pa.array(number[keep])], names=["key", "head", "rep", "i"])
        key, last, head, i = k[-1], r[-1], heads[-1], int(number[-1])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches are close."""
    return np.bitwise_count((a ^ b).view(np.uint64)) <= NEAR_BITS


def _close(batches):
    """From entries sorted by key and rep, rows of two kinds: (key, a, b) for the first image a of a key and each other one close to it there; (key, a, null, sketch) for
    those others that are close to one another, or are in an entry of more than BLOCK. Of a key that goes on in the next batch at most BLOCK rows are held."""

    def row(key, a, b, sketch):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b, pa.int64()), pa.array(sketch)], names=["key", "a", "b", "sketch"])

    def beyond(head, key, rep, sketch):
        """Rows of an entry of more than BLOCK, whose first one is given."""
        ok = _near(sketch, head[2]) & (rep != head[1])
        yield row(key[ok], np.full(ok.sum(), head[1]), rep[ok], sketch[ok])
        yield row(key, rep, np.full(len(key), None), sketch)

    held = head = None
    for batch in chain(batches, [None]):
        cols = [c.to_numpy() for c in batch.columns] if batch else [np.zeros(0, np.int64)] * 3
        if held:
            cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
        held = None
        if head and len(cols[0]):
            of = np.searchsorted(cols[0], head[0], "right")
            yield from beyond(head, *(c[:of] for c in cols))
            cols = [c[of:] for c in cols]
            head = None if len(cols[0]) else head
        if not len(cols[0]):
            continue
        end = np.searchsorted(cols[0], cols[0][-1]) if batch else len(cols[0])
        held = [c[end:] for c in cols]
        if len(held[0]) > BLOCK:
            head = tuple(c[0] for c in held)
            yield from beyond(head, *(c[1:] for c in held))
            held = None
        key, rep, sketch = (c[:end] for c in cols)
        same = np.append(key[1:] == key[:-1], False)
        some = np.flatnonzero(same | np.append(False, same)[: len(key)])  # rows that are not alone with their key
        if not len(some):
            continue
        key, rep, sketch = key[some], rep[some], sketch[some]
        star = next(_star([pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(len(key)))], names=["key", "rep"])]))
        first, at, number = (star.column(c).to_numpy() for c in (1, 2, 3))
        ok = _near(sketch[first], sketch[at]) & (rep[first] != rep[at])
        yield row(key[at[ok]], rep[first[ok]], rep[at[ok]], sketch[at[ok]])
        size = np.bincount(first, minlength=len(key))[first]  # of the others
        stay = np.zeros(len(key), bool)
        stay[at[size >= BLOCK]] = True
        few = size < BLOCK
        at, number = at[few], number[few]
        lag = 0
        while len(at):
            lag += 1
            at, number = at[number > lag], number[number > lag]
            two = at[_near(sketch[at], sketch[at - lag]) & (rep[at] != rep[at - lag])]
            stay[two] = stay[two - lag] = True
        yield row(key[stay], rep[stay], np.full(stay.sum(), None), sketch[stay])


def _verify(batches):
    for batch in batches:
        a, b, pa_, pb = (batch.column(k) for k in range(4))
        ok = [consensus(np.frombuffer(x.as_buffer(), POINT), np.frombuffer(y.as_buffer(), POINT)) >= MIN_INLIERS for x, y in zip(pa_, pb, strict=True)]
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _block_pairs(batches):
    """Close pairs (a, b) of different components, a < b, from runs of one (key, i, j)."""
    for t in runs(batches, 3):
        side, comp, rep, sketch = (t[c].to_numpy() for c in ("side", "comp", "rep", "sketch"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        p, q = np.nonzero((comp[left][:, None] != comp[right][None]) & _near(sketch[left][:, None], sketch[right][None]))
        a, b = rep[left[p]], rep[right[q]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _verified(pairs: DataFrame, points: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that are copies; only the corners of images in a pair are moved, once for each image."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), f"media-{name}-ids")
    needed = written(points.join(small(ids), "rep", "left_semi").dropDuplicates(["rep"]), f"media-{name}-points")
    left, right = (needed.select(F.col("rep").alias(c), F.col("points").alias(f"p{c}")) for c in "ab")
    links = written(pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(_verify, "a long, b long"), f"media-{name}-links")
    forget(ids, needed)
    return links


def copies(images: DataFrame, key: str = "media_id", column: str = "image") -> DataFrame:
    """One row per input row: the id, n_points, class_id (smallest id with the same bytes), n_class (rows of the class) and component_id (smallest id reachable over copies)."""
    rows = images.select(F.col(key).cast("long").alias("id"), F.col(column).alias("image"))
    rows = rows.withColumn("hash", F.sha2(F.coalesce("image", F.lit(b"").cast("binary")), 256))
    return _linked(rows.select("id", "image", "hash").mapInArrow(_features, FEATURES), key)


def _linked(feats: DataFrame, key: str) -> DataFrame:
    feats = written(feats, "media-points")
    known = feats.where("id is not null")
    classes = written(known.groupBy("hash").agg(F.min("id").alias("rep"), F.count("*").alias("n_class")), "media-classes")
    nodes = written(classes.groupBy("rep").agg(F.xxhash64(F.min("hash")).alias("of")), "media-nodes")
    points = known.where("n_points > 0").join(small(nodes), (F.col("id") == F.col("rep")) & (F.xxhash64("hash") == F.col("of"))).select("rep", "points")
    entries = points.mapInArrow(_entries, "key long, rep long, sketch long")
    close = written(entries.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_close, "key long, a long, b long, sketch long"), "media-close")
    first = written(close.where("b is not null").select("a", "b").distinct(), "media-first")
    near = _verified(first, points, "first")
    label = components(near, "media-first")
    # close ones of an entry that are still apart: all pairs with its first image were compared above
    members = close.where("b is null").select("key", F.col("a").alias("rep"), "sketch").distinct()
    leaves = written(members.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("comp"), "rep", "sketch"), "media-leaves")
    met = spread(cross_blocks(leaves, ["rep", "sketch"], BLOCK), "key", "i", "j").mapInArrow(_block_pairs, "a long, b long").distinct()
    more = met.join(first, ["a", "b"], "left_anti")
    more = _verified(written(more, "media-more"), points, "more")
    label = components(near.union(more), "media-all")
    final = written(classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("hash", "n_class", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id")), "media-final")
    forget(close, leaves, nodes)
    linked = known.select("id", "hash", "n_points").join(small(final), "hash").select(F.col("id").alias(key), "n_points", "class_id", "n_class", "component_id")
    lone = feats.where("id is null").select(F.col("id").alias(key), "n_points", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("n_class"), F.lit(None).cast("long").alias("component_id"))
    return linked.unionByName(lone)


# --- images for tables that have none -------------------------------------------------

SIDE = 96
_f = np.random.default_rng(9)
_WAVES = _f.uniform(-0.2, 0.2, (64, 2))
_yy, _xx = np.mgrid[0:SIDE, 0:SIDE]
_PHASE = 2 * np.pi * (_WAVES[:, :1] * _xx.ravel() + _WAVES[:, 1:] * _yy.ravel())
_COS, _SIN = np.cos(_PHASE).astype(np.float32), np.sin(_PHASE).astype(np.float32)


def rendered(embeddings: list) -> np.ndarray:
    """Pictures of waves whose phases are the vectors' values: different vectors give unlike pictures."""
    e = np.zeros((len(embeddings), 64), np.float32)
    for k, v in enumerate(embeddings):
        if v:
            e[k, : len(v)] = [0.0 if x is None else x for x in v[:64]]
    x = np.cos(40 * e) @ _COS - np.sin(40 * e) @ _SIN
    return (128 + 18 * x).clip(0, 255).reshape(-1, SIDE, SIDE)


def edited(grey: np.ndarray, kind: int) -> np.ndarray:
    """A crop (0), a turned and darkened copy (1), or a smaller copy with more light (2)."""
    if kind == 0:
        return grey[9:-4, 5:-11]
    if kind == 1:
        return np.rot90(grey) * 0.7 + 10
    return resize(grey[None], 1.4)[0] * 0.9 + 20


def _pictures(batches, every: int):
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            ids, out = [], []
            keys, vectors = (b.column(k).slice(lo, 256).to_pylist() for k in range(2))
            for v, x in zip(keys, rendered(vectors), strict=True):
                ids.append(None if v is None else 2 * v)
                out.append(pgm(x))
                if v is not None and v % every == 3:
                    ids.append(2 * v + 1)
                    out.append(pgm(edited(x, v // every % 3)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["media_id", "image"])


def _described(batches, every: int):
    for b in _pictures(batches, every):
        hashes = pa.array([sha256(x.as_buffer()).hexdigest() for x in b.column(1)])
        yield from _features([pa.RecordBatch.from_arrays([*b.columns, hashes], names=["id", "image", "hash"])])


def media_from_embeddings(embeddings: DataFrame, every: int = 10) -> DataFrame:
    """media_id, image: a picture of every vector (2 * vec_id), and of each vector whose vec_id is 3 modulo ``every`` an edited copy (2 * vec_id + 1)."""
    return embeddings.select("vec_id", "embedding").mapInArrow(partial(_pictures, every=every), "media_id long, image binary")


def copies_of_embeddings(embeddings: DataFrame, every: int = 10) -> DataFrame:
    """The copies of media_from_embeddings; a picture is described by the worker that makes it, so pictures are not sent from one to another."""
    return _linked(embeddings.select("vec_id", "embedding").mapInArrow(partial(_described, every=every), FEATURES), "media_id")
