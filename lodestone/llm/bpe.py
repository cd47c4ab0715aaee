"""Byte-level BPE by ranks: encoding with length-bucketed padded matrices, and decoding.

A text is cut by the vocabulary's pattern; the pieces a worker has not seen yet
are laid into padded matrices, one for each range of byte lengths. In each round
every row merges its leftmost pair of minimum rank; pairs are looked up in an
open-addressing hash table of numpy arrays; rows without a pair leave the matrix.
A very long piece merges all places of its minimum pair in one round where that
provably gives the same ids.

Defined cases: null text counts as empty and has no ids; texts are encoded whole,
whatever their length; rows are encoded one by one, so ties and repeated rows give
equal ids; letters and digits are those of the interpreter's Unicode version below
U+3000, of the ``regex`` module beyond; null doc_id passes through; other columns are kept (``encode``) or
ignored (``digests``); an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from . import textbuf as T

NONE = np.uint32(0xFFFFFFFF)
#: Byte lengths up to which pieces share a matrix; longer ones are encoded alone.
BUCKETS = (4, 8, 12, 16, 24, 32, 48, 64, 128, 256, 512)
#: Pieces and their ids that a worker keeps between batches.
CACHE = 600_000
#: Rows of a matrix are bounded so that it has at most so many cells.
CELLS = 1 << 20

_PLANE = 0x3000  # characters below it are split by a pattern of plain ranges
_BEYOND = re.compile(f"[^\\x00-\\u{_PLANE - 1:04x}]")
#: Fixed value: white space of the Unicode property White_Space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _ranges(kind: str, top: int) -> str:
    """Characters below ``top`` of a Unicode general category, as the inside of a character class."""
    out, start = [], None
    for c in range(top + 1):
        if c < top and unicodedata.category(chr(c))[0] == kind:
            start = c if start is None else start
        elif start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


def _plain(pattern: str, top: int) -> re.Pattern:
    r"""``pattern`` for the standard module: \p{L}, \p{N} and \s spelled out as ranges below ``top``."""
    for name, inside in (("\\p{L}", _ranges("L", top)), ("\\p{N}", _ranges("N", top)), ("\\s", _SPACE)):
        pattern = re.sub(r"\[[^\]]*\]|" + re.escape(name), lambda m, name=name, inside=inside: m[0].replace(name, inside if m[0][0] == "[" else f"[{inside}]"), pattern)
    return re.compile(pattern.replace("\\S", f"[^{_SPACE}]"))


class Splitter:
    """The pieces of a text: plain ranges where the text allows, else the ``regex`` module."""

    def __init__(self, pattern: str):
        import regex

        self.ascii, self.plane, self.full = _plain(pattern, 128).findall, _plain(pattern, _PLANE).findall, regex.compile(pattern).findall

    def __call__(self, text: str) -> list[str]:
        return self.ascii(text) if text.isascii() else self.full(text) if _BEYOND.search(text) else self.plane(text)


class Ranks:
    """A vocabulary of byte strings with ranks (ids), and its hashed pair table.

    Two tokens side by side are a pair if their bytes together are a token; its
    rank is that token's id, which is also the merged id.
    """

    def __init__(self, lines):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.tokens[v] = k
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.byte = np.array([ranks.get(bytes([i]), NONE) for i in range(256)], np.uint32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        a, b, r = np.array(pairs, np.uint64).reshape(-1, 3).T
        self.mask = np.uint64((1 << max(4, (4 * len(r)).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.values = np.full(int(self.mask) + 1, NONE, np.uint32)
        key, self.probes = (a << np.uint64(32)) | b, 1
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = self.keys[slot[left]] == NONE_KEY
            first = left[free][np.unique(slot[left[free]], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = key[first], r[first]
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            self.probes += bool(len(left))

    def _slot(self, key):
        return T.mix(key) & self.mask

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where it is no token or an id is padding."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right
        slot = self._slot(key)
        out, seen = self.values[slot], self.keys[slot]
        miss = np.flatnonzero(((seen != key) & (seen != NONE_KEY)).ravel())
        out = np.where(seen == key, out, NONE)
        flat_key, flat_out, at = key.ravel(), out.reshape(-1), slot.ravel()
        for _ in range(self.probes):
            if not len(miss):
                break
            at[miss] = (at[miss] + np.uint64(1)) & self.mask
            seen = self.keys[at[miss]]
            hit = seen == flat_key[miss]
            flat_out[miss[hit]] = self.values[at[miss[hit]]]
            miss = miss[~hit & (seen != NONE_KEY)]
        return flat_out.reshape(key.shape)

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The ids (little-endian unsigned 32-bit) of pieces of at most ``width`` bytes, by matrix rounds."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < n[:, None], self.byte[raw], NONE)
        out: list[bytes] = [b""] * len(pieces)
        row = np.arange(len(pieces))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else np.zeros((len(pieces), 0), np.uint32)
        while len(row):
            best = ranks.min(1, initial=NONE)
            over = best == NONE
            if over.any():
                for i in np.flatnonzero(over):
                    out[row[i]] = ids[i, : n[i]].tobytes()
                ids, ranks, n, row, best = ids[~over], ranks[~over], n[~over], row[~over], best[~over]
                if not len(row):
                    break
            at = ranks.argmin(1)
            every = np.arange(len(row))
            # compaction: what stands right of the merged pair moves one place to the left
            take = np.arange(ids.shape[1] - 1)
            take = take + (take > at[:, None])
            last = n - 1
            ids = np.take_along_axis(ids, take, 1)
            ids[every, at] = best
            n = last
            keep = max(1, int(n.max()))
            ids = ids[:, :keep]
            if keep == 1:
                ranks = np.zeros((len(row), 0), np.uint32)
                continue
            moved = np.arange(keep - 1)
            ranks = np.take_along_axis(ranks, np.minimum(moved + (moved > at[:, None]), ranks.shape[1] - 1), 1)
            ranks[moved[None] >= (n - 1)[:, None]] = NONE
            for side in (at - 1, at):  # only the two pairs at the merged token are new
                ok = np.flatnonzero((side >= 0) & (side + 1 < n))
                if len(ok):
                    ranks[ok, side[ok]] = self.pair_ranks(ids[ok, side[ok]], ids[ok, side[ok] + 1])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """One long piece. All leftmost non-overlapping places of the minimum pair merge at once if no pair that arises has a lower rank; else only the leftmost does."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            ranks = self.pair_ranks(ids[:-1], ids[1:])
            low = ranks.min()
            if low == NONE:
                break
            at = np.flatnonzero(ranks == low)
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(np.diff(at, prepend=-9) > 1, np.arange(len(at)), 0))
            at = at[run % 2 == 0]  # in a run of overlapping places every second one
            merged = self._merged(ids, at, low)
            if len(at) > 1:
                left = self.pair_ranks(merged[:-1], merged[1:])
                new = (merged[:-1] == low) | (merged[1:] == low)
                if (left[new] < low).any():
                    merged = self._merged(ids, at[:1], low)
            ids = merged
        return ids.tobytes()

    @staticmethod
    def _merged(ids, at, low):
        ids = ids.copy()
        ids[at] = low
        return np.delete(ids, at + 1)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces, each as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for top in BUCKETS:
            of = np.flatnonzero((size > low) & (size <= top))
            for k in range(0, len(of), step := max(1, CELLS // top)):
                part = of[k : k + step]
                for i, x in zip(part, self.merge_rows([pieces[i] for i in part], top), strict=True):
                    out[i] = x
            low = top
        for i in np.flatnonzero(size > low):
            out[i] = self.merge_long(pieces[i])
        return out


NONE_KEY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Encoder:
    """Encodes and decodes whole texts; keeps the ids of pieces between batches, at most CACHE of them."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.split, self.known = ranks, Splitter(pattern), {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        cut = [self.split(t) for t in texts]
        new = list(set().union(*cut).difference(self.known)) if cut else []
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = list(set().union(*cut))
        self.known.update(zip(new, self.ranks.encode_pieces([p.encode() for p in new]), strict=True))
        look = self.known.__getitem__
        return [np.frombuffer(b"".join(map(look, pieces)), np.uint32) for pieces in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, ids.tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The process's encoder for a local rank file (every machine has it, as it has the tokenizer packages)."""
    if (path, pattern) not in _encoders:
        with open(path, "rb") as f:
            _encoders[path, pattern] = Encoder(Ranks(f), pattern)
    return _encoders[path, pattern]


def _texts(cut, raw: list[bytes]) -> list[str]:
    return [t.decode("utf-8", "replace") for t in raw]


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column ``ids`` (array<int>) in place of the text column; an existing column of that name is replaced."""
    rest = [c for c in docs.columns if c not in (column, ids)]
    schema = docs.select(rest).schema.add(ids, ArrayType(IntegerType()))

    def run(batches):
        enc = encoder(path, pattern)
        for cut, raw in T.pieces(batches, column):
            got = enc.encode(_texts(cut, raw))
            first = np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int32)
            flat = np.concatenate(got).view(np.int32) if got else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in rest), pa.ListArray.from_arrays(pa.array(first), pa.array(flat))], names=[*rest, ids])

    return docs.select(*rest, column).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", column: str = "text") -> DataFrame:
    """tokens with the decoded text in place of the ids; null ids give null, bytes that are no UTF-8 are replaced as Python's decoder does."""
    rest = [c for c in tokens.columns if c not in (column, ids)]
    schema = tokens.select(rest).schema.add(column, "string")

    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            out = [None if not x.is_valid else enc.decode(x.values.to_numpy(zero_copy_only=False)).decode("utf-8", "replace") for x in b.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(out, pa.string())], names=[*rest, column])

    return tokens.select(*rest, ids).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one space) and decoded_sha256 (the decoded bytes) of every row: encoded, then decoded from the ids."""

    def run(batches):
        enc = encoder(path, pattern)
        word = enc.ranks.decimal.__getitem__
        for cut, raw in T.pieces(batches):
            got = enc.encode(_texts(cut, raw))
            n = pa.array([len(x) for x in got], pa.int64())
            ids = [hashlib.sha256(" ".join(map(word, x.tolist())).encode()).hexdigest() for x in got]
            back = [hashlib.sha256(enc.decode(x)).hexdigest() for x in got]
            yield pa.RecordBatch.from_arrays([cut.column(0).cast(pa.int64()), n, pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


assert sys.byteorder == "little"
