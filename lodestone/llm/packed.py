"""Token ids in files of fixed-width bit packing, with block offsets for random access.

File layout, little-endian, all counts unsigned 64-bit:

    magic "TOKPACK1" | bits | block | n_docs | n_ids | n_blocks
    n_docs int64 document ids (null: the smallest int64, flagged below)
    n_docs bytes null flags, padded to 8
    n_docs + 1 first id of each document, counted within the file
    n_blocks + 1 byte offsets of the blocks, counted from the payload's start
    payload: blocks of ``block`` ids, each packed from its own first byte

An id takes the fewest bits that hold every id of the vocabulary. 64 ids fill
exactly ``bits`` 64-bit words, so packing and unpacking are some 64 steps of whole
numpy columns for any number of ids.

Texts are range-partitioned by (doc_id, a hash of the text, the row's place in the
input) and sorted; a task encodes its range as a stream and starts a new file
whenever FILE_IDS ids have come together, so neither a range, nor a doc_id that many
rows repeat, has to fit in memory. Every task writes its files under new names in the
shared folder and returns one manifest row for each; only files that the written
manifest names are read: what a lost or repeated task left behind is never looked at.

Words are hashed and looked up in a numpy table of the words that a worker has seen;
their ids are gathered for many texts at once. A found word's bytes are compared with
the text, so a clash of hashes cannot give a wrong id.

Defined cases: null text counts as empty, so it has the end id alone; rows that
repeat a doc_id are ordered by a hash of their texts; null doc_id comes first; an
empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbuf as T
from .shared import shared_dir, small, written

MAGIC = b"TOKPACK1"
BLOCK = 4096  # ids, a multiple of 64
#: Ids from which on a file is closed; a file is read as one row.
FILE_IDS = 4_000_000
#: Words, and bytes of words and ids, that a worker keeps between batches.
CACHE, CACHE_BYTES = 1_200_000, 48 << 20
NO_ID = -(2**63)


def width(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids laid bit to bit, lowest bit first; the last byte is padded with zeros."""
    x = np.zeros(-(-len(ids) // 64) * 64, np.uint64)
    x[: len(ids)] = ids
    x = np.ascontiguousarray(x.reshape(-1, 64).T)
    out = np.zeros((bits, x.shape[1]), np.uint64)
    for i in range(64):
        w, s = divmod(i * bits, 64)
        out[w] |= x[i] << np.uint64(s)
        if s + bits > 64:
            out[w + 1] |= x[i] >> np.uint64(64 - s)
    return out.T.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of what ``pack`` made."""
    groups = -(-n // 64)
    raw = np.zeros(groups * bits * 8, np.uint8)
    have = np.frombuffer(data, np.uint8)[: len(raw)]
    raw[: len(have)] = have
    x = np.ascontiguousarray(raw.view(np.uint64).reshape(groups, bits).T)
    out, mask = np.empty((64, groups), np.uint32), np.uint64((1 << bits) - 1)
    for i in range(64):
        w, s = divmod(i * bits, 64)
        v = x[w] >> np.uint64(s)
        if s + bits > 64:
            v |= x[w + 1] << np.uint64(64 - s)
        out[i] = v & mask
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One file of documents with these numbers of ids, in this order."""
    n_blocks, step = -(-len(ids) // BLOCK), 32 * BLOCK  # a full block ends on a byte, so many are packed at once
    payload = b"".join(pack(ids[i : i + step], bits) for i in range(0, len(ids), step))
    head = np.array([bits, BLOCK, len(doc_ids), len(ids), n_blocks], np.uint64).tobytes()
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = np.array([NO_ID if d is None else d for d in doc_ids], np.int64)
    first = np.concatenate(([0], np.cumsum(counts))).astype(np.uint64)
    at = np.minimum(np.arange(n_blocks + 1) * (BLOCK * bits // 8), len(payload)).astype(np.uint64)
    return b"".join((MAGIC, head, docs.tobytes(), null.tobytes().ljust(-(-len(null) // 8) * 8, b"\0"), first.tobytes(), at.tobytes(), payload))


class File:
    """A file's documents and ids; ids are unpacked where they are asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a packed token file")
        self.data = data
        self.bits, self.block, docs, self.n_ids, blocks = (int(x) for x in np.frombuffer(data, np.uint64, 5, 8))
        at = 48
        self.doc_ids = np.frombuffer(data, np.int64, docs, at)
        at += 8 * docs
        self.null = np.frombuffer(data, np.uint8, docs, at).astype(bool)
        at += -(-docs // 8) * 8
        self.first = np.frombuffer(data, np.uint64, docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.offsets = np.frombuffer(data, np.uint64, blocks + 1, at).astype(np.int64)
        self.payload = at + 8 * (blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids start .. stop - 1 of the file, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        lo, hi = start // self.block, -(-stop // self.block)
        data = memoryview(self.data)[self.payload + self.offsets[lo] : self.payload + self.offsets[hi]]
        return unpack(data, self.bits, min(hi * self.block, self.n_ids) - lo * self.block)[start - lo * self.block : stop - lo * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """a with room for n items, doubled where it grows."""
    if n <= len(a):
        return a
    new = np.zeros(max(n, 2 * len(a)), a.dtype)
    new[: len(a)] = a
    return new


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start .. start + size - 1 of every run, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class WordTable:
    """Words seen so far with their ids, found by 64-bit hashes in an open-addressing table of numpy arrays."""

    def __init__(self, most: int = CACHE, most_bytes: int = CACHE_BYTES):
        self.most, self.most_bytes = most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.keys, self.used = np.zeros(1024, np.uint64), np.zeros(1024, bool)
        #: for words and ids: where each begins, how long it is, and all of them end to end
        self.start = {"word": np.zeros(1024, np.int64), "ids": np.zeros(1024, np.int64)}
        self.size = {"word": np.zeros(1024, np.int32), "ids": np.zeros(1024, np.int32)}
        self.flat = {"word": np.zeros(1 << 14, np.uint8), "ids": np.zeros(1 << 14, np.uint32)}
        self.filled = {"word": 0, "ids": 0}
        self.slots = np.full(4096, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash's word, -1 for an unknown one."""
        mask = np.uint64(len(self.slots) - 1)
        at = h & mask
        out = self.slots[at]
        left = np.flatnonzero((out >= 0) & (self.keys[out] != h))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & mask
            got = self.slots[at[left]]
            out[left] = got
            left = left[(got >= 0) & (self.keys[got] != h[left])]
        return out

    def _enter(self, first: int) -> None:
        """Puts the words from number ``first`` on into slots."""
        if 3 * self.n > len(self.slots):
            self.slots = np.full(1 << (6 * self.n).bit_length(), -1, np.int32)
            first = 0
        mask = np.uint64(len(self.slots) - 1)
        at = self.keys[first : self.n] & mask
        left = np.arange(len(at))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            free = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[free]] = first + free
            left = left[self.slots[at[left]] != first + left]
            at[left] = (at[left] + np.uint64(1)) & mask

    def add(self, h: np.ndarray, words: tuple[np.ndarray, np.ndarray], ids: tuple[np.ndarray, np.ndarray]) -> None:
        """New words by distinct hashes; words and ids as (all end to end, sizes)."""
        first, self.n = self.n, self.n + len(h)
        self.keys, self.used = _grown(self.keys, self.n), _grown(self.used, self.n)
        self.keys[first : self.n] = h
        for name, (flat, size) in (("word", words), ("ids", ids)):
            at = self.filled[name]
            self.filled[name] = at + len(flat)
            self.flat[name] = _grown(self.flat[name], at + len(flat))
            self.flat[name][at : at + len(flat)] = flat
            self.start[name], self.size[name] = _grown(self.start[name], self.n), _grown(self.size[name], self.n)
            self.start[name][first : self.n] = at + np.cumsum(size) - size
            self.size[name][first : self.n] = size
        self._enter(first)

    def gathered(self, name: str, which: np.ndarray) -> np.ndarray:
        """The words or ids with these numbers, end to end."""
        return self.flat[name][_runs(self.start[name][which], self.size[name][which])]

    def make_room(self) -> None:
        """If the table is full, drops the words not used since the last time, or the older half where all were."""
        if self.n <= self.most and self.filled["word"] + 4 * self.filled["ids"] <= self.most_bytes:
            return
        keep = np.flatnonzero(self.used[: self.n])
        keep = keep[len(keep) // 2 :] if 2 * len(keep) > self.n else keep
        h, parts = self.keys[keep], [(self.gathered(x, keep), self.size[x][keep]) for x in ("word", "ids")]
        self.clear()
        if 2 * (len(parts[0][0]) + 4 * len(parts[1][0])) <= self.most_bytes:
            self.add(h, *parts)


class WordEncoder:
    """Whole texts by a ``tokenizers`` file that drops white space: a text's ids are those of its words, and words repeat.

    Words are cut at the six ASCII white-space bytes, which the file drops as well; what
    else it takes for white space stays inside a word and is left to it. A text with a
    special token is handed to the library whole.
    """

    #: Words are joined by one of these to be encoded together, and their ids cut at its id.
    MARKS = "\u2605\u2665\u2600\u266b\u2122\u2026"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values() if t.content]
        single = [(c, x[0]) for c, x in zip(self.MARKS, self._library(list(self.MARKS)), strict=True) if len(x) == 1]
        self.mark, self.mark_id = single[0] if single else (self.MARKS[0], None)
        self.table = WordTable()

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, end to end, and how many each has. Many words go to the library as one text with a mark between them."""
        text = [w.decode("utf-8", "replace") for w in words]
        flat, sizes = [], []
        for k in range(0, len(text), 2000):
            part = text[k : k + 2000]
            ids = self._library([f" {self.mark} ".join(part)])[0]
            cut = np.flatnonzero(ids == self.mark_id) if self.mark_id is not None else np.zeros(0, int)
            if len(cut) == len(part) - 1:
                sizes.append(np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1)
                flat.append(np.delete(ids, cut))
            else:  # a word holds the mark itself
                each = self._library(part)
                sizes.append(np.array([len(x) for x in each], int))
                flat.append(np.concatenate(each))
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, w: T.Words, h: np.ndarray, new: np.ndarray) -> None:
        of = np.flatnonzero(new)
        of = of[np.unique(h[of], return_index=True)[1]]
        words = [w.data[s:e].tobytes() for s, e in zip(w.start[of].tolist(), w.end[of].tolist(), strict=True)]
        size = (w.end - w.start)[of]
        self.table.add(h[of], (w.data[_runs(w.start[of], size)], size), self.words(words))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        whole = np.array([any(s in t for s in self.special) for t in texts], bool)
        w = T.Words([b"" if x else t for t, x in zip(texts, whole.tolist(), strict=True)] if whole.any() else texts)
        self.table.make_room()
        h = w.hashes()
        at = self.table.find(h)
        new = at < 0
        if new.any():
            self._learn(w, h, new)
            at[new] = self.table.find(h[new])
        self.table.used[at] = True
        # a word with another one's hash: its text goes to the library
        size, known = w.end - w.start, self.table.size["word"][at]
        if (size != known).any():
            whole[w.doc[size != known]] = True
        else:
            same = self.table.gathered("word", at) == w.data[~T.IS_SPACE[w.data]]
            if not same.all():
                whole[w.doc[np.searchsorted(np.cumsum(size), np.flatnonzero(~same), "right")]] = True
        count = T.segment_sum(self.table.size["ids"][at], w.first).astype(np.int64)
        ids = self.table.gathered("ids", at)
        if whole.any():
            cut = np.concatenate(([0], np.cumsum(count)))
            each = [ids[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)]
            for i in np.flatnonzero(whole):
                each[i] = self._library([texts[i].decode("utf-8", "replace")])[0]
            ids, count = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        return ids, count


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, count: np.ndarray, end: int) -> np.ndarray:
    """ids with ``end`` after each text's."""
    out = np.full(len(ids) + len(count), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
    return out


def _put(path: str, end: int, folder: str, bits: int, file_ids: int):
    """Encodes a sorted range of texts and writes its files; a manifest row for each, with the task's number and the file's number in it."""

    def write(docs, counts, ids, k):
        from pyarrow import fs

        to, base = fs.FileSystem.from_uri(folder)
        name = f"{uuid.uuid4().hex}.tok"
        to.create_dir(base, recursive=True)
        docs, counts, ids = pa.chunked_array(docs).to_pylist(), np.concatenate(counts), np.concatenate(ids)
        with to.open_output_stream(f"{base}/{name}") as f:
            f.write(file_bytes(docs, counts, ids, bits))
        task = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([k], pa.int64()), pa.array([name]), pa.array([len(docs)], pa.int64()), pa.array([len(ids)], pa.int64())], names=["part", "k", "file", "n_docs", "n_ids"])

    def run(batches):
        enc, docs, counts, ids, held, k = word_encoder(path), [], [], [], 0, 0
        for cut, texts in T.pieces(batches):
            got, n = enc.encode(texts)
            docs.append(cut.column(0))
            counts.append(n + 1)
            ids.append(with_end(got, n, end))
            held += len(ids[-1])
            if held >= file_ids:
                yield write(docs, counts, ids, k)
                docs, counts, ids, held, k = [], [], [], 0, k + 1
        if docs:
            yield write(docs, counts, ids, k)

    return run


def write(docs: DataFrame, path: str, end: int, file_ids: int = FILE_IDS) -> tuple[str, DataFrame]:
    """Encodes every text, appends ``end``, and writes the files in ascending doc_id order. Returns the folder and the written manifest: file, n_docs, n_ids and start, the ids of all files before it."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/lodestone-tok-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}"
    bits = width(max(word_encoder(path).size, end + 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    ranges = rows.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place").select("doc_id", "text")
    manifest = written(ranges.mapInArrow(_put(path, end, folder, bits, file_ids), "part long, k long, file string, n_docs long, n_ids long"), "tok-files")
    # running sums in two levels: one row for each task, then the files of each task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_task = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    return folder, written(manifest.join(of_task, "part").select("file", "n_docs", "n_ids", start.alias("start")), "tok-manifest")


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest names."""
    spark = manifest.sparkSession

    def run(batches):
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = File(data.as_buffer().to_pybytes())
                crc = []
                for lo in range(0, len(f.doc_ids), 64):  # some documents at a time
                    hi = min(lo + 64, len(f.doc_ids))
                    ids, first = f.ids(int(f.first[lo]), int(f.first[hi])), f.first[lo : hi + 1] - f.first[lo]
                    crc += [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, mask=f.null), pa.array(start + f.first[:-1]), pa.array(np.diff(f.first)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    name = F.element_at(F.split("path", "/"), -1)
    data = spark.read.format("binaryFile").load(folder).select(name.alias("file"), "content")
    return data.join(small(manifest.select("file", "start")), "file").select("start", "content").mapInArrow(run, schema)


def packed(docs: DataFrame, path: str, end: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the documents' ids and reads the files back."""
    return read(*write(docs, path, end, file_ids))
