"""Target-distribution importance resampling over hashed word runs, with identical texts collapsed.

1. Rows are grouped by their full text (map-side partial counts first, so a text that
   holds a third of all rows is one row per task before the shuffle). Each different
   text is cut into words and hashed once; its buckets are stored as one packed array.
2. Bucket counts of the corpus are sums over the different texts of their buckets times
   the text's number of rows; each task adds up one array of ``buckets`` numbers.
3. A bucket's gain compares its smoothed share in the target with that in the corpus; a
   text's weight is the floored mean of its gains, again computed once for a text.
4. Weights are joined back to the rows by the text's SHA-256. Texts of more than 1 in
   HEAVY rows (so at most HEAVY of them) are joined by broadcast, the others by shuffle.
5. Only then each document gets its own Gumbel noise. Ranks come from counts of the
   scores above and a row number among equal scores, so no task sorts all rows.

Defined cases: a null text has no words but is a text like any other; texts without
words have n_features 0 and weight 0; a null doc_id is hashed as the word ``null`` and
comes last among equal scores; rows that repeat a doc_id share its noise and are each
ranked, equal ones in the order of their texts' hashes; an empty corpus gives no rows,
an empty target leaves t and T at 0; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbuf as T
from .shared import forget, small, written

BUCKETS = 10_000
#: Texts of more than 1 in HEAVY rows are joined by broadcast: there are at most HEAVY.
HEAVY = 2000

#: Bytes of a word: digits, small letters, and everything outside ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[ord("0") : ord("9") + 1] = IS_WORD[ord("a") : ord("z") + 1] = IS_WORD[128:] = True

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> np.uint32(1)), _CRC >> np.uint32(1))
#: Words of up to so many bytes are hashed together, byte by byte; longer ones each by zlib.
TOGETHER = 48


def crc32s(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The crc32 of each slice data[start:end]."""
    size = end - start
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(-np.minimum(size, TOGETHER + 1), kind="stable")
    long = int((size > TOGETHER).sum())
    for w in order[:long]:
        out[w] = zlib.crc32(data[start[w] : end[w]])
    order = order[long:]
    begin, size = start[order], size[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))  # the words longer than k bytes come first
        state[:n] = _CRC[(state[:n] ^ data[begin[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    return out


def hashed_runs(texts: list[bytes], runs: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every run of ``runs[0]`` to ``runs[1]`` words of each text, laid end to end, and where each text's begin."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined.translate(T.LOWER_AZ), np.uint8)
    word = IS_WORD[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes + 1))))
    parts, owner = [], []
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    for n in range(runs[0], runs[1] + 1):
        if n == 1:
            parts.append(crc32s(data, start, end))
            owner.append(doc)
            continue
        m = max(0, len(start) - n + 1)
        at = np.flatnonzero(doc[:m] == doc[n - 1 :])
        spelt = [b" ".join(data[start[i + k] : end[i + k]].tobytes() for k in range(n)) for i in at]
        parts.append(np.fromiter(map(zlib.crc32, spelt), np.uint32, len(spelt)))
        owner.append(doc[at])
    value, of = np.concatenate(parts) % np.uint32(buckets), np.concatenate(owner)
    if len(parts) > 1:
        order = np.argsort(of, kind="stable")
        value, of = value[order], of[order]
    return value.astype("<u4"), np.searchsorted(of, np.arange(len(texts) + 1))


def text_features(runs: tuple[int, int], buckets: int):
    """Rows with ``text`` to key, copies, words (runs of 1), n_features and the packed buckets."""

    def run(batches):
        for cut, texts in T.pieces(batches):
            value, first = hashed_runs(texts, runs, buckets)
            packed = value.astype("<u2") if buckets <= 1 << 16 else value
            n_words = np.diff(hashed_runs(texts, (1, 1), buckets)[1]) if runs != (1, 1) else np.diff(first)
            col = lambda name: cut.column(cut.schema.get_field_index(name))
            yield pa.RecordBatch.from_arrays(
                [col("key"), col("copies"), pa.array(n_words.astype(np.int64)), pa.array(np.diff(first).astype(np.int64)), pa.array([packed[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())],
                names=["key", "copies", "n_words", "n_features", "packed"],
            )

    return run


def _unpacked(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a batch's rows end to end, and where each row's begin."""
    width = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    col = batch.column(batch.schema.get_field_index("packed"))
    rows = [x.as_buffer() for x in col]
    first = np.concatenate(([0], np.cumsum([len(x) // width.itemsize for x in rows]))).astype(np.int64)
    return np.frombuffer(b"".join(rows), width), first


def bucket_sums(buckets: int):
    """Each task's sums of copies over its rows' buckets, as (bucket, n) without zeros."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                value, first = _unpacked(part, buckets)
                copies = part.column(part.schema.get_field_index("copies")).to_numpy()
                one = copies == 1  # most texts stand once
                size = np.diff(first)
                total += np.bincount(value[np.repeat(one, size)], minlength=buckets)
                for r in np.flatnonzero(~one):
                    total += copies[r] * np.bincount(value[first[r] : first[r + 1]], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["bucket", "n"])

    return run


def text_weights(gains: np.ndarray):
    """The floored mean gain of each text's features."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                value, first = _unpacked(part, len(gains))
                total = np.concatenate(([0], np.cumsum(gains[value])))
                n = np.diff(first)
                weight = np.where(n > 0, (total[first[1:]] - total[first[:-1]]) // np.maximum(n, 1), 0)
                col = lambda name: part.column(part.schema.get_field_index(name))
                yield pa.RecordBatch.from_arrays([col("key"), col("copies"), col("n_words"), col("n_features"), pa.array(weight.astype(np.int64))], names=["key", "copies", "n_words", "n_features", "weight"])

    return run


def text_key(text: Column) -> Column:
    """32 bytes that stand for the whole text; null for a null text is kept apart from the empty one."""
    return F.unhex(F.sha2(F.concat(F.when(text.isNull(), "-").otherwise("+"), F.coalesce(text, F.lit(""))).cast("binary"), 256))


def collapsed(rows: DataFrame, runs: tuple[int, int], buckets: int) -> DataFrame:
    """key, copies, n_words, n_features and packed buckets of each different text."""
    texts = rows.groupBy("text").agg(F.count("*").alias("copies")).select(text_key(F.col("text")).alias("key"), "copies", "text")
    return texts.mapInArrow(text_features(runs, buckets), "key binary, copies long, n_words long, n_features long, packed binary")


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) of every bucket, both smoothed by one; reads ``buckets`` numbers of each side."""
    sums = []
    for side in (corpus, target):
        n = np.zeros(buckets, np.int64)
        for r in side.mapInArrow(bucket_sums(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # bound: one row for each bucket
            n[r.bucket] = r.n
        sums.append(n)
    s, t = (x.astype(np.float64) for x in sums)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of a number u in (0, 1) that the seed and the id give."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, runs: tuple[int, int] = (1, 1), buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; the floor(percent / 100 of the rows with ``least_words`` words or more) highest scores are drawn and have ranks 1, 2, ..."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = written(collapsed(rows, runs, buckets), "texts")
    gains = bucket_gains(texts, collapsed(target.select(F.col("text").cast("string").alias("text")), runs, buckets), buckets)
    weights = written(texts.mapInArrow(text_weights(gains), "key binary, copies long, n_words long, n_features long, weight long"), "text-weights")
    forget(texts)
    n_rows = weights.agg(F.sum("copies"), F.sum(F.when(F.col("n_words") >= least_words, F.col("copies")).otherwise(0))).first()
    draws = percent * (n_rows[1] or 0) // 100
    heavy = F.col("copies") > F.lit((n_rows[0] or 0) // HEAVY)
    cols = ["key", "n_words", "n_features", "weight"]
    ids = rows.select("doc_id", text_key(F.col("text")).alias("key"))
    light = weights.where(~heavy).select(*cols)
    most = F.broadcast(weights.where(heavy).select(*cols))  # bound: HEAVY rows, each above 1 in HEAVY of all
    ids = written(ids, "text-keys")
    joined = ids.join(most, "key").unionByName(ids.join(most, "key", "left_anti").join(light, "key"))
    # each document's own noise comes after the join
    scored = written(joined.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).select("doc_id", "key", "n_words", "n_features", "weight", "score"), "scored")
    forget(ids, weights)
    able = scored.where(F.col("n_words") >= least_words)
    # scores are integers of a narrow range: a row for each, with the rows above it
    levels = able.groupBy("score").agg(F.count("*").alias("n")).withColumn("above", F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)))
    levels = written(levels.select("score", F.coalesce("above", F.lit(0)).alias("above")).where(F.col("above") < draws), "score-levels")
    cut = levels.agg(F.min("score")).first()[0]
    out = ["doc_id", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.select(*out, no_rank)
    drawn = (F.col("n_words") >= least_words) & (F.col("score") >= cut)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "key"))
    high = scored.where(drawn).join(small(levels), "score").withColumn("rank", F.col("above") + place.cast("long"))
    return high.select(*out, F.when(F.col("rank") <= draws, F.col("rank")).alias("rank")).unionByName(scored.where(~drawn).select(*out, no_rank))


def resample_sql(percent: int = 10, least_words: int = 20, seed: int = 2024) -> str:
    """The same rows for runs of one word, row by row without collapsing texts."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH table_of AS (SELECT list(c ORDER BY n) AS crc FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS t(n))),
d AS (SELECT doc_id, unnest({words}) AS w FROM documents),
b AS (SELECT unnest({words}) AS w FROM benchmark),
octets AS (SELECT w, list_transform(range(0, octet_length(encode(w))::BIGINT), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS o FROM (SELECT w FROM d UNION SELECT w FROM b)),
bucket AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, o), lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8))) % {BUCKETS} AS k FROM octets, table_of),
s AS (SELECT k, count(*) AS s FROM d JOIN bucket USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b JOIN bucket USING (w) GROUP BY k),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS big_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS big_t),
gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + {BUCKETS}) / ((s + 1)::DOUBLE * (big_t + {BUCKETS}))))::BIGINT AS g FROM s LEFT JOIN t USING (k), sums),
weight AS (SELECT doc_id, count(*) AS n_features, floor(sum(g) / count(*))::BIGINT AS weight FROM d JOIN bucket USING (w) JOIN gain USING (k) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN weight USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {percent} * n // 100 THEN r END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
