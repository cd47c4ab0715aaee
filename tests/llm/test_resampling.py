"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib

import numpy as np

from lodestone.llm.importance import crc32s, hashed_runs, resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, copies string, weight double, key int"


def words(text):
    return WORD.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


def features(text, runs):
    w = words(text)
    return [b" ".join(w[i : i + n]) for n in range(runs[0], runs[1] + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, runs, buckets, percent, least):
    s, t = [0] * buckets, [0] * buckets
    for side, n in ((docs, s), (target, t)):
        for _, text in side:
            for f in features(text, runs):
                n[zlib.crc32(f) % buckets] += 1
    gain = [math.floor(1000 * math.log((t[k] + 1) * (sum(s) + buckets) / ((s[k] + 1) * (sum(t) + buckets)))) for k in range(buckets)]
    rows = []
    for i, text in docs:
        f = [gain[zlib.crc32(x) % buckets] for x in features(text, runs)]
        weight = sum(f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)), text])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, hashlib.sha256(("-" if r[6] is None else "+" + r[6]).encode()).digest()))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


def test_crc_of_slices():
    data = b"a" * 70 + "héllo wörld z".encode() + b"\x00\xff" * 40
    cuts = [(0, 70), (0, 1), (3, 3), (70, 76), (71, 84), (5, 53), (5, 54), (84, 164)]
    got = crc32s(np.frombuffer(data, np.uint8), *(np.array(c) for c in zip(*cuts)))
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in cuts]


def test_runs_stay_inside_a_text():
    value, first = hashed_runs([b"One two", b"", b"three", b"!?"], (1, 2), 10_000)
    want = [[b"one", b"two", b"one two"], [], [b"three"], []]
    assert [sorted(value[a:b]) for a, b in zip(first[:-1], first[1:])] == [sorted(zlib.crc32(x) % 10_000 for x in w) for w in want]


def test_against_plain_version(spark):
    base = ["red green blue " * 4, "Maths Physik été " * 3, None, "", "!!", "x" * 3000 + " y z", "same same same same " * 5, "ÀÉ 42 über 7"]
    docs = [(k if k % 11 else None, base[k % 8] + (f" w{k % 5}" if k % 3 and base[k % 8] else "") if base[k % 8] is not None else None) for k in range(160)]
    docs += [(5, "same same same same " * 5)] * 60 + [(5, "another text with the id of the others")] * 2
    target = [(0, "Maths Physik été 42"), (1, None), (2, "blue blue")]
    df = spark.createDataFrame([(*r, "c", 1.0, 2) for r in docs], SCHEMA)
    for runs in ((1, 1), (1, 2)):
        got = resample(df, spark.createDataFrame(target, "item_id long, text string"), runs, 97, 30, 3)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(repr, map(tuple, got.collect()))) == plain(docs, target, runs, 97, 30, 3)


def test_empty_tables(spark):
    empty, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b", "", 0.0, 0)], SCHEMA)
    assert resample(empty, some.select("text")).collect() == []
    assert resample(some, empty.select("text"), least_words=1, percent=100).first()["rank"] == 1
    assert resample(some, empty.select("text")).first()["rank"] is None
