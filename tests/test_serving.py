"""Selection, embeddings, forests, cooldowns, strong components and entity state against plain loops; cleaning and loaders on small cases."""

import datetime as dt
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import anomaly as A
from lodestone.operators import cleaning as C
from lodestone.operators import graph as G
from lodestone.operators import retrieval as R
from lodestone.sources import files
from lodestone.streaming import state as ST
from lodestone.streaming import windows as W


def plain_choice(rows, k, balance):
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    chosen = []
    while rows and len(chosen) < k:
        if not chosen:
            chosen.append(rows.pop(0))
            continue
        def worth(r):
            sim = max(len(r[2] & c[2]) / len(r[2] | c[2]) if r[2] | c[2] else 0.0 for c in chosen)
            return balance * r[1] - (1 - balance) * sim
        top = max(map(worth, rows))
        chosen.append(rows.pop([worth(r) for r in rows].index(top)))
    return [r[0] for r in chosen]


def test_diverse_equals_a_greedy_loop(spark):
    rng = random.Random(3)
    rows = [(g, i, round(rng.random(), 2), sorted({rng.choice("abcdefg") for _ in range(rng.randrange(5))})) for g in "xy" for i in range(25)]
    df = spark.createDataFrame(rows, "g string, id long, s double, t array<string>")
    got = {}
    for r in sorted(R.diverse(df, ["g"], "id", "s", "t", 8).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.g, []).append(r.id)
    for g in "xy":
        assert got[g] == plain_choice([(i, s, frozenset(t)) for h, i, s, t in rows if h == g], 8, 0.7)


def test_diverse_by_text_and_by_vector(spark):
    rng = random.Random(5)
    rows = [(i, round(rng.random(), 3), " ".join(rng.choice(["Red", "fox", "runs", "élan", "a_b"]) for _ in range(rng.randrange(7))) if i % 9 else None, [rng.gauss(0, 1) for _ in range(3)] if i % 7 else None) for i in range(40)]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, id long, s double, t string, v array<double>")

    def keyword(q, t):
        words, q, t = re.findall(r"\w+", (t or "").lower()), (q or "").lower(), (t or "").lower()
        asked = set(re.findall(r"\w+", q))
        if not asked or not words:
            return 0.0
        return min(1.0, 0.75 * len(asked & set(words)) / len(asked) + 0.1 * sum(w in asked for w in words) / len(words) + 0.15 * (q in t))

    def cosine(a, b):
        return 0.0 if a is None or b is None else sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    for column, like, similarity in ((2, "text", keyword), (3, "vector", cosine)):
        left = sorted(rows, key=lambda r: (-r[1], r[0]))
        chosen = [left.pop(0)]
        while len(chosen) < 9:
            best = max(left, key=lambda r: (0.7 * r[1] - 0.3 * max(similarity(r[column], c[column]) for c in chosen), -left.index(r)))
            left.remove(best)
            chosen.append(best)
        got = R.diverse(df, ["g"], "id", "s", "tv"[column - 2], 9, like=like).orderBy("rank").collect()
        assert [r.id for r in got] == [c[0] for c in chosen], like


def test_hashed_embedding_equals_a_loop(spark):
    texts = {1: "Ein Wort, ein Wort und élan_2", 2: "", 3: None, 4: "..."}
    got = {r.id: r.embedding for r in R.hashed_embedding(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text", 16).collect()}
    for i, t in texts.items():
        v = [0.0] * 16
        for w in re.findall(r"\w+", (t or "").lower()):
            d = hashlib.blake2b(w.encode(), digest_size=16).hexdigest()
            v[int(d[:8], 16) % 16] += 1 if int(d[8:10], 16) % 2 == 0 else -1
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        assert got[i] == pytest.approx([x / n for x in v])


def test_highlights(spark):
    df = spark.createDataFrame([("A cat sat. " * 3,), ("no",), (None,)], "t string")
    got = [r[0] for r in df.select(R.highlights(F.col("t"), "CAT on", 2, 8)).collect()]
    assert got == [["A cat sat...", ".... A cat sat..."], [], []]


def test_supported_claims(spark):
    c = spark.createDataFrame([(1, 1, "red fox runs"), (1, 2, "nothing"), (1, 3, None)], "s long, c long, text string")
    e = spark.createDataFrame([(1, 7, "red fox"), (1, 5, "fox red"), (2, 1, "nothing")], "s long, d long, text string")
    got = {r.c: (r.support, r.d, r.is_supported) for r in R.supported(c, e, ["s"], "c", "d", "text", 0.5).collect()}
    assert got == {1: (pytest.approx(2 / 3), 5, True), 2: (0.0, None, False), 3: (0.0, None, False)}


def test_forest_scores_equal_walks_and_find_strangers(spark):
    rng = np.random.default_rng(1)
    tree = A.grown(rng.normal(size=(64, 2)), rng)
    x = rng.normal(size=(200, 2)) * 2

    def walk(p):
        n = 0
        while tree["column"][n] >= 0:
            n = tree["left"][n] + int(p[tree["column"][n]] >= tree["cut"][n])
        return tree["path"][n]

    assert A.depths(tree, x).tolist() == [walk(p) for p in x]
    near = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    far = [(1000 + i, 9.0 + i, -9.0 - i) for i in range(5)]
    df = spark.createDataFrame(near + far + [(5000, None, 1.0), (5001, float("nan"), 1.0)], "id long, a double, b double")
    got = {r.id: r for r in A.isolation_forest(df, "id", ["a", "b"], trees=50).collect()}
    assert all(got[1000 + i].is_outlier for i in range(5))
    assert sum(bool(r.is_outlier) for r in got.values()) <= 0.06 * len(got)
    assert got[5000].isolation is None and got[5001].isolation is None and got[5001].is_outlier is None
    empty = A.isolation_forest(df.where("id < 0"), "id", ["a", "b"])
    assert empty.count() == 0


def test_cooldown_equals_a_loop(spark):
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), base + dt.timedelta(seconds=rng.randrange(5000)), i) for i in range(400)] + [("a", None, 999)]
    df = spark.createDataFrame(rows, "who string, ts timestamp, id long")
    got = sorted(r.id for r in A.cooled(df, ["who"], "ts", 300, F.col("id")).collect())
    last, want = {}, []
    for who, ts, i in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[2])):
        if who not in last or (ts - last[who]).total_seconds() >= 300:
            last[who] = ts
            want.append(i)
    assert got == sorted(want)


def plain_strong(edges):
    nodes = {n for e in edges for n in e}
    near = {n: {b for a, b in edges if a == n} for n in nodes}

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    far = {n: reach(n) for n in nodes}
    return {n: min(m for m in far[n] if n in far[m]) for n in nodes}


@pytest.mark.parametrize("seed, nodes, count", [(1, 14, 20), (2, 10, 24)])
def test_strong_components(spark, seed, nodes, count):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(count)})
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.component for r in G.strong_components(df).collect()} == plain_strong(edges)


def test_subgraph_and_no_edges(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    assert [tuple(r) for r in G.subgraph(df, spark.createDataFrame([(1,), (2,)], "node long")).collect()] == [(1, 2)]
    assert G.strong_components(df.where("src > 9")).count() == 0


def test_velocity_state_over_batches(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    first = [("a", base, 1.0, "x"), ("a", base + dt.timedelta(seconds=5), 2.0, "y"), ("b", base, None, None)]
    later = [("a", base + dt.timedelta(seconds=12), 4.0, "x"), ("b", base + dt.timedelta(seconds=1), 1.0, "z"), (None, base, 1.0, "x")]
    kind = "who string, ts timestamp, v double, l string"
    src = f"file://{tmp_path}/in"
    stream = lambda: ST.velocity(spark.readStream.schema(kind).parquet(src), "who", "ts", "v", "l", 10, 3600, "1 hour")
    for rows in (first, later):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        W.run_available(stream(), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    got = {(r.entity, int((r.ts - base).total_seconds())): (r.n_recent, r.sum_recent, r.is_new_label) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {("a", 0): (1, 1.0, False), ("a", 5): (2, 3.0, True), ("a", 12): (2, 6.0, False), ("b", 0): (1, 0.0, False), ("b", 1): (2, 1.0, False)}


def test_cleaning_edges(spark):
    df = spark.createDataFrame([("1", " Ann ", "1,200.5"), ("x", "Bo", "5"), (None, "", "-9"), ("4", "Cy", "900000")], "id string, name string, v string")
    fields = [C.Field("id", kind="integer", required=True), C.Field("name", default="none", shortest=3), C.Field("v", kind="number", low=0, outside="null", high=1e5)]
    good, dead = C.cleaned(df, fields)
    assert [tuple(r) for r in good.collect()] == [(1, "Ann", 1200.5)]
    assert sorted(r.reasons for r in dead.collect()) == [["missing:id"], ["short:name"], ["type:id", "short:name"]]
    good, dead = C.cleaned(df, [C.Field("id", redacted=True), C.Field("v", "value", "integer", low=0, high=1000, outside="drop")], others=True)
    assert sorted(tuple(r) for r in good.collect()) == [("[REDACTED]", 5, "Bo")] or good.columns == ["id", "value", "name"]
    assert dead.count() == 0


def test_mapping_edges(spark):
    df = spark.createDataFrame([(" ", "b", "7"), (None, None, "q")], "a string, b string, n string")
    t = [C.Target("x", ("gone", "a", "b"), required=True), C.Target("n", ("n",), "int", checks={"small": F.col("n") < 5})]
    assert [(r.x, r.n, r.errors) for r in C.mapped(df, t).collect()] == [("b", 7, ["check:n:small"]), (None, None, ["missing:x", "type:n"])]


def test_values_from_text(spark):
    df = spark.createDataFrame([('["a", " b "]', '{"k": "v"}', '{"a": [{"b": 3}]}'), ("x; ;y", "a=1;=2;b;a=3", "no"), (None, None, None)], "l string, m string, j string")
    got = df.select(X.listed(F.col("l"), ";"), X.pairs(F.col("m")), X.at_path(F.col("j"), "a.0.b"), X.camel(F.lit("one two_three"))).collect()
    assert [tuple(r)[:3] for r in got] == [(["a", "b"], {"k": "v"}, "3"), (["x", "y"], {"b": None, "a": "3"}, None), (None, None, None)]
    assert got[0][3] == "oneTwoThree"


def test_loaders(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "deep" / "b.json").write_text('{"id": 3, "name": "z"}\n{bad\n')
    (tmp_path / "note.md").write_text("hello\n")
    df = files.load_folder(spark, f"file://{tmp_path}", "id long, name string")
    rows = sorted((r.id or 0, r.name or "", r[files.BAD] or "", r._file.rsplit("/", 1)[1]) for r in df.collect())
    assert rows == [(0, "", "{bad", "b.json"), (1, "x", "", "a.csv"), (2, "y", "", "a.csv"), (3, "z", "", "b.json")]
    assert [r.value for r in files.load(spark, f"file://{tmp_path}/note.md").collect()] == ["hello"]
    assert files.load(spark, f"file://{tmp_path}/a.csv", "id long, name string").count() == 2
    for bad in ("x.exe", "x.csv"):
        with pytest.raises(ValueError):
            files.load(spark, bad)


def test_jdbc_round_trip(spark):
    url = "jdbc:derby:memory:lodestone;create=true"
    df = spark.range(100).selectExpr("id", "id * 2 AS twice")
    files.write_jdbc(df, url, "numbers", parts=2, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    back = files.read_jdbc(spark, url, "numbers", "ID", 0, 100, 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert back.rdd.getNumPartitions() == 4
    assert back.where("id >= 90").agg(F.sum("twice")).first()[0] == sum(2 * i for i in range(90, 100))
    assert [tuple(r) for r in files.as_messages(spark.sql("SELECT 1 AS a"), "a").collect()] == [("1", '{"a":1}')]
