"""Sources, sinks, streams, governance, search and forecasts on small frames."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators import forecast as P
from lodestone.operators import governance as V
from lodestone.operators import search as S
from lodestone.sources import files
from lodestone.streaming import windows as W


def test_csv_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2.5\nx,3\n3,\n4,-1\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), "id int, v double").cache()
    good, dead = files.split_bad(df, ["v"], {"positive": F.col("v") > 0})
    assert [tuple(r) for r in good.collect()] == [(1, 2.5)]
    assert sorted(r.reasons[0] for r in dead.collect()) == ["corrupt", "missing:v", "rule:positive"]


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n[nonsense\n{"id": 2}\n')
    good, dead = files.split_bad(files.read_json(spark, str(tmp_path / "a.jsonl"), "id int").cache())
    assert sorted(r.id for r in good.collect()) == [1, 2] and dead.count() == 1
    (tmp_path / "b.json").write_text('{"data": {"rows": [{"id": 7}, {"id": 8}]}}')
    got = files.read_json(spark, str(tmp_path / "b.json"), "data struct<rows: array<struct<id: int>>>", "data.rows", whole=True)
    assert sorted(r.id for r in got.collect()) == [7, 8]
    (tmp_path / "c.xml").write_text('<r><x k="1"><n>a</n></x><x k="2"/></r>')
    rows = files.read_xml(spark, str(tmp_path / "c.xml"), "x", "`@k` int, n string").orderBy("@k").collect()
    assert [tuple(r) for r in rows] == [(1, "a"), (2, None)]


def test_parquet_filters_reach_the_scan(spark, sf_dir):
    df = files.read_parquet(spark, f"{sf_dir}/orders.parquet", ["o_orderkey"], [("o_totalprice", "gt", 1000.0)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_orderdate" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("action,want", [("update", [(1, "a", 9), (2, "b", 2), (3, "n", 3), (None, "q", 5)]), ("nothing", [(1, "a", 1), (2, "b", 2), (3, "n", 3), (None, "q", 5)])])
def test_upsert(spark, action, want):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, v int")
    new = spark.createDataFrame([(1, "z", 8), (1, "y", 9), (3, "n", 3), (None, "q", 5)], "id int, s string, v int")
    got = files.upsert(old, new, ["id"], action, fields=["v"], order=[F.col("v")])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_names_and_flatten(spark):
    assert files.snake_names(spark.range(1).selectExpr("1 AS OrderKey", "2 AS `order key`", "3 AS `?`")).columns == ["order_key", "order_key_2", "column"]
    df = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.struct(F.lit(2).alias("c")).alias("b")).alias("s"), "id")
    assert files.flattened(df).first().asDict() == {"s_a": 1, "s_b_c": 2, "id": 0}


def test_upserting_stream_goes_on(spark, tmp_path):
    src, at, kind = tmp_path / "in", str(tmp_path / "table"), "id int, v int"
    for turn, rows in enumerate([[(1, 1), (2, 1)], [(2, 5), (2, 4), (3, 7)]]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(str(src))
        W.upsert_available(spark.readStream.schema(kind).parquet(str(src)), spark, at, str(tmp_path / "cp"), ["id"], ["v"])
        got = sorted(map(tuple, spark.read.parquet(f"{at}/v{turn}").collect()))
    assert got == [(1, 1), (2, 5), (3, 7)]


def test_hmac_is_the_plain_one(spark):
    for key in (b"k", b"x" * 100):
        for r in spark.createDataFrame([("",), ("olá",), ("a" * 500,)], "m string").select("m", V.hmac_sha256(F.col("m"), key).alias("t")).collect():
            assert r.t == hmac.new(key, r.m.encode(), hashlib.sha256).hexdigest()


def test_schema_drift():
    a, b = StructType.fromDDL("x int, y string, z date, w bigint"), StructType.fromDDL("y string, x bigint, w int, v int")
    assert V.schema_drift(a, b) == [("v", "added", False), ("w", "narrowed", True), ("x", "moved", False), ("x", "widened", False), ("y", "moved", False), ("z", "removed", True)]
    assert V.schema_drift(a, a) == []


def test_forecasts_against_plain_loops(spark):
    xs = [3.0, 5.0, 4.0, 8.0, 9.0]
    df = spark.createDataFrame([("a", xs), ("b", [2.0]), ("c", [])], "k string, xs array<double>")
    for model, weights in (("moving", [1, 1, 1]), ("weighted", [1, 2, 3])):
        want = list(xs)
        for _ in range(4):
            want.append(sum(a * w for a, w in zip(want[-3:], weights)) / sum(weights))
        got = {(r.k, r.step): r.value for r in P.forecast(df, ["k"], model, 4).collect()}
        assert [got["a", h] for h in range(1, 5)] == pytest.approx(want[-4:]) and got["b", 4] == 2.0 and len(got) == 8
    for model in ("naive", "seasonal", "smoothed", "trend"):
        got = [r.value for r in P.forecast(df, ["k"], model, 2, season=4).where("k = 'b'").collect()]
        assert got == [2.0, 2.0]
    assert [r.value for r in P.forecast(df, ["k"], "seasonal", 5, season=4).where("k = 'a'").orderBy("step").collect()] == [5.0, 4.0, 8.0, 9.0, 5.0]


def test_loan_ends_at_zero(spark):
    rows = P.schedule(spark.createDataFrame([(1, 1200.0)], "id int, p double"), "id", "p", 0.0, 12).orderBy("period").collect()
    assert [round(r.balance, 6) for r in rows][-2:] == [100.0, 0.0] and sum(r.repaid for r in rows) == pytest.approx(1200)


def test_chunks_cover_the_text(spark):
    df = spark.createDataFrame([(1, "x" * 100 + "é" * 23), (2, ""), (3, None), (4, "short")], "id int, t string")
    got = {}
    for r in S.chunks(df, "id", "t", 50, 10).orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append(r.content)
    assert set(got) == {1, 4} and got[4] == ["short"]
    assert got[1][0] + "".join(c[10:] for c in got[1][1:]) == "x" * 100 + "é" * 23
    parts = S.paragraphs(spark.createDataFrame([(1, " a\nb\n \n\nc ")], "id int, t string"), "id", "t").collect()
    assert [p.content for p in parts] == ["a\nb", "c"]
