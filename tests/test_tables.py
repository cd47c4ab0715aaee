"""Vectors, personal data by column, inferred schemas and stored features, against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import inference as I
from lodestone.operators import materialise as Z
from lodestone.operators import privacy as P
from lodestone.operators import vectors as V


def vectors(spark, ids, rows):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids, rows)], "id long, v array<double>")


def unit(x):
    return x / np.sqrt((x**2).sum(1))[:, None]


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 12))[rng.integers(0, 40, 900)] + 0.25 * rng.standard_normal((900, 12))
    x[700:900] = x[700]  # many equal ones
    df = vectors(spark, range(900), x)
    cos = unit(x) @ unit(x).T
    got = {(r.query_id, r.id) for r in V.within(df, "id", "v", F.col("id") % 10 == 0, 0.9).collect()}
    assert got == {(i, j) for i in range(0, 900, 10) for j in range(900) if i != j and cos[i, j] >= 0.9}
    far = -np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = V.nearest(df, "id", "v", F.col("id") % 90 == 0, 7, "euclidean").collect()
    for q in range(0, 900, 90):
        rows = sorted((r.place, r.id, r.score) for r in near if r.query_id == q)
        want = sorted((j for j in range(900) if j != q), key=lambda j: (-round(far[q, j], 9), j))[:7]
        assert [r[0] for r in rows] == list(range(1, 8)) and np.allclose([r[2] for r in rows], far[q, want])
    pairs = {(r.a, r.b) for r in V.near_pairs(df, "id", "v", 0.9).collect()}
    of = {r.id: r.class_id for r in V.same_vectors(df, "id", "v").collect()}
    assert all(of[i] == 700 for i in range(700, 900)) and len(of) == 900
    real = {(i, j) for i in range(701) for j in range(i + 1, 701) if cos[i, j] >= 0.9}
    assert pairs <= real and len(pairs) >= 0.9 * len(real) > 100


def test_odd_vectors_take_no_part(spark):
    df = vectors(spark, range(8), [[1, 0], [0, 0], None, [], [float("nan"), 1], [float("inf"), 1], [1, 2, 3], [1, 0.1]])
    assert {(r.query_id, r.id) for r in V.within(df, "id", "v", F.lit(True), -2).collect()} == {(0, 7), (7, 0)}
    assert V.nearest(df.limit(0), "id", "v", F.lit(True), 3).count() == V.near_pairs(df.limit(0), "id", "v", 0.5).count() == 0
    with pytest.raises(ValueError):
        V.within(df, "id", "v", F.lit(True), 0, "other")


def test_personal_columns(spark):
    rows = [("a@b.com", "529.982.247-25", "Ann", 1, "write to ann@b.com or card 4111 1111 1111 1111 please"), ("x", "111.111.111-11", None, 2, "short"), (None, "11.222.333/0001-81", "Bo", 3, ""), ("c@d.org", None, "", 4, "a text of some length without anything")]
    df = spark.createDataFrame(rows, "contact string, papers string, full_name string, shipment int, note string")
    got = {(r.column, r.type, r.where): (r.hits, r.non_null, r.severity, r.action) for r in P.findings(df).collect()}
    assert got == {
        ("contact", "EMAIL", "value"): (2, 3, "MEDIUM", "MASK"), ("papers", "CPF", "value"): (2, 3, "HIGH", "MASK"), ("papers", "CNPJ", "value"): (1, 3, "HIGH", "MASK"), ("full_name", "PERSON_NAME", "value"): (3, 3, "MEDIUM", "WARN"),
        ("shipment", "IP_ADDRESS", "value"): (4, 4, "LOW", "WARN"), ("note", "EMAIL", "text"): (1, 4, "HIGH", "MASK"), ("note", "CREDIT_CARD", "text"): (1, 4, "CRITICAL", "BLOCK"), ("note", "CREDIT_CARD", "value"): (1, 4, "CRITICAL", "BLOCK"),
    }
    risk = {r.column: r for r in P.columns_at_risk(P.findings(df)).collect()}
    assert risk["papers"].types == "CNPJ,CPF" and risk["papers"].severity == "HIGH" and math.isclose(risk["papers"].risk, min(100, (3 * 45 + 2.5) / 3**0.5)) and risk["note"].action == "BLOCK"
    whole = P.table_risk(P.findings(df)).first()
    assert whole.findings == 15 and whole.columns == 5 and whole.status == "NON_COMPLIANT"
    clean = P.findings(df.select(F.lit(1).alias("k")))
    assert clean.count() == 0 and P.table_risk(clean).first().status == "COMPLIANT" and P.findings(df.limit(0)).count() == 0


def test_classes_and_entropy(spark):
    rng = random.Random(1)
    texts = ["", "a", "aab", "0123456789abcdef", "é日本é", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [None if t is None else -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) + 0.0 for t in texts]
    assert [r.e for r in df.select(P.text_entropy(F.col("t")).alias("e")).collect()] == pytest.approx(want)
    keys = spark.createDataFrame([("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(60)), "x@y.com", "word", "plain words that are long enough for this") for _ in range(20)], "a string, b string, c string, d string")
    assert {r.column: (r.label, r.types) for r in P.classified(keys).collect()} == {"a": ("confidential", ""), "b": ("internal", "EMAIL"), "c": ("public", ""), "d": ("public", "")}


def plain_type(values):
    import re

    kinds = set()
    for v in values:
        v = (v or "").strip()
        if v.lower() in I.NULLS:
            continue
        kinds.add("boolean" if v.lower() in ("true", "false") else "integer" if re.fullmatch(r"[+-]?\d{1,18}", v) else "decimal" if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d{19,})", v) else "date" if re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])", v)
                  else "timestamp" if re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[T ][0-2]\d:[0-5]\d(:[0-5]\d(\.\d{1,9})?)?Z?", v) else "string")
    if not kinds:
        return "unknown"
    if len(kinds) == 1:
        return kinds.pop()
    return "decimal" if kinds == {"integer", "decimal"} else "timestamp" if kinds == {"date", "timestamp"} else "string"


def test_inferred_types_are_those_of_a_plain_loop(spark):
    rng = random.Random(2)
    pool = ["1", " 2 ", "-30", "4.50", ".5", "9" * 25, "TRUE", "false", "2024-02-30", "2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02 03:04", "", "NULL", "n/a", None, "x", "1e5", "2024-13-01"]
    columns = {f"c{k}": [rng.choice(rng.sample(pool, rng.randint(1, 3))) for _ in range(6)] for k in range(60)}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} string" for c in columns))
    got = {r.column: r for r in I.inferred(df).collect()}
    for c, values in columns.items():
        nulls = sum((v or "").strip().lower() in I.NULLS for v in values)
        assert (got[c].type, got[c].nulls, got[c].nullable, got[c].non_null) == (plain_type(values), nulls, nulls > 0, 6 - nulls), (c, values)
    small = spark.createDataFrame([("007.500", "1", "x"), ("-12.25", None, "NULL"), ("3", "+4", "y")], "d string, i string, s string")
    found = I.inferred(small)
    assert [(r.precision, r.scale) for r in found.orderBy("position").collect()] == [(4, 2), (1, 0), (None, None)]
    assert [tuple(map(str, r)) for r in I.typed(small, I.as_schema(found)).collect()] == [("7.50", "1", "x"), ("-12.25", "None", "None"), ("3.00", "4", "y")]
    assert I.inferred(small.limit(0)).count() == 0


def test_chunks_written_twice_change_nothing(spark, tmp_path):
    at = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "who string, ts timestamp, x double")
    t = lambda d: f"2024-01-{d:02}"
    mk = lambda *r: rows(*((w, None, x) for w, _, x in r)).withColumn("ts", F.lit(None).cast("timestamp")) if not r else spark.createDataFrame([(w, d, x) for w, d, x in r], "who string, d string, x double").select("who", F.to_timestamp("d").alias("ts"), "x")
    first, second = mk(("a", t(1), 1.0), ("b", t(2), 2.0), (None, t(2), 9.0), ("c", None, 9.0)), mk(("a", t(5), 5.0), ("d", t(1), 4.0))
    see = lambda: sorted((r.who, r.x) for r in Z.latest(spark, at, "v").collect())
    Z.write_chunk(first, at, "v", ["who"], "ts", "1")
    Z.write_chunk(second, at, "v", ["who"], "ts", "2")
    assert see() == [("a", 5.0), ("b", 2.0), ("d", 4.0)]
    for _ in range(2):
        Z.write_chunk(second, at, "v", ["who"], "ts", "2")
        Z.write_chunk(first, at, "v", ["who"], "ts", "1")
        assert see() == [("a", 5.0), ("b", 2.0), ("d", 4.0)] and Z.history(spark, at, "v").count() == 4
    Z.write_chunk(mk(("a", t(5), 6.0)), at, "v", ["who"], "ts", "2")  # corrected: d was a mistake
    assert see() == [("a", 6.0), ("b", 2.0)]
    Z.write_chunk(mk(("z", t(1), 0.0)), at, "other", ["who"], "ts", "1")
    assert see() == [("a", 6.0), ("b", 2.0)]
    spine = mk(("a", t(1), 0.0), ("a", t(4), 0.0), ("a", t(9), 0.0), ("b", t(1), 0.0), ("q", t(9), 0.0)).drop("x")
    got = sorted(((r.who, r.ts.day, r.x) for r in Z.as_of(spine, spark, at, "v", ["who"], "ts", ["x"]).collect()), key=str)
    assert got == [("a", 1, 1.0), ("a", 4, 1.0), ("a", 9, 6.0), ("b", 1, None), ("q", 9, None)]
    Z.write_chunk(second.limit(0), at, "v", ["who"], "ts", "2")
    assert see() == [("a", 1.0), ("b", 2.0)]
    assert {(r.feature, r.problem, r.n) for r in Z.validated(first, ["who"], "ts", {"x": (1.5, 8.0)}).collect()} == {("who", "missing", 1), ("ts", "missing", 1), ("x", "below", 1), ("x", "above", 2)}
