"""Cases that the tables do not hold."""

from pyspark.sql import functions as F

from lodestone.functions import predicates as P
from lodestone.functions import text as X
from lodestone.operators import aggregate as A
from lodestone.operators import graph as G
from lodestone.operators import joins as J
from lodestone.operators import quality as Q
from lodestone.operators import timeseries as T


def test_rule_tree_is_null_safe(spark):
    df = spark.createDataFrame([(1, None), (2, "abc"), (3, "xyz")], "id int, s string")
    assert [r.id for r in df.where(P.rule({"any": [{"field": "s", "op": "starts_with", "value": "a"}]})).collect()] == [2]
    assert sorted(r.id for r in df.where(P.rule({"not": {"field": "s", "op": "starts_with", "value": "a"}})).collect()) == [1, 3]
    assert df.where(P.condition("s", "in", [])).count() == 0 and df.where(P.condition("s", "not_in", [])).count() == 3


def test_aggregates_of_nothing(spark):
    df = spark.createDataFrame([("a", None, 0.0), ("a", None, 0.0), (None, 2.0, 1.0)], "g string, v double, w double")
    r = {x.g: x for x in A.aggregate(df, ["g"], [A.Agg("n", "count"), A.Agg("s", "sum", "v"), A.Agg("sd", "stddev", "v"), A.Agg("wa", "weighted_avg", "v", weight="w")]).collect()}
    assert (r["a"].n, r["a"].s, r["a"].sd, r["a"].wa) == (2, 0.0, 0.0, None)
    assert (r[None].s, r[None].sd, r[None].wa) == (2.0, 0.0, 2.0)


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert [(r.bin, r.n, r.share) for r in A.histogram(df, "v", 4).collect()] == [(0, 2, 1.0)]


def test_enrich_merges(spark):
    df = spark.createDataFrame([(1, "old"), (2, None), (3, "x")], "k int, v string")
    ref = spark.createDataFrame([(1, "new"), (2, "two"), (1, "newer")], "k int, v string")
    got = lambda **a: {r.k: r.v for r in J.enrich(df, ref, ["k"], ["v"], **a).collect()}
    assert got() == {1: "new", 2: "two", 3: "x"}
    assert got(merge="fill_nulls") == {1: "old", 2: "two", 3: "x"}
    assert got(missing="drop") == {1: "new", 2: "two"}


def test_session_gap_is_strict(spark):
    df = spark.createDataFrame([(1, 0), (1, 1800), (1, 3601)], "u int, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.session for r in T.sessions(df, "u", "ts", 1800, ["s"]).orderBy("s").collect()] == [1, 1, 2]


def test_text_functions(spark):
    row = spark.range(1).select(
        X.camel(F.lit("Valor_Total pago")).alias("camel"), X.kebab(F.lit("ÁreaTotal x")).alias("kebab"), X.boolean(F.lit(" Sim ")).alias("yes"), X.number(F.lit("1.234,5"), ",").alias("n"),
        X.mask_email(F.lit("joana@x.pt")).alias("mail"), X.mask_card(F.lit("4111 1111 1111 1111")).alias("card"), X.is_cpf(F.lit("529.982.247-25")).alias("cpf"), X.is_cpf(F.lit("111.111.111-11")).alias("alike"), X.timestamp(F.lit("1700000000000")).cast("string").alias("ms"),
    ).first()
    assert (row.camel, row.kebab, row.yes, row.n) == ("valorTotalPago", "area-total-x", True, 1234.5)
    assert (row.mail, row.card, row.cpf, row.alike, row.ms) == ("j***a@x.pt", "411111******1111", True, False, "2023-11-14 22:13:20")


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, "A "), (2, "a"), (3, None), (4, None)], "id int, s string")
    assert [(r.s, r.n) for r in Q.duplicates(df, {"s": F.lower(F.trim("s"))}).collect()] == [("a", 2)]
    assert [r.id for r in Q.deduplicate(df, [F.col("s")], ["id"]).orderBy("id").collect()] == [1, 2, 3]
    assert {r.rule: r.failed for r in Q.check(df, {"set": F.col("s") == "a"}).collect()} == {"set": 3}
    assert df.where(Q.missing(F.col("s"), "blank")).count() == 2


def test_graph_cycle(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 9.0), ("x", "y", 1.0), ("y", "x", 1.0), ("d", "d", 1.0)], "src string, dst string, w double")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.cost for r in G.shortest_paths(e, start).collect()} == {"a": 0.0, "b": 1.0, "c": 3.0}
    assert {r.node: r.distance for r in G.reach(e, start).collect()} == {"a": 0, "b": 1, "c": 1}
    assert {r.node: r.component for r in G.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "d": "d"}
    assert {r.node: r.level for r in G.topological_levels(e).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "d": None}
    assert abs(sum(r.rank for r in G.pagerank(e, rounds=5).collect()) - 1) < 1e-9
