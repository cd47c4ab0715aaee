"""Lookups, membership checks and inexact joins. Sides are broadcast by Catalyst's own size estimate, never by a bare hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread


def enrich(df: DataFrame, ref: DataFrame, keys: list[str], fields: list[str], merge: str = "overwrite", missing: str = "keep", order: str | None = None) -> DataFrame:
    """df with ``fields`` of the first matching reference row (by ``order``, else by the fields themselves).

    merge: overwrite, keep_existing, fill_nulls, prefix or nest; missing: keep, mark (``matched``) or drop.
    """
    first = F.min_by(F.struct(*fields), F.col(order) if order else F.struct(*fields)).alias("_ref")
    one = ref.groupBy(*keys).agg(first)
    out = df.join(one, keys, "inner" if missing == "drop" else "left")
    have = set(df.columns)
    new: dict[str, Column] = {}
    for f in fields:
        r = F.col(f"_ref.{f}")
        if merge == "prefix":
            new[f"ref_{f}"] = r
        elif merge == "nest":
            continue
        elif f in have and merge == "keep_existing":
            continue
        elif f in have and merge == "fill_nulls":
            new[f] = F.coalesce(F.col(f), r)
        else:
            new[f] = F.when(F.col("_ref").isNotNull(), r).otherwise(F.col(f)) if f in have else r
    if merge == "nest":
        new["ref"] = F.col("_ref")
    if missing == "mark":
        new["matched"] = F.col("_ref").isNotNull()
    return out.withColumns(new).drop("_ref") if new else out.drop("_ref")


def orphans(df: DataFrame, ref: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows whose key is in no reference row; rows with a null in the key are no violation."""
    known = ref.select(*(F.col(r).alias(f"_k{i}") for i, r in enumerate(keys.values()))).distinct()
    cond = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    kept = df.dropna(subset=list(keys))
    return kept.join(known, cond, "left_anti")


def coverage(df: DataFrame, ref: DataFrame, key: str, ref_key: str) -> DataFrame:
    """n_ref, n_covered, coverage: the share of reference keys that occur."""
    used = df.select(F.col(key).alias("_k")).where("_k is not null").distinct().withColumn("_hit", F.lit(1))
    keys = ref.select(F.col(ref_key).alias("_k")).distinct()
    return keys.join(used, "_k", "left").agg(F.count("*").alias("n_ref"), F.count("_hit").alias("n_covered")).withColumn("coverage", F.try_divide(F.col("n_covered"), F.col("n_ref")))


def value_accuracy(df: DataFrame, ref: DataFrame, key: str, value: str, ref_value: str) -> DataFrame:
    """n, n_matching, accuracy: rows whose value equals (null-safely) the reference's for their key; keys without a reference count as wrong."""
    r = ref.select(F.col(key), F.col(ref_value).alias("_v"), F.lit(True).alias("_known"))
    same = F.coalesce(F.col("_known"), F.lit(False)) & F.col(value).eqNullSafe(F.col("_v"))
    return df.join(r, key, "left").agg(F.count("*").alias("n"), F.count_if(same).alias("n_matching")).withColumn("accuracy", F.try_divide(F.col("n_matching"), F.col("n")))


def asof(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, fields: list[str]) -> DataFrame:
    """left with ``fields`` of the latest right row of the same key at or before its time.

    Both sides are put in one stream per key and the last right row is carried
    forward: one shuffle and one sort, no pairs. Of right rows with one time the
    largest (by fields) counts.
    """
    cols = left.columns
    packed = F.struct(*(F.col(f) for f in fields))
    lhs = left.select(*by, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_row"), F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("_ref"))
    rhs = right.select(*by, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*cols).alias("r")).schema["r"].dataType).alias("_row"), packed.alias("_ref"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_ref").rowsBetween(Window.unboundedPreceding, 0)
    out = lhs.unionByName(rhs).withColumn("_ref", F.last("_ref", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_row.*", *(F.col(f"_ref.{f}").alias(f) for f in fields))


def fuzzy_matches(df: DataFrame, key: str, text: str, block: Column, threshold: float) -> DataFrame:
    """a, b, similarity (a < b): rows of one block whose texts are similar by Levenshtein ratio.

    Different texts of a block meet first, each pair once, and lengths are bounded before a
    distance is taken; then the rows of similar texts meet, so copies cost no distance.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), block.alias("block")).where("k IS NOT NULL AND t IS NOT NULL AND block IS NOT NULL")
    texts = cut(spread(rows.select("block", "t").distinct()), "texts")
    longest = F.greatest(F.length("ta"), F.length("tb"))
    close = F.abs(F.length("ta") - F.length("tb")) <= (1 - threshold) * longest
    sim = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein("ta", "tb") / longest)
    met = texts.withColumnRenamed("t", "ta").join(texts.withColumnRenamed("t", "tb"), "block").where((F.col("ta") <= F.col("tb")) & close)
    met = cut(met.select("block", "ta", "tb", sim.alias("similarity")).where(F.col("similarity") >= threshold), "similar-texts")
    both = met.unionByName(met.where("ta <> tb").select("block", F.col("tb").alias("ta"), F.col("ta").alias("tb"), "similarity"))
    x, y = rows.select(F.col("k").alias("a"), F.col("t").alias("ta"), "block"), rows.select(F.col("k").alias("b"), F.col("t").alias("tb"), "block")
    return spread(x.join(both, ["block", "ta"])).join(y, ["block", "tb"]).where("a < b").select("a", "b", "similarity")
