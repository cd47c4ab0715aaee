"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's mean repetition rate is its target share of the output over its rows.
Each document inverts the Poisson distribution of that mean at a hash of its id
and the seed, is repeated that often (possibly never), and the copies are dealt
out and ordered by a hash of their own: a global random order.

A mean above PART is the sum of equal parts, each with a hash of its own, so the
inverted table stays short for any rate.

Defined cases: null source is a source of its own; a source without a target (or
with weight 0 or null) gets no copies when targets are given; null doc_id is
hashed by the text's hash instead; rows that repeat an id repeat alike; null and
empty texts count as any other row; an empty table gives no rows; the columns
``copy`` and ``shuffle_key`` of the input, if any, are replaced (work columns start
with ``_mix_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small, written

#: The largest mean inverted at once, and the terms of its distribution (beyond them less than 1e-15 is left).
PART, TERMS = 4.0, 36


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of the parts joined by a colon."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson(mean: Column, u: Column) -> Column:
    """The smallest k whose cumulative probability exceeds u, for a mean up to PART."""
    zero = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))

    def step(s, k):
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), (s["n"] + (u >= s["c"]).cast("int")).alias("n"))

    return F.aggregate(F.array(*(F.lit(float(k)) for k in range(1, TERMS + 1))), zero, step, lambda s: s["n"])


def rates(docs: DataFrame, targets: dict[str, float] | None = None, power: float = 0.5, size: float = 1.0, source: str = "source") -> DataFrame:
    """source and its mean rate. The targets are weights, in proportion; without them a source's weight is its number of rows to the ``power``. ``size``: rows out for each row in, in the mean."""
    counts = written(docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n")), "mix-counts")
    if targets is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "_mix_of string, w double")
        weighed = counts.join(small(given, len(targets)), F.col("source").eqNullSafe(F.col("_mix_of")), "left").select("source", "n", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w"))
    total = weighed.agg(F.sum("w"), F.sum("n")).first()
    return weighed.select("source", (F.lit(float(size)) * F.col("w") / F.lit(float(total[0] or 1)) * F.lit(float(total[1] or 0)) / F.col("n")).alias("rate"))


def replicate(docs: DataFrame, targets: dict[str, float] | None = None, power: float = 0.5, size: float = 1.0, seed: int = 0) -> DataFrame:
    """The copies of docs in a global random order, with ``copy`` (1, 2, ...) and ``shuffle_key``."""
    docs = docs.drop("copy", "shuffle_key")
    cols = docs.columns
    rate = written(rates(docs, targets, power, size), "mix-rates")
    table = small(rate.select(F.col("source").alias("_mix_of"), F.col("rate").alias("_mix_rate")), rate.count())
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5("text")), F.lit("null"))
    parts = F.ceil(F.col("_mix_rate") / F.lit(PART))
    # the sum over the parts; most means have one
    count = F.aggregate(F.sequence(F.lit(1).cast("long"), parts), F.lit(0), lambda a, k: a + poisson(F.col("_mix_rate") / parts, unit_hash(F.lit(seed), ident, k)))
    many = docs.join(table, F.col("source").eqNullSafe(F.col("_mix_of"))).withColumn("_mix_n", F.when(F.col("_mix_rate") > 0, count).otherwise(0)).where("_mix_n > 0")
    copies = many.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), ident, F.col("copy").cast("string"))))
    return copies.select(*cols, "copy", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mixing_sql(power: float = 0.5, seed: int = 0) -> str:
    """The same rows over ``documents`` in plain SQL, for means of any size."""
    return f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
     rate AS (SELECT source, n, pow(n, {power}) / (SELECT sum(pow(n, {power})) FROM counts) * (SELECT sum(n) FROM counts) / n AS r FROM counts),
     part AS (SELECT source, ceil(r / {PART})::BIGINT AS parts, r / ceil(r / {PART}) AS m FROM rate),
     pmf AS (SELECT source, k, exp(k * ln(m) - m - lgamma(k + 1)) AS p FROM part, range(0, {TERMS}) AS t(k)),
     cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
     draw AS (SELECT d.doc_id, d.source, x.i, ('0x' || substr(md5('{seed}:' || d.doc_id || ':' || x.i), 1, 13))::BIGINT / pow(2, 52) AS u
              FROM documents d JOIN part p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.parts + 1)) AS i) x),
     number AS (SELECT w.doc_id, sum((SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM w.source AND w.u >= c.c)) AS n FROM draw w GROUP BY w.doc_id)
SELECT d.*, c.copy::INTEGER AS copy, md5('{seed}:order:' || d.doc_id || ':' || c.copy) AS shuffle_key
FROM documents d JOIN number USING (doc_id), LATERAL (SELECT unnest(range(1, n::BIGINT + 1)) AS copy) c
"""
