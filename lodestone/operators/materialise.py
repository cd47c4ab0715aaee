"""Features kept as tables: a history written chunk by chunk, the latest row of each entity beside it, and reads as of a time.

The history is partitioned by view, part (a hash of the entity) and chunk. A chunk is
written by overwriting just its partitions, and the latest rows of the parts that it
touches, in its old or its new form, are made again from the history: so a chunk written
twice changes nothing, and one that is corrected corrects the latest rows too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts that the entities of a view are dealt to.
PARTS = 16


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _stored(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A stored table; its partition columns keep the types they were written with."""
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(path)


def _overwrite(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _newest(rows: DataFrame, by: list[str], ts: str) -> DataFrame:
    """The row of each entity with the latest time, of equal times that of the last chunk, and of those the greatest."""
    others = [c for c in rows.columns if c not in (*by, ts, "view", "part", "chunk")]
    w = Window.partitionBy("view", "part", *by).orderBy(F.desc(ts), F.desc("chunk"), *(F.desc_nulls_last(c) for c in others))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_chunk(df: DataFrame, path: str, view: str, by: list[str], ts: str, chunk: str) -> None:
    """Stores the rows of df as one chunk of a view, in place of what the chunk was before. Rows without an entity or time are left out; an empty df empties the chunk."""
    spark = df.sparkSession
    history, latest = f"{path}/history", f"{path}/latest"
    kept = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, ts)))
    rows = kept.withColumns({"view": F.lit(view), "part": F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int"), "chunk": F.lit(chunk)})
    schema = rows.schema
    touched = {r.part for r in rows.select("part").distinct().collect()}  # bound: PARTS
    if _exists(spark, history):
        was = _stored(spark, history, schema).where((F.col("view") == view) & (F.col("chunk") == chunk))
        gone = {r.part for r in was.select("part").distinct().collect()} - touched  # bound: PARTS
        # parts that the chunk no longer reaches: their partition is deleted, as an overwrite with no rows leaves it alone
        jvm = spark.sparkContext._jvm
        for part in gone:
            p = jvm.org.apache.hadoop.fs.Path(f"{history}/view={view}/part={part}/chunk={chunk}")
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        touched |= gone
    _overwrite(rows.repartition("part"), history, ["view", "part", "chunk"])
    if not touched:
        return
    again = _stored(spark, history, schema).where((F.col("view") == view) & F.col("part").isin(*sorted(touched)))
    newest = _newest(again, by, ts)
    _overwrite(newest.repartition("part"), latest, ["view", "part"])
    left = {r.part for r in newest.select("part").distinct().collect()}  # bound: PARTS
    jvm = spark.sparkContext._jvm
    for part in touched - left:
        p = jvm.org.apache.hadoop.fs.Path(f"{latest}/view={view}/part={part}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def latest(spark: SparkSession, path: str, view: str) -> DataFrame:
    """The newest row of each entity."""
    return _stored(spark, f"{path}/latest").where(F.col("view") == view).drop("view", "part", "chunk")


def history(spark: SparkSession, path: str, view: str) -> DataFrame:
    """All rows of all chunks."""
    return _stored(spark, f"{path}/history").where(F.col("view") == view).drop("view", "part")


def as_of(spine: DataFrame, spark: SparkSession, path: str, view: str, by: list[str], ts: str, features: list[str], first: tuple[str, ...] = (), known: bool = False) -> DataFrame:
    """spine with the features that each entity had at the row's ``ts`` (the time itself included; null where it had none): the last one is carried forward in one sort of both.

    Of an entity's rows with one time the one of the last chunk counts, and of those the one
    that comes first by the stored columns ``first``. With ``known`` a feature's last value
    that is not null counts, else the values of the last row.
    """
    stored = history(spark, path, view)
    marks = {f: F.lit(None).cast(stored.schema[f].dataType) for f in features}
    ties = [f"_o{i}" for i in range(len(first))]
    left = spine.withColumns({**{f"_f_{f}": v for f, v in marks.items()}, "_side": F.lit(1), "_has": F.lit(False)})
    right = stored.select(*by, ts, *(F.col(f).alias(f"_f_{f}") for f in features), "chunk", *(F.col(c).alias(o) for c, o in zip(first, ties, strict=True)), F.lit(0).alias("_side"), F.lit(True).alias("_has"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.asc(ts), F.asc("_side"), F.asc_nulls_first("chunk"), *(F.desc_nulls_first(o) for o in ties)).rowsBetween(Window.unboundedPreceding, 0)
    if known:
        last = F.struct(*(F.last(f"_f_{f}", ignorenulls=True).over(w).alias(f"_f_{f}") for f in features))
    else:
        last = F.last(F.when(F.col("_has"), F.struct(*(f"_f_{f}" for f in features))), ignorenulls=True).over(w)
    out = both.withColumn("_row", last).where("_side = 1")
    return out.select(*spine.columns, *(F.col("_row")[f"_f_{f}"].alias(f) for f in features))


def validated(df: DataFrame, by: list[str], ts: str, ranges: dict[str, tuple[float | None, float | None]], required: tuple[str, ...] = ()) -> DataFrame:
    """feature, problem, n: rows with a missing entity or time, missing required features, values outside their range; those without any are absent."""
    checks = {(c, "missing"): F.col(c).isNull() for c in (*by, ts, *required)}
    for c, (low, high) in ranges.items():
        if low is not None:
            checks[(c, "below")] = F.col(c) < low
        if high is not None:
            checks[(c, "above")] = F.col(c) > high
    names = list(checks)
    counts = df.agg(*(F.count_if(checks[k]).alias(f"_c{i}") for i, k in enumerate(names)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(p).alias("problem"), F.col(f"_c{i}").alias("n")) for i, (c, p) in enumerate(names))))).where("n > 0")
