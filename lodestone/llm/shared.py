"""Shared folder, size-checked broadcasts, connected components and blocked comparison of large groups, for the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows up to which a side is broadcast; beyond it the join is left to Catalyst.
BROADCAST_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a new temporary folder is set, but only on a local master: on a cluster other machines would not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables made by ``written`` that nothing reads any more."""
    for df in tables:
        files, jvm = df.inputFiles(), df.sparkSession.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in files}:
            if "/lodestone-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _width(df: DataFrame) -> tuple[int, list]:
    """Bytes of a row's fixed columns, and measures of the others."""
    fixed, parts = 0, []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            parts.append(F.octet_length(c))
        elif kind in ("array", "map", "struct"):
            parts.append(F.octet_length(F.to_json(F.struct(c))))
        fixed += 16
    return fixed, parts


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if its rows have at most BROADCAST_BYTES bytes, else unchanged. Pass a written table; ``rows`` is its count, if known."""
    fixed, parts = _width(df)
    if rows is None or parts:
        total = df.agg(F.count("*"), *(F.sum(p) for p in parts)).first()
        size = total[0] * fixed + sum(x or 0 for x in total[1:])
    else:
        size = rows * fixed
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component): the smallest id reachable over the undirected edges (a, b); ids without an edge are absent.

    Rounds of minimum-label spreading and pointer jumping, each round written to
    the shared folder (the round before is deleted); a round's join is on ids, its
    aggregation combines before the shuffle, so a node with very many edges stays in
    many tasks.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component"), F.lit(0).cast("long").alias("was")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        now = labels.select("id", "component")
        spread = both.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        nearer = now.join(spread, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = now.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = written(nearer.join(jump, "component", "left").select("id", F.least("component", F.coalesce("far", "component")).alias("component"), "was"), f"{name}-{turn}")
        forget(labels)
        labels = new
        if new.where("component <> was").isEmpty():
            forget(both)
            return new.select("id", "component")


def cross_blocks(leaves: DataFrame, columns: list[str], block: int) -> DataFrame:
    """Deals the leaves (key, comp, *columns) of each key to blocks (key, i, j): every two leaves of a key with different ``comp`` meet in one, on different sides.

    Side 0 has the leaves outside the key's largest component, side 1 all leaves; a key
    that is one component is dropped. So a group of which most leaves are linked already
    costs its leaves times the few others, and no block has many more than ``block``
    leaves of a side. Rows of one block are not brought together yet.
    """
    each = leaves.groupBy("key", "comp").agg(F.count("*").alias("c"))
    of_key = each.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("big"), F.sum("c").alias("m"), F.count("*").alias("comps")).where("comps > 1")
    of_key = written(of_key.select("key", F.col("big.comp").alias("big"), F.ceil(F.col("m") / block).cast("int").alias("nj"), F.ceil((F.col("m") - F.col("big.c")) / block).cast("int").alias("ni")), "blocks")
    placed = leaves.join(small(of_key), "key")
    at = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), *columns), F.col(n)).cast("int")
    left = placed.where("comp <> big").select("key", at("ni", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(0).alias("side"), "comp", *columns)
    right = placed.select("key", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), at("nj", 2).alias("j"), F.lit(1).alias("side"), "comp", *columns)
    return left.unionByName(right)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df partitioned and sorted by the keys, for work that costs more than its bytes tell: the session's number of shuffle partitions is kept."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)


def runs(batches, keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first ``keys`` columns, from sorted batches; a run may span batches."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(x).to_numpy() for x in range(keys)]
        new = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        cut = np.flatnonzero(new) + 1
        for s, e in zip(np.append(0, cut), np.append(cut, batch.num_rows), strict=True):
            here = tuple(c[s] for c in cols)
            if held and key != here:
                yield pa.Table.from_batches(held)
                held = []
            key = here
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)
