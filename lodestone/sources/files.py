"""File sources and sinks: readers that split off bad rows, pushed-down filters, dead letters, upserts.

Readers declare a schema and never infer over the data twice. A bad row is kept
with its text and reason, so nothing is lost silently.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import all_of

BAD = "_corrupt_record"


def snake_names(df: DataFrame) -> DataFrame:
    """Column names in snake case; names that become equal get _2, _3, ..."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = "_".join(re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])", c)).lower() or "column"
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """The rows of CSV files; one that does not fit the schema keeps its text in ``_corrupt_record``."""
    return spark.read.csv(path, schema=f"{schema}, {BAD} string", sep=sep, header=header, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, enforceSchema=False)


def read_json(spark: SparkSession, path: str, schema: str, array_field: str | None = None, whole: bool = False) -> DataFrame:
    """Rows of JSON lines (or, with ``whole``, of one document a file); ``array_field``: a dotted path to an array of objects, one row each."""
    df = spark.read.json(path, schema=f"{schema}, {BAD} string", multiLine=whole, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD)
    return df if array_field is None else df.select(F.inline(F.col(array_field)))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """One row per element ``row_tag``; attributes are columns that begin with @."""
    return spark.read.format("xml").schema(schema).options(rowTag=row_tag, attributePrefix="@", ignoreNamespace=True).load(path)


#: Endings of file names and the reader's format.
ENDINGS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc", "txt": "text", "log": "text", "md": "text"}


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file by the ending of its name (``ENDINGS``); csv (with a header) and json need a schema, so that data are read once. Text has one row a line, ``value``."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in ENDINGS:
        raise ValueError(f"no reader for {path!r}")
    fmt = ENDINGS[ending]
    if fmt in ("csv", "json"):
        if schema is None:
            raise ValueError(f"{fmt} needs a schema")
        return (read_csv if fmt == "csv" else read_json)(spark, path, schema)
    return spark.read.format(fmt).load(path)


def load_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All csv, json, parquet and orc files at any depth of a folder as one table of the schema, ``_corrupt_record`` (texts that did not fit) and ``_file``.

    One scan for each format that occurs; other files are not read. Columns that a file lacks are null.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ending = F.lower(F.substring_index("path", ".", -1))
    found = {r[0] for r in every.select(ending).where(ending.isin(*ENDINGS)).distinct().collect()}  # a few endings
    kind = spark.createDataFrame([], schema).schema
    out = spark.createDataFrame([], f"{schema}, {BAD} string, _file string")
    for e in sorted(found):
        if ENDINGS[e] == "text":
            continue
        r = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{e}")
        if ENDINGS[e] in ("csv", "json"):
            r = r.schema(f"{schema}, {BAD} string").options(header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD)
        else:
            r = r.schema(kind)
        df = r.format(ENDINGS[e]).load(path)
        df = df if BAD in df.columns else df.withColumn(BAD, F.lit(None).cast("string"))
        out = out.unionByName(df.withColumn("_file", F.input_file_name()))
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, split: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table (or ``(query) alias``) of a database. With ``split`` (a number column) ``parts`` tasks read a range of it each; filters and columns are pushed down."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split:
        r = r.options(partitionColumn=split, lowerBound=low, upperBound=high, numPartitions=parts)
    return r.load()


def write_jdbc(df: DataFrame, url: str, table: str, parts: int = 8, mode: str = "append", **options: str) -> None:
    """Rows into a table of a database over at most ``parts`` connections."""
    df.coalesce(parts).write.format("jdbc").mode(mode).options(url=url, dbtable=table, **options).save()


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: str, stream: bool = True, **options: str) -> DataFrame:
    """JSON messages of a topic as columns of the schema with key, topic, partition, offset and timestamp. Needs Spark's Kafka package."""
    r = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options)
    value = F.from_json(F.col("value").cast("string"), schema).alias("v")
    return r.load().select(F.col("key").cast("string").alias("key"), "topic", "partition", "offset", "timestamp", value).select("*", "v.*").drop("v")


def as_messages(df: DataFrame, key: str) -> DataFrame:
    """Rows as key and JSON value, as Spark's Kafka sink takes them."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, filters: list[tuple] = ()) -> DataFrame:
    """Parquet with pruned columns and a conjunction of (field, operator, value) that reaches the scan."""
    df = spark.read.parquet(path)
    if filters:
        df = df.where(all_of(filters))
    return df.select(*columns) if columns else df


def split_bad(df: DataFrame, required: list[str] = (), rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters). A dead letter has ``reasons`` (corrupt, missing:<column>, rule:<name>) and the row as JSON ``payload``.

    A rule that is null counts as broken. The reasons are one expression over one scan.
    """
    checks = [F.when(F.col(BAD).isNotNull(), F.lit("corrupt"))] if BAD in df.columns else []
    checks += [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in required]
    checks += [F.when(~F.coalesce(r, F.lit(False)), F.lit(f"rule:{n}")) for n, r in (rules or {}).items()]
    reasons = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    marked = df.withColumn("_reasons", reasons)
    good = marked.where(F.size("_reasons") == 0).drop("_reasons", BAD)
    dead = marked.where(F.size("_reasons") > 0).select(F.col("_reasons").alias("reasons"), F.to_json(F.struct(*df.columns)).alias("payload"))
    return good, dead


def write(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] = (), mode: str = "append") -> None:
    """Files of one format (parquet, orc, csv with a header, json lines), partitioned by columns."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*by) if by else w).save(path)


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], action: str = "update", fields: list[str] | None = None, order: list[Column] = ()) -> DataFrame:
    """``table`` after the rows were put in: an equal key is updated (``fields``, by default all others) or left (action nothing).

    Of several rows with one key the last by ``order`` counts. One full join on
    the keys; a null key equals nothing, so such rows are inserted.
    """
    others = [c for c in table.columns if c not in keys]
    fields = others if fields is None else fields
    if order:
        packed = F.max_by(F.struct(*others), F.struct(*order)).alias("_new")
    else:
        packed = F.max(F.struct(*others)).alias("_new")
    null_key = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    new = rows.where(~null_key).groupBy(*keys).agg(packed)
    joined = table.withColumn("_old", F.lit(True)).join(new, keys, "full")
    taken = [F.when(F.col("_old").isNull() | (F.col("_new").isNotNull() & F.lit(action == "update" and c in fields)), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in others else F.col(c) for c in table.columns]
    return joined.select(*taken).unionByName(rows.where(null_key).select(*table.columns))


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """The rows that ``where`` holds for get the values; null counts as false."""
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) if c in table.columns else F.when(hit, v) for c, v in values.items()})


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def soft_delete(table: DataFrame, where: Column, actor: str, at: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({"is_deleted": hit, "deleted_at": F.when(hit, at), "deleted_by": F.when(hit, F.lit(actor))})


def flattened(df: DataFrame, sep: str = "_") -> DataFrame:
    """Structs at any depth as columns named by their path."""

    def leaves(schema, path):
        for f in schema.fields:
            at = [*path, f.name]
            yield from leaves(f.dataType, at) if f.dataType.typeName() == "struct" else [(at, sep.join(at))]

    return df.select(*(F.col(".".join(f"`{p}`" for p in at)).alias(name) for at, name in leaves(df.schema, [])))
