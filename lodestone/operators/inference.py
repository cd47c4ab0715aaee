"""Schemas of text tables: each value's kind is a bit, a column's type the least one above all its bits, in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, LongType, StringType, StructField, StructType, TimestampType

#: Texts that stand for null (lower-cased), and the patterns of kinds; the first that fits counts, and what fits none is a string.
NULLS = ("", "null", "none", "na", "n/a", "nan", "-")
KINDS = {
    "boolean": r"^(?i:true|false)$", "integer": r"^[+-]?[0-9]{1,18}$", "decimal": r"^[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]{19,})$",
    "date": r"^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$", "timestamp": r"^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])[T ][0-2][0-9]:[0-5][0-9](?::[0-5][0-9](?:\.[0-9]{1,9})?)?Z?$",
}
BIT = {name: 1 << i for i, name in enumerate([*KINDS, "string"])}
#: The lattice: the type of each set of kinds, from the least; every other set is string.
ABOVE = {frozenset(): "unknown", **{frozenset([k]): k for k in KINDS}, frozenset(["integer", "decimal"]): "decimal", frozenset(["date", "timestamp"]): "timestamp"}


def kind_bit(text: Column) -> Column:
    """The bit of a trimmed text's kind, 0 for what stands for null."""
    out = F.lit(BIT["string"])
    for name, pattern in reversed(KINDS.items()):
        out = F.when(text.rlike(pattern), BIT[name]).otherwise(out)
    return F.when(text.isNull() | F.lower(text).isin(*NULLS), 0).otherwise(out)


def joined(bits: Column) -> Column:
    """The least type above a set of kinds."""
    out = F.lit("string")
    for kinds, name in ABOVE.items():
        out = F.when(bits == sum(BIT[k] for k in kinds), name).otherwise(out)
    return out


def inferred(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, position, type, nullable, nulls, non_null, max_length, precision, scale: what the values of text columns are.

    Types: boolean, integer, decimal, date, timestamp, string, unknown (nothing but
    nulls). precision and scale are those of a decimal that holds every number of the
    column (trailing zeros of fractions do not count). Other columns are read as their text.
    """
    columns = columns or df.columns
    value = F.trim(F.col("value"))
    cell = df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)))))
    number = F.col("bit").isin(BIT["integer"], BIT["decimal"])
    whole = F.length(F.regexp_replace(F.regexp_extract("value", r"^[+-]?([0-9]*)", 1), "^0+(?=[0-9])", ""))
    fraction = F.length(F.regexp_replace(F.regexp_extract("value", r"\.([0-9]*)$", 1), "0+$", ""))
    cell = cell.select("position", "column", value.alias("value"), kind_bit(value).alias("bit"))
    found = cell.groupBy("position", "column").agg(
        F.bit_or("bit").alias("bits"), F.count_if(F.col("bit") == 0).alias("nulls"), F.count_if(F.col("bit") > 0).alias("non_null"), F.max(F.when(F.col("bit") > 0, F.length("value"))).alias("max_length"),
        F.max(F.when(number, whole)).alias("whole"), F.max(F.when(number, fraction)).alias("scale"),
    )
    kind = joined(F.col("bits"))
    numeric = kind.isin("integer", "decimal")
    precision = F.greatest(F.lit(1), F.col("whole") + F.col("scale"))
    return found.select("column", "position", kind.alias("type"), (F.col("nulls") > 0).alias("nullable"), "nulls", "non_null", "max_length", F.when(numeric, precision).alias("precision"), F.when(numeric, F.col("scale")).alias("scale"))


def as_schema(found: DataFrame) -> StructType:
    """The Spark schema of ``inferred`` rows; numbers of more than 38 digits and unknown columns are strings. Reads one row for each column."""
    plain = {"boolean": BooleanType(), "integer": LongType(), "date": DateType(), "timestamp": TimestampType()}
    fields = []
    for r in found.orderBy("position").collect():
        kind = DecimalType(r.precision, r.scale) if r.type == "decimal" and r.precision <= 38 else plain.get(r.type, StringType())
        fields.append(StructField(r.column, kind, r.nullable))
    return StructType(fields)


def typed(df: DataFrame, schema: StructType) -> DataFrame:
    """The text columns cast to a schema that was inferred; what stands for null is null, and what does not fit is null as well."""
    def cast(f: StructField) -> Column:
        text = F.trim(F.col(f"`{f.name}`").cast("string"))
        return F.when(~F.lower(text).isin(*NULLS), text if isinstance(f.dataType, StringType) else text.try_cast(f.dataType)).alias(f.name)

    return df.select(*(cast(f) for f in schema.fields))
