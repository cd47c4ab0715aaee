"""Personal data by column: every column against every rule in one scan, merged to a risk for each column and for the table.

A rule speaks of a column by its name (then every value counts) or of a value by its
pattern or checksum; long texts are searched for what is embedded in them. All rows
count. Nothing here rewrites a value; ``governance`` masks and tokenises.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_cnpj, is_cpf, is_luhn


@dataclass(frozen=True)
class Rule:
    """A type of personal data: its severity and action, what column names and whole values it fits, and a checksum (by name) that is enough as well."""

    type: str
    severity: str
    action: str
    columns: tuple[str, ...]
    value: str | None = None
    check: str | None = None


_IP = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$|^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"
#: Types with their severities, actions and patterns (of lower-cased column names, and of trimmed values).
RULES = (
    Rule("CPF", "HIGH", "MASK", (r"\bcpf\b", "documento_cpf", "taxpayer"), r"^\d{3}\.?\d{3}\.?\d{3}-?\d{2}$", "cpf"),
    Rule("CNPJ", "HIGH", "MASK", (r"\bcnpj\b", "company_document", "documento_empresa"), r"^\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}$", "cnpj"),
    Rule("EMAIL", "MEDIUM", "MASK", ("email", "e_mail", "mail_address"), r"(?i)^[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}$"),
    Rule("PHONE", "MEDIUM", "MASK", ("phone", "telefone", "celular", "whatsapp", "mobile"), r"^\+?\d{0,3}\s?\(?\d{2,3}\)?\s?\d{4,5}[-\s]?\d{4}$"),
    Rule("CREDIT_CARD", "CRITICAL", "BLOCK", ("credit_card", "card_number", "cartao", "pan"), r"^(?:\d[ -]*?){13,19}$", "luhn"),
    Rule("IP_ADDRESS", "LOW", "WARN", ("ip", "remote_addr"), _IP),
    Rule("CEP", "LOW", "WARN", (r"\bcep\b", "postal", "zipcode", "zip_code"), r"^\d{5}-?\d{3}$"),
    Rule("PERSON_NAME", "MEDIUM", "WARN", ("nome", "name")),
    Rule("ADDRESS", "MEDIUM", "WARN", ("address", "endereco", "logradouro", "street", "bairro")),
    Rule("BIRTH_DATE", "MEDIUM", "WARN", ("birth", "nascimento", "dob")),
    Rule("UUID", "LOW", "WARN", ("uuid", "guid", "external_id"), r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"),
    Rule("PASSWORD", "CRITICAL", "BLOCK", ("password", "passwd", "senha", "pwd")),
    Rule("API_KEY", "CRITICAL", "BLOCK", ("api_key", "apikey", "secret_key", "access_key", "private_key"), r"(?i)^(sk|pk|api|key|secret)[-_]?[a-z0-9]{16,}$"),
    Rule("TOKEN", "CRITICAL", "BLOCK", ("token", "bearer", "jwt"), r"^[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{10,}$"),
    Rule("GENERIC_DOCUMENT", "HIGH", "MASK", ("document", "documento", "rg", "passport", "passaporte")),
)
#: What is searched in texts of at least EMBEDDED characters; these findings are HIGH at least.
SEARCHED = {"EMAIL": r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "CPF": r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", "CNPJ": r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b", "CREDIT_CARD": r"\b(?:\d[ -]*?){13,19}\b"}
EMBEDDED = 20
#: Points of a finding by severity and action, and more for blocked types.
SEVERITIES = {"LOW": 5.0, "MEDIUM": 15.0, "HIGH": 35.0, "CRITICAL": 60.0}
ACTIONS = {"ALLOW": 0.0, "WARN": 5.0, "MASK": 10.0, "HASH": 10.0, "TOKENIZE": 15.0, "BLOCK": 30.0, "QUARANTINE": 40.0}
BLOCKED = ("CREDIT_CARD", "PASSWORD", "API_KEY", "TOKEN")
BLOCKED_POINTS = 15.0

_CHECKS = {"cpf": is_cpf, "cnpj": is_cnpj, "luhn": is_luhn}


def named(column: str, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """The rules that a column's name alone is a finding of."""
    return [r for r in rules if any(re.search(p, column.strip().lower()) for p in r.columns)]


def fits(c: Column, rule: Rule) -> Column:
    """Whether a text is, as a whole, what the rule looks for."""
    text = F.trim(c)
    out = text.rlike(rule.value) if rule.value else F.lit(False)
    return F.coalesce((out | _CHECKS[rule.check](text) if rule.check else out) & (text != ""), F.lit(False))


def findings(df: DataFrame, columns: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """column, type, where (value or text), severity, action, hits, non_null: one row for each rule that anything in a column fits.

    The columns are unpivoted, so each rule is written out once however many there are;
    the counts are combined before the shuffle, which has a row for each column and task.
    """
    columns = columns or df.columns
    by_type = {r.type: r for r in rules}
    texts = [c for c in columns if df.schema[c].dataType.typeName() == "string"]
    value = F.col("value")
    known = {r.type: [c for c in columns if r in named(c, rules)] for r in rules}
    tried = [r for r in rules if r.value or r.check]
    searched = [(t, p) for t, p in SEARCHED.items() if t in by_type]
    cell = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns)))).where(value.isNotNull())
    counts = [F.count("*").alias("non_null"), *(F.count_if(fits(value, r)).alias(f"_v{i}") for i, r in enumerate(tried))]
    counts += [F.count_if((F.length(value) >= EMBEDDED) & value.rlike(p)).alias(f"_t{i}") for i, (_, p) in enumerate(searched)]
    rows = []
    for r in rules:
        own = F.col(f"_v{tried.index(r)}") if r in tried else F.lit(0).cast("long")
        rows.append((r.type, "value", r.severity, F.when(F.col("column").isin(*known[r.type]), F.col("non_null")).otherwise(own) if known[r.type] else own))
    for i, (t, _) in enumerate(searched):
        rows.append((t, "text", max(by_type[t].severity, "HIGH", key=list(SEVERITIES).index), F.when(F.col("column").isin(*texts), F.col(f"_t{i}")).otherwise(0)))
    each = [F.struct(F.lit(t).alias("type"), F.lit(w).alias("where"), F.lit(s).alias("severity"), F.lit("BLOCK" if t in BLOCKED else by_type[t].action).alias("action"), n.alias("hits")) for t, w, s, n in rows]
    found = cell.groupBy("column").agg(*counts).select("column", F.inline(F.array(*each)), "non_null")
    return found.where("hits > 0").select("column", "type", "where", "severity", "action", "hits", "non_null")


def _points(c: Column, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _highest(c: Column, table: dict[str, float]) -> Column:
    return F.max_by(c, F.array_position(F.array(*map(F.lit, table)), c))


def columns_at_risk(found: DataFrame) -> DataFrame:
    """column, detected, ratio (findings for each value, of all rules together), types, severity, action, risk (0 to 100): what ``findings`` says of each column."""
    points = F.col("hits") * (_points(F.col("severity"), SEVERITIES) + _points(F.col("action"), ACTIONS) + F.when(F.col("type").isin(*BLOCKED), BLOCKED_POINTS).otherwise(0.0))
    n = F.sum("hits")
    return found.groupBy("column").agg(
        n.alias("detected"), (n / F.greatest(F.max("non_null"), F.lit(1))).alias("ratio"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), _highest(F.col("severity"), SEVERITIES).alias("severity"), _highest(F.col("action"), ACTIONS).alias("action"),
        F.least(F.lit(100.0), (F.sum(points) + 2.5) / F.sqrt(n)).alias("risk"),
    )


def table_risk(found: DataFrame) -> DataFrame:
    """findings, columns, risk, status (COMPLIANT, WARNING or NON_COMPLIANT) of the whole table, in one row."""
    points = F.col("hits") * (_points(F.col("severity"), SEVERITIES) + _points(F.col("action"), ACTIONS) + F.when(F.col("type").isin(*BLOCKED), BLOCKED_POINTS).otherwise(0.0))
    bad = F.col("action").isin("BLOCK", "QUARANTINE") | F.col("severity").isin("HIGH", "CRITICAL")
    of_column = found.groupBy("column").agg(F.sum("hits").alias("n"), F.sum(points).alias("p"), F.max(bad).alias("bad"))
    n, columns = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    risk = F.when(n > 0, F.least(F.lit(100.0), (F.sum("p") + F.least(F.lit(25.0), columns * 2.5)) / F.sqrt(n))).otherwise(0.0)
    return of_column.agg(n.alias("findings"), columns.alias("columns"), risk.alias("risk"), F.when(F.max("bad"), "NON_COMPLIANT").when(n > 0, "WARNING").otherwise("COMPLIANT").alias("status"))


#: What a column's findings make of it.
LABELS = {"CRITICAL": "restricted", "HIGH": "confidential", "MEDIUM": "internal", "LOW": "internal"}


def classified(df: DataFrame, columns: list[str] | None = None, least_ratio: float = 0.02) -> DataFrame:
    """column, label (restricted, confidential, internal, public), types, entropy: each column by its findings of at least ``least_ratio`` of its values.

    ``entropy`` is the mean bits of a character in its values (of the distribution inside
    each), which is high for keys and hashes; a column of values of EMBEDDED characters
    or more with 4 bits or more each is confidential at least, whatever the rules say.
    """
    columns = columns or df.columns
    found = findings(df, columns).where(F.col("hits") >= least_ratio * F.greatest(F.col("non_null"), F.lit(1)))
    own = found.groupBy("column").agg(_highest(F.col("severity"), SEVERITIES).alias("severity"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    value = lambda c: F.col(f"`{c}`").cast("string")
    stats = df.agg(*(a for i, c in enumerate(columns) for a in (F.avg(text_entropy(value(c))).alias(f"_e{i}"), F.avg(F.length(value(c))).alias(f"_l{i}"), F.count_if(value(c).contains(" ")).alias(f"_s{i}"))))
    each = stats.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.round(F.coalesce(f"_e{i}", F.lit(0.0)), 6).alias("entropy"), F.col(f"_l{i}").alias("long"), F.col(f"_s{i}").alias("spaced")) for i, c in enumerate(columns)))))
    dense = (F.col("entropy") >= 4) & (F.col("long") >= EMBEDDED) & (F.col("spaced") == 0)
    label = F.coalesce(_mapped(F.col("severity"), LABELS), F.lit("public"))
    label = F.when(dense & label.isin("public", "internal"), "confidential").otherwise(label)
    return each.join(own, "column", "left").select("column", label.alias("label"), F.coalesce("types", F.lit("")).alias("types"), "entropy")


def _mapped(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def text_entropy(c: Column) -> Column:
    """Shannon entropy in bits of a text's characters; 0 for an empty one, null for null. Runs of the sorted characters are counted, so a text is looked at once."""
    chars = F.array_sort(F.split(c, ""))
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"))

    def weigh(n):
        return F.when(n > 0, n * F.log2(F.greatest(n, F.lit(1)).cast("double"))).otherwise(0.0)

    def step(a, x):
        same = a["last"].eqNullSafe(x)
        return F.struct(x.alias("last"), F.when(same, a["n"] + 1).otherwise(1).alias("n"), (a["sum"] + F.when(same, 0.0).otherwise(weigh(a["n"]))).alias("sum"))

    n = F.length(c).cast("double")
    total = F.aggregate(chars, zero, step, lambda a: a["sum"] + weigh(a["n"]))
    return F.when(n > 0, F.log2(n) - total / n).when(n == 0, 0.0)
