"""Statements, subscription metrics, cohorts, tax and bank matching as conditional aggregates and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def income_statement(df: DataFrame, by: list[str], amount: str, income: Column) -> DataFrame:
    """by, revenue, expenses, net_profit, margin (percent of revenue, 0 without any)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = df.groupBy(*by).agg(zero(F.sum(F.when(income, F.col(amount)))).alias("revenue"), zero(F.sum(F.when(~income, F.col(amount)))).alias("expenses"))
    net = F.col("revenue") - F.col("expenses")
    return out.select("*", net.alias("net_profit"), F.when(F.col("revenue") > 0, net / F.col("revenue") * 100).otherwise(0.0).alias("margin"))


def revenue_periods(df: DataFrame, customer: str, period: Column, amount: str) -> DataFrame:
    """period (a number), revenue, new, expansion, contraction, churned, customers, nrr (net revenue retention): each customer's revenue against the period before."""
    cur = df.groupBy(F.col(customer).alias("c"), period.cast("int").alias("p")).agg(F.sum(amount).alias("cur"))
    both = cur.withColumn("prev", F.lit(0.0)).unionByName(cur.select("c", (F.col("p") + 1).alias("p"), F.lit(0.0).alias("cur"), F.col("cur").alias("prev")))
    last = cur.agg(F.max("p").alias("last"))
    each = both.groupBy("c", "p").agg(F.sum("cur").alias("cur"), F.sum("prev").alias("prev")).crossJoin(F.broadcast(last)).where("p <= last")
    cur, prev = F.col("cur"), F.col("prev")
    sums = each.groupBy(F.col("p").alias("period")).agg(
        F.sum(cur).alias("revenue"), F.sum(F.when(prev == 0, cur).otherwise(0.0)).alias("new"), F.sum(F.when((prev > 0) & (cur > prev), cur - prev).otherwise(0.0)).alias("expansion"),
        F.sum(F.when((cur > 0) & (cur < prev), prev - cur).otherwise(0.0)).alias("contraction"), F.sum(F.when(cur == 0, prev).otherwise(0.0)).alias("churned"), F.count_if(cur > 0).alias("customers"), F.sum(prev).alias("before"),
    )
    kept = F.col("before") + F.col("expansion") - F.col("contraction") - F.col("churned")
    return sums.select("period", "revenue", "new", "expansion", "contraction", "churned", "customers", F.try_divide(kept, F.col("before")).alias("nrr"))


def revenue_cohorts(df: DataFrame, customer: str, period: Column, amount: str) -> DataFrame:
    """cohort (first period of its customers), age, customers, revenue."""
    each = df.groupBy(F.col(customer).alias("c"), period.cast("int").alias("p")).agg(F.sum(amount).alias("v"))
    each = each.withColumn("cohort", F.min("p").over(Window.partitionBy("c")))
    return each.groupBy("cohort", (F.col("p") - F.col("cohort")).alias("age")).agg(F.count("*").alias("customers"), F.sum("v").alias("revenue"))


def bracket_tax(gross: Column, brackets: list[tuple[float, float, float]]) -> Column:
    """Tax by (from, fixed, rate) brackets in ascending order: fixed + (gross - from) * rate of the last one that begins below; 0 under the first."""
    out = F.lit(0.0)
    for start, fixed, rate in brackets:
        out = F.when(gross >= start, fixed + (gross - start) * rate).otherwise(out)
    return out


def bank_matches(statements: DataFrame, transactions: DataFrame, least: float = 0.5) -> DataFrame:
    """statement_id, transaction_id, score: each statement's best transaction (ties by id). Both sides have id, amount, date, text.

    Amounts agree to 0.01 (half of the score), dates are at most 3 days apart (0.3,
    falling linearly) and equal texts give 0.2. Transactions are reduced to the smallest id
    of each (amount, day) and of each (amount, day, text), statements to their different
    (amount, day, text), so many equal amounts are one row on either side; those meet in
    cells of eight cents and a week, of which a statement looks at one to four.
    """
    cell = lambda amount: F.floor(amount / 0.08)
    week = lambda day: F.floor(day / 7)
    day = F.unix_date(F.to_date("date"))
    s = statements.select(F.col("id").alias("statement_id"), F.col("amount").alias("sa"), day.alias("sd"), F.lower("text").alias("st"))
    asked = s.select("sa", "sd", "st").distinct()
    t = transactions.groupBy(F.col("amount").alias("ta"), day.alias("td"), F.lower("text").alias("tt")).agg(F.min("id").alias("id"))
    placed = lambda x: x.withColumns({"c": cell(F.col("ta")), "w": week(F.col("td"))})
    any_text = placed(t.groupBy("ta", "td").agg(F.min("id").alias("id")))
    near = asked.withColumn("c", F.explode(F.sequence(cell(F.col("sa") - 0.0101), cell(F.col("sa") + 0.0101)))).withColumn("w", F.explode(F.sequence(week(F.col("sd") - 3), week(F.col("sd") + 3))))
    apart = F.abs(F.col("sd") - F.col("td")) <= 3
    same = near.join(placed(t).withColumnRenamed("tt", "st"), ["c", "w", "st"]).where(apart).withColumn("bonus", F.lit(0.2))
    other = near.join(any_text, ["c", "w"]).where(apart).withColumn("bonus", F.lit(0.0))
    pair = same.unionByName(other).where(F.abs(F.col("sa") - F.col("ta")) <= 0.01 + 1e-9)
    score = F.round(0.5 + 0.3 * (1 - F.abs(F.col("sd") - F.col("td")) / 3) + F.col("bonus"), 9)
    best = pair.select("sa", "sd", "st", "id", score.alias("score")).where(F.col("score") >= least).groupBy("sa", "sd", "st").agg(F.max(F.struct("score", (-F.col("id")).alias("k"))).alias("b"))
    best = best.select(F.col("sa").alias("_a"), F.col("sd").alias("_d"), F.col("st").alias("_t"), "b")
    found = s.join(best, (F.col("sa") == F.col("_a")) & (F.col("sd") == F.col("_d")) & F.col("st").eqNullSafe(F.col("_t")))
    return found.select("statement_id", (-F.col("b.k")).alias("transaction_id"), "b.score")


def cash_flow(df: DataFrame, period: Column, amount: str, receipt: Column, opening: float = 0.0) -> DataFrame:
    """period, receipts, payments, net, opening, closing: what comes in and goes out a period, carried on from the balance before the first.

    One aggregate; the running balance is a window over periods, of which there are few at any size.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hit = F.coalesce(receipt, F.lit(False))
    sums = df.groupBy(period.alias("period")).agg(zero(F.sum(F.when(hit, F.col(amount)))).alias("receipts"), zero(F.sum(F.when(~hit, F.col(amount)))).alias("payments"))
    sums = sums.withColumn("net", F.col("receipts") - F.col("payments"))
    closing = F.lit(opening) + F.sum("net").over(Window.orderBy("period"))
    return sums.withColumn("closing", closing).select("period", "receipts", "payments", "net", (F.col("closing") - F.col("net")).alias("opening"), "closing")


def balance_sheet(df: DataFrame, side: Column, group: Column, amount: str) -> DataFrame:
    """side (assets, liabilities, equity), grp, total: the sums of each group, each side's total (a null group), and equity as assets less liabilities.

    Rows of another side are left out.
    """
    kept = df.select(side.alias("side"), group.alias("grp"), F.col(amount).alias("v")).where(F.col("side").isin("assets", "liabilities"))
    sums = kept.rollup("side", "grp").agg(F.sum("v").alias("total"), F.grouping_id().alias("g"), F.sum(F.when(F.col("side") == "assets", F.col("v")).otherwise(-F.col("v"))).alias("equity"))
    equity = F.col("g") == 3
    return sums.select(F.when(equity, "equity").otherwise(F.col("side")).alias("side"), "grp", F.when(equity, F.col("equity")).otherwise(F.col("total")).alias("total"))


def achievement(value: Column, target: Column, higher: bool = True) -> tuple[Column, Column]:
    """(percent of the target reached, status: excellent from 110, good from 95, warning from 75, else critical; unknown if it can't be told)."""
    over, under = (value, target) if higher else (target, value)
    percent = F.when(target != 0, F.try_divide(over, under) * 100)
    status = F.when(percent.isNull(), "unknown").when(percent >= 110, "excellent").when(percent >= 95, "good").when(percent >= 75, "warning").otherwise("critical")
    return percent, status


def health(statuses: Column) -> Column:
    """The mean of the statuses' points as an aggregate, to two digits."""
    points = F.when(statuses == "excellent", 100.0).when(statuses == "good", 85.0).when(statuses == "warning", 60.0).when(statuses == "critical", 30.0).otherwise(50.0)
    return F.round(F.avg(points), 2)
