"""Builders and report aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.filters import in_period, is_spending, non_consumption
from ..operators.joins import with_bounds
from ..schema import UNCATEGORISED, blank_to_null
from .templates import money


def clamp(n: int, low: int = 1, high: int = 100) -> int:
    return max(low, min(high, n))


def _spending(tx: DataFrame, exclude_transfers: bool = True, exclude_income: bool = True) -> DataFrame:
    rows = tx.where(~F.col("is_transfer_bool")) if exclude_transfers else tx
    return rows.where("amount < 0") if exclude_income else rows


def signed_monthly_spend(tx: DataFrame, exclude_transfers: bool = True, exclude_income: bool = True) -> DataFrame:
    """Signed sums, so spending is negative."""
    rows = _spending(tx, exclude_transfers, exclude_income)
    return rows.groupBy("month").agg(F.count("*").alias("transaction_count"), money(F.sum("amount")).alias("total_amount")).orderBy(F.desc("month"))


def signed_tag_breakdown(tx: DataFrame, top_n: int = 10) -> DataFrame:
    rows = _spending(tx).select("amount", F.explode("tags_list").alias("tag"))
    out = rows.groupBy("tag").agg(F.count("*").alias("transaction_count"), money(F.sum("amount")).alias("total_amount"))
    return out.orderBy("total_amount", "tag").limit(clamp(top_n))


def top_merchants(tx: DataFrame, top_n: int = 10) -> DataFrame:
    out = _spending(tx).groupBy("merchant_raw").agg(F.count("*").alias("transaction_count"), money(F.sum("amount")).alias("total_amount"))
    out = out.withColumn("avg_amount", F.col("total_amount") / F.col("transaction_count"))
    return out.orderBy("total_amount", F.col("merchant_raw").asc_nulls_last()).limit(clamp(top_n))


def account_summary(tx: DataFrame) -> DataFrame:
    rows = tx.where(~F.col("is_transfer_bool"))
    part = lambda cond: money(F.coalesce(F.sum(F.when(cond, F.col("amount"))), F.lit(0)))
    return (
        rows.groupBy("account")
        .agg(
            F.count("*").alias("transaction_count"),
            part(F.col("amount") < 0).alias("total_expense"),
            part(F.col("amount") > 0).alias("total_income"),
            money(F.sum("amount")).alias("net"),
        )
        .orderBy("total_expense", "account")
    )


def spend_movers(tx: DataFrame, top_n: int = 5, days: int = 30) -> DataFrame:
    """Change of spending per category over the last days against the days before."""
    rows = tx.where(is_spending())
    rows = with_bounds(rows, rows.agg(F.max("date").alias("__max")))
    age = F.datediff(F.to_date("__max"), F.to_date("date"))
    label = F.coalesce(F.nullif(F.col("category_final"), F.lit("")), F.lit(UNCATEGORISED))
    part = lambda cond: F.round(F.coalesce(F.sum(F.when(cond, -F.col("amount"))), F.lit(0)), 0).cast("long")
    out = rows.where(age < 2 * days).groupBy(label.alias("label")).agg(part(age < days).alias("now"), part(age >= days).alias("before"))
    out = out.where("now <> 0 or before <> 0").withColumn("delta_krw", F.col("now") - F.col("before"))
    out = out.withColumn("direction", F.when(F.col("delta_krw") >= 0, "up").otherwise("down"))
    return out.orderBy(F.desc(F.abs("delta_krw")), "label").limit(clamp(top_n)).select("label", "delta_krw", "direction")


def report_monthly(tx: DataFrame, period: str | None = None) -> DataFrame:
    """By type, so refunds (positive expenses) net out."""
    rows = tx.where((F.col("type_norm") == "expense") & ~F.col("is_transfer_bool"))
    if period:
        rows = rows.where(in_period(period))
    return rows.groupBy("month").agg(F.count("*").alias("transaction_count"), money(F.round(-F.sum("amount"), 0)).alias("total_spend")).orderBy("month")


def report_by_tag(tx: DataFrame, top_n: int = 10) -> DataFrame:
    """Shares are of all tags, not of those shown."""
    rows = tx.where((F.col("type_norm") == "expense") & ~F.col("is_transfer_bool")).select("amount", F.explode("tags_list").alias("tag"))
    by_tag = rows.groupBy("tag").agg(F.count("*").alias("transaction_count"), F.sum("amount").alias("__sum"))
    total = by_tag.agg(F.sum("__sum").alias("__all"))
    out = with_bounds(by_tag, total)
    share = F.when(F.col("__all") != 0, F.round(money(F.col("__sum")) / money(F.col("__all")) * 100, 1)).otherwise(0.0)
    out = out.select("tag", "transaction_count", money(-F.col("__sum")).alias("total_spend"), share.alias("percentage"))
    return out.orderBy(F.desc("total_spend"), "tag").limit(top_n)


def report_by(tx: DataFrame, key: str) -> DataFrame:
    """Report per category or account: nulls under one heading."""
    rows = tx.where((F.col("type_norm") == "expense") & ~F.col("is_transfer_bool"))
    name = F.coalesce(blank_to_null(F.col(key)), F.lit(UNCATEGORISED if key == "category_final" else "unknown"))
    out = rows.groupBy(name.alias(key)).agg(F.count("*").alias("transaction_count"), money(-F.sum("amount")).alias("total_spend"))
    return out.orderBy(F.desc("total_spend"), key)


def report_transfers(tx: DataFrame) -> DataFrame:
    cols = ("date", "time", "merchant_raw", "account", "amount", "transfer_group_id", "row_hash")
    return tx.where("is_transfer_bool").select(*cols).withColumn("amount", money(F.col("amount"))).orderBy("date", "time", "row_hash")


def report_top_merchants(tx: DataFrame, top_n: int = 10) -> DataFrame:
    rows = tx.where((F.col("type_norm") == "expense") & ~F.col("is_transfer_bool") & blank_to_null(F.col("merchant_raw")).isNotNull())
    out = rows.groupBy("merchant_raw").agg(F.count("*").alias("transaction_count"), money(-F.sum("amount")).alias("total_spend"))
    return out.orderBy(F.desc("total_spend"), "merchant_raw").limit(top_n)


def summary_stats(tx: DataFrame) -> DataFrame:
    rows = tx.where(~F.col("is_transfer_bool"))
    part = lambda cond: money(F.coalesce(F.sum(F.when(cond, F.col("amount"))), F.lit(0)))
    return rows.agg(
        F.count("*").alias("transaction_count"),
        (-part(F.col("type_norm") == "expense")).alias("total_expense"),
        part(F.col("type_norm") == "income").alias("total_income"),
        money(F.coalesce(F.sum("amount"), F.lit(0))).alias("net"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def date_range(tx: DataFrame) -> DataFrame:
    return tx.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("month").alias("months"))


# Tags that mark structural savings.
SAVINGS_TAGS = ("정기저축", "IRP", "연금", "투자입금")


def _savings_tags(aliases: Sequence[str]) -> Column:
    known = F.array(*[F.lit(a.lower().strip()) for a in aliases])
    return F.array_sort(F.array_distinct(F.array_intersect(F.transform("tags_list", lambda t: F.lower(F.trim(t))), known)))


def structural_savings(tx: DataFrame, aliases: Sequence[str] = SAVINGS_TAGS) -> DataFrame:
    """Savings inferred from tagged spending, per category and matched tags; monthly over all observed months."""
    months = tx.agg(F.count_distinct("month").alias("__months"))
    rows = tx.where(is_spending()).withColumn("tags", _savings_tags(aliases)).where(F.size("tags") > 0)
    whole = F.round(F.abs("amount"), 0).cast("long")
    category = F.coalesce(blank_to_null(F.col("category_final")), F.lit(UNCATEGORISED))
    out = rows.groupBy(category.alias("category"), F.array_join("tags", ", ").alias("label")).agg(
        F.sum(whole).alias("amount"), F.count("*").alias("transaction_count"), F.count_distinct("month").alias("months")
    )
    out = with_bounds(out, months).withColumn("monthly_amount", F.round(F.col("amount") / F.col("__months"), 0).cast("long"))
    return out.drop("__months").orderBy("category", "label")


def savings_rate(tx: DataFrame, aliases: Sequence[str] = SAVINGS_TAGS, recent: int = 3) -> DataFrame:
    """One row: monthly averages, the recent savings rate, and the rate without structural savings (at most the
    month's expense) counted as consumption."""
    rows = tx.where(~F.col("is_transfer_bool"))
    saved = F.when((F.col("amount") < 0) & (F.size(_savings_tags(aliases)) > 0), F.round(F.abs("amount"), 0))
    part = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    monthly = rows.groupBy("month").agg(
        part(F.col("amount") > 0, F.col("amount")).alias("income"), part(F.col("amount") < 0, -F.col("amount")).alias("expense"), F.coalesce(F.sum(saved), F.lit(0)).alias("structural")
    )
    # one row per month
    ranked = monthly.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("month"))))
    last = F.col("__r") <= recent
    total = lambda c: money(F.sum(F.when(last, F.col(c))))
    out = ranked.agg(
        F.round(money(F.sum("income")) / F.count("*"), 0).cast("long").alias("monthly_avg_income"),
        F.round(money(F.sum("expense")) / F.count("*"), 0).cast("long").alias("monthly_avg_expense"),
        F.round(money(F.sum(F.greatest(F.col("expense") - F.col("structural"), F.lit(0)))) / F.count("*"), 0).cast("long").alias("monthly_avg_consumption_expense"),
        F.round(money(F.sum(F.least("structural", "expense"))) / F.count("*"), 0).cast("long").alias("structural_monthly_avg"),
        total("income").alias("i"), total("expense").alias("e"), total("structural").alias("s"),
    )
    rate = lambda spent: F.when(F.col("i") > 0, F.round((F.col("i") - spent) / F.col("i"), 2))
    out = out.withColumn("savings_rate_3mo", rate(F.col("e"))).withColumn("consumption_savings_rate_3mo", rate(F.greatest(F.col("e") - F.col("s"), F.lit(0.0))))
    return out.drop("i", "e", "s")


def monthly_income_expense(tx: DataFrame) -> DataFrame:
    part = lambda cond: money(F.coalesce(F.sum(F.when(cond, F.abs("amount"))), F.lit(0)))
    rows = tx.where(~F.col("is_transfer_bool"))
    return rows.groupBy("month").agg(part(F.col("amount") > 0).alias("income"), part(F.col("amount") < 0).alias("expense")).orderBy("month")


def top_categories(tx: DataFrame, top_n: int = 5) -> DataFrame:
    name = F.coalesce(*[blank_to_null(F.col(c)) for c in ("category_final", "category_rule", "minor_raw", "major_raw")], F.lit(UNCATEGORISED))
    out = tx.where(is_spending()).groupBy(name.alias("name")).agg(F.round(-F.sum("amount"), 0).cast("long").alias("amount"))
    return out.orderBy(F.desc("amount"), "name").limit(top_n)
