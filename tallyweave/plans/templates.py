"""The parameterised queries. Each takes the ``transactions`` view (a DataFrame) and typed parameters."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import check_period, in_months, is_consumption, is_expense, is_spending, non_consumption
from ..operators.joins import with_bounds
from ..schema import UNCATEGORISED, UNKNOWN_MERCHANT


def money(c: Column) -> Column:
    """A sum of exact amounts, as a double at the very end."""
    return c.cast("double")


def spend() -> Column:
    return money(F.abs(F.sum("amount")))


def mean_spend(digits: int = 0) -> Column:
    return F.round(spend() / F.count("*"), digits)


def monthly_spend(tx: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    rows = tx.where(is_spending() & in_months(since, until))
    return rows.groupBy("month").agg(F.count("*").alias("transaction_count"), spend().alias("total_spend")).orderBy(F.desc("month"))


def tag_breakdown(tx: DataFrame, since: str | None = None, until: str | None = None, top_n: int = 10) -> DataFrame:
    rows = tx.where(is_spending() & in_months(since, until)).select("amount", F.explode("tags_list").alias("tag"))
    out = rows.groupBy("tag").agg(F.count("*").alias("transaction_count"), spend().alias("total_spend"))
    return out.orderBy(F.desc("total_spend"), "tag").limit(top_n)


def monthly_consumption_summary(tx: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """The pattern is asked of each distinct combination of labels, not of each row."""
    labels = ("category_final", "major_raw", "minor_raw", "tags_list")
    rows = tx.where(is_expense() & in_months(since, until)).groupBy("month", *labels).agg(F.count("*").alias("n"), F.sum(F.abs("amount")).alias("spent"))
    rows = rows.select("month", "n", "spent", non_consumption().alias("other"))
    whole = lambda keep: F.round(F.coalesce(F.sum(F.when(keep, F.col("spent"))), F.lit(0)), 0).cast("long")
    return (
        rows.groupBy("month")
        .agg(
            F.coalesce(F.sum(F.when(~F.col("other"), F.col("n"))), F.lit(0)).alias("transaction_count"),
            whole(~F.col("other")).alias("consumption_spend"),
            whole(F.col("other")).alias("excluded_non_consumption_spend"),
        )
        .orderBy(F.desc("month"))
    )


def _top_consumption(tx: DataFrame, month: str, key: Column, name: str, top_n: int) -> DataFrame:
    rows = tx.where(is_consumption() & (F.col("month") == check_period(month))).select(key.alias(name), F.abs("amount").alias("spent"))
    out = rows.groupBy(name).agg(F.count("*").alias("transaction_count"), F.round(F.sum("spent"), 0).cast("long").alias("consumption_spend"))
    return out.orderBy(F.desc("consumption_spend"), name).limit(top_n)


def consumption_category_breakdown(tx: DataFrame, month: str, top_n: int = 10) -> DataFrame:
    return _top_consumption(tx, month, F.coalesce("category_final", "minor_raw", "major_raw", F.lit(UNCATEGORISED)), "category", top_n)


def merchant_top_spend(tx: DataFrame, month: str, top_n: int = 20) -> DataFrame:
    return _top_consumption(tx, month, F.coalesce("merchant_raw", F.lit(UNKNOWN_MERCHANT)), "merchant", top_n)


def event_adjusted_spend(tx: DataFrame, month: str, event_tags: str = "") -> DataFrame:
    tags = sorted(t.strip() for t in event_tags.split(",") if t.strip())
    is_event = F.coalesce(F.arrays_overlap("tags_list", F.array(*map(F.lit, tags))), F.lit(False)) if tags else F.lit(False)
    rows = tx.where(is_consumption() & (F.col("month") == check_period(month))).select(F.abs("amount").alias("spent"), is_event.alias("event"))
    whole = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)), 0).cast("long")
    return rows.agg(
        F.lit(month).alias("month"),
        F.lit(", ".join(tags)).alias("event_tags"),
        F.count("*").alias("transaction_count"),
        F.count_if("event").alias("event_transaction_count"),
        whole(F.col("spent")).alias("total_consumption_spend"),
        whole(F.when(F.col("event"), F.col("spent"))).alias("event_spend"),
        whole(F.when(~F.col("event"), F.col("spent"))).alias("adjusted_consumption_spend"),
    )


# What tells the intent of a recurring charge, in order, and how sure each is.
INTENTS = (
    ("savings", "(적금|예금|저축|savings?|deposit|isa|연금|펀드)", 0.9),
    ("loan_or_interest", "(대출|이자|상환|loan|interest|mortgage)", 0.9),
    ("spending", "(구독|정기지출|통신|보험|렌탈|관리비|월세|subscription|netflix|spotify|disney|gym|membership|멤버십)", 0.75),
)


def recurring_candidates(tx: DataFrame, min_occurrences: int = 3, min_amount: float = 5000, top_n: int = 20) -> DataFrame:
    """Groups of merchant and signed amount. Whether an intent word occurs is asked of each row and or-ed over the
    group, so no text is gathered: no word spans two rows."""
    text = lambda *cs: F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs]))
    said = text("merchant_raw", "major_raw", "minor_raw", "category_final", "memo_raw", "tags_final")
    rows = tx.where(is_spending() & (F.abs("amount") >= min_amount))
    flags = {f"__{name}": F.max(said.rlike(pattern)) for name, pattern, _ in INTENTS}
    out = rows.groupBy("merchant_raw", "amount").agg(
        F.count("*").alias("occurrences"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), *[c.alias(k) for k, c in flags.items()]
    )
    out = out.where(F.col("occurrences") >= min_occurrences)
    intent, sure = F.lit("unknown"), F.lit(0.0)
    for name, _, confidence in reversed(INTENTS):
        intent, sure = F.when(F.col(f"__{name}"), name).otherwise(intent), F.when(F.col(f"__{name}"), confidence).otherwise(sure)
    out = out.select(
        "merchant_raw", money(F.abs("amount")).alias("amount_krw"), "occurrences", "first_seen", "last_seen", intent.alias("intent"), sure.alias("intent_confidence")
    )
    return out.orderBy(F.desc("occurrences"), F.desc("amount_krw"), "merchant_raw").limit(top_n)


def anomaly_large_txn(tx: DataFrame, threshold: float = 300000, since: str | None = None, until: str | None = None, top_n: int = 20) -> DataFrame:
    rows = tx.where(is_spending() & (F.abs("amount") >= threshold) & in_months(since, until))
    out = rows.orderBy(F.desc(F.abs("amount")), "row_hash").limit(top_n)
    return out.select("date", "merchant_raw", "account", "category_final", money(F.abs("amount")).alias("amount_krw"))


def card_spend_summary(tx: DataFrame, since: str | None = None, until: str | None = None, top_n: int = 20) -> DataFrame:
    rows = tx.where(is_spending() & in_months(since, until))
    out = rows.groupBy("account").agg(F.count("*").alias("transaction_count"), spend().alias("total_spend"), mean_spend().alias("avg_spend"))
    return out.orderBy(F.desc("total_spend"), "account").limit(top_n)


def merchant_monthly_trend(tx: DataFrame, merchant: str, since: str | None = None, until: str | None = None, top_n: int = 12) -> DataFrame:
    """By default the twelve months that end with the data's last month of spending."""
    like = "%" + re.sub(r"([%_\\])", r"\\\1", merchant) + "%"
    rows = tx.where(is_spending())
    if until is not None:
        at = int(check_period(until)[:4]) * 12 + int(until[5:7]) - 12
        hits = rows.where(in_months(since or f"{at // 12:04d}-{at % 12 + 1:02d}", until) & F.col("merchant_raw").ilike(like))
    else:
        bounds = rows.agg(F.max("month").alias("until_month"))
        first = F.lit(check_period(since)) if since is not None else F.date_format(F.add_months(F.to_date(F.concat("until_month", F.lit("-01"))), -11), "yyyy-MM")
        bounds = bounds.withColumn("since_month", first)
        hits = with_bounds(rows.where(in_months(since) & F.col("merchant_raw").ilike(like)), bounds)
        hits = hits.where(F.col("month").between(F.col("since_month"), F.col("until_month")))
    out = hits.groupBy("month").agg(F.count("*").alias("transaction_count"), spend().alias("total_spend"), mean_spend().alias("avg_spend"))
    return out.orderBy(F.desc("month")).limit(top_n)


WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def spend_by_weekday_hour(tx: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    rows = tx.where(is_spending() & in_months(since, until))
    rows = rows.select(F.weekday(F.to_date("date")).alias("weekday_idx"), F.split_part("time", F.lit(":"), F.lit(1)).cast("int").alias("hour"), "amount")
    out = rows.groupBy("weekday_idx", "hour").agg(F.count("*").alias("transaction_count"), spend().alias("total_spend"), mean_spend().alias("avg_spend"))
    name = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.col("weekday_idx") + 1)
    return out.select("weekday_idx", name.alias("weekday_name"), "hour", "transaction_count", "total_spend", "avg_spend").orderBy("weekday_idx", "hour")


def _dated(tx: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Rows beside the last date of all, and the days since each row's date."""
    last = tx.agg(F.max("date").alias("__max"))
    rows = with_bounds(tx, last)
    return rows, F.datediff(F.to_date("__max"), F.to_date("date")), F.col("__max")


def weekly_anomalies(tx: DataFrame, period_days: int = 7, threshold_pct: float = 30) -> DataFrame:
    """Two adjacent periods by category. A null category never equals itself, so it appears once as gone and once as new."""
    rows, age, _ = _dated(tx)
    rows = rows.where(is_spending()).withColumn("__age", age).where(F.col("__age") < 2 * period_days)
    part = lambda cond, total: rows.where(cond).groupBy("category_final").agg(F.sum("amount").alias(total))
    now = part(F.col("__age") < period_days, "c_total").withColumnRenamed("category_final", "c_cat")
    before = part(F.col("__age") >= period_days, "p_total").withColumnRenamed("category_final", "p_cat")
    both = now.join(before, F.col("c_cat") == F.col("p_cat"), "full")
    current, prior = money(F.abs(F.coalesce("c_total", F.lit(0)))), money(F.abs(F.coalesce("p_total", F.lit(0))))
    missing_c, missing_p = F.col("c_total").isNull(), F.col("p_total").isNull()
    kind = F.when(missing_c & ~missing_p, "gone").when(missing_p & ~missing_c, "new").when(missing_p & missing_c, F.lit(None)).otherwise("changed")
    change = F.when(~missing_c & ~missing_p & (prior != 0), F.round((current - prior) / prior * 100, 1))
    out = both.select(F.coalesce("c_cat", "p_cat").alias("category"), current.alias("current_spend"), prior.alias("prior_spend"), kind.alias("change_type"), change.alias("change_pct"))
    out = out.where((F.abs("change_pct") > threshold_pct) | F.col("change_type").isin("new", "gone"))
    return out.orderBy(F.desc(F.abs(F.col("current_spend") - F.col("prior_spend"))), F.col("category").asc_nulls_last(), "change_type")


def new_merchants(tx: DataFrame, days: int = 7) -> DataFrame:
    """One pass: a merchant is new if its first expense of any sign lies within the last days."""
    rows, age, _ = _dated(tx)
    rows = rows.where((F.col("type_norm") == "expense") & ~F.col("is_transfer_bool") & F.col("merchant_raw").isNotNull()).withColumn("__age", age)
    recent = (F.col("__age") < days) & (F.col("amount") < 0)
    out = rows.groupBy("merchant_raw").agg(
        F.max("__age").alias("__oldest"), F.count_if(recent).alias("transaction_count"), money(F.abs(F.sum(F.when(recent, F.col("amount"))))).alias("total_spend")
    )
    out = out.where((F.col("__oldest") < days) & (F.col("transaction_count") > 0)).drop("__oldest")
    return out.orderBy(F.desc("total_spend"), "merchant_raw")


def spending_comparison(tx: DataFrame, period_days: int = 7) -> DataFrame:
    rows, age, _ = _dated(tx)
    rows = rows.where(is_spending()).withColumn("__age", age)
    now, before = F.col("__age") < period_days, F.col("__age").between(period_days, 2 * period_days - 1)
    total = lambda c: money(F.coalesce(F.abs(F.sum(F.when(c, F.col("amount")))), F.lit(0)))
    out = rows.agg(F.count_if(now).alias("current_txn_count"), total(now).alias("current_spend"), F.count_if(before).alias("prior_txn_count"), total(before).alias("prior_spend"))
    change = F.when((F.col("prior_spend") == 0) & (F.col("current_spend") == 0), 0.0).when(
        F.col("prior_spend") != 0, F.round((F.col("current_spend") - F.col("prior_spend")) / F.col("prior_spend") * 100, 1)
    )
    return out.withColumn("change_pct", change)


GROUP_BY = ("category_final", "merchant_raw", "account")
TYPE_NORM = {"expense": ("expense",), "income": ("income",), "all": None}


def compare(tx: DataFrame, baseline_months: Sequence[str], current_months: Sequence[str], group_by: str = "category_final", type_norm: str = "expense") -> DataFrame:
    """Monthly averages of two sets of months; a side is divided by those of its months that have data."""
    if group_by not in GROUP_BY:
        raise ValueError(f"cannot compare by {group_by!r}")
    kinds = TYPE_NORM[type_norm]
    sides = {"b": [check_period(m) for m in baseline_months], "c": [check_period(m) for m in current_months]}
    key = F.coalesce(F.nullif(F.trim(F.col(group_by).cast("string")), F.lit("")), F.lit("(unknown)"))
    rows = tx.where(F.col("type_norm").isin(*kinds)) if kinds else tx
    rows = rows.where(F.col("month").isin(*{m for side in sides.values() for m in side}))
    rows = rows.select("month", key.alias("group_key"), F.abs("amount").alias("size"))
    inside = {k: F.col("month").isin(*months) if months else F.lit(False) for k, months in sides.items()}
    counts = rows.agg(*[F.count_distinct(F.when(c, F.col("month"))).alias(f"{k}_months") for k, c in inside.items()])
    sums = rows.groupBy("group_key").agg(*[F.sum(F.when(c, F.col("size"))).alias(k) for k, c in inside.items()])
    mean = lambda k: F.coalesce(money(F.col(k)) / F.nullif(F.col(f"{k}_months"), F.lit(0)), F.lit(0.0))
    out = with_bounds(sums, counts).select("group_key", mean("b").alias("b"), mean("c").alias("c"))
    diff = F.col("c") - F.col("b")
    out = out.select(
        "group_key",
        F.round("b", 1).alias("baseline_monthly_avg"),
        F.round("c", 1).alias("current_monthly_avg"),
        F.round(diff, 1).alias("diff"),
        F.when(F.col("b") != 0, F.round(diff / F.col("b") * 100, 1)).alias("pct_change"),
    )
    return out.orderBy(F.desc(F.abs("diff")), "group_key")


OTHER, MISSING = "_other_", "_unknown_"
ROW_AXES = ("month", "year", "quarter", "account", "type_norm", "is_transfer")
COLUMN_AXES = ("category_final", "major_raw", "minor_raw", "merchant_raw", "type_norm", "tags")
PIVOT_AGGREGATES = ("sum", "avg", "count", "max", "min")


def _axis(name: str) -> Column:
    if name == "year":
        found = F.substring("date", 1, 4)
    elif name == "quarter":
        found = F.concat(F.substring("date", 1, 4), F.lit("-Q"), F.quarter(F.to_date("date")).cast("string"))
    elif name == "is_transfer":
        return F.when(F.coalesce("is_transfer_bool", F.lit(False)), "true").otherwise("false")
    else:
        found = F.col("tag" if name == "tags" else name)
    return F.coalesce(F.nullif(F.trim(found), F.lit("")), F.lit(MISSING))  # a blank value names no column


def pivot(
    tx: DataFrame,
    row: str = "month",
    col: str = "category_final",
    value: str = "amount",
    agg: str = "sum",
    months: tuple[str | None, str | None] = (None, None),
    top_n_cols: int = 10,
    include_transfers: bool = False,
) -> DataFrame:
    """Two phases: rank the column values (the top ones are at most ``top_n_cols`` on the driver), then one aggregation
    with a fixed list of columns. The rest goes to ``_other_``; a cell without rows is 0. Spending is positive."""
    if row not in ROW_AXES or col not in COLUMN_AXES or agg not in PIVOT_AGGREGATES or value not in ("amount", "count"):
        raise ValueError("unknown axis, value or aggregate")
    rows = tx.where(in_months(*months))
    if not include_transfers and row != "is_transfer":
        rows = rows.where(~F.col("is_transfer_bool"))
    if col == "tags":
        rows = rows.withColumn("tag", F.explode("tags_list"))
    base = rows.select(_axis(row).alias("row_key"), _axis(col).alias("bucket"), F.abs("amount").alias("size"))
    size = F.count("*") if value == "count" or agg == "count" else F.sum("size")
    ranked = base.groupBy("bucket").agg(size.alias("rank")).orderBy(F.desc("rank"), "bucket").limit(top_n_cols + 1)
    top = [r["bucket"] for r in ranked.collect()]
    kept, more = top[:top_n_cols], len(top) > top_n_cols
    if more:
        base = base.withColumn("bucket", F.when(F.col("bucket").isin(*kept), F.col("bucket")).otherwise(OTHER))
    measure = F.count("size") if value == "count" or agg == "count" else {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[agg]("size")
    names = [*kept, *([OTHER] if more and OTHER not in kept else [])]
    out = base.groupBy("row_key").pivot("bucket", names).agg(measure)
    kind = "long" if value == "count" or agg == "count" else "double"
    return out.select(F.col("row_key").alias(row), *[F.coalesce(F.col(f"`{n}`").cast(kind), F.lit(0).cast(kind)).alias(n) for n in names]).orderBy(row)


@dataclass(frozen=True)
class Param:
    kind: str
    default: object = None
    required: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()

    def coerce(self, name: str, raw: object) -> object:
        if raw is None:
            if self.required:
                raise ValueError(f"{name} is needed")
            return self.default
        if self.kind == "int" or self.kind == "number":
            value = int(raw) if self.kind == "int" else float(raw)
            if self.low is not None and value < self.low or self.high is not None and value > self.high:
                raise ValueError(f"{name} must lie within {self.low:g} and {self.high:g}")
            return value
        if self.kind == "month":
            return check_period(str(raw))
        if self.kind == "months":
            return month_list(raw)
        if self.kind == "window":
            first, _, last = str(raw).partition("..")
            return check_period(first or None), check_period(last or first or None)
        if self.kind == "date":
            return dt.date.fromisoformat(str(raw)).isoformat()
        if self.kind == "bool":
            if str(raw).lower() not in ("true", "false", "1", "0", "yes", "no"):
                raise ValueError(f"{name} is no yes or no")
            return str(raw).lower() in ("true", "1", "yes")
        if self.kind == "enum":
            if raw not in self.choices:
                raise ValueError(f"{name} must be one of {', '.join(self.choices)}")
            return raw
        text = str(raw)
        if any(ord(c) < 32 for c in text) or len(text) > 200:
            raise ValueError(f"{name} is no plain text")
        return text


def month_list(raw: object) -> list[str]:
    """A list of months, or a range first..last, or a text of months with commas."""
    if isinstance(raw, (list, tuple)):
        return [check_period(str(m)) for m in raw]
    first, dots, last = str(raw).partition("..")
    if not dots:
        return [check_period(m.strip()) for m in first.split(",")]
    a, b = (int(x[:4]) * 12 + int(x[5:7]) - 1 for x in (check_period(first), check_period(last)))
    if b < a:
        raise ValueError(f"{raw}: the range ends before it begins")
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(a, b + 1)]


@dataclass(frozen=True)
class Template:
    run: Callable[..., DataFrame]
    params: dict[str, Param]
    domain: str = "transaction"


_SINCE = {"since": Param("month"), "until": Param("month")}
_top = lambda n, high=100: {"top_n": Param("int", n, low=1, high=high)}
TEMPLATES: dict[str, Template] = {
    "monthly_spend": Template(monthly_spend, _SINCE),
    "tag_breakdown": Template(tag_breakdown, _SINCE | _top(10)),
    "monthly_consumption_summary": Template(monthly_consumption_summary, _SINCE),
    "consumption_category_breakdown": Template(consumption_category_breakdown, {"month": Param("month", required=True)} | _top(10)),
    "merchant_top_spend": Template(merchant_top_spend, {"month": Param("month", required=True)} | _top(20)),
    "event_adjusted_spend": Template(event_adjusted_spend, {"month": Param("month", required=True), "event_tags": Param("text", "")}),
    "recurring_candidates": Template(recurring_candidates, {"min_occurrences": Param("int", 3, low=2, high=36), "min_amount": Param("number", 5000, low=1e3, high=5e6)} | _top(20)),
    "anomaly_large_txn": Template(anomaly_large_txn, {"threshold": Param("number", 300000, low=1e4, high=1e8)} | _SINCE | _top(20, 200)),
    "card_spend_summary": Template(card_spend_summary, _SINCE | _top(20)),
    "merchant_monthly_trend": Template(merchant_monthly_trend, {"merchant": Param("text", required=True)} | _SINCE | _top(12, 24)),
    "spend_by_weekday_hour": Template(spend_by_weekday_hour, _SINCE),
    "weekly_anomalies": Template(weekly_anomalies, {"period_days": Param("int", 7, low=1, high=365), "threshold_pct": Param("number", 30, low=0, high=1000)}),
    "new_merchants": Template(new_merchants, {"days": Param("int", 7, low=1, high=365)}),
    "spending_comparison": Template(spending_comparison, {"period_days": Param("int", 7, low=1, high=365)}),
    "compare": Template(
        compare,
        {
            "baseline_months": Param("months", required=True),
            "current_months": Param("months", required=True),
            "group_by": Param("enum", "category_final", choices=GROUP_BY),
            "type_norm": Param("enum", "expense", choices=tuple(TYPE_NORM)),
        },
    ),
    "pivot": Template(
        pivot,
        {
            "row": Param("enum", "month", choices=ROW_AXES),
            "col": Param("enum", "category_final", choices=COLUMN_AXES),
            "value": Param("enum", "amount", choices=("amount", "count")),
            "agg": Param("enum", "sum", choices=PIVOT_AGGREGATES),
            "months": Param("window", (None, None)),
            "top_n_cols": Param("int", 10, low=1, high=100),
        },
    ),
}


def run_template(tx: DataFrame, name: str, **params: object) -> DataFrame:
    """A template by name with raw parameters, checked and typed."""
    template = TEMPLATES[name]
    if unknown := set(params) - set(template.params):
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    return template.run(tx, **{k: p.coerce(k, params.get(k)) for k, p in template.params.items()})
