"""Asset status, net worth position, breakdown, history, and the forecast fold."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import as_of, last_per_month, merge_by_precedence, name_key
from ..session import ship_package
from .templates import money

EXACT = "decimal(18,2)"


def latest(df: DataFrame, date_column: str = "snapshot_date") -> DataFrame:
    newest = df.agg(F.max(date_column).alias("__at"))
    return df.join(F.broadcast(newest), F.col(date_column) == F.col("__at")).drop("__at")


def asset_status(snapshots: DataFrame) -> DataFrame:
    """Value and positions per account at the latest date."""
    rows = latest(snapshots)
    out = rows.groupBy("snapshot_date", "account_id").agg(money(F.sum(F.col("market_value").cast(EXACT))).alias("total_value"), F.count("*").alias("positions"))
    return out.orderBy(F.desc("total_value"), "account_id")


def holdings(snapshots: DataFrame, account: str | None = None, limit: int = 50) -> DataFrame:
    rows = latest(snapshots)
    if account is not None:
        rows = rows.where(F.col("account_id").contains(account))
    return rows.select("account_id", "instrument_id", "quantity", "market_value", "currency").orderBy(F.desc("market_value"), "account_id", "instrument_id").limit(limit)


def balance_sides(balance: DataFrame) -> DataFrame:
    rows = latest(balance)
    return rows.groupBy("side").agg(money(F.sum(F.col("amount").cast(EXACT))).alias("total"), F.count("*").alias("items")).orderBy("side")


def snapshot_assets(snapshots: DataFrame) -> DataFrame:
    out = snapshots.groupBy(F.col("instrument_id").alias("name")).agg(F.sum(F.col("market_value").cast(EXACT)).alias("value"))
    return out.select("name", F.lit("financial").alias("category"), F.col("value").cast(EXACT).alias("value"), F.lit("snapshot").alias("source"))


def balance_assets(balance: DataFrame, side: str = "asset") -> DataFrame:
    rows = balance.where(F.col("side") == side)
    return rows.select(F.col("item_name").alias("name"), "category", F.col("amount").cast(EXACT).alias("value"), F.lit("overview").alias("source"))


def position(snapshots: DataFrame, manual: DataFrame, at: str, balance: DataFrame | None = None, liabilities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Assets and liabilities on a date: overview balances before snapshots, manual entries before both, by name."""
    known = as_of(balance, "snapshot_date", at) if balance is not None else None
    if known is not None and not known.isEmpty():
        source, debts = balance_assets(known), balance_assets(known, "liability")
    else:
        source, debts = snapshot_assets(as_of(snapshots, "snapshot_date", at)), None
    own = manual.select("name", "category", F.col("value").cast(EXACT).alias("value"), F.lit("manual").alias("source"))
    assets = merge_by_precedence(own, source, name_key(F.col("name")), ["name"])
    if liabilities is None:
        out = debts if debts is not None else source.where(F.lit(False))
    else:
        mine = liabilities.select("name", F.lit(None).cast("string").alias("category"), F.col("value").cast(EXACT).alias("value"), F.lit("manual").alias("source"))
        out = merge_by_precedence(mine, debts, name_key(F.col("name")), ["name"]) if debts is not None else mine
    return assets, out


def breakdown(assets: DataFrame, by: str = "category") -> DataFrame:
    """Value and share per category or asset."""
    key = {"category": "category", "asset": "name"}[by]
    rows = assets.groupBy(key).agg(F.sum("value").alias("__v"))
    total = rows.agg(F.sum("__v").alias("__t"))
    out = rows.crossJoin(F.broadcast(total))  # one row
    share = F.when(F.col("__t") != 0, F.round(money(F.col("__v")) / money(F.col("__t")) * 100, 2)).otherwise(0.0)
    return out.select(key, money(F.col("__v")).alias("value"), share.alias("share_pct")).orderBy(F.desc("value"), key)


def net_worth(assets: DataFrame, liabilities: DataFrame) -> DataFrame:
    total = lambda df, name: df.agg(F.coalesce(F.sum("value"), F.lit(0)).alias(name))
    both = total(assets, "a").crossJoin(total(liabilities, "l"))  # one row each
    return both.select(money(F.col("a")).alias("total_assets"), money(F.col("l")).alias("total_liabilities"), money(F.col("a") - F.col("l")).alias("net_worth"))


def history(snapshots: DataFrame, manual: DataFrame, liabilities_total: float = 0.0, months: int = 6) -> DataFrame:
    """Net worth at each month's last snapshot. Manual assets count in every month and replace snapshot assets of the
    same name. Overview balances play no part here."""
    rows = last_per_month(snapshots, "snapshot_date")
    names = manual.select(name_key(F.col("name")).alias("__key")).distinct()
    rows = rows.withColumn("__key", name_key(F.col("instrument_id"))).join(names, "__key", "left_anti")
    own = manual.agg(F.coalesce(F.sum(F.col("value").cast(EXACT)), F.lit(0)).alias("__own"))
    points = last_per_month(snapshots, "snapshot_date").select("month", "snapshot_date").distinct()
    sums = rows.groupBy("month").agg(F.sum(F.col("market_value").cast(EXACT)).alias("__s"))
    out = points.join(sums, "month", "left").crossJoin(F.broadcast(own))  # one row
    out = out.select(F.col("snapshot_date").alias("as_of"), (money(F.coalesce("__s", F.lit(0)) + F.col("__own")) - F.lit(float(liabilities_total))).alias("net_worth"))
    return out.orderBy(F.desc("as_of")).limit(months).orderBy("as_of")


@dataclass(frozen=True)
class Event:
    """``expense``: once, on ``date``. ``swap``: ``remove`` becomes ``add_*`` on ``date``. ``monthly``: from ``start`` to ``end``."""

    name: str
    kind: str
    amount: float = 0.0
    date: str | None = None
    start: str | None = None
    end: str | None = None
    remove: str | None = None
    add_name: str | None = None
    add_category: str = "financial"
    add_value: float = 0.0


@dataclass(frozen=True)
class Assumptions:
    savings_per_month: float = 0.0
    returns: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    liability_rate_delta: float = 0.0
    events: tuple[Event, ...] = ()


def assumptions_from_config(config: Mapping) -> Assumptions:
    """From a parsed scenarios document: ``assumptions`` and ``lifecycle_events`` of the three kinds."""
    a = config.get("assumptions") or {}
    events = []
    for e in config.get("lifecycle_events") or ():
        if "one_time_expense" in e:
            events.append(Event(e["name"], "expense", e["one_time_expense"], date=str(e["date"])))
        elif "monthly_net_expense" in e:
            events.append(Event(e["name"], "monthly", e["monthly_net_expense"], start=str(e["start"]), end=str(e["end"]) if e.get("end") else None))
        elif "remove" in e and "add" in e:
            to = e["add"]
            events.append(Event(e["name"], "swap", date=str(e["date"]), remove=e["remove"], add_name=to["name"], add_category=to["category"], add_value=to["value"]))
        else:
            raise ValueError(f"{e.get('name', 'unnamed')}: an event of no known kind")
    return Assumptions(a.get("default_savings_per_month", 0), a.get("asset_returns") or {}, a.get("liability_rate_delta", 0.0), tuple(events))


def add_month(d: dt.date) -> dt.date:
    """The same day a month later, or that month's last day. Repeated steps keep a day that has been cut."""
    year, month = (d.year + 1, 1) if d.month == 12 else (d.year, d.month + 1)
    last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(year, month, min(d.day, last))


SAVINGS = "Projected savings"


def _fold(scenario: str, assets: dict[str, list], debts: list[list], a: Assumptions, start: dt.date, years: int) -> Iterator[tuple]:
    """Month by month: growth, interest, savings, events; two decimals after every step."""
    day, fired = start, set()

    def save(amount: float) -> None:
        if amount:
            bucket = assets.setdefault(SAVINGS.lower(), ["financial", 0.0])
            bucket[1] = round(bucket[1] + float(amount), 2)

    def events(before: dt.date | None) -> int:
        hits = 0
        for e in a.events:
            if e.kind == "monthly":
                begins, ends = dt.date.fromisoformat(e.start), dt.date.fromisoformat(e.end) if e.end else None
                if before is None or not (begins <= day and (ends is None or ends > before)):
                    continue
                save(-e.amount)
            else:
                on = dt.date.fromisoformat(e.date)
                if (e.kind, e.name, e.date) in fired or not (on == day if before is None else before < on <= day):
                    continue
                fired.add((e.kind, e.name, e.date))
                if e.kind == "expense":
                    save(-e.amount)
                else:
                    if e.remove.strip().lower() not in assets:
                        raise ValueError(f"{e.name}: there is no asset {e.remove!r} to replace on {e.date}")
                    del assets[e.remove.strip().lower()]
                    assets[e.add_name.strip().lower()] = [e.add_category, float(e.add_value)]
            hits += 1
        return hits

    def point(hits: int) -> tuple:
        have, owe = round(sum(v[1] for v in assets.values()), 2), round(sum(d[0] for d in debts), 2)
        return scenario, day.isoformat(), have, owe, round(have - owe, 2), hits

    yield point(events(None))
    for _ in range(years * 12):
        before, day = day, add_month(day)
        for v in assets.values():
            v[1] = round(v[1] * (1.0 + a.returns.get(v[0], {}).get(scenario, 0.0) / 12.0), 2)
        for d in debts:
            rate = 0.0 if d[1] is None else (d[1] / 100.0 if abs(d[1]) > 1.0 else d[1]) + a.liability_rate_delta
            d[0] = round(d[0] * (1.0 + max(rate, 0.0) / 12.0), 2)
        save(a.savings_per_month)
        yield point(events(before))


def forecast(assets: DataFrame, liabilities: DataFrame, assumptions: Assumptions, *, start: str, years: int, scenarios: Sequence[str] = ("bear", "base", "bull")) -> DataFrame:
    """One row per scenario and month. A scenario's position is a handful of named assets, so each one folds in one task."""
    if years < 1:
        raise ValueError("years must be 1 or more")
    ship_package(assets.sparkSession)
    begin = dt.date.fromisoformat(start)
    value = F.col("value").cast("double")
    rate = F.col("rate").cast("double") if "rate" in liabilities.columns else F.lit(None).cast("double")
    rows = assets.select(F.lit(True).alias("is_asset"), "name", "category", value.alias("value"), F.lit(None).cast("double").alias("rate")).unionByName(
        liabilities.select(F.lit(False).alias("is_asset"), "name", F.lit(None).cast("string").alias("category"), value.alias("value"), rate.alias("rate"))
    )
    rows = rows.withColumn("scenario", F.explode(F.array(*map(F.lit, scenarios))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["is_asset", "name"])
        own = {r.name.strip().lower(): [r.category, float(r.value)] for r in pdf[pdf.is_asset].itertuples(index=False)}
        owed = [[float(r.value), None if pd.isna(r.rate) else float(r.rate)] for r in pdf[~pdf.is_asset].itertuples(index=False)]
        cols = ["scenario", "date", "total_assets", "total_liabilities", "net_worth", "events"]
        return pd.DataFrame(list(_fold(pdf.scenario.iloc[0], own, owed, assumptions, begin, years)), columns=cols)

    schema = "scenario string, date string, total_assets double, total_liabilities double, net_worth double, events int"
    return rows.groupBy("scenario").applyInPandas(run, schema)


def forecast_summary(projections: DataFrame, years: int, target: float | None = None) -> DataFrame:
    first, last = F.min_by("net_worth", "date"), F.max_by("net_worth", "date")
    reached = F.min(F.when(F.col("net_worth") >= F.lit(target), F.col("date"))) if target is not None else F.lit(None).cast("string")
    out = projections.groupBy("scenario").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), first.alias("start_net_worth"), last.alias("end_net_worth"), F.sum("events").alias("events_count"), reached.alias("target_reached_at")
    )
    growth: Column = F.round(F.pow(F.col("end_net_worth") / F.col("start_net_worth"), F.lit(1.0 / years)) - 1, 6)
    return out.withColumn("cagr", F.when((F.col("start_net_worth") > 0) & (F.col("end_net_worth") > 0), growth)).orderBy("scenario")
