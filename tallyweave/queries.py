"""Registered queries over the star-schema tables: one per operator or group of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .adapters import MONEY, ledger_from_events, ledger_from_orders, read, transactions_source
from .functions import normalize as N
from .operators import filters as P
from .operators import joins as J
from .operators import transfers as X
from .operators.rules import Condition, Rule, apply_rules, matched_rules, rule_cotags, rule_months, rule_preview
from .plans import endpoint, networth, reports, signals, templates
from .plans.templates import money
from .registry import QUERIES, register
from .schema import TAG_COLUMNS, parse_tags

BASE = ("amount", "date", "is_transfer", "transfer_group_id")


def orders_tx(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The transactions view with the columns that a query needs, so unneeded dimensions are not joined."""
    return transactions_source(ledger_from_orders(spark, sf_dir, (*BASE, *columns)))


NON_CONSUMPTION_COLUMNS = ("category_final", "major_raw", "minor_raw", "tags_final")


# ---- templates


@register
def monthly_spend(spark, d):
    return templates.monthly_spend(orders_tx(spark, d))


@register
def monthly_spend_window(spark, d):
    return templates.run_template(orders_tx(spark, d), "monthly_spend", since="1997-03", until="1998-10")


@register
def tag_breakdown(spark, d):
    return templates.tag_breakdown(orders_tx(spark, d, "tags_final"))


@register
def monthly_consumption_summary(spark, d):
    return templates.monthly_consumption_summary(orders_tx(spark, d, "type_norm", *NON_CONSUMPTION_COLUMNS))


@register
def consumption_category_breakdown(spark, d):
    return templates.consumption_category_breakdown(orders_tx(spark, d, "type_norm", *NON_CONSUMPTION_COLUMNS), "1997-05")


@register
def merchant_top_spend(spark, d):
    return templates.merchant_top_spend(orders_tx(spark, d, "type_norm", "merchant_raw", *NON_CONSUMPTION_COLUMNS), "1997-05")


@register
def event_adjusted_spend(spark, d):
    return templates.event_adjusted_spend(orders_tx(spark, d, "type_norm", *NON_CONSUMPTION_COLUMNS), "1997-05", "building, machinery")


@register
def recurring_candidates(spark, d):
    """Amounts are floored to 50,000 and merchants taken by nation: raw ones do not repeat in this data."""
    tx = orders_tx(spark, d, "merchant_raw", "memo_raw", *NON_CONSUMPTION_COLUMNS)
    tx = tx.withColumns({"merchant_raw": F.col("minor_raw"), "amount": (F.floor(F.col("amount") / 50000) * 50000).cast(MONEY)})
    return templates.recurring_candidates(tx, min_occurrences=3, min_amount=5000, top_n=50)


@register
def anomaly_large_txn(spark, d):
    return templates.anomaly_large_txn(orders_tx(spark, d, "row_hash", "merchant_raw", "account", "category_final"), top_n=50)


@register
def card_spend_summary(spark, d):
    return templates.card_spend_summary(orders_tx(spark, d, "account"))


@register
def merchant_monthly_trend(spark, d):
    return templates.merchant_monthly_trend(orders_tx(spark, d, "merchant_raw"), "00001")


@register
def spend_by_weekday_hour(spark, d):
    return templates.spend_by_weekday_hour(orders_tx(spark, d, "time"))


@register
def weekly_anomalies(spark, d):
    return templates.weekly_anomalies(orders_tx(spark, d, "category_final"), period_days=14, threshold_pct=5)


@register
def new_merchants(spark, d):
    return templates.new_merchants(orders_tx(spark, d, "type_norm", "merchant_raw"), days=60)


@register
def spending_comparison(spark, d):
    return templates.spending_comparison(orders_tx(spark, d), period_days=30)


@register
def compare_months(spark, d):
    tx = orders_tx(spark, d, "category_final", "type_norm")
    return templates.run_template(tx, "compare", baseline_months="1996-01..1996-06", current_months="1997-01,1997-02")


@register
def compare_accounts_all_types(spark, d):
    tx = orders_tx(spark, d, "account", "type_norm")
    return templates.compare(tx, ["1996-01"], ["1999-01", "2010-01"], group_by="account", type_norm="all")


@register
def pivot_month_category(spark, d):
    return templates.pivot(orders_tx(spark, d, "category_final"))


@register
def pivot_quarter_count(spark, d):
    return templates.pivot(orders_tx(spark, d, "type_norm"), row="quarter", col="type_norm", value="count", agg="count")


@register
def pivot_tags(spark, d):
    return templates.pivot(orders_tx(spark, d, "account", "tags_final"), row="account", col="tags", agg="max")


@register
def pivot_other_bucket(spark, d):
    """The three largest nations and the rest, by year; its columns depend on the data, so they are put out as rows."""
    out = templates.pivot(orders_tx(spark, d, "minor_raw"), row="year", col="minor_raw", top_n_cols=3)
    return out.unpivot("year", out.columns[1:], "bucket", "value")


# ---- predicates


@register
def confirmed_transfers(spark, d):
    tx = orders_tx(spark, d, "row_hash")
    return tx.groupBy("month").agg(F.count_if("is_transfer_bool").alias("transfers"), F.count_if(~F.col("is_transfer_bool")).alias("others"))


@register
def exclude_transfers_flag_only(spark, d):
    ledger = ledger_from_orders(spark, d, ("amount", "account", "is_transfer"))
    return P.exclude_transfers(ledger).groupBy("account").agg(F.count("*").alias("n"), money(F.sum("amount")).alias("total"))


@register
def non_consumption(spark, d):
    tx = orders_tx(spark, d, *NON_CONSUMPTION_COLUMNS)
    tx = tx.withColumn("minor_raw", F.when(F.col("minor_raw").like("%1%"), F.lit("주식 투자")).otherwise(F.col("minor_raw")))
    return tx.groupBy(P.non_consumption().alias("excluded"), "major_raw").agg(F.count("*").alias("n"))


FILTERS = P.ReportFilters(
    merchants=(P.MerchantExclusion("0000001"), P.MerchantExclusion("customer#000000123", "exact"), P.MerchantExclusion("9{2}$", "regex", since="1998-01-01")),
    categories=(P.CategoryExclusion("MACHINERY"),),
    dates=(P.DateExclusion("1996-02-01", "1996-03-15"),),
)


@register
def report_filter_kept(spark, d):
    tx = FILTERS.apply(orders_tx(spark, d, "merchant_raw", "category_final"))
    return tx.groupBy("month").agg(F.count("*").alias("kept"), money(F.sum("amount")).alias("total"))


@register
def report_filter_excluded(spark, d):
    tx = orders_tx(spark, d, "merchant_raw", "category_final")
    parts = {f"rule_{k}": F.count_if(r.column()) for k, r in enumerate(FILTERS.rules)}
    return tx.agg(F.count_if(FILTERS.matches()).alias("excluded"), *[c.alias(k) for k, c in parts.items()])


@register
def untagged_rows(spark, d):
    tx = orders_tx(spark, d, "tags_final", "account")
    return tx.where(P.untagged()).groupBy("account").agg(F.count("*").alias("n"))


@register
def rule_matched_rows(spark, d):
    tx = orders_tx(spark, d, "tags_rule", "category_rule", "account")
    return tx.where(P.rule_matched()).groupBy("account").agg(F.count("*").alias("n"))


@register
def review_predicates(spark, d):
    tx = orders_tx(spark, d, "tags_final", "category_final", "needs_review", "confidence", "account")
    return tx.groupBy("account").agg(
        F.count_if(P.needs_attention()).alias("attention"), F.count_if(P.low_confidence(0.5)).alias("low"), F.count_if(P.has_tag("building")).alias("tagged")
    )


@register
def search_ilike(spark, d):
    tx = orders_tx(spark, d, "row_hash", "merchant_raw", "memo_raw")
    return P.search(tx, "MEMO 5").select("date", "row_hash", "merchant_raw", "memo_raw")


@register
def date_range_filter(spark, d):
    tx = orders_tx(spark, d, "time", "row_hash", "account")
    return P.filter_range(tx, "1996-05-10", "1996-05-20", ("date", "time", "row_hash", "account"))


@register
def period_filter(spark, d):
    tx = orders_tx(spark, d, "merchant_raw", "row_hash").where(P.in_period("1997-11") & P.merchant_contains("#00000000"))
    return P.order_by(tx, "amount desc nulls last, row_hash asc").select("row_hash", "merchant_raw", money(F.col("amount")).alias("amount"))


# ---- builders and reports


@register
def signed_monthly_spend(spark, d):
    return reports.signed_monthly_spend(orders_tx(spark, d), exclude_transfers=False, exclude_income=False)


@register
def signed_tag_breakdown(spark, d):
    return reports.signed_tag_breakdown(orders_tx(spark, d, "tags_final"), top_n=500)


@register
def top_merchants(spark, d):
    return reports.top_merchants(orders_tx(spark, d, "merchant_raw"), 25)


@register
def account_summary(spark, d):
    return reports.account_summary(orders_tx(spark, d, "account"))


@register
def spend_movers(spark, d):
    return reports.spend_movers(orders_tx(spark, d, "category_final"), 10)


@register
def report_monthly_refunds(spark, d):
    """Every ninth expense counts as a refund."""
    tx = orders_tx(spark, d, "type_norm", "source_row")
    tx = tx.withColumn("amount", F.when(F.col("source_row") % 9 == 0, F.abs("amount")).otherwise(F.col("amount")))
    return reports.report_monthly(tx)


@register
def report_by_tag(spark, d):
    return reports.report_by_tag(orders_tx(spark, d, "type_norm", "tags_final"), 6)


@register
def report_by_category(spark, d):
    return reports.report_by(orders_tx(spark, d, "type_norm", "category_final"), "category_final")


@register
def report_by_account(spark, d):
    return reports.report_by(orders_tx(spark, d, "type_norm", "account"), "account")


@register
def report_transfers(spark, d):
    return reports.report_transfers(orders_tx(spark, d, "time", "merchant_raw", "account", "row_hash"))


@register
def report_top_merchants(spark, d):
    return reports.report_top_merchants(orders_tx(spark, d, "type_norm", "merchant_raw"), 15)


@register
def summary_stats(spark, d):
    return reports.summary_stats(orders_tx(spark, d, "type_norm"))


@register
def date_range(spark, d):
    return reports.date_range(orders_tx(spark, d))


SAVINGS = ("BUILDING", " machinery")


@register
def structural_savings(spark, d):
    return reports.structural_savings(orders_tx(spark, d, "tags_final", "category_final"), SAVINGS)


@register
def savings_rate(spark, d):
    return reports.savings_rate(orders_tx(spark, d, "tags_final"), SAVINGS)


@register
def monthly_income_expense(spark, d):
    return reports.monthly_income_expense(orders_tx(spark, d))


@register
def top_categories(spark, d):
    return reports.top_categories(orders_tx(spark, d, "category_final", "category_rule", "minor_raw", "major_raw"), 8)


# ---- signals


@register
def status_metrics(spark, d):
    return signals.status_metrics(orders_tx(spark, d, "tags_final", "is_transfer_candidate"))


@register
def top_untagged_merchants(spark, d):
    return signals.top_untagged_merchants(orders_tx(spark, d, "tags_final", "merchant_raw"), 20)


@register
def suggestion_coverage(spark, d):
    return signals.suggestion_coverage(orders_tx(spark, d, "tags_final"))


CONTEXT_COLUMNS = ("tags_final", "merchant_raw", "time", "major_raw", "minor_raw", "account", "memo_raw", "category_rule")


@register
def merchant_context(spark, d):
    return signals.merchant_context(orders_tx(spark, d, *CONTEXT_COLUMNS), 2, 200)


@register
def rule_suggestions(spark, d):
    """Customers and, as every eleventh merchant, a payment gateway; a rule for the names that end with 7 is known."""
    tx = orders_tx(spark, d, *CONTEXT_COLUMNS, "source_row")
    tx = tx.withColumn("merchant_raw", F.when(F.col("source_row") % 11 == 3, "KG-Inicis").otherwise(F.concat("minor_raw", F.lit(" "), F.lpad((F.col("source_row") % 20).cast("string"), 2, "0"), F.lit(" ("), F.col("account"), F.lit(")"))))
    return signals.rule_suggestions(tx, patterns=("07",), names=("suggested_kg_inicis",), top_n=60)


@register
def networth_posture(spark, d):
    debts = spark.createDataFrame([("Loan", 120000.0)], "name string, value double")
    worth = networth.net_worth(*networth.position(order_snapshots(spark, d), manual_assets(spark), "1999-12-31", None, debts))
    return signals.networth_posture(worth, 1e12)


@register
def obligations_posture(spark, d):
    return signals.obligations_posture(orders_tx(spark, d, "type_norm", "minor_raw"), label=F.col("minor_raw"), known=("france",), max_range=0.95)


@register
def review_posture(spark, d):
    return signals.review_posture(orders_tx(spark, d, "tags_final", "category_final", "needs_review"))


@register
def top_commands(spark, d):
    return signals.top_commands(read(spark, d, "events").select(F.when(F.col("event_id") % 9 > 0, F.col("event_type")).alias("command")))


@register
def tagged_merchants(spark, d):
    return signals.tagged_merchants(orders_tx(spark, d, *CONTEXT_COLUMNS))


@register
def nearest_merchants(spark, d):
    tx = orders_tx(spark, d, *CONTEXT_COLUMNS).withColumn("merchant_raw", F.when(P.untagged(), F.col("minor_raw")).otherwise(F.concat("minor_raw", F.lit("-"), "account")))
    out = signals.similar_merchants(tx)
    return out.select("name", "near", "category", "rank")


@register
def merchant_clusters(spark, d):
    tx = orders_tx(spark, d, "merchant_raw", "source_row")
    odd = F.when(F.col("source_row") % 2 == 0, F.upper(F.replace("merchant_raw", F.lit("#"), F.lit(" ")))).otherwise(F.col("merchant_raw"))
    return signals.merchant_clusters(tx.withColumn("merchant_raw", odd))


EXPECTED = {"building": "ASIA:INDIA", "machinery": "AMERICA:CANADA", "1-urgent": "EUROPE:FRANCE"}


@register
def gap_analysis(spark, d):
    return signals.gap_analysis(orders_tx(spark, d, "merchant_raw", "tags_final", "major_raw", "minor_raw", "datetime", "row_hash"), EXPECTED)


@register
def coverage_simulation(spark, d):
    return signals.coverage_simulation(orders_tx(spark, d, "tags_final", "merchant_raw"))


def budget_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("BUILDING", 3_000_000), ("MACHINERY", 100), ("FURNITURE", 90_000_000), ("Travel", 5)], "category string, target long")


@register
def budget_status(spark, d):
    return signals.budget_status(orders_tx(spark, d, "type_norm", *NON_CONSUMPTION_COLUMNS), budget_targets(spark), "1997-05")


@register
def budget_name_hints(spark, d):
    names = read(spark, d, "customer").select(F.col("c_mktsegment").alias("category")).distinct()
    targets = spark.createDataFrame([("build",), ("HOUSEHOLD",), ("automobile club",), ("none",)], "category string")
    return signals.budget_name_hints(targets, names)


@register
def recurring_obligations(spark, d):
    tx = orders_tx(spark, d, "type_norm", "minor_raw")
    return signals.recurring_obligations(tx, label=F.col("minor_raw"), known=("france",), max_range=0.95)


@register
def review_pressure(spark, d):
    return signals.review_pressure(orders_tx(spark, d, "tags_final", "category_final", "needs_review", "confidence"))


@register
def review_queue(spark, d):
    return signals.review_queue(orders_tx(spark, d, "row_hash", "merchant_raw", "tags_final", "category_final", "needs_review", "confidence"), 40)


@register
def large_transactions(spark, d):
    return signals.large_transactions(orders_tx(spark, d, "row_hash", "merchant_raw"), 400000, 10)


@register
def retry_recovery(spark, d):
    """Events as an audit log: clicks are asset templates, and every third run fails."""
    e = read(spark, d, "events")
    key = F.col("event_id")
    log = e.select(
        "event_id",
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(F.col("event_type") == "click", "asset_list").otherwise(F.col("event_type")).alias("template_name"),
        F.when(key % 10 == 0, "Asset").alias("template_domain"),
        (key % 2).cast("string").alias("param_fingerprint"),
        (key % 3 != 0).alias("success"),
        F.col("value").alias("duration"),
    )
    same = F.when(F.floor(key / 4) % 2 == 0, "spend").otherwise(F.col("template_name"))
    return signals.audit_stats(log.withColumns({"template_name": same, "param_fingerprint": F.floor(key / 4).cast("string")}))


@register
def freshness(spark, d):
    tx = orders_tx(spark, d)
    events = read(spark, d, "events")
    none = tx.where("date > '2999-01-01'")
    return signals.freshness({"orders": (tx, "date", 30), "events": (events, "ts", 400), "none": (none, "date", 1)}, "2024-12-31")


@register
def next_actions(spark, d):
    tx = orders_tx(spark, d)
    fresh = signals.freshness({"freshness": (tx, "date", 30)}, "2024-12-31").select("domain", "status")
    over = signals.budget_status(orders_tx(spark, d, "type_norm", *NON_CONSUMPTION_COLUMNS), budget_targets(spark), "1997-05").where("status = 'over'")
    return signals.next_actions(fresh.unionByName(over.select(F.lit("budget").alias("domain"), "status").distinct()))


# ---- joins and set operators


@register
def anti_join(spark, d):
    orders, customers = read(spark, d, "orders"), read(spark, d, "customer")
    new = customers.select(F.col("c_custkey").alias("key"), "c_mktsegment")
    old = orders.where("o_totalprice > 100000").select(F.col("o_custkey").alias("key"))
    return J.anti_join(new, old, ["key"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@register
def nullsafe_anti_join(spark, d):
    """Orders whose key and status, which may be null, no returned line of theirs bears."""
    orders, lines = read(spark, d, "orders"), read(spark, d, "lineitem")
    a = orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("s"))
    b = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_orderkey") % 4 == 0, F.lit(None)).otherwise(F.col("l_linestatus")).alias("s"))
    return J.anti_join(a, b, ["k", "s"], null_safe=True).groupBy("s").agg(F.count("*").alias("n"))


@register
def dedup_keep_first(spark, d):
    rows = orders_tx(spark, d, "account", "source_row", "file_id", "row_hash")
    out = J.keep_first(rows, ["account", "month"], ["source_row", "file_id"])
    return out.select("account", "month", "row_hash", money(F.col("amount")).alias("amount"))


def order_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as asset snapshots: month-ends of the order date, account by priority, instrument by status and year."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.date_format(F.last_day(F.col("o_orderdate").cast("timestamp").cast("date")), "yyyy-MM-dd").alias("snapshot_date"),
        F.col("o_orderpriority").alias("account_id"),
        F.concat(F.col("o_orderstatus"), (F.col("o_orderkey") % 5).cast("string")).alias("instrument_id"),
        F.lit(1.0).alias("quantity"),
        F.col("o_totalprice").alias("market_value"),
        F.lit("KRW").alias("currency"),
    )


def manual_assets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Flat", "real_estate", 250000.0), (" f1 ", "cash", 1000.0), ("Car", "other", 9000.5)], "name string, category string, value double")


@register
def asof_snapshot(spark, d):
    rows = J.as_of(order_snapshots(spark, d), "snapshot_date", "1997-07-15")
    return rows.groupBy("snapshot_date", "account_id").agg(F.count("*").alias("n"))


@register
def asset_status(spark, d):
    return networth.asset_status(order_snapshots(spark, d))


@register
def holdings(spark, d):
    return networth.holdings(order_snapshots(spark, d).groupBy("snapshot_date", "account_id", "instrument_id", "currency").agg(F.sum("quantity").alias("quantity"), money(F.sum(F.col("market_value").cast(MONEY))).alias("market_value")), "URGENT")


@register
def merge_precedence(spark, d):
    assets, _ = networth.position(order_snapshots(spark, d), manual_assets(spark), "1999-12-31")
    return assets.select("name", "category", money(F.col("value")).alias("value"), "source")


@register
def networth_position(spark, d):
    debts = spark.createDataFrame([("Loan", 120000.0)], "name string, value double")
    return networth.net_worth(*networth.position(order_snapshots(spark, d), manual_assets(spark), "1999-12-31", None, debts))


@register
def networth_breakdown(spark, d):
    assets, _ = networth.position(order_snapshots(spark, d), manual_assets(spark), "1999-12-31")
    return networth.breakdown(assets)


@register
def networth_history(spark, d):
    return networth.history(order_snapshots(spark, d), manual_assets(spark), 5000.0, 12)


FORECAST = networth.Assumptions(
    savings_per_month=1500,
    returns={"financial": {"bear": -0.02, "base": 0.04, "bull": 0.08}, "real_estate": {"base": 0.02, "bull": 0.03}},
    liability_rate_delta=0.005,
)


@register
def forecast(spark, d):
    """Three scenarios over ten years from the customers' balances by segment."""
    c = read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(money(F.sum(F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast(MONEY))).alias("value"))
    assets = c.select("name", F.when(F.col("name") == "BUILDING", "real_estate").otherwise("financial").alias("category"), "value")
    debts = spark.createDataFrame([("Mortgage", 80000.0, 3.5), ("Card", 1200.0, None)], "name string, value double, rate double")
    return networth.forecast(assets, debts, FORECAST, start="2024-01-31", years=10)


@register
def forecast_summary(spark, d):
    return networth.forecast_summary(forecast(spark, d), 10, 1_000_000.0)


@register
def transfer_candidates(spark, d):
    out = X.candidate_pairs(ledger_from_events(spark, d), tolerance=0.25, window_s=300)
    return out.select("major_raw", "out_row_hash", "in_row_hash", "ratio", "delta_s")


@register
def transfer_pairs(spark, d):
    out = X.match_pairs(X.candidate_pairs(ledger_from_events(spark, d), tolerance=0.25, window_s=300))
    return out.select("out_row_hash", "in_row_hash", "transfer_group_id", "ratio", "delta_s")


@register
def transfer_state(spark, d):
    ledger = ledger_from_events(spark, d)
    out = X.detect_transfers(ledger, tolerance=0.25, window_s=300)
    return out.groupBy("major_raw").agg(F.count("*").alias("n"), F.sum("is_transfer").cast("long").alias("paired"), F.sum("is_transfer_candidate").cast("long").alias("candidates"))


@register
def set_operators(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    n = lambda df, name: df.agg(F.count("*").alias("n"), F.sum("k").alias("total")).withColumn("op", F.lit(name))
    return n(c.intersect(o), "intersect").unionByName(n(c.exceptAll(o), "except")).unionByName(n(c.union(c), "union_all"))


@register
def grouping_sets(spark, d):
    tx = orders_tx(spark, d, "account", "type_norm")
    return tx.rollup("account", "type_norm").agg(F.count("*").alias("n"), money(F.sum("amount")).alias("total"))


@register
def unnest_tags(spark, d):
    tx = orders_tx(spark, d, "row_hash", "tags_final")
    return tx.select("row_hash", F.posexplode("tags_list").alias("pos", "tag"))


# ---- normalisation


@register
def row_hash(spark, d):
    o = ledger_from_orders(spark, d, ("date", "time", "type_raw", "merchant_raw", "amount", "currency", "account", "source_row"))
    h = N.row_hash(*[F.col(c) for c in ("date", "time", "type_raw", "merchant_raw", "amount", "currency", "account")])
    return o.select("source_row", h.alias("row_hash"))


@register
def normalize_type(spark, d):
    o = read(spark, d, "orders").withColumn("raw", F.element_at(F.array(*map(F.lit, ("카드지출", "출금이체", "급여수입", "입금", "계좌이체", "기타", ""))), (F.col("o_orderkey") % 7 + 1).cast("int")))
    o = o.withColumn("type_norm", N.type_norm(F.col("raw"))).withColumn("amount", N.signed_amount(-F.col("o_totalprice").cast(MONEY), F.col("type_norm")))
    return o.groupBy("raw", "type_norm").agg(F.count("*").alias("n"), money(F.sum("amount")).alias("total"), F.count_if(N.amount_suspicious(F.col("amount"))).alias("suspicious"))


@register
def category_chain(spark, d):
    tx = orders_tx(spark, d, "category_final", "category_rule", "minor_raw", "major_raw", "source_row")
    manual = F.when(F.col("source_row") % 23 == 0, " own ")
    return tx.groupBy(N.category_final(manual, F.col("category_rule"), F.when(F.col("source_row") % 3 == 0, F.col("minor_raw")), F.lit(" ")).alias("category")).agg(F.count("*").alias("n"))


@register
def merged_tags(spark, d):
    tx = ledger_from_orders(spark, d, ("source_row", *TAG_COLUMNS))
    arrays = [parse_tags(F.col(c)) for c in ("tags_rule", "tags_manual", "tags_final")]
    manual = F.concat(arrays[1], F.array(F.lit(" rule "), F.lit(""), F.lit(N.CATEGORY_OVERRIDE + "Own")))
    out = tx.select(N.merge_tags(arrays[0], arrays[2], manual).alias("tags"), N.manual_category(manual).alias("category"))
    return out.groupBy(F.array_join("tags", ",").alias("tags"), "category").agg(F.count("*").alias("n"))


@register
def parse_numbers(spark, d):
    p = read(spark, d, "part")
    shown = F.format_number(F.col("p_retailprice"), 2)
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("₩ "), shown)).when(k == 1, F.concat(F.lit("("), shown, F.lit(")"))).when(k == 2, F.concat(F.col("p_size").cast("string"), F.lit("만원"))).otherwise("n/a")
    return p.select("p_partkey", N.parse_number(raw).alias("number"))


@register
def parse_dates(spark, d):
    o = read(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("timestamp"))
    k = F.col("o_orderkey") % 4
    raw = (
        F.when(k == 0, F.date_format("day", "'from 2000-01-01 to' yyyy-MM-dd")).when(k == 1, F.date_format("day", "yyyy'년' M'월' d'일'"))
        .when(k == 2, F.date_format("day", "yyyy.MM.dd HH:mm")).otherwise("2023-13-45")
    )
    out = o.select(N.parse_date(raw).alias("parsed"), N.parse_period_month(raw).alias("period"))
    return out.groupBy(F.date_format("parsed", "yyyy-MM-dd").alias("parsed"), "period").agg(F.count("*").alias("n"))


@register
def derived_ids(spark, d):
    c = read(spark, d, "customer")
    return c.select("c_custkey", N.derived_id(F.col("c_name"), "acc_").alias("account_id"), N.fact_id(F.col("c_name"), F.lit(None), F.col("c_nationkey")).alias("fact_id"))


@register
def clean_times(spark, d):
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "nan").otherwise(F.concat((k % 24).cast("string"), F.lit(":05:59")))
    return o.groupBy(N.clean_time(raw).alias("time")).agg(F.count("*").alias("n"))


@register
def text_cleanup(spark, d):
    c = read(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("="), F.col("c_name"))).otherwise(F.concat(F.col("c_mktsegment"), F.lit(" 강남점 12")))
    return c.select("c_custkey", N.neutralize(name).alias("safe"), N.mask_digits(name).alias("masked"), N.merchant_key(name).alias("key"), N.redact_paths(F.concat(F.lit("see /home/x/y and a.csv "), name)).alias("redacted"))


@register
def export_master(spark, d):
    from .sources.files import export_master as export

    ledger = ledger_from_orders(spark, d)
    ledger = ledger.withColumns({c: parse_tags(F.col(c)) for c in TAG_COLUMNS})
    return export(ledger).select("row_hash", "date", "time", "merchant_raw", "tags_final", "category_final", money(F.col("amount")).alias("amount"))


# ---- rules

RULES = (
    Rule("asia", ("asia", "far"), "Asia", match="asia|japan", fields=("major_raw", "minor_raw"), priority=70),
    Rule("big", ("big",), None, conditions=(Condition("amount", "less_than", -300000),), priority=60),
    Rule("mid", ("mid",), "Middle", conditions=(Condition("amount", "between", (-200000, -100000)), Condition("account", "starts_with", "1-")), priority=60),
    Rule("urgent", ("urgent",), "Urgent", conditions=(Condition("account", "contains", "URGENT"), Condition("memo_raw", "not_contains", "memo 3")), priority=50),
    Rule("any", ("any",), None, conditions=(Condition("minor_raw", "is", "france"), Condition("merchant_raw", "regex", "0{3}7\\d$")), logic="any", priority=40),
    Rule("off", ("off",), "Off", match="a", enabled=False),
    Rule("income", ("income",), "Income", conditions=(Condition("type_norm", "is_not", "expense"), Condition("amount", "greater_than", 250000)), priority=10),
)
RULE_COLUMNS = ("row_hash", "merchant_raw", "memo_raw", "major_raw", "minor_raw", "account", "type_norm")


@register
def tag_rules(spark, d):
    """Tags, category, confidence and review flag of every row under a fixed set of rules."""
    out = apply_rules(orders_tx(spark, d, *RULE_COLUMNS), RULES)
    return out.select("row_hash", F.array_join("tags_final", ",").alias("tags"), "category_rule", "category_final", "confidence", "needs_review")


@register
def explain_rules(spark, d):
    tx = orders_tx(spark, d, *RULE_COLUMNS)
    return tx.groupBy(F.array_join(matched_rules(RULES), ",").alias("rules")).agg(F.count("*").alias("n"))


@register
def rule_dry_run(spark, d):
    return rule_preview(orders_tx(spark, d, "tags_final", *RULE_COLUMNS), RULES[0])


@register
def rule_month_distribution(spark, d):
    return rule_months(orders_tx(spark, d, *RULE_COLUMNS), RULES[2])


@register
def rule_cotags_top(spark, d):
    return rule_cotags(orders_tx(spark, d, "tags_final", *RULE_COLUMNS), RULES[0])


# ---- guarded SQL


@register
def query_page(spark, d):
    orders_tx(spark, d, "account", "merchant_raw").createOrReplaceTempView("transactions")
    sql = "with t as (select account, month, count(*) as n, cast(sum(amount) as double) as total from transactions where not is_transfer_bool group by account, month) select * from t where n > 1"
    return endpoint.page(endpoint.query(spark, sql), 20, 30, ("month", "account"))


# ---- worksheets


def overview_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a balance sheet: assets left, liabilities right."""
    s = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(money(F.sum(F.col("s_acctbal").cast(MONEY))).alias("v"))
    n = read(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    n = n.join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.col("n_nationkey") + 4
    shown = F.coalesce(F.concat(F.format_number("v", 2), F.lit("원")), F.lit("-"))
    cell = lambda at, value: F.struct(row.cast("int").alias("row"), F.lit(at).alias("col"), value.alias("value"))
    body = n.select(F.explode(F.array(cell(2, F.col("r_name")), cell(3, F.col("n_name")), cell(4, shown), cell(6, F.col("r_name")), cell(7, F.concat(F.lit("L "), F.col("n_name"))), cell(8, F.lit("(1,000)")))).alias("c")).select(F.lit("overview").alias("sheet"), "c.*")
    head = [(1, 1, "1. 재무현황"), (3, 2, "항목"), (3, 3, "상품명"), (3, 4, "금액"), (3, 6, "항목"), (3, 7, "상품명"), (3, 8, "금액"), (40, 2, "총자산"), (40, 4, "999"), (45, 1, "2. 보험현황"), (46, 2, "금융사")]
    return body.unionByName(spark.createDataFrame([("overview", *h) for h in head], "sheet string, row int, col int, value string"))


@register
def overview_balance(spark, d):
    from .sources.sheets import balance

    return balance(overview_cells(spark, d), "2024-01-31", "f1").select("side", "category", "item_name", "amount", "source_row")


@register
def overview_facts(spark, d):
    from .sources.sheets import facts

    return facts(overview_cells(spark, d), "2024-01-31", "f1").groupBy("block_id", "value_type").agg(F.count("*").alias("n"), F.count_distinct("fact_id").alias("ids"))


@register
def tpch_q1(spark, d):
    """Pricing summary: a wide aggregation over the largest table."""
    li = read(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    price, disc = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(12,2)")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        money(F.sum(F.col("l_quantity").cast("decimal(12,2)"))).alias("sum_qty"), money(F.sum(price)).alias("sum_base_price"), money(F.sum(price * (1 - disc))).alias("sum_disc_price"), F.count("*").alias("count_order")
    )


del T

from . import store_queries  # noqa: E402,F401  (registers the queries that go through the store and files)
