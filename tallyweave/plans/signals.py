"""Status counters, suggestions, gap analysis, budgets, recurring obligations, review pressure, audit statistics, posture."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import mask_digits, match_pattern, merchant_key
from ..operators.filters import is_consumption, is_expense, is_spending, low_confidence, needs_attention, untagged
from ..operators.joins import nearest_by_mean, with_bounds
from ..schema import UNCATEGORISED, blank_to_null
from .templates import money


def status_metrics(tx: DataFrame) -> DataFrame:
    """All counters of the status page in one pass."""
    transfer, bare = F.col("is_transfer_bool"), untagged()
    candidate = F.coalesce("is_transfer_candidate", F.lit(0)) == 1
    return tx.agg(
        F.count("*").alias("total_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_if(bare).alias("untagged_count"),
        F.count_if(bare & ~transfer).alias("suggestable_untagged_count"),
        F.count_if(candidate).alias("transfer_candidate_count"),
        F.count_if(transfer).alias("transfer_excluded_count"),
        F.count_if(transfer & bare).alias("transfer_excluded_untagged_count"),
        F.greatest(F.count_if(candidate) - F.count_if(transfer), F.lit(0)).alias("unconfirmed_transfer_candidate_count"),
    )


def top_untagged_merchants(tx: DataFrame, top_n: int = 10) -> DataFrame:
    rows = tx.where(untagged() & blank_to_null(F.col("merchant_raw")).isNotNull())
    return rows.groupBy("merchant_raw").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "merchant_raw").limit(top_n)


def suggestion_coverage(tx: DataFrame) -> DataFrame:
    transfer, bare = F.col("is_transfer_bool"), untagged()
    out = tx.agg(
        F.count("*").alias("total_count"),
        F.count_if(bare).alias("untagged_count"),
        F.count_if(~transfer).alias("suggestable_total_count"),
        F.count_if(~transfer & bare).alias("suggestable_untagged_count"),
        F.count_if(transfer).alias("transfer_excluded_count"),
        F.count_if(transfer & bare).alias("transfer_excluded_untagged_count"),
    )
    share = lambda n, k: F.when(F.col(n) > 0, F.round((F.col(n) - F.col(k)) / F.col(n) * 100, 2)).otherwise(0.0)
    return out.withColumns({"coverage_before_pct": share("total_count", "untagged_count"), "suggestable_coverage_before_pct": share("suggestable_total_count", "suggestable_untagged_count")})


def _named(tx: DataFrame) -> DataFrame:
    name = F.col("merchant_raw")
    return tx.where(~F.col("is_transfer_bool") & blank_to_null(name).isNotNull() & ~name.rlike("^[0-9]+$"))


MEMO_SAMPLE = 3


def merchant_context(tx: DataFrame, min_count: int = 2, limit: int = 50, file_id: str | None = None) -> DataFrame:
    """What is known of each untagged merchant. Ties of modes go to the smallest value. ``sample_memos`` is a sample: the
    three most frequent memos, then by text; memos are counted before they are put together, and for the merchants shown
    only, so a gateway with millions of them costs three."""
    rows = _named(tx).where(untagged())
    if file_id is not None:
        rows = rows.where(F.col("file_id") == file_id)
    size = F.abs("amount").cast("double")
    hour = F.substring("time", 1, 2).try_cast("int")
    out = rows.groupBy(F.col("merchant_raw").alias("merchant")).agg(
        F.count("*").alias("transaction_count"),
        money(F.sum(F.abs("amount"))).alias("total_amount"),
        (money(F.sum(F.abs("amount"))) / F.count("*")).alias("avg_amount"),
        F.round(F.coalesce(F.stddev_samp(size), F.lit(0.0)), 2).alias("amount_stddev"),
        F.array_join(F.array_sort(F.collect_set("month")), ",").alias("active_months"),
        F.mode("major_raw", True).alias("major_raw"),
        F.mode("minor_raw", True).alias("minor_raw"),
        F.mode("account", True).alias("payment_method"),
        (F.count_if(F.weekday(F.to_date("date")) < 5) / F.count("*")).alias("weekday_pct"),
        (F.count_if(hour.between(11, 13)) / F.count("*")).alias("lunch_pct"),
        (F.count_distinct("month") >= 2).alias("is_recurring"),
    )
    out = out.where(F.col("transaction_count") >= min_count).orderBy(F.desc("transaction_count"), "merchant").limit(limit)
    memo = blank_to_null(F.col("memo_raw"))
    memos = rows.select(F.col("merchant_raw").alias("of"), memo.alias("memo")).where("memo is not null").groupBy("of", "memo").agg(F.count("*").alias("n"))
    memos = memos.join(out.select(F.col("merchant").alias("of")), "of", "left_semi")
    memos = memos.withColumn("r", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("n"), "memo"))).where(F.col("r") <= MEMO_SAMPLE)
    memos = memos.groupBy("of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "memo"))), lambda x: x["memo"]), ",").alias("sample_memos"))
    out = out.join(memos, F.col("merchant") == F.col("of"), "left").drop("of").withColumn("sample_memos", F.coalesce("sample_memos", F.lit("")))
    return out.orderBy(F.desc("transaction_count"), "merchant")


def tagged_merchants(tx: DataFrame) -> DataFrame:
    category = F.coalesce(*[blank_to_null(F.col(c)) for c in ("category_rule", "minor_raw", "major_raw")], F.lit(UNCATEGORISED))
    rows = _named(tx).where(~untagged())
    out = rows.groupBy(F.col("merchant_raw").alias("merchant"), category.alias("category")).agg(
        (money(F.sum(F.abs("amount"))) / F.count("*")).alias("avg_amount"), F.count("*").alias("transaction_count")
    )
    return out.where("transaction_count >= 2")


def similar_merchants(tx: DataFrame, min_count: int = 2, top: int = 3) -> DataFrame:
    """For each untagged merchant the tagged ones with the nearest mean amounts."""
    rows = _named(tx).where(untagged()).groupBy(F.col("merchant_raw").alias("merchant"))
    left = rows.agg((money(F.sum(F.abs("amount"))) / F.count("*")).alias("avg_amount"), F.count("*").alias("n")).where(F.col("n") >= min_count)
    return nearest_by_mean(left, tagged_merchants(tx).select("merchant", "avg_amount", "category"), name="merchant", value="avg_amount", top=top)


def merchant_clusters(tx: DataFrame, min_names: int = 2) -> DataFrame:
    """Spellings of one merchant: names that are equal without case, spaces and marks."""
    out = _named(tx).groupBy(merchant_key(F.col("merchant_raw")).alias("cluster")).agg(
        F.count_distinct("merchant_raw").alias("names"), F.count("*").alias("transaction_count"), F.min("merchant_raw").alias("first_name")
    )
    return out.where(F.col("names") >= min_names).orderBy(F.desc("transaction_count"), "cluster")


# Payment gateways, whose names say nothing of the purchase, as they are without spaces and marks; what the
# names of others begin with; the priority of a suggested rule, and what a recurring charge adds to it.
GATEWAYS = (
    "KGINICIS 이니시스 케이지이니시스 NHNKCP KCP 엔에이치엔케이씨피 토스페이먼츠 TOSSPAYMENTS 나이스페이먼츠 NICEPAYMENTS KICC 한국정보통신 ALIPAY ALIPAYCONNECT ANOMALY"
).split()
GATEWAY_STARTS = ("PAYPAL*", "PAYPAL *", "STRIPE*", "STRIPE *")
SUGGESTED_PRIORITY, RECURRING_BOOST = 80, 5


def is_gateway(name: Column) -> Column:
    starts = F.lit(False)
    for x in GATEWAY_STARTS:
        starts = starts | F.upper(F.trim(name)).startswith(x)
    return F.upper(merchant_key(name)).isin(*GATEWAYS) | starts


def covered_by(pattern: Column, merchant: Column, known: Sequence[str]) -> Column:
    """A known rule's word stands in the merchant's name or its pattern, or holds the pattern."""
    words = sorted({w.lower() for k in known for w in k.split("|") if w})
    name, own = F.lower(merchant), F.lower(pattern)
    return F.exists(F.array(*map(F.lit, words)), lambda w: name.contains(w) | own.contains(w) | w.contains(own)) if words else F.lit(False)


def rule_suggestions(tx: DataFrame, patterns: Sequence[str] = (), names: Sequence[str] = (), min_count: int = 2, top_n: int = 10, file_id: str | None = None) -> DataFrame:
    """Rule proposals for the most frequent untagged merchants that no rule covers (``patterns``): what kind of merchant it
    is, what to do by default, and the rule itself. A rule's name is that of the merchant, numbered where it is taken."""
    out = merchant_context(tx, min_count, max(top_n * 20, top_n), file_id)
    out = out.withColumn("pattern", match_pattern(F.col("merchant"))).where(~covered_by(F.col("pattern"), F.col("merchant"), patterns))
    out = out.orderBy(F.desc("transaction_count"), "merchant").limit(top_n)
    minor, major = blank_to_null(F.col("minor_raw")), blank_to_null(F.col("major_raw"))
    stem = F.trim(F.regexp_replace(F.lower("merchant"), "[^a-z0-9가-힣]+", "_"), F.lit("_"))
    base = F.concat(F.lit("suggested_"), F.coalesce(F.nullif(F.substring(stem, 1, 30), F.lit("")), F.lit("unknown")))
    nth = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("transaction_count"), "merchant"))
    taken = F.array(*map(F.lit, names)).cast("array<string>")
    numbered = F.transform(F.sequence(F.lit(1), F.col("nth") + len(names)), lambda k: F.when(k == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), k.cast("string"))))
    free = F.filter(numbered, lambda x: ~F.array_contains(taken, x))
    gateway = is_gateway(F.col("merchant"))
    out = out.withColumn("base", base).withColumn("nth", nth)
    return out.select(
        "merchant", "transaction_count", "total_amount", "pattern",
        F.when(gateway, "payment_gateway").otherwise("merchant").alias("merchant_kind"),
        F.when(gateway, "payment_gateway").alias("ambiguous_reason"),
        F.when(gateway, "skip_rule").otherwise("create_rule").alias("default_action"),
        (~gateway).alias("auto_apply_eligible"),
        F.element_at(free, F.col("nth")).alias("rule_name"),
        F.coalesce(minor, major, F.lit(UNCATEGORISED)).alias("category"),
        F.when(F.coalesce(minor, major).isNull(), F.lit(UNCATEGORISED)).otherwise(F.array_join(F.array_distinct(F.array_compact(F.array(minor, major))), ",")).alias("tags"),
        (F.lit(SUGGESTED_PRIORITY) + F.when(F.col("is_recurring"), RECURRING_BOOST).otherwise(0)).alias("priority"),
        "sample_memos",
    ).orderBy(F.desc("transaction_count"), "merchant")


def gap_analysis(tx: DataFrame, expected: Mapping[str, str] | None = None) -> DataFrame:
    """Tags against bank categories per merchant, judged by the merchant's first row in time.

    ``expected`` maps a tag to its category ``major:minor``; the first mapped tag decides. No tags: CRITICAL. Equal:
    COMPLETE. A bank category with 기타: MISMATCH. Else PARTIAL; of several tags one of which fits, it is noise."""
    rows = tx.where(blank_to_null(F.col("merchant_raw")).isNotNull())
    first = F.min_by(F.struct("tags_list", "major_raw", "minor_raw"), F.struct("datetime", "row_hash"))
    out = rows.groupBy("merchant_raw").agg(F.count("*").alias("transaction_count"), money(F.abs(F.sum("amount"))).alias("total_amount"), first.alias("f"))
    tags = F.coalesce("f.tags_list", F.array().cast("array<string>"))
    raw = F.concat(F.coalesce("f.major_raw", F.lit("기타")), F.lit(":"), F.coalesce("f.minor_raw", F.lit("기타")))
    pairs = [x for kv in (expected or {}).items() for x in map(F.lit, kv)]
    known = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    mapped = F.filter(F.transform(tags, lambda t: F.try_element_at(known, t)), lambda c: c.isNotNull())
    out = out.select("merchant_raw", "transaction_count", "total_amount", tags.alias("tags"), raw.alias("category"), mapped.alias("mapped"))
    wanted = F.coalesce(F.get("mapped", F.lit(0)), F.lit("기타:기타"))
    other = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    noise = (F.size("tags") > 1) & F.array_contains("mapped", F.col("category")) & (F.col("category") != wanted)
    conflict = (other(F.col("category")) != other(wanted)) & (other(F.col("category")) != "기타") & (other(wanted) != "기타")
    bare, same = F.size("tags") == 0, F.col("category") == wanted
    gap = F.when(bare, "CRITICAL").when(same, "COMPLETE").when(F.col("category").contains("기타"), "MISMATCH").otherwise("PARTIAL")
    severity = F.when(bare | same, "none").when(noise, "low").when(conflict, "high").otherwise("medium")
    out = out.select(
        "merchant_raw", "transaction_count", "total_amount", F.array_join("tags", ",").alias("tags"), "category",
        F.when(~bare, wanted).alias("expected_category"), gap.alias("gap_type"), severity.alias("severity"), (bare | same | ~noise).alias("actionable"),
    )
    return out.orderBy(F.desc("transaction_count"), "merchant_raw")


def coverage_simulation(tx: DataFrame, top_n: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Coverage if the most frequent untagged merchants had rules. Only the top merchants are ranked."""
    base = tx.agg(F.count("*").alias("total"), F.count_if(~untagged()).alias("tagged"))
    counts = tx.where(untagged()).groupBy("merchant_raw").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("merchant_raw").asc_nulls_last()).limit(max(top_n))
    ranked = counts.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), F.col("merchant_raw").asc_nulls_last())))
    gains = ranked.agg(*[F.coalesce(F.sum(F.when(F.col("r") <= k, F.col("n"))), F.lit(0)).alias(f"g{k}") for k in top_n])
    both = with_bounds(base, gains)
    item = lambda k: F.struct(F.lit(k).cast("long").alias("top_n"), (F.col("tagged") + F.col(f"g{k}")).alias("expected_tagged"))
    out = both.select("total", "tagged", F.explode(F.array(*map(item, top_n))).alias("x")).select("total", "tagged", "x.*")
    share = lambda c: F.when(F.col("total") > 0, c / F.col("total") * 100).otherwise(0.0)
    after, before = share(F.col("expected_tagged")), share(F.col("tagged"))
    return out.select("top_n", "expected_tagged", F.round(after, 4).alias("expected_coverage_pct"), F.round(after - before, 4).alias("improvement_pct"))


def budget_status(tx: DataFrame, targets: DataFrame, month: str, consumption_only: bool = True) -> DataFrame:
    """Spending of a month against targets (``category``, ``target``): under, on-track from 90 %, over above 100 %, or unbudgeted."""
    rows = tx.where((is_consumption() if consumption_only else is_expense()) & (F.col("month") == month))
    label = F.coalesce(blank_to_null(F.col("category_final")), F.lit(UNCATEGORISED))
    actual = rows.groupBy(label.alias("category")).agg(F.round(-F.sum("amount"), 0).cast("long").alias("actual"))
    both = targets.select("category", F.col("target").cast("long").alias("target")).join(actual, "category", "full")
    both = both.withColumn("actual", F.coalesce("actual", F.lit(0)))
    used = F.when(F.col("target") > 0, F.round(F.col("actual") / F.col("target") * 100, 1))
    state = (
        F.when(F.col("target").isNull(), "unbudgeted").when(F.col("actual") > F.col("target"), "over")
        .when(F.col("actual") >= 0.9 * F.col("target"), "on-track").otherwise("under")
    )
    return both.select("category", "target", "actual", (F.col("target") - F.col("actual")).alias("remaining"), used.alias("used_pct"), state.alias("status")).orderBy("category")


def budget_name_hints(targets: DataFrame, categories: DataFrame) -> DataFrame:
    """Unmatched targets beside categories that contain their name or are contained in it. Both sides are name lists
    that people keep by hand; the broadcast side is cut off at a thousand targets by an error."""
    n = targets.limit(1001).count()
    if n > 1000:
        raise ValueError("more than a thousand budget targets")
    loose = targets.select("category").join(categories.select("category"), "category", "left_anti").withColumnRenamed("category", "target")
    a, b = F.lower("target"), F.lower("category")
    return categories.select("category").join(F.broadcast(loose), a.contains(b) | b.contains(a)).select("target", "category")


def recurring_obligations(
    tx: DataFrame, label: Column | None = None, known: Sequence[str] = (), min_months: int = 6, min_mean: float = 300_000, max_range: float = 0.4
) -> DataFrame:
    """Labels charged in every month of at least six in a row, at about the same amount."""
    name = label if label is not None else mask_digits(F.coalesce(blank_to_null(F.col("merchant_raw")), blank_to_null(F.col("category_final")), F.lit(UNCATEGORISED)))
    monthly = tx.where(is_expense()).groupBy(name.alias("label"), "month").agg((-F.sum("amount")).alias("total"))
    ordinal = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
    out = monthly.groupBy("label").agg(
        F.count("*").alias("months"), (F.max(ordinal) - F.min(ordinal) + 1).alias("span"), money(F.sum("total")).alias("sum"),
        money(F.min("total")).alias("low"), money(F.max("total")).alias("high"), F.min("month").alias("first_month"), F.max("month").alias("last_month"),
    )
    spread = F.when(F.col("high") > 0, (F.col("high") - F.col("low")) / F.col("high"))
    out = out.where((F.col("months") >= min_months) & (F.col("span") == F.col("months"))).withColumn("range", spread)
    out = out.where((F.col("sum") / F.col("months") >= min_mean) & (F.col("range") <= max_range))
    if known:
        out = out.where(~F.lower("label").isin(*[k.lower() for k in known]))
    return out.select("label", "months", "first_month", "last_month", F.round(F.col("sum") / F.col("months"), 2).alias("monthly_mean"), F.round("range", 4).alias("range")).orderBy("label")


def review_pressure(tx: DataFrame, threshold: float = 0.7) -> DataFrame:
    return tx.agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce("needs_review", F.lit(0)) == 1).alias("flagged"),
        F.count_if(untagged()).alias("untagged"),
        F.count_if(low_confidence(threshold)).alias("low_confidence"),
        F.count_if(F.trim(F.coalesce("category_final", F.lit(""))).isin("", UNCATEGORISED)).alias("uncategorised"),
        F.count_if(needs_attention()).alias("queue"),
    )


def review_queue(tx: DataFrame, limit: int = 50) -> DataFrame:
    rows = tx.where(needs_attention()).select("row_hash", "date", "merchant_raw", money(F.col("amount")).alias("amount"), "confidence")
    return rows.orderBy(F.col("confidence").asc_nulls_first(), F.desc("date"), "row_hash").limit(limit)


def large_transactions(tx: DataFrame, threshold: float, top: int = 5) -> DataFrame:
    """The largest rows beside the count of all that reach the threshold. Without any, one row with the count 0 alone."""
    rows = tx.where(is_spending() & (F.abs("amount") >= threshold))
    total = rows.agg(F.count("*").alias("count"))
    shown = rows.orderBy(F.desc(F.abs("amount")), "row_hash").limit(top).select("row_hash", "date", "merchant_raw", money(F.abs("amount")).alias("amount"))
    both = total.withColumn("__one", F.lit(1)).join(shown.withColumn("__one", F.lit(1)), "__one", "left")  # one row and at most ``top``
    return both.select(*shown.columns, "count")


def template_domain(domain: Column, name: Column) -> Column:
    given = F.lower(F.trim(domain))
    return F.when(given.isin("asset", "transaction"), given).when(F.coalesce(name, F.lit("")).startswith("asset_"), "asset").otherwise("transaction")


def audit_stats(events: DataFrame, order: Sequence[str] = ("timestamp", "event_id")) -> DataFrame:
    """Per domain: runs, successes, mean duration, and retries: a failed run that the same template with the same
    parameters follows at once. The log has one order, so ``lag`` runs over all of it; it is cut to whole days
    first, and a day's first run looks at the last one of the day before."""
    rows = events.withColumn("domain", template_domain(F.col("template_domain"), F.col("template_name"))).withColumn("__day", F.to_date(order[0]))
    by_day = Window.partitionBy("__day").orderBy(*order)
    cols = ("template_name", "param_fingerprint", "success", "domain")
    before = F.lag(F.struct(*cols)).over(by_day)
    rows = rows.withColumn("__prev", before)
    # the last run of each day, handed to the next day that has runs: one row per day
    last = rows.groupBy("__day").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__last"))
    last = last.select(F.lead("__day").over(Window.orderBy("__day")).alias("__day"), "__last").where("__day is not null")
    rows = rows.join(last, "__day", "left").withColumn("__prev", F.coalesce("__prev", "__last"))
    retry = (
        F.col("__prev.template_name").eqNullSafe(F.col("template_name"))
        & F.col("__prev.param_fingerprint").eqNullSafe(F.col("param_fingerprint"))
        & F.coalesce(F.col("__prev.success") == F.lit(False), F.lit(False))
        & F.col("__prev").isNotNull()
    )
    good = F.coalesce(F.col("success"), F.lit(False))
    runs = rows.groupBy("domain").agg(
        F.count("*").alias("runs"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"),
        F.round(F.sum(F.coalesce("duration", F.lit(0.0)).cast("decimal(18,4)")).cast("double") / F.count("*"), 4).alias("avg_duration"),
    )
    retries = rows.where(retry).groupBy(F.col("__prev.domain").alias("domain")).agg(F.count("*").alias("retry_attempts"), F.count_if(good).alias("recovered_retries"))
    out = runs.join(retries, "domain", "left").na.fill(0, ["retry_attempts", "recovered_retries"])
    rate = F.when(F.col("retry_attempts") > 0, F.round(F.col("recovered_retries") / F.col("retry_attempts"), 4)).otherwise(0.0)
    return out.withColumns({"success_rate": F.round(F.col("succeeded") / F.col("runs"), 4), "recovery_rate": rate}).orderBy("domain")


def freshness(tables: Mapping[str, tuple[DataFrame, str, int]], today: str) -> DataFrame:
    """Per domain the days since its latest date against a threshold: missing, fresh or stale."""
    out: DataFrame | None = None
    for domain, (df, column, most) in tables.items():
        row = df.agg(F.max(F.to_date(F.col(column).cast("string"))).alias("latest")).select(F.lit(domain).alias("domain"), "latest", F.lit(most).alias("threshold_days"))
        out = row if out is None else out.unionByName(row)
    days = F.datediff(F.lit(today).cast("date"), "latest")
    state = F.when(F.col("latest").isNull(), "missing").when(days > F.col("threshold_days"), "stale").otherwise("fresh")
    return out.select("domain", F.date_format("latest", "yyyy-MM-dd").alias("latest"), days.alias("days_since"), "threshold_days", state.alias("status"))


def top_commands(events: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent commands of the audit log; events without one do not count."""
    return events.where(F.col("command").isNotNull()).groupBy("command").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "command").limit(top)


def networth_posture(position: DataFrame, target: float | None = None) -> DataFrame:
    """State of a net worth (``total_assets``, ``total_liabilities``, ``net_worth``, one row or, without any data, none)."""
    worth, goal = F.col("net_worth"), F.lit(target).cast("double")
    state = (
        F.when(worth.isNull() | (F.col("total_assets").isNull() & F.col("total_liabilities").isNull()), "missing_data")
        .when(worth < 0, "negative").when(goal.isNotNull() & (worth >= goal), "on_target").when(goal.isNotNull(), "tracking").otherwise("healthy")
    )
    one = position.agg(*[F.max(c).alias(c) for c in ("total_assets", "total_liabilities", "net_worth")])
    out = one.select(F.lit("networth").alias("domain"), state.alias("status"), "net_worth", goal.alias("target"), (goal - worth).alias("gap_to_target"))
    return out.withColumn("actionable", F.col("status").isin("missing_data", "negative"))


def obligations_posture(tx: DataFrame, **options: object) -> DataFrame:
    """Whether recurring charges wait to be confirmed: empty ledger, needs_confirmation, or healthy."""
    rows = tx.agg(F.count("*").alias("rows"))
    found = recurring_obligations(tx, **options).agg(F.count("*").alias("candidates"))
    state = F.when(F.col("rows") == 0, "empty").when(F.col("candidates") > 0, "needs_confirmation").otherwise("healthy")
    out = with_bounds(rows, found).select(F.lit("obligations").alias("domain"), state.alias("status"), "candidates")
    return out.withColumn("actionable", F.col("status") == "needs_confirmation")


def review_posture(tx: DataFrame) -> DataFrame:
    """Rows of the latest month that wait for review: empty, needs_attention, or healthy."""
    by_month = tx.groupBy("month").agg(F.count_if(needs_attention()).alias("waiting"))
    last = by_month.agg(F.max("month").alias("month"), F.max_by("waiting", "month").alias("waiting"))
    state = F.when(F.col("month").isNull(), "empty").when(F.col("waiting") > 0, "needs_attention").otherwise("healthy")
    out = last.select(F.lit("review").alias("domain"), state.alias("status"), "month", F.coalesce("waiting", F.lit(0)).alias("waiting"))
    return out.withColumn("actionable", F.col("status") == "needs_attention")


# What to do about each state, by priority.
ACTIONS = (
    ("freshness", "missing", 1, "import"), ("freshness", "stale", 2, "import"), ("budget", "missing", 2, "budget"), ("budget", "over", 2, "budget"),
    ("networth", "missing_data", 2, "assets"), ("networth", "negative", 1, "assets"), ("review", "needs_attention", 1, "review"), ("obligations", "needs_confirmation", 2, "goals"),
)


def next_actions(posture: DataFrame) -> DataFrame:
    """Prioritised actions for a posture table (``domain``, ``status``), by priority, domain, command."""
    spark: SparkSession = posture.sparkSession
    known = spark.createDataFrame(list(ACTIONS), "domain string, status string, priority int, command string")
    return posture.join(F.broadcast(known), ["domain", "status"]).select("priority", "domain", "command", "status").orderBy("priority", "domain", "command")
