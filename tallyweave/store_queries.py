"""Registered queries that go through the store, text files and worksheets: what they write lies in the scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import MONEY, ledger_from_orders, read, transactions_source
from .functions import normalize as N
from .operators import filters as P
from .operators.rules import Rule, dry_run, edit_tags
from .plans import networth, run
from .plans.templates import money, monthly_spend
from .registry import register
from .schema import LEDGER_COLUMNS, normalize_ledger
from .session import scratch_path
from .sources import files, sheets
from .sources.store import AppendResult, Store
from .streaming.ingest import ingest, ledger_stream

exact = lambda c: money(F.sum(F.col(c).cast(MONEY)))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as typed ledger rows."""
    return normalize_ledger(ledger_from_orders(spark, sf_dir))


def new_store(spark: SparkSession, name: str) -> Store:
    return Store(spark, scratch_path(spark, name))


def filled(spark: SparkSession, sf_dir: str, name: str) -> Store:
    store = new_store(spark, name)
    store.append("transactions", ledger(spark, sf_dir))
    return store


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even orders; odd ones with every twentieth order, and every seventh once more."""
    rows = ledger(spark, sf_dir)
    again = rows.where("source_row % 20 = 0").unionByName(rows.where("source_row % 7 = 1"))
    return rows.where("source_row % 2 = 0"), rows.where("source_row % 2 = 1").unionByName(again)


def results(spark: SparkSession, **steps: AppendResult) -> DataFrame:
    return spark.createDataFrame([(k, r.new, r.duplicates, r.partitions) for k, r in steps.items()], "step string, new long, duplicates long, partitions long")


# ---- appends, previews, upserts


@register
def append_preview(spark, d):
    first, batch = halves(spark, d)
    store = new_store(spark, "append-preview")
    return results(spark, first=store.append("transactions", first), preview=store.preview("transactions", batch))


@register
def append_results(spark, d):
    first, batch = halves(spark, d)
    store = new_store(spark, "append-results")
    return results(spark, first=store.append("transactions", first), second=store.append("transactions", batch), again=store.append("transactions", batch))


@register
def append_twice(spark, d):
    """What two overlapping batches leave in the store."""
    first, batch = halves(spark, d)
    store = new_store(spark, "append-twice")
    for rows in (first, batch, first):
        store.append("transactions", rows)
    return store.ledger().groupBy("month").agg(F.count("*").alias("n"), F.count_distinct("row_hash").alias("hashes"), exact("amount").alias("total"))


@register
def upsert_moves(spark, d):
    """Every ninth order is doubled and moved to 2002."""
    store = filled(spark, d, "upsert")
    moved = store.read("transactions").where("source_row % 9 = 0")
    store.upsert("transactions", moved.withColumns({"amount": F.col("amount") * 2, "date": F.concat(F.lit("2002"), F.substring("date", 5, 6))}))
    return store.ledger().groupBy("month").agg(F.count("*").alias("n"), exact("amount").alias("total"))


@register
def replace_month(spark, d):
    store = filled(spark, d, "replace")
    rows = store.read_month("transactions", 1997, 5)
    store.write_month("transactions", rows.where("source_row % 2 = 0").withColumn("amount", -F.abs("amount")), 1997, 5)
    return store.ledger().groupBy("month").agg(F.count("*").alias("n"), exact("amount").alias("total"))


# ---- scans


@register
def month_scan(spark, d):
    return filled(spark, d, "month-scan").read_month("transactions", 1996, 5, ["row_hash", "date", "account", "amount"])


@register
def range_scan(spark, d):
    return filled(spark, d, "range-scan").read_range("transactions", "1996-12-20", "1997-01-10", ["row_hash", "date", "merchant_raw"])


@register
def full_scan(spark, d):
    """Two columns of the whole store."""
    return filled(spark, d, "full-scan").read("transactions", ["account", "amount"]).groupBy("account").agg(F.count("*").alias("n"), exact("amount").alias("total"))


@register
def partition_glob(spark, d):
    return filled(spark, d, "glob").read_partitions("transactions", "year=1997/month=*", ["account", "amount"]).groupBy("account").agg(F.count("*").alias("n"), exact("amount").alias("total"))


@register
def store_view_spend(spark, d):
    """A template over the registered view, months pruned."""
    store = filled(spark, d, "view")
    store.register_views(P.ReportFilters(categories=(P.CategoryExclusion("MACHINERY"),)))
    return monthly_spend(spark.table("transactions"), "1996-11", "1997-02")


@register
def index_counts(spark, d):
    store = filled(spark, d, "index")
    return store.index().select("table", "year", "month", F.col("rows").alias("n"))


@register
def row_count(spark, d):
    store = filled(spark, d, "count")
    return spark.createDataFrame([(store.count("transactions"), len(store.validate("transactions")), len(store.months("transactions")))], "n long, problems long, months long")


@register
def point_lookup(spark, d):
    """The order that the first customer placed first, by its hash."""
    store = filled(spark, d, "lookup")
    first = store.read("transactions").agg(F.min_by("row_hash", F.struct("merchant_raw", "date", "source_row")).alias("h")).first()["h"]
    return store.find(first).select("row_hash", "date", "merchant_raw", money(F.col("amount").cast(MONEY)).alias("amount"))


# ---- assets and worksheets


def asset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a holdings sheet with names but without ids."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.date_format(F.last_day(F.col("o_orderdate").cast("timestamp").cast("date")), "yyyy-MM-dd").alias("기준일"),
        F.col("o_orderpriority").alias("계좌명"),
        F.concat(F.lit("fund "), (F.col("o_orderkey") % 40).cast("string")).alias("종목명"),
        F.when(F.col("o_orderkey") % 3 == 0, "USD").when(F.col("o_orderkey") % 3 == 1, " ").alias("통화"),
        F.lit(1.0).alias("수량"),
        F.col("o_totalprice").alias("평가금액"),
        F.col("o_orderkey").alias("source_row"),
    )


@register
def asset_aliases(spark, d):
    out = N.alias_assets(asset_rows(spark, d))
    return out.groupBy("account_id", "currency").agg(F.count("*").alias("n"), F.count_distinct("instrument_id").alias("instruments"), exact("market_value").alias("total"))


@register
def asset_append(spark, d):
    """One row a date, account and instrument stays: the first by row. Read back month by month."""
    store = new_store(spark, "assets")
    rows = asset_rows(spark, d).select("source_row", F.col("기준일").alias("snapshot_date"), F.col("계좌명").alias("account_id"), F.col("종목명").alias("instrument_id"), F.col("수량").alias("quantity"), F.col("평가금액").alias("market_value"))
    for _ in range(2):
        store.append("assets", rows)
    whole = store.read_month("assets", 1997, 5).unionByName(store.read_range("assets", "1997-06-01", "1997-07-31"))
    return whole.groupBy("snapshot_date", "account_id").agg(F.count("*").alias("n"), exact("market_value").alias("total"))


@register
def overview_append(spark, d):
    """Suppliers as balance rows, some without category, appended twice: null keys equal null keys."""
    store = new_store(spark, "overview")
    s = read(spark, d, "supplier")
    rows = s.select(
        F.lit("2024-01-31").alias("snapshot_date"), F.when(F.col("s_acctbal") < 0, "liability").otherwise("asset").alias("side"),
        F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("category"), F.col("s_name").alias("item_name"),
        F.abs("s_acctbal").alias("amount"), F.col("s_suppkey").alias("source_row"),
    )
    for part in (rows.where("source_row % 2 = 0"), rows, rows):
        store.append("balance", part)
    return store.read("balance").groupBy("side", "category").agg(F.count("*").alias("n"), exact("amount").alias("total"))


@register
def balance_sides(spark, d):
    s = read(spark, d, "supplier")
    rows = s.select(F.when(F.col("s_suppkey") % 5 == 0, "2023-12-31").otherwise("2024-01-31").alias("snapshot_date"), F.when(F.col("s_acctbal") < 0, "liability").otherwise("asset").alias("side"), F.abs("s_acctbal").alias("amount"))
    return networth.balance_sides(rows)


@register
def cashflow_months(spark, d):
    """Monthly sums by priority as cash flow; the period decides the month, or the date where there is none."""
    store = new_store(spark, "cashflow")
    o = read(spark, d, "orders").select(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM").alias("m"), F.col("o_orderpriority").alias("category"), "o_totalprice")
    rows = o.groupBy("m", "category").agg(exact("o_totalprice").alias("amount"))
    rows = rows.select(F.concat("m", F.lit("-28")).alias("snapshot_date"), F.when(F.col("category") != "5-LOW", F.col("m")).alias("period_month"), "category", "amount")
    for _ in range(2):
        store.append("cashflow", rows)
    return store.index().where("table = 'cashflow'").select("year", "month", F.col("rows").alias("n"))


def cashflow_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by nation and year as a worksheet: years are months of 2024, nations rows."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = o.groupBy(F.col("c_nationkey").alias("k"), F.year(F.col("o_orderdate").cast("timestamp")).alias("y")).agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("v"))
    cell = lambda row, col, value: (row.cast("int").alias("row"), col.cast("int").alias("col"), value.alias("value"))
    body = sums.select(*cell(F.col("k") + 5, F.col("y") - 1992, F.concat(F.format_number("v", 2), F.lit("원"))))
    names = read(spark, sf_dir, "nation").select(*cell(F.col("n_nationkey") + 5, F.lit(2), F.col("n_name")))
    head = [(2, 1, "3. 현금흐름현황"), (4, 2, "구분"), *[(4, 3 + k, f"2024년 {k + 1}월") for k in range(7)], (60, 1, "4. 보험현황"), (61, 2, "금융사")]
    return body.unionByName(names).unionByName(spark.createDataFrame(head, "row int, col int, value string")).select(F.lit("현황").alias("sheet"), "row", "col", "value")


@register
def sheet_cashflow(spark, d):
    return sheets.cashflow(cashflow_cells(spark, d), "2024-12-31", "f").select("period_month", "category", "amount")


def insurance_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as an insurance table; those whose key ends with 3 lack a name, and rows end after the first two blank ones."""
    s = read(spark, sf_dir, "supplier")
    row = (F.col("s_suppkey") + 12).cast("int")
    cell = lambda col, value: F.struct(row.alias("row"), F.lit(col).alias("col"), value.alias("value"))
    items = F.array(
        cell(2, F.col("s_name")), cell(3, F.when(F.col("s_suppkey") % 10 != 3, F.concat(F.lit("plan "), F.col("s_nationkey").cast("string")))),
        cell(4, F.concat(F.format_number(F.abs("s_acctbal"), 2), F.lit("원"))), cell(5, F.concat(F.lit("2020."), (F.col("s_suppkey") % 12 + 1).cast("string"), F.lit(".5"))),
    )
    body = s.select(F.explode(items).alias("c")).select("c.*").where("value is not null")
    head = [(9, 1, "4. 보험현황"), (11, 2, "금융사"), (11, 3, "보험명"), (11, 4, "총납입금"), (11, 5, "계약일자")]
    return body.unionByName(spark.createDataFrame(head, "row int, col int, value string")).select(F.lit("s").alias("sheet"), "row", "col", "value")


@register
def sheet_insurance(spark, d):
    return sheets.structured(insurance_cells(spark, d), "insurance", "2024-01-31", "f").select("institution", "policy_name", "paid_amount", "contract_date", "source_row")


@register
def sheet_inspect(spark, d):
    cells = cashflow_cells(spark, d).unionByName(insurance_cells(spark, d))
    found = sheets.find_sheet(cells, ["현황"])
    return sheets.inspect(cells).select("sheet", "rows", "cols", "cells", F.array_join("anchors", ",").alias("anchors"), (F.col("sheet") == found).alias("found"))


@register
def snapshot_dates(spark, d):
    """A given date, a labelled cell, the file's name, or its time of change, whichever comes first."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    k, none = F.col("o_orderkey") % 4, F.lit(None).cast("string")
    found = N.snapshot_date(
        F.when(k == 0, F.date_format("at", "yyyy-MM-dd")).otherwise(none), F.when(k <= 1, F.date_format("at", "'as of' yyyy.MM.dd")).otherwise("no date"),
        F.when(k == 2, F.date_format("at", "'export_'yyyy_MM_dd'.xlsx'")).otherwise("export.xlsx"), F.date_add(F.col("at").cast("date"), 1),
    )
    return o.groupBy(F.date_format(found, "yyyy-MM-dd").alias("snapshot_date"), k.alias("kind")).agg(F.count("*").alias("n"))


# ---- import


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under an export's headers; some lack a date, an amount or a payer."""
    o, k = ledger_from_orders(spark, sf_dir), F.col("source_row")
    return o.select(
        F.when(k % 97 != 0, F.col("date")).alias("날짜"), F.col("time").alias("시간"), F.col("type_raw").alias("타입"), F.col("major_raw").alias("대분류"), F.col("minor_raw").alias("소분류"),
        F.col("merchant_raw").alias("내용"), F.when(k % 89 != 0, F.format_number("amount", 2)).alias("금액"), F.lit(None).cast("string").alias("화폐"),
        F.when(k % 83 != 0, F.col("account")).otherwise(" ").alias("결제수단"), F.col("memo_raw").alias("메모"),
    )


@register
def import_rows(spark, d):
    good, _ = N.normalize_export(raw_export(spark, d), "f")
    return good.groupBy("type_norm", "currency", "category_final").agg(F.count("*").alias("n"), exact("amount").alias("total"), F.min("datetime").alias("first"))


@register
def import_rejects(spark, d):
    _, bad = N.normalize_export(raw_export(spark, d), "f")
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@register
def import_aliases(spark, d):
    out = N.alias_columns(raw_export(spark, d))
    return out.groupBy("type", "account").agg(F.count("*").alias("n"), F.count("date").alias("dated"), F.count("amount").alias("amounts"))


@register
def import_validation(spark, d):
    report = N.validate_input(raw_export(spark, d))
    return spark.createDataFrame([(report["rows"], report["blank_rows"], report["all_dates_null"], report["valid"], len(report["missing"]))], "rows long, blank_rows long, all_dates_null boolean, valid boolean, missing long")


@register
def ledger_run(spark, d):
    """The whole run, twice: import, tag, match, export; the second time nothing changes."""
    store = new_store(spark, "run")
    rules = [Rule("asia", ("asia",), "Asia", match="asia", fields=("major_raw",))]
    parts = [("f1", raw_export(spark, d))]
    first, again = run.run(store, parts, rules), run.run(store, parts, rules)
    assert again.new == again.changed == 0 and first.new
    return run.export(store).groupBy("category_final", "tags_final").agg(F.count("*").alias("n"), exact("amount").alias("total"))


@register
def import_history(spark, d):
    """Suppliers as imports, of which every third comes again under a new id."""
    s = read(spark, d, "supplier")
    entry = lambda rows, prefix: rows.select(
        F.concat(F.lit(prefix), F.col("s_suppkey").cast("string")).alias("file_id"), F.col("s_name").alias("original_filename"), F.concat(F.lit("/in/"), F.col("s_name")).alias("imported_from"),
        F.lit("yes").alias("archived"), F.lit("").alias("archived_path"), F.lit("2024-01-01").alias("imported_at"), F.col("s_nationkey").cast("string").alias("source_rows"),
    )
    history = files.record_import(entry(s, "a").where("false"), entry(s, "a"))
    return files.list_imports(files.record_import(history, entry(s.where("s_suppkey % 3 = 0"), "b"))).select("file_id", "imported_from", "source_rows")


@register
def normalize_tag_lists(spark, d):
    c = read(spark, d, "customer")
    tags = F.array(F.concat(F.lit(" "), F.col("c_mktsegment")), F.col("c_mktsegment"), F.lit(""), F.lit("  "), F.lit(None), F.when(F.col("c_custkey") % 2 == 0, "even ").otherwise(F.col("c_mktsegment")))
    return c.groupBy(F.array_join(N.normalize_tags(tags), ",").alias("tags")).agg(F.count("*").alias("n"))


# ---- audit log


def audit_path(spark: SparkSession, sf_dir: str) -> str:
    """Events as JSON lines, of which every seventh is broken and every eleventh blank."""
    e = read(spark, sf_dir, "events")
    line = F.to_json(
        F.struct(
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), F.lit("template_run").alias("event"), F.col("event_type").alias("command"),
            (F.col("event_id") % 2 == 0).alias("success"), F.col("value").alias("duration"),
        )
    )
    path = scratch_path(spark, "audit")
    e.select(F.when(F.col("event_id") % 11 == 0, "  ").when(F.col("event_id") % 7 == 0, F.concat(F.lit("{broken "), line)).otherwise(line).alias("value")).write.text(path)
    return path


@register
def audit_read(spark, d):
    return files.read_audit(spark, audit_path(spark, d)).groupBy("command", "success").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"))


@register
def audit_skipped(spark, d):
    path = audit_path(spark, d)
    return spark.createDataFrame([(files.read_audit(spark, path).count(), files.skipped_lines(spark, path))], "events long, skipped long")


@register
def audit_trim(spark, d):
    """What is appended to a log, and its newest hundred lines."""
    path = audit_path(spark, d)
    events = files.read_audit(spark, path)
    files.append_audit(events.where("command = 'click'").withColumn("command", F.lit("again")), path)
    kept = files.trim_audit(files.read_audit(spark, path).where("command <> 'again'"), 100)
    again = files.read_audit(spark, path).where("command = 'again'")
    return kept.unionByName(again).groupBy((F.col("command") == "again").alias("again")).agg(F.count("*").alias("n"), F.min("timestamp").alias("first"))


# ---- text files, rules


@register
def csv_round_trip(spark, d):
    path = scratch_path(spark, "csv")
    files.write_ledger_csv(ledger(spark, d), path)
    out = transactions_source(files.read_ledger_csv(spark, [path]))
    return out.groupBy("month", "account").agg(F.count("*").alias("n"), exact("amount").alias("total"), F.sum(F.size("tags_list")).alias("tags"))


@register
def csv_legacy(spark, d):
    """A ledger of version 2 read beside one of version 4: what it lacks gets its defaults."""
    rows = ledger(spark, d)
    old, new = scratch_path(spark, "csv2"), scratch_path(spark, "csv4")
    files.write_ledger_csv(rows.where("source_row % 2 = 1"), new)
    lacking = [c for c in LEDGER_COLUMNS if c not in ("notes_manual", "is_transfer_candidate", "transfer_group_id", "datetime")]
    files.encode_tags(rows.where("source_row % 2 = 0").select(*lacking)).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(old)
    out = files.read_ledger_csv(spark, [old, new])
    return out.groupBy("is_transfer", "is_transfer_candidate", (F.col("datetime") == F.concat("date", F.lit("T"), "time")).alias("no_seconds")).agg(F.count("*").alias("n"), F.count("transfer_group_id").alias("grouped"))


DRY_RULES = (Rule("asia", ("asia",), "Asia", match="asia", fields=("major_raw",)), Rule("big", ("big",), match="0000001"))


@register
def rule_changes(spark, d):
    """Rows that a run of the rules would change, the first fifty by hash."""
    tx = ledger(spark, d)
    out = dry_run(tx, DRY_RULES)
    return out.select("row_hash", F.array_join("tags_after", ",").alias("tags_after"), "category_after")


@register
def manual_edit(spark, d):
    """A row's tags and category set by hand, written through the store."""
    store = filled(spark, d, "edit")
    first = store.read("transactions").agg(F.min("row_hash").alias("h")).first()["h"]
    store.upsert("transactions", edit_tags(store.read("transactions"), first, add=["x", " y "], remove=["vip"], category="Own", note="by hand"))
    out = store.read("transactions")
    return out.groupBy((F.col("notes_manual") == "by hand").alias("edited")).agg(F.count("*").alias("n"), F.min(F.when(F.col("notes_manual") == "by hand", F.concat_ws("|", "row_hash", "category_final", F.array_join("tags_final", ",")))).alias("row"))


@register
def filter_document(spark, d):
    """Report filters from their document."""
    found = P.ReportFilters.load("excluded_merchants:\n- {pattern: '0{3}[12]$', match_type: regex, since: '1996-01-01', reason: r}\nexcluded_categories:\n- {name: BUILDING, reason: r}\nexcluded_date_ranges:\n- {start: '1997-02-01', end: '1997-02-28', reason: r}\n")
    tx = transactions_source(ledger_from_orders(spark, d, ("amount", "date", "merchant_raw", "category_final", "is_transfer", "transfer_group_id")))
    return found.apply(tx).groupBy("month").agg(F.count("*").alias("kept"), exact("amount").alias("total"))


@register
def merchant_pattern(spark, d):
    tx = transactions_source(ledger_from_orders(spark, d, ("amount", "date", "merchant_raw", "is_transfer", "transfer_group_id")))
    return tx.where(P.merchant_matches("R#0+[1-9]7$")).groupBy("merchant_raw").agg(F.count("*").alias("n"), exact("amount").alias("total"))


# ---- streaming


@register
def streamed_import(spark, d):
    """Orders arriving as files in falling order of time, the first ones twice, through the stream into the store."""
    path, store = scratch_path(spark, "stream-in"), new_store(spark, "stream-store")
    rows = ledger(spark, d)
    for year in ("2000", "1997"):
        part = rows.where((F.substring("date", 1, 4) >= year) & (F.substring("date", 1, 4) < str(int(year) + 3)))
        part.coalesce(2).write.mode("append").parquet(path)
        ingest(ledger_stream(spark, path), store, scratch_path(spark, f"stream-mark-{year}")).awaitTermination()
    rows.where("date < '1997'").coalesce(2).write.mode("append").parquet(path)
    ingest(ledger_stream(spark, path), store, scratch_path(spark, "stream-mark-last")).awaitTermination()
    return store.ledger().groupBy("month").agg(F.count("*").alias("n"), F.count_distinct("row_hash").alias("hashes"), exact("amount").alias("total"))
