"""Overview worksheets as relations: cells ``(sheet, row, col, value)`` in, facts and typed tables out.

Anchors are filters over cells, sections run from an anchor to the next one, tables are cells below a header, joined by
row and pivoted by header. Workbooks themselves are read on the driver; one sheet is at most a million rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import fact_id, parse_date, parse_number, parse_period_month
from ..schema import TABLES
from .workbook import read_cells, sheet_names

#: Cells of a workbook that go to the engine at once.
BLOCK_CELLS = 500_000
# Section titles, summary labels and the headers of the tables.
SECTIONS = {"고객정보": "customer", "현금흐름현황": "cashflow", "재무현황": "balance", "보험현황": "insurance", "투자현황": "investments", "대출현황": "loans"}
SUMMARY = ("합계", "총계", "총자산", "총부채")
HEADERS = {
    "insurance": {"institution": ("금융사",), "policy_name": ("보험명",), "contract_status": ("계약상태",), "paid_amount": ("총납입금",), "contract_date": ("계약일자",), "maturity_date": ("만기일자",)},
    "investments": {
        "product_type": ("투자상품종류",), "institution": ("금융사",), "product_name": ("상품명",), "principal_amount": ("투자원금",),
        "valuation_amount": ("평가금액",), "return_rate": ("수익률",), "start_date": ("가입일자",), "maturity_date": ("만기일자",),
    },
    "loans": {
        "loan_type": ("대출종류",), "institution": ("금융사",), "product_name": ("상품명",), "principal_amount": ("대출원금",),
        "balance_amount": ("대출잔액",), "interest_rate": ("대출금리",), "start_date": ("대출신규일",), "maturity_date": ("대출만기일", "만기일자"),
    },
}
BALANCE_HEADERS = {"category": ("항목", "분류"), "item": ("상품명", "자산명", "부채명"), "amount": ("금액",)}
IDENTITY = {"insurance": ("institution", "policy_name"), "investments": ("institution", "product_name"), "loans": ("institution", "product_name")}
NUMBERS = {"paid_amount", "principal_amount", "valuation_amount", "return_rate", "balance_amount", "interest_rate"}
DATES = {"contract_date", "maturity_date", "start_date"}


def norm(c: Column) -> Column:
    """A label without its number, spaces and marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^\d+\s*[.)]\s*", ""), r"[\s_.·:()-]", "")


def read_workbook(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """Cells of a workbook on the driver, of all sheets or some; a sheet's cells go to the engine in blocks of rows."""
    schema = "sheet string, row int, col int, value string"
    out, cells = None, read_cells(path, names)
    while block := list(islice(cells, BLOCK_CELLS)):
        part = spark.createDataFrame(block, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def transaction_sheet(names: Sequence[str]) -> str:
    """The sheet that an export keeps its transactions in: the second one, or the only one."""
    if not names:
        raise ValueError("a workbook without sheets")
    return names[1] if len(names) > 1 else names[0]


def records(cells: DataFrame, sheet: str) -> DataFrame:
    """A sheet as a table: its first row names the columns; rows without any value are left out. All values are text."""
    rows = cells.where(F.col("sheet") == sheet)
    first = rows.agg(F.min("row").alias("row"))
    head = rows.join(F.broadcast(first), "row").orderBy("col").select("row", "col", F.trim("value").alias("name")).collect()
    if not head:
        return cells.sparkSession.createDataFrame([], "source_row long")
    names = {r["col"]: r["name"] for r in reversed(head) if r["name"]}
    body = rows.where(F.col("row") > head[0]["row"]).groupBy("row").pivot("col", sorted(names)).agg(F.first("value"))
    return body.select(F.col("row").cast("long").alias("source_row"), *[F.col(f"`{k}`").alias(n) for k, n in sorted(names.items())])


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """The transaction sheet of an exported workbook, as a table of text."""
    sheet = transaction_sheet(sheet_names(path))
    return records(read_workbook(spark, path, [sheet]), sheet)


def find_sheet(cells: DataFrame, names: Sequence[str]) -> str | None:
    """The sheet whose normalised name is one of those given."""
    found = cells.select("sheet").distinct().where(norm(F.col("sheet")).isin(*names)).orderBy("sheet").first()
    return found["sheet"] if found else None


def inspect(cells: DataFrame) -> DataFrame:
    """Per sheet its extent and the section titles found; no other cell text leaves the sheet."""
    title = F.when(norm(F.col("value")).isin(*SECTIONS), norm(F.col("value")))
    out = cells.groupBy("sheet").agg(F.max("row").alias("rows"), F.max("col").alias("cols"), F.count("*").alias("cells"), F.array_sort(F.collect_set(title)).alias("anchors"))
    return out.orderBy("sheet")


def sections(cells: DataFrame) -> DataFrame:
    """Cells with the block of the last section anchor at or above their row."""
    anchors = cells.where(norm(F.col("value")).isin(*SECTIONS)).select("sheet", "row", norm(F.col("value")).alias("title"))
    known = F.create_map(*[x for kv in SECTIONS.items() for x in map(F.lit, kv)])
    anchors = anchors.groupBy("sheet", "row").agg(F.min("title").alias("title"))
    anchors = anchors.select("sheet", F.col("row").alias("first"), known[F.col("title")].alias("block"), F.col("title").alias("block_title"))
    anchors = anchors.withColumn("until", F.lead("first").over(Window.partitionBy("sheet").orderBy("first")))
    # a sheet has as many anchors as there are section titles, a bounded few
    inside = (cells["sheet"] == anchors["sheet"]) & (cells["row"] > anchors["first"]) & (anchors["until"].isNull() | (cells["row"] < anchors["until"]))
    return cells.join(anchors, inside).select(cells["*"], "block", "block_title", "first")


def _table(cells: DataFrame, block: str, headers: Mapping[str, Sequence[str]], need: Sequence[str]) -> DataFrame:
    """Rows below the block's first row that has the needed headers, one column per header, until two blank rows."""
    rows = sections(cells).where(F.col("block") == block)
    names = {v: field for field, variants in headers.items() for v in variants}
    known = F.create_map(*[x for kv in names.items() for x in map(F.lit, kv)])
    marks = rows.where(norm(F.col("value")).isin(*names)).select("sheet", "row", "col", known[norm(F.col("value"))].alias("field"))
    per_row = marks.groupBy("sheet", "row").agg(F.collect_set("field").alias("fields"))
    head = per_row.where(F.size(F.array_except(F.array(*map(F.lit, need)), "fields")) == 0).groupBy("sheet").agg(F.min("row").alias("header_row"))
    columns = marks.join(head, "sheet").where("row = header_row").groupBy("sheet", "header_row", "field").agg(F.min("col").alias("col"))
    body = rows.select("sheet", "row", "col", "value").join(columns, ["sheet", "col"]).where("row > header_row")
    lines = body.groupBy("sheet", "header_row", "row").pivot("field", sorted(headers)).agg(F.first("value"))
    gap = F.col("row") - F.lag("row", 1).over(Window.partitionBy("sheet").orderBy("row"))
    broken = F.sum(F.when(F.coalesce(gap, F.col("row") - F.col("header_row")) > 2, 1).otherwise(0)).over(Window.partitionBy("sheet").orderBy("row"))
    return lines.withColumn("__broken", broken).where("__broken = 0").drop("__broken")


def facts(cells: DataFrame, snapshot_date: str, file_id: str) -> DataFrame:
    """Every non-blank cell of a section as a fact with its row's and column's labels."""
    rows = sections(cells).where(F.trim("value") != "")
    label = F.first("value").over(Window.partitionBy("sheet", "row").orderBy("col"))
    header = F.first("value").over(Window.partitionBy("sheet", "block", "col").orderBy("row"))
    number, date = parse_number(F.col("value")), parse_date(F.col("value"))
    rows = rows.withColumns({"row_label": label, "column_label": header, "value_numeric": number, "__date": date})
    kind = F.when(F.col("value_numeric").isNotNull(), "number").when(F.col("__date").isNotNull(), "date").otherwise("text")
    at = F.lit(snapshot_date)
    out = rows.select(
        fact_id(at, *map(F.col, ("sheet", "block", "row_label", "column_label", "row", "col"))).alias("fact_id"), at.alias("snapshot_date"),
        F.col("sheet").alias("sheet_name"), F.col("block").alias("block_id"), "block_title", F.lit("cell").alias("fact_kind"), "row_label", "column_label",
        "value_numeric", F.col("value").alias("value_text"), kind.alias("value_type"), F.lit(file_id).alias("file_id"),
        F.col("row").cast("long").alias("source_row"), F.col("col").cast("long").alias("source_col"),
    )
    return out.select(*TABLES["facts"].schema.names)


def structured(cells: DataFrame, block: str, snapshot_date: str, file_id: str) -> DataFrame:
    """Insurance, investments or loans as their typed table; rows without institution and name are left out."""
    names = IDENTITY[block]
    rows = _table(cells, block, HEADERS[block], names)
    rows = rows.where(F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names]).isNotNull())
    at = F.lit(snapshot_date)

    def value(c: str) -> Column:
        if c in NUMBERS:
            return parse_number(F.regexp_replace(c, "%$", ""))
        return F.date_format(parse_date(F.col(c)), "yyyy-MM-dd") if c in DATES else F.nullif(F.trim(c), F.lit(""))

    made = {c: value(c) for c in HEADERS[block]} | {
        "snapshot_date": at, "currency": F.lit("KRW"), "file_id": F.lit(file_id), "source_row": F.col("row").cast("long"),
        "source_fact_id": fact_id(at, F.col("sheet"), F.lit(block), F.col("row"), F.col(names[1])),
    }
    return rows.select(*[made[c].alias(c) for c in TABLES[block].schema.names])


def balance(cells: DataFrame, snapshot_date: str, file_id: str) -> DataFrame:
    """Two tables side by side: the first block of headers is assets, the second liabilities. Summary rows are left out."""
    rows = sections(cells).where(F.col("block") == "balance")
    names = {v: field for field, variants in BALANCE_HEADERS.items() for v in variants}
    known = F.create_map(*[x for kv in names.items() for x in map(F.lit, kv)])
    marks = rows.where(norm(F.col("value")).isin(*names)).select("sheet", "row", "col", known[norm(F.col("value"))].alias("field"))
    head = marks.where("field = 'amount'").groupBy("sheet", "row").agg(F.count("*").alias("n")).where("n >= 2").groupBy("sheet").agg(F.min("row").alias("header_row"))
    marks = marks.join(head, "sheet").where("row = header_row")
    nth = F.row_number().over(Window.partitionBy("sheet", "field").orderBy("col"))
    columns = marks.withColumn("side", F.when(nth == 1, "asset").when(nth == 2, "liability")).where("side is not null")
    body = rows.select("sheet", "row", "col", "value").join(columns.select("sheet", "col", "header_row", "field", "side"), ["sheet", "col"]).where("row > header_row")
    lines = body.groupBy("sheet", "row", "side").pivot("field", sorted(BALANCE_HEADERS)).agg(F.first("value"))
    name = F.coalesce(F.nullif(F.trim("item"), F.lit("")), F.nullif(F.trim("category"), F.lit("")))
    amount, at = parse_number(F.col("amount")), F.lit(snapshot_date)
    out = lines.where(amount.isNotNull() & name.isNotNull() & ~norm(name).isin(*SUMMARY))
    out = out.select(
        at.alias("snapshot_date"), "side", F.trim("category").alias("category"), name.alias("item_name"), amount.alias("amount"), F.lit("KRW").alias("currency"),
        fact_id(at, F.col("sheet"), F.lit("balance"), F.col("row"), name).alias("source_fact_id"), F.lit(file_id).alias("file_id"), F.col("row").cast("long").alias("source_row"),
    )
    return out.select(*TABLES["balance"].schema.names)


def cashflow(cells: DataFrame, snapshot_date: str, file_id: str) -> DataFrame:
    """Categories by months: the header is the first row with two months or more. One value that is no number voids the table."""
    rows = sections(cells).where(F.col("block") == "cashflow")
    months = rows.withColumn("period_month", parse_period_month(F.col("value"))).where("period_month is not null")
    head = months.groupBy("sheet", "row").agg(F.count("*").alias("n")).where("n >= 2").groupBy("sheet").agg(F.min("row").alias("header_row"))
    columns = months.join(head, "sheet").where("row = header_row").select("sheet", "header_row", "col", "period_month")
    first = columns.groupBy("sheet").agg(F.min("col").alias("first_col"))
    label = rows.join(first, "sheet").where("col < first_col").groupBy("sheet", "row").agg(F.min_by("value", "col").alias("category"))
    body = rows.where(F.trim("value") != "").select("sheet", "row", "col", "value").join(columns, ["sheet", "col"]).where("row > header_row").join(label, ["sheet", "row"])
    body = body.withColumn("amount", parse_number(F.col("value")))
    void = body.where("amount is null").select("sheet").distinct()
    at = F.lit(snapshot_date)
    out = body.join(void, "sheet", "left_anti").select(
        at.alias("snapshot_date"), "period_month", F.trim("category").alias("category"), "amount",
        fact_id(at, F.col("sheet"), F.lit("cashflow"), F.col("row"), F.col("col")).alias("source_fact_id"), F.lit(file_id).alias("file_id"),
    )
    return out.select(*TABLES["cashflow"].schema.names)
