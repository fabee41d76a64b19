"""Typed schemas, the version registry, and additive read compatibility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNCATEGORISED = "미분류"
UNKNOWN_MERCHANT = "미상"
NULL_TOKENS = ("", "NA", "NULL")

TAG_COLUMNS = ("tags_rule", "tags_ai", "tags_manual", "tags_final")
INT_COLUMNS = ("needs_review", "is_transfer_candidate", "is_transfer", "source_row")
DOUBLE_COLUMNS = ("amount", "confidence")

# The ledger's columns in order (version 4).
LEDGER_COLUMNS = (
    "row_hash date time datetime type_raw type_norm major_raw minor_raw merchant_raw memo_raw notes_manual amount account "
    "currency counterparty category_rule category_final tags_rule tags_ai tags_manual tags_final confidence needs_review "
    "is_transfer_candidate is_transfer transfer_group_id file_id source_row"
).split()


def _ledger_type(name: str) -> T.DataType:
    if name in TAG_COLUMNS:
        return T.ArrayType(T.StringType())
    if name in INT_COLUMNS:
        return T.LongType()
    return T.DoubleType() if name in DOUBLE_COLUMNS else T.StringType()


LEDGER_SCHEMA = T.StructType([T.StructField(c, _ledger_type(c)) for c in LEDGER_COLUMNS])


@dataclass(frozen=True)
class TableSpec:
    """A partitioned table: its schema, its key, and the date column that its month comes from."""

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    date_column: str
    null_safe: bool = False
    fallback_date: str | None = None
    sort: tuple[str, ...] = ()


def _spec(name: str, columns: str, key: str, date_column: str, **more: object) -> TableSpec:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType()}
    fields = [T.StructField(c.partition(":")[0], kinds[c.partition(":")[2] or "s"]) for c in columns.split()]
    return TableSpec(name, T.StructType(fields), tuple(key.split()), date_column, **more)


# The tables' columns (text unless marked d for double or l for long), keys and date columns.
TABLES = {
    "transactions": TableSpec("transactions", LEDGER_SCHEMA, ("row_hash",), "date", sort=("datetime", "row_hash")),
    "assets": _spec(
        "assets",
        "snapshot_date account_id instrument_id quantity:d market_value:d currency file_id source_row:l",
        "snapshot_date account_id instrument_id",
        "snapshot_date",
    ),
    "facts": _spec(
        "facts",
        "fact_id snapshot_date sheet_name block_id block_title fact_kind row_label column_label value_numeric:d value_text value_type file_id source_row:l source_col:l",
        "snapshot_date block_id fact_kind row_label column_label source_row source_col",
        "snapshot_date",
        null_safe=True,
    ),
    "balance": _spec(
        "balance",
        "snapshot_date side category item_name amount:d currency source_fact_id file_id source_row:l",
        "snapshot_date side category item_name source_row",
        "snapshot_date",
        null_safe=True,
    ),
    "cashflow": _spec(
        "cashflow",
        "snapshot_date period_month category amount:d source_fact_id file_id",
        "snapshot_date period_month category",
        "period_month",
        null_safe=True,
        fallback_date="snapshot_date",
    ),
    "insurance": _spec(
        "insurance",
        "snapshot_date institution policy_name contract_status paid_amount:d contract_date maturity_date currency source_fact_id file_id source_row:l",
        "snapshot_date institution policy_name source_row",
        "snapshot_date",
        null_safe=True,
    ),
    "investments": _spec(
        "investments",
        "snapshot_date product_type institution product_name principal_amount:d valuation_amount:d return_rate:d start_date maturity_date currency source_fact_id file_id source_row:l",
        "snapshot_date institution product_name source_row",
        "snapshot_date",
        null_safe=True,
    ),
    "loans": _spec(
        "loans",
        "snapshot_date loan_type institution product_name principal_amount:d balance_amount:d interest_rate:d start_date maturity_date currency source_fact_id file_id source_row:l",
        "snapshot_date institution product_name source_row",
        "snapshot_date",
        null_safe=True,
    ),
}

ACTIVE, LEGACY, UNSUPPORTED = "active", "compatible-legacy", "unsupported"
#: Columns that older versions lack.
OPTIONAL_COLUMNS = {2: ("notes_manual", "is_transfer_candidate", "transfer_group_id", "datetime"), 3: ("notes_manual", "is_transfer_candidate"), 4: ()}


def detect_version(header: list[str]) -> tuple[int | None, str]:
    """Version and state of a header: exact match first, else the columns in order with allowed gaps."""
    if list(header) == list(LEDGER_COLUMNS):
        return 4, ACTIVE
    for version in (3, 2):
        allowed = set(OPTIONAL_COLUMNS[version])
        if set(LEDGER_COLUMNS) - set(header) <= allowed and [c for c in LEDGER_COLUMNS if c in set(header)] == list(header):
            return version, LEGACY
    return None, UNSUPPORTED


def worst_state(states: list[str]) -> str:
    return max(states, key=(ACTIVE, LEGACY, UNSUPPORTED).index, default=ACTIVE)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def parse_tags(c: Column) -> Column:
    """Array from JSON text; null for text that is no array."""
    return F.from_json(c, T.ArrayType(T.StringType()))


def normalize_ledger(df: DataFrame) -> DataFrame:
    """All ledger columns, typed, with the defaults that older versions need. Text input keeps its null tokens null."""
    have = set(df.columns)
    kinds = dict(df.dtypes)

    def text(name: str) -> Column:
        c = F.col(name)
        return F.when(~c.isin(*NULL_TOKENS), c) if kinds[name] == "string" else c

    def value(name: str) -> Column:
        if name in have:
            if name in TAG_COLUMNS:
                tags = parse_tags(F.col(name)) if kinds[name] == "string" else F.col(name)
                return F.coalesce(tags, F.array().cast("array<string>"))
            if name in INT_COLUMNS:
                return text(name).try_cast("double").cast("long")
            return text(name).try_cast("double") if name in DOUBLE_COLUMNS else text(name).cast("string")
        if name == "notes_manual":
            return F.lit("")
        if name == "is_transfer_candidate" and "is_transfer" in have:
            return F.coalesce(text("is_transfer").try_cast("double").cast("long"), F.lit(0).cast("long"))
        if name == "datetime" and {"date", "time"} <= have:
            return F.concat(text("date"), F.lit("T"), text("time"))
        if name in TAG_COLUMNS:
            return F.array().cast("array<string>")
        if name == "currency":
            return F.lit("KRW")
        return F.lit(None).cast(_ledger_type(name))

    out = df.select(*[value(c).cast(_ledger_type(c)).alias(c) for c in LEDGER_COLUMNS])
    chain = F.coalesce(*[blank_to_null(F.col(c)) for c in ("category_final", "category_rule", "minor_raw", "major_raw")], F.lit(UNCATEGORISED))
    return out.withColumn("category_final", chain) if "category_final" not in have else out


def encode_tags(df: DataFrame) -> DataFrame:
    """Tag arrays as JSON text, for text formats."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({c: F.coalesce(F.to_json(F.col(c)), F.lit("[]")) for c in arrays})
