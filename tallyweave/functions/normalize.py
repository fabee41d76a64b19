"""Row-level normalisation as column expressions: types, amounts, hashes, times, numbers, dates, tags, headers."""

from __future__ import annotations

import difflib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import UNCATEGORISED, blank_to_null

# Header variants of each logical field, in order of preference.
HEADERS = {
    "date": ("날짜", "date"), "time": ("시간", "time"), "type": ("타입", "type"), "major": ("대분류", "major"), "minor": ("소분류", "minor"),
    "merchant": ("내용", "merchant"), "amount": ("금액", "amount"), "currency": ("화폐", "currency"), "account": ("결제수단", "account"), "memo": ("메모", "memo"),
}
ASSET_HEADERS = {
    "snapshot_date": ("기준일", "snapshot_date"), "account_id": ("계좌번호", "account_id"), "account_name": ("계좌명", "account_name"),
    "instrument_id": ("종목코드", "instrument_id"), "instrument_name": ("종목명", "instrument_name"), "quantity": ("수량", "quantity"),
    "market_value": ("평가금액", "market_value"), "currency": ("통화", "currency"),
}
AMOUNT_BOUNDS = (0.01, 999_000_000.0)
CATEGORY_OVERRIDE = "__category__:"


def alias_columns(df: DataFrame, headers: Mapping[str, Sequence[str]] = HEADERS) -> DataFrame:
    """The first variant present of each logical field, under the field's name; fields without one are left out."""
    lower = {c.strip().lower(): c for c in reversed(df.columns)}
    found = {field: next((lower[v.lower()] for v in variants if v.lower() in lower), None) for field, variants in headers.items()}
    return df.select(*[F.col(f"`{c}`").alias(field) for field, c in found.items() if c])


def alias_assets(df: DataFrame, default_currency: str = "KRW") -> DataFrame:
    """Asset rows with ids, derived from names where a sheet has only names."""
    out = alias_columns(df, ASSET_HEADERS)
    have = set(out.columns)
    for field, prefix in (("account", "acc_"), ("instrument", "ins_")):
        own = blank_to_null(F.col(f"{field}_id").cast("string")) if f"{field}_id" in have else F.lit(None).cast("string")
        name = derived_id(F.col(f"{field}_name").cast("string"), prefix) if f"{field}_name" in have else F.lit(None).cast("string")
        out = out.withColumn(f"{field}_id", F.coalesce(own, name))
    given = blank_to_null(F.col("currency")) if "currency" in have else F.lit(None).cast("string")
    return out.withColumn("currency", F.coalesce(given, F.lit(default_currency))).drop("account_name", "instrument_name")


def suggest_header(name: str, known: Sequence[str]) -> list[str]:
    return difflib.get_close_matches(name, known, n=3, cutoff=0.6)


def validate_input(df: DataFrame, required: Sequence[str] = ("date", "time", "type", "merchant", "amount")) -> dict:
    """Missing columns with suggestions, and the counts of rows, blank rows and null dates, in one pass."""
    fields = alias_columns(df).columns
    missing = {f: suggest_header(HEADERS[f][1], df.columns) for f in required if f not in fields}
    aliased = alias_columns(df)
    blank = F.lit(True)
    for c in aliased.columns:
        blank = blank & F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    null_dates = F.count_if(F.col("date").isNull()) if "date" in fields else F.lit(0)
    n, blanks, dates = aliased.agg(F.count("*"), F.count_if(blank), null_dates).first()
    return {"missing": missing, "rows": n, "blank_rows": blanks, "all_dates_null": bool(n) and dates == n, "valid": not missing and n > 0}


def type_norm(raw: Column) -> Column:
    """expense, income, transfer or other; the first kind whose word is contained wins."""
    has = lambda *words: F.coalesce(F.greatest(*[raw.contains(w) for w in words], F.lit(False)), F.lit(False))
    return F.when(has("지출", "출금"), "expense").when(has("수입", "입금"), "income").when(has("이체"), "transfer").otherwise("other")


def signed_amount(amount: Column, kind: Column) -> Column:
    """Income is positive; an expense keeps its sign, so a positive one is a refund; others stay."""
    return F.when(kind == "income", F.abs(amount)).otherwise(amount)


def amount_suspicious(amount: Column) -> Column:
    return F.coalesce(~F.abs(amount).between(*AMOUNT_BOUNDS), F.lit(True))


def row_hash(date: Column, time: Column, kind: Column, merchant: Column, amount: Column, currency: Column, account: Column) -> Column:
    """First 16 hex digits of the SHA-256 of seven trimmed fields; null if one is null. The amount is hashed as two decimals."""
    parts = [F.trim(c.cast("string")) for c in (date, time, kind, merchant, amount.cast("decimal(18,2)"), currency, account)]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("|"), p)
    return F.substring(F.sha2(joined, 256), 1, 16)


def clean_time(raw: Column) -> Column:
    """HH:MM; 00:00 for anything that is no time."""
    found = F.regexp_extract(F.trim(F.coalesce(raw, F.lit(""))), r"^(\d{1,2}:\d{2})", 1)
    return F.when(found == "", "00:00").otherwise(F.lpad(found, 5, "0"))


def datetime_of(date: Column, time: Column) -> Column:
    return F.concat(date, F.lit("T"), time, F.lit(":00"))


def derived_id(name: Column, prefix: str) -> Column:
    """Prefix and 12 hex digits of the SHA-256 of the lower-cased name without spaces, ``_`` and ``-``."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.regexp_replace(F.lower(name), "[ _-]", ""), 256), 1, 12))


def fact_id(*parts: Column) -> Column:
    norm = [F.coalesce(F.lower(F.trim(p.cast("string"))), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *norm), 256), 1, 16)


def parse_number(raw: Column) -> Column:
    """Numbers with thousands commas, currency marks, 만원 for ten thousands, and parentheses for negatives.

    Read in a lambda, which names the text without commas: most texts are plain numbers then, and the forms of others, which
    look at the text a dozen times, stay out of the code that Spark generates for a row. With them it passes the 8,000 bytes
    above which the JVM never compiles a method."""

    def reading(text: Column) -> Column:
        plain = r"^[+-]?\d+(\.\d+)?$"
        negative = text.rlike(r"^\(.*\)$")
        bare = F.regexp_replace(text, r"[()]", "")
        scale = F.when(bare.rlike("만원?$"), 10000.0).otherwise(1.0)
        bare = F.regexp_replace(bare, r"(?i)(₩|krw|만원|만|원)", "")
        value = F.when(bare.rlike(plain), bare).try_cast("double") * scale
        return F.when(text.rlike(plain), text.try_cast("double")).when(negative, -value).otherwise(value)

    return F.get(F.transform(F.array(F.translate(F.trim(raw), ", \t\n\x0b\f\r", "")), reading), F.lit(0))


def parse_date(raw: Column) -> Column:
    """The last date in a text: separators - . / or the forms with 년 월 일. Null for impossible dates."""
    found = F.regexp_extract_all(raw, F.lit(r"(\d{4}\s*[-./년]\s*\d{1,2}\s*[-./월]\s*\d{1,2})"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    part = lambda k: F.try_element_at(F.regexp_extract_all(last, F.lit(r"(\d+)"), F.lit(1)), F.lit(k))
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), F.lit("yyyy-MM-dd")))


def parse_period_month(raw: Column) -> Column:
    """yyyy-MM from texts such as 2024-03, 2024.3 or 2024년 3월; null for others."""
    year = F.regexp_extract(raw, r"(\d{4})\s*[-./년]\s*(\d{1,2})", 1)
    month = F.regexp_extract(raw, r"(\d{4})\s*[-./년]\s*(\d{1,2})", 2)
    return F.when(month.try_cast("int").between(1, 12), F.concat(year, F.lit("-"), F.lpad(month, 2, "0")))


def snapshot_date(explicit: Column, labelled: Column, file_name: Column, modified: Column) -> Column:
    """The first of: a given date, a labelled cell, a date in the file's name, its time of change."""
    return F.coalesce(explicit.cast("date"), parse_date(labelled), parse_date(F.regexp_replace(file_name, "_", "-")), modified.cast("date"))


def category_final(manual: Column, rule: Column, minor: Column, major: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in (manual, rule, minor, major)], F.lit(UNCATEGORISED))


def normalize_tags(tags: Column) -> Column:
    """Trimmed, without blanks and repetitions, order kept."""
    trimmed = F.transform(tags, lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))


def merge_tags(rule: Column, ai: Column, manual: Column) -> Column:
    """Rule, then model, then manual tags; the first occurrence stays, category markers go."""
    empty = F.array().cast("array<string>")
    merged = F.concat(*[F.coalesce(c, empty) for c in (rule, ai, manual)])
    return normalize_tags(F.filter(merged, lambda x: ~F.coalesce(x.startswith(CATEGORY_OVERRIDE), F.lit(False))))


def manual_category(tags: Column) -> Column:
    """The category that a marker among the manual tags carries."""
    marks = F.filter(tags, lambda x: x.startswith(CATEGORY_OVERRIDE))
    return blank_to_null(F.substring(F.try_element_at(marks, F.lit(1)), len(CATEGORY_OVERRIDE) + 1, 1_000_000))


def strip_category_marks(tags: Column) -> Column:
    return F.filter(tags, lambda x: ~x.startswith(CATEGORY_OVERRIDE))


def merchant_key(name: Column) -> Column:
    """Cluster key of a merchant name: lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def match_pattern(name: Column) -> Column:
    """A merchant name without branch suffix and trailing numbers, for use as a rule's pattern."""
    text = F.regexp_replace(F.trim(name), r"\s*[(\[].*[)\]]\s*$", "")
    text = F.regexp_replace(text, r"\s+\S*(지점|본점|점)$", "")
    return F.trim(F.regexp_replace(text, r"[\s#_-]*\d+$", ""))


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\d+", "#")


def redact_paths(text: Column) -> Column:
    """File system paths and spreadsheet names, masked."""
    text = F.regexp_replace(text, r"(?<![\w])(/[\w.-]+){2,}", "[path]")
    return F.regexp_replace(text, r"[\w.-]+\.(xlsx|csv|zip)\b", "[file]")


def neutralize(text: Column) -> Column:
    """A quote before text that a spreadsheet would take for a formula."""
    return F.when(text.rlike(r"^[\t\r\n]*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def neutralize_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: neutralize(F.col(c)) for c, kind in df.dtypes if kind == "string"})


def _read_export(raw: DataFrame) -> DataFrame:
    """All rows of a bank export with what is read out of them; ``reason`` says why one is rejected."""
    rows = alias_columns(raw)
    for c in HEADERS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    date = F.coalesce(parse_date(F.col("date").cast("string")), F.col("date").try_cast("date"))
    # where both read a text they agree; a cast that fails costs ten times as much
    read = [F.col("amount").try_cast("double"), parse_number(F.col("amount").cast("string"))]
    amount = F.coalesce(*(reversed(read) if dict(rows.dtypes)["amount"] == "string" else read))
    rows = rows.withColumn("_date", F.date_format(date, "yyyy-MM-dd")).withColumn("_amount", amount)
    rows = rows.withColumn("_time", clean_time(F.col("time").cast("string"))).withColumn("_type", type_norm(F.col("type")))
    rows = rows.withColumn("_currency", F.coalesce(blank_to_null(F.col("currency")), F.lit("KRW")))
    rows = rows.withColumn("_signed", signed_amount(F.col("_amount"), F.col("_type")))
    reason = (
        F.when(F.col("_date").isNull(), "no date").when(F.col("_amount").isNull(), "no amount")
        .when(blank_to_null(F.col("merchant")).isNull(), "no merchant").when(blank_to_null(F.col("account")).isNull(), "no account")
        .when(blank_to_null(F.col("type")).isNull(), "no type")
    )
    return rows.withColumn("reason", reason)


def _export_columns(file_id: str) -> list[Column]:
    digest = row_hash(*map(F.col, ("_date", "_time", "type", "merchant", "_signed", "_currency", "account")))
    return [
        F.when(F.col("reason").isNull(), digest).alias("row_hash"), F.col("_date").alias("date"), F.col("_time").alias("time"), datetime_of(F.col("_date"), F.col("_time")).alias("datetime"),
        F.col("type").alias("type_raw"), F.col("_type").alias("type_norm"), F.col("major").alias("major_raw"), F.col("minor").alias("minor_raw"),
        F.col("merchant").alias("merchant_raw"), F.col("memo").alias("memo_raw"), F.lit("").alias("notes_manual"), F.col("_signed").alias("amount"),
        F.col("account"), F.col("_currency").alias("currency"), F.lit(None).cast("string").alias("counterparty"), F.lit(None).cast("string").alias("category_rule"),
        category_final(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("minor"), F.col("major")).alias("category_final"),
        F.lit(file_id).alias("file_id"), F.monotonically_increasing_id().alias("source_row"),
    ]


def read_export(raw: DataFrame, file_id: str) -> DataFrame:
    """All rows of a bank export as ledger rows, with the ``reason`` why one is rejected: what is written once and split then.

    A filter on the reason is repeated in front of everything that is read out of a row, so a plan over both parts of
    ``normalize_export`` reads each row several times."""
    return _read_export(raw).select(*_export_columns(file_id), "reason")


def normalize_export(raw: DataFrame, file_id: str) -> tuple[DataFrame, DataFrame]:
    """Ledger rows of a bank export, and its rejected rows with a reason."""
    rows = _read_export(raw)
    return rows.where("reason is null").select(*_export_columns(file_id)), rows.where("reason is not null").select(*HEADERS, "reason")
