"""Predicates over ledger rows, as column expressions that push down to the scan where they can."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import confirmed_transfer
from ..schema import UNCATEGORISED

# Fixed value: what marks a row as no consumption, in the lower-cased text of category, major, minor and tags.
NON_CONSUMPTION = (
    "(카드대금|카드결제|결제대금|상환|이체|송금|투자|증권|주식|펀드|isa|irp|연금|저축|적금|예금|savings?|investment|소비제외|금융|금융비용|외화)"
)
SPENDING = "amount < 0 and not is_transfer_bool"
PERIOD = re.compile(r"^\d{4}-\d{2}$")


def is_confirmed_transfer(df: DataFrame) -> Column:
    """Tolerates ledgers without the flag (nothing is a transfer) or without groups (the flag decides)."""
    have = set(df.columns)
    return confirmed_transfer(F.col("is_transfer") if "is_transfer" in have else None, F.col("transfer_group_id") if "transfer_group_id" in have else None)


def exclude_transfers(df: DataFrame) -> DataFrame:
    return df.where(~is_confirmed_transfer(df))


def non_consumption(category: str = "category_final", major: str = "major_raw", minor: str = "minor_raw", tags: str = "tags_list") -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (category, major, minor)]
    return F.lower(F.concat_ws(" ", *parts, F.coalesce(F.array_join(F.col(tags), " "), F.lit("")))).rlike(NON_CONSUMPTION)


def is_spending() -> Column:
    return (F.col("amount") < 0) & ~F.col("is_transfer_bool")


def is_consumption() -> Column:
    return is_spending() & (F.col("type_norm") == "expense") & ~non_consumption()


def is_expense() -> Column:
    return is_spending() & (F.col("type_norm") == "expense")


def in_months(since: str | None = None, until: str | None = None, month: str = "month") -> Column:
    """Inclusive, open at a bound that is None."""
    for p in (since, until):
        check_period(p)
    out = F.lit(True)
    if since is not None:
        out = out & (F.col(month) >= since)
    if until is not None:
        out = out & (F.col(month) <= until)
    return out


def check_period(period: str | None) -> str | None:
    if period is not None and not PERIOD.match(period):
        raise ValueError(f"{period!r} is no month of the form YYYY-MM")
    return period


def in_period(period: str, month: str = "month") -> Column:
    """Dates that begin with a month, asked of the view's month, which prunes partitions."""
    return F.col(month) == check_period(period)


def between_dates(start: str, end: str, column: str = "date") -> Column:
    return F.col(column).between(start, end)


def untagged(tags: str = "tags_list") -> Column:
    return F.size(F.coalesce(F.col(tags), F.array().cast("array<string>"))) == 0


def rule_matched() -> Column:
    """Has rule tags or a rule category."""
    tags = F.coalesce(F.from_json("tags_rule", "array<string>"), F.array().cast("array<string>"))
    return (F.size(tags) > 0) | (F.trim(F.coalesce("category_rule", F.lit(""))) != "")


def needs_attention(tags: str = "tags_list") -> Column:
    """Flagged for review, or without tags, or without category."""
    category = F.trim(F.coalesce("category_final", F.lit("")))
    return (F.coalesce("needs_review", F.lit(0)) == 1) | untagged(tags) | category.isin("", UNCATEGORISED)


def low_confidence(threshold: float = 0.7) -> Column:
    return F.col("confidence").isNull() | (F.col("confidence") < threshold)


def has_tag(tag: str, tags: str = "tags_list") -> Column:
    return F.coalesce(F.array_contains(F.col(tags), tag), F.lit(False))


def merchant_contains(text: str) -> Column:
    """Literal, whatever the text's letters mean in patterns."""
    return F.col("merchant_raw").contains(text)


def merchant_matches(pattern: str) -> Column:
    """A regular expression, found anywhere in the lower-cased name; the pattern is lower-cased too."""
    re.compile(pattern.lower())
    return F.lower("merchant_raw").rlike(pattern.lower())


def search(df: DataFrame, text: str, date: str | None = None, limit: int = 10) -> DataFrame:
    """Case-insensitive search in merchants and memos, newest first. ``%`` and ``_`` in the text are literal."""
    like = "%" + re.sub(r"([%_\\])", r"\\\1", text) + "%"
    found = df.where(F.col("merchant_raw").ilike(like) | F.col("memo_raw").ilike(like))
    if date is not None:
        found = _within(found, date, date)
    return found.orderBy(F.desc("date"), "row_hash").limit(limit)


def _within(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows of a date range; their months first, where the view has them, to prune partitions."""
    for bound, name in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            df = df.where(getattr(F.col("date"), name)(bound))
            if "month" in df.columns and len(bound) >= 7:
                df = df.where(getattr(F.col("month"), name)(bound[:7]))
    return df


def filter_range(df: DataFrame, start: str | None, end: str | None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of a date range, newest first, some columns of them."""
    out = _within(df, start, end).orderBy(F.desc("date"), F.desc("time"), "row_hash")
    return out.select(*columns) if columns else out


ORDERABLE = ("date", "time", "datetime", "amount", "merchant_raw", "account", "category_final", "row_hash")


def order_by(df: DataFrame, clause: str) -> DataFrame:
    """A user's ``column [asc|desc] [nulls first|last], ...`` over allow-listed columns."""
    keys = []
    for part in clause.split(","):
        m = re.fullmatch(r"\s*(\w+)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?\s*", part, re.IGNORECASE)
        if not m or m[1] not in ORDERABLE:
            raise ValueError(f"cannot order by {part.strip()!r}")
        way = (m[2] or "asc").lower()
        nulls = (m[3] or "last").lower()
        keys.append(getattr(F.col(m[1]), f"{way}_nulls_{nulls}")())
    return df.orderBy(*keys)


@dataclass(frozen=True)
class MerchantExclusion:
    pattern: str
    match_type: str = "contains"
    since: str | None = None
    reason: str = ""

    def column(self) -> Column:
        name = F.lower(F.coalesce("merchant_raw", F.lit("")))
        if self.match_type == "exact":
            hit = name == self.pattern.lower()
        elif self.match_type == "regex":
            hit = F.coalesce("merchant_raw", F.lit("")).rlike("(?i)" + self.pattern)
        elif self.match_type == "contains":
            hit = name.contains(self.pattern.lower())
        else:
            raise ValueError(f"unknown match type {self.match_type!r}")
        return hit if self.since is None else hit & F.coalesce(F.col("date") >= self.since, F.lit(False))


@dataclass(frozen=True)
class CategoryExclusion:
    name: str
    reason: str = ""

    def column(self) -> Column:
        return F.coalesce(F.col("category_final") == self.name, F.lit(False))


@dataclass(frozen=True)
class DateExclusion:
    start: str
    end: str
    reason: str = ""

    def column(self) -> Column:
        return F.coalesce(F.col("date").between(self.start, self.end), F.lit(False))


@dataclass(frozen=True)
class ReportFilters:
    """Rows that reports leave out: those that any rule matches."""

    merchants: tuple[MerchantExclusion, ...] = ()
    categories: tuple[CategoryExclusion, ...] = ()
    dates: tuple[DateExclusion, ...] = ()
    rules: tuple = field(init=False, default=())

    def __post_init__(self) -> None:
        object.__setattr__(self, "rules", (*self.merchants, *self.categories, *self.dates))

    @classmethod
    def from_config(cls, config: dict) -> ReportFilters:
        """From the parsed YAML document: excluded_merchants, excluded_categories, excluded_date_ranges."""
        pick = lambda key, kind: tuple(kind(**x) for x in config.get(key) or ())
        return cls(pick("excluded_merchants", MerchantExclusion), pick("excluded_categories", CategoryExclusion), pick("excluded_date_ranges", DateExclusion))

    @classmethod
    def load(cls, text: str) -> ReportFilters:
        """From YAML text; patterns that are none and ranges that end before they begin are refused."""
        import yaml

        found = cls.from_config(yaml.safe_load(text) or {})
        for m in found.merchants:
            if m.match_type == "regex":
                re.compile(m.pattern)
            elif m.match_type not in ("contains", "exact"):
                raise ValueError(f"unknown match type {m.match_type!r}")
        for d in found.dates:
            if d.end < d.start:
                raise ValueError(f"{d.start}..{d.end}: the range ends before it begins")
        return found

    def matches(self) -> Column:
        return reduce(lambda a, b: a | b, [r.column() for r in self.rules], F.lit(False))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(~self.matches()) if self.rules else df

    def applied(self, df: DataFrame) -> int:
        """Number of rules that match at least one row, in one scan."""
        if not self.rules:
            return 0
        row = df.agg(*[F.max(r.column().cast("int")).alias(f"r{k}") for k, r in enumerate(self.rules)]).first()
        return sum(x or 0 for x in row)
