"""Declarative tagging rules, compiled to column expressions.

A rule has either ``match`` (substrings separated by ``|``, literal and case-insensitive, in any of ``fields``) or
``conditions`` joined by ``logic``. Null text counts as '' (so negations hold), a null number satisfies nothing.
Every matching rule adds its tags; the first one that has a category sets it; rules stand in order of priority.

Rule sets up to ``FOLD`` rules become one ``when`` per rule; larger ones become one pass over an array of structs, which
keeps the generated code of a row small.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import category_final, manual_category, merge_tags

# The columns that rules may look at, the operators and their other names.
FIELDS = ("merchant_raw", "memo_raw", "major_raw", "minor_raw", "account", "amount", "type_norm")
OPERATORS = ("contains", "not_contains", "is", "is_not", "starts_with", "regex", "less_than", "greater_than", "between")
ALIASES = {"equals": "is", "eq": "is", "not_equals": "is_not", "lt": "less_than", "gt": "greater_than", "startswith": "starts_with", "matches": "regex"}
# What is meant by other words for an operator.
HINTS = {
    "equal": "is", "equals": "is", "eq": "is", "ne": "is_not", "notequal": "is_not", "lt": "less_than", "gt": "greater_than", "matches": "regex",
    "startswith": "starts_with", "start_with": "starts_with", "contain": "contains", "has": "contains", "in_range": "between",
}
NUMERIC = ("less_than", "greater_than", "between")
DEFAULT_PRIORITY, FOLD = 50, 200
CONFIDENT, REVIEW_BELOW = 1.0, 0.7


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object

    def column(self) -> Column:
        op = ALIASES.get(self.op, self.op)
        if op in NUMERIC:
            number = F.col(self.field).try_cast("double") if self.field != "amount" else F.col(self.field).cast("double")
            if op == "between":
                low, high = self.value
                hit = number.between(float(low), float(high))
            else:
                hit = number < float(self.value) if op == "less_than" else number > float(self.value)
            return F.coalesce(hit, F.lit(False))
        raw = F.coalesce(F.col(self.field).cast("string"), F.lit(""))
        text, value = F.lower(raw), str(self.value).lower()
        if op == "contains":
            return text.contains(value)
        if op == "not_contains":
            return ~text.contains(value)
        if op == "is":
            return text == value
        if op == "is_not":
            return text != value
        if op == "starts_with":
            return text.startswith(value)
        return raw.rlike("(?i)" + str(self.value))


@dataclass(frozen=True)
class Rule:
    name: str
    tags: tuple[str, ...] = ()
    category: str | None = None
    match: str | None = None
    fields: tuple[str, ...] = ("merchant_raw",)
    conditions: tuple[Condition, ...] = ()
    logic: str = "all"
    priority: int = DEFAULT_PRIORITY
    enabled: bool = True
    extra: dict = field(default_factory=dict, compare=False)

    @classmethod
    def from_config(cls, config: dict) -> Rule:
        known = {k: config[k] for k in ("name", "category", "match", "logic", "priority", "enabled") if config.get(k) is not None}
        conditions = tuple(Condition(c["field"], c["op"], c.get("value")) for c in config.get("conditions") or ())
        return cls(**known, tags=tuple(config.get("tags") or ()), fields=tuple(config.get("fields") or ("merchant_raw",)), conditions=conditions)

    def column(self) -> Column:
        if self.conditions:
            parts = [c.column() for c in self.conditions]
            return reduce((lambda a, b: a | b) if self.logic == "any" else (lambda a, b: a & b), parts)
        # only the visible columns are looked at; another name counts as empty
        words = [w.strip().lower() for w in (self.match or "").split("|") if w.strip()]
        hits = [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).contains(w) for w in words for f in self.fields if f in FIELDS]
        return reduce(lambda a, b: a | b, hits, F.lit(False))


def load_rules(text: str) -> list[Rule]:
    """Rules of a YAML document, in order of priority; a document with problems is refused with all of them."""
    import yaml

    config = yaml.safe_load(text) or {}
    if problems := validate(config):
        raise ValueError("; ".join(problems))
    return ordered(Rule.from_config(c) for c in config["rules"])


def ordered(rules: Iterable[Rule]) -> list[Rule]:
    """Enabled rules by falling priority, in their own order among equals."""
    return sorted((r for r in rules if r.enabled), key=lambda r: -r.priority)


def rule_tags(rules: Sequence[Rule]) -> Column:
    none = F.array().cast("array<string>")
    found = [F.when(r.column(), F.array(*map(F.lit, r.tags))).otherwise(none) for r in ordered(rules) if r.tags]
    if not found:
        return none
    return F.array_distinct(F.concat(*found) if len(found) <= FOLD else F.flatten(F.array(*found)))


def rule_category(rules: Sequence[Rule]) -> Column:
    found = [F.when(r.column(), F.lit(r.category)) for r in ordered(rules) if r.category]
    if not found:
        return F.lit(None).cast("string")
    return F.coalesce(*found) if len(found) <= FOLD else F.get(F.filter(F.array(*found), lambda x: x.isNotNull()), F.lit(0))


def matched_rules(rules: Sequence[Rule]) -> Column:
    """Names of the rules that match, in order: what explains a row's tags, conditions included."""
    names = [F.when(r.column(), F.lit(r.name)) for r in ordered(rules)]
    return F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rule tags and category, merged final tags and category, confidence and review flag. A pure projection."""
    empty = F.array().cast("array<string>")
    have = set(df.columns)
    column = lambda c: F.col(c) if c in have else empty
    out = df.withColumns({"tags_rule": rule_tags(rules), "category_rule": rule_category(rules)})
    out = out.withColumn("tags_final", merge_tags(F.col("tags_rule"), column("tags_ai"), column("tags_manual")))
    matched = (F.size("tags_rule") > 0) | F.col("category_rule").isNotNull()
    out = out.withColumns(
        {
            "category_final": category_final(manual_category(column("tags_manual")), F.col("category_rule"), F.col("minor_raw"), F.col("major_raw")),
            "confidence": F.when(matched, CONFIDENT).otherwise(0.0),
        }
    )
    return out.withColumn("needs_review", F.when(F.col("confidence") < REVIEW_BELOW, 1).otherwise(0).cast("long"))


def dry_run(df: DataFrame, rules: Sequence[Rule], limit: int = 50) -> DataFrame:
    """The first rows, by hash, whose final tags or category a run would change, with both states."""
    before = df.select("row_hash", F.col("tags_final").alias("tags_before"), F.col("category_final").alias("category_before"))
    after = apply_rules(df, rules).select("row_hash", F.col("tags_final").alias("tags_after"), F.col("category_final").alias("category_after"))
    both = before.join(after, "row_hash")
    changed = ~F.col("tags_before").eqNullSafe(F.col("tags_after")) | ~F.col("category_before").eqNullSafe(F.col("category_after"))
    return both.where(changed).orderBy("row_hash").limit(limit)


def edit_tags(df: DataFrame, row_hash: str, add: Sequence[str] = (), remove: Sequence[str] = (), category: str | None = None, note: str | None = None) -> DataFrame:
    """The edited row, with its final columns computed anew; the store's upsert takes it from here."""
    from ..functions.normalize import CATEGORY_OVERRIDE, normalize_tags, strip_category_marks

    row = df.where(F.col("row_hash") == row_hash)
    manual = F.coalesce("tags_manual", F.array().cast("array<string>"))
    manual = F.filter(F.concat(manual, F.array(*map(F.lit, add)).cast("array<string>")), lambda x: ~x.isin(*remove) if remove else F.lit(True))
    if category is not None:
        manual = F.concat(strip_category_marks(manual), F.array(F.lit(CATEGORY_OVERRIDE + category)))
    row = row.withColumn("tags_manual", normalize_tags(manual))
    row = row.withColumn("tags_final", merge_tags(F.col("tags_rule"), F.col("tags_ai"), F.col("tags_manual")))
    row = row.withColumn("category_final", category_final(manual_category(F.col("tags_manual")), F.col("category_rule"), F.col("minor_raw"), F.col("major_raw")))
    return row if note is None else row.withColumn("notes_manual", F.lit(note))


def validate(config: dict) -> list[str]:
    """Problems of a rule document's rules, with close matches for misspelt operators and fields."""
    out = []
    if not isinstance(config.get("rules"), list):
        return ["no list of rules"]
    for k, r in enumerate(config["rules"]):
        at = f"rule {k + 1} ({r.get('name', 'unnamed')})"
        if not r.get("name"):
            out.append(f"{at}: no name")
        if not r.get("match") and not r.get("conditions"):
            out.append(f"{at}: neither match nor conditions")
        if not r.get("tags") and not r.get("category"):
            out.append(f"{at}: neither tags nor category")
        priority = r.get("priority", DEFAULT_PRIORITY)
        if not isinstance(priority, int) or not 0 <= priority <= 100:
            out.append(f"{at}: priority {priority!r} is not within 0 to 100")
        for name in r.get("fields") or ():
            if name not in FIELDS:
                out.append(f"{at}: unknown field {name!r}" + _meant(name, FIELDS))
        for c in r.get("conditions") or ():
            op, name, value = ALIASES.get(c.get("op"), c.get("op")), c.get("field"), c.get("value")
            if name not in FIELDS:
                out.append(f"{at}: unknown field {name!r}" + _meant(name, FIELDS))
            if op not in OPERATORS:
                out.append(f"{at}: unknown operator {op!r}" + _meant(op, OPERATORS))
            elif op in NUMERIC and not _numeric(op, value):
                out.append(f"{at}: {op} needs {'two numbers' if op == 'between' else 'a number'}, not {value!r}")
            elif op == "regex" and not _pattern(value):
                out.append(f"{at}: {value!r} is no pattern")
    return out


def _meant(word: object, known: Sequence[str]) -> str:
    """A hint at the known word that an unknown one stands for or nearly is."""
    hint = HINTS.get(str(word).lower())
    close = [hint] if hint in known else difflib.get_close_matches(str(word), known, 1)
    return f", did you mean {close[0]}?" if close else ""


def _numeric(op: str, value: object) -> bool:
    values = value if op == "between" else [value]
    try:
        return len([float(v) for v in values]) == (2 if op == "between" else 1)
    except (TypeError, ValueError):
        return False


def _pattern(value: object) -> bool:
    try:
        re.compile(str(value))
    except re.error:
        return False
    return True


def lint(rules: Sequence[Rule]) -> list[str]:
    """Names used twice, rules whose words another's contain, and such pairs in the wrong order of priority."""
    out = []
    names = [r.name for r in rules]
    out += [f"name used twice: {n}" for n in sorted({n for n in names if names.count(n) > 1})]
    words = [(r, w) for r in rules for w in (r.match or "").lower().split("|") if w]
    for a, x in words:
        for b, y in words:
            if a is not b and x != y and x in y and set(a.fields) & set(b.fields):
                out.append(f"{a.name}: {x!r} also matches what {b.name} looks for with {y!r}")
                if a.priority > b.priority and a.category and b.category and a.category != b.category:
                    out.append(f"{a.name} comes before the more specific {b.name}")
    return out


def rule_preview(df: DataFrame, rule: Rule, tags: str = "tags_list") -> DataFrame:
    """One row: how many rows and how much money a new rule matches, how many it newly tags, and coverage after."""
    hit = rule.column()
    bare = F.size(F.coalesce(F.col(tags), F.array().cast("array<string>"))) == 0
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(hit).alias("matched"),
        F.coalesce(F.sum(F.when(hit, F.abs("amount"))), F.lit(0)).cast("double").alias("matched_amount"),
        F.count_if(hit & bare).alias("newly_tagged"),
        F.count_if(~bare | hit).alias("tagged_after"),
    )


def rule_months(df: DataFrame, rule: Rule) -> DataFrame:
    return df.where(rule.column()).groupBy("month").agg(F.count("*").alias("matched")).orderBy("month")


def rule_cotags(df: DataFrame, rule: Rule, top: int = 5, tags: str = "tags_list") -> DataFrame:
    found = df.where(rule.column()).select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))
    return found.orderBy(F.desc("count"), "tag").limit(top)
