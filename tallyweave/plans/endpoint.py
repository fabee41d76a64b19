"""Guarded read-only SQL with pagination, byte-bounded pages, privacy profiles and context bundles.

The guard works on the parsed plan, not on the text: a literal that reads 'drop' is fine, a command is not, however it
is written. Relations are held against an allow-list, and functions that reach out of the engine are refused."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import redact_paths  # noqa: F401  (re-exported: the column form of redaction)

MAX_ROWS = 10_000
VIEWS = ("transactions", "transactions_source", "transactions_raw")
# The functions and table functions that a query may call. None runs code, reads settings, touches files, or
# makes more rows or longer values than it is given.
FUNCTIONS = frozenset(
    """
    abs add_months any any_value between approx_count_distinct approx_percentile array array_agg array_contains array_distinct array_except array_intersect array_join
    array_max array_min array_position array_remove array_size array_sort array_union arrays_overlap avg bool_and bool_or bround btrim cardinality case cast
    ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr count count_if covar_pop covar_samp cume_dist curdate
    current_date current_timestamp date date_add date_diff date_format date_from_unix_date date_part date_sub date_trunc dateadd datediff datepart day dayname dayofmonth
    dayofweek dayofyear decimal decode dense_rank div double element_at elt endswith every exists exp explode explode_outer extract filter first first_value
    flatten float floor forall format_number format_string from_json get get_json_object greatest grouping grouping_id hash hour if ifnull ilike in initcap
    instr int isnan isnotnull isnull json_array_length json_object_keys kurtosis lag last last_day last_value lcase lead least left len length like ln locate
    log log10 log2 lower lpad ltrim map map_contains_key map_from_arrays map_keys map_values max max_by md5 mean median min min_by minute mod mode month
    monthname months_between named_struct next_day not now nth_value ntile nullif nvl nvl2 percent_rank percentile percentile_approx percentile_cont
    percentile_disc pmod position positive posexplode posexplode_outer pow power quarter rank regexp regexp_count regexp_extract regexp_extract_all regexp_instr regexp_like
    regexp_replace regexp_substr regr_slope replace reverse right rint rlike round row_number rpad rtrim second sha1 sha2 sign signum size skewness slice
    some sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string struct substr substring substring_index sum timestamp to_char
    to_date to_json to_number to_timestamp transform translate trim trunc try_add try_avg try_cast try_divide try_element_at try_multiply try_subtract try_sum
    try_to_number try_to_timestamp typeof ucase unix_date unix_timestamp upper var_pop var_samp variance weekday weekofyear when width_bucket window
    xxhash64 year zip_with
    """.split()
)
TABLE_FUNCTIONS = frozenset("explode explode_outer posexplode posexplode_outer inline inline_outer json_tuple".split())


class GuardError(ValueError):
    """The text is no permitted query."""


def _seq(items: object) -> list:
    return [items.apply(i) for i in range(items.size())]


def _check_functions(expressions: list) -> list:
    """Refuses functions outside the allow list; returns the plans of subqueries."""
    plans, todo = [], expressions
    while todo:
        e = todo.pop()
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            name = e.nameParts().mkString(".").lower()
            if name not in FUNCTIONS:
                raise GuardError(f"function {name} is not allowed")
        if "plan" in {m.getName() for m in e.getClass().getMethods()} and hasattr(e.plan(), "children"):
            plans.append(e.plan())
        todo += _seq(e.children())
    return plans


def _check(plan: object, names: frozenset[str], writes: tuple[str, ...]) -> None:
    """Refuses what is no query, relations that are not in scope, and functions; a name that WITH defines is in scope in the
    definitions after it and in its own query, and nowhere else."""
    kind, full = plan.getClass().getSimpleName(), plan.getClass().getName()
    if "Command" in kind or "Insert" in kind or ".command." in full or (kind.startswith(writes) and kind != "SetOperation"):
        raise GuardError(f"{kind} is no query")
    if kind == "UnresolvedRelation" and plan.name().lower() not in names:
        raise GuardError(f"unknown relation {plan.name()}")
    if kind == "UnresolvedTableValuedFunction" and plan.name().mkString(".").lower() not in TABLE_FUNCTIONS:
        raise GuardError(f"table function {plan.name().mkString('.')} is not allowed")
    if kind == "UnresolvedWith":
        for rel in _seq(plan.cteRelations()):
            _check(rel.productElement(1), names, writes)
            names = names | {rel.productElement(0).lower()}
        below = _seq(plan.children())
    else:
        below = [*_seq(plan.children()), *[p for p in _seq(plan.innerChildren()) if hasattr(p, "innerChildren") and hasattr(p, "subqueries")]]
    for p in [*below, *_check_functions(_seq(plan.expressions()))]:
        _check(p, names, writes)


_WRITES = tuple("Create Drop Alter Show Describe Set Truncate Delete Update Merge Cache Uncache Refresh Analyze Load Repair Explain Use Replace Add Comment Call".split())


def guard(spark: SparkSession, sql: str, views: Sequence[str] = VIEWS) -> None:
    """Raises unless the text is one query over the given views."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise GuardError("not a single readable statement") from e
    _check(plan, frozenset(v.lower() for v in views), _WRITES)


@dataclass(frozen=True)
class Page:
    rows: list[dict]
    total: int
    offset: int
    next_offset: int | None
    truncated: bool = False


def query(spark: SparkSession, sql: str, views: Sequence[str] = VIEWS) -> DataFrame:
    """A guarded query as a DataFrame. A path named as a table is no view, so it is refused like any other relation."""
    guard(spark, sql, views)
    return spark.sql(sql)


def page(df: DataFrame, offset: int = 0, limit: int = 100, order: Sequence[str] = ()) -> DataFrame:
    """A page in a total order: the given columns first, then all others, so that pages neither overlap nor skip."""
    if offset < 0 or not 1 <= limit <= MAX_ROWS:
        raise ValueError(f"limit must lie within 1 and {MAX_ROWS}, offset must not be negative")
    keys = [*order, *[c for c in df.columns if c not in order]]
    return df.orderBy(*keys).offset(offset).limit(limit)


def page_after(df: DataFrame, after: Mapping[str, object] | None = None, limit: int = 100, order: Sequence[str] = ()) -> DataFrame:
    """The page that follows a row, the last one of the page before: a filter and a top-k, so deep pages cost what the
    first one does. Null sorts first. Rows that are equal in every column are one place, and come on one page only if it
    holds them all: give ``order`` a unique column, such as the row's hash."""
    if not 1 <= limit <= MAX_ROWS:
        raise ValueError(f"limit must lie within 1 and {MAX_ROWS}")
    keys = [*order, *[c for c in df.columns if c not in order]]
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for k in keys:
            value = F.lit(after[k]).cast(df.schema[k].dataType)
            further = F.col(k).isNotNull() if after[k] is None else F.coalesce(F.col(k) > value, F.lit(False))
            beyond, equal = beyond | equal & further, equal & F.col(k).eqNullSafe(value)
        df = df.where(beyond)
    return df.orderBy(*keys).limit(limit)


def query_page(spark: SparkSession, sql: str, offset: int = 0, limit: int = 100, order: Sequence[str] = (), max_bytes: int | None = None, views: Sequence[str] = VIEWS) -> Page:
    """Rows, total count and next cursor; rows that do not fit a byte budget wait for the next page."""
    df = query(spark, sql, views)
    total = df.count()
    rows = [r.asDict(True) for r in page(df, offset, limit, order).collect()]
    kept = truncate(rows, max_bytes) if max_bytes is not None else rows
    after = offset + len(kept)
    return Page(kept, total, offset, after if after < total else None, len(kept) < len(rows))


def truncate(rows: list[dict], max_bytes: int) -> list[dict]:
    """The leading rows whose JSON fits, at least one."""
    used, out = 2, []
    for r in rows:
        used += len(json.dumps(r, ensure_ascii=False, default=str).encode()) + 1
        if out and used > max_bytes:
            break
        out.append(r)
    return out


# What a redacted profile leaves out.
REDACTED_KEYS = frozenset("merchant_raw memo_raw notes_manual counterparty account file_id imported_from archived_path original_filename".split())


def redact(value: object, profile: str = "redacted") -> object:
    """A JSON value under a profile: raw as it is, redacted without names and paths, compact also without nulls and empties."""
    if profile == "raw":
        return value
    if isinstance(value, Mapping):
        out = {k: "[redacted]" if k in REDACTED_KEYS and v is not None else redact(v, profile) for k, v in value.items()}
        return {k: v for k, v in out.items() if v not in (None, "", [], {})} if profile == "compact" else out
    if isinstance(value, (list, tuple)):
        return [redact(v, profile) for v in value]
    if isinstance(value, str):
        return re.sub(r"[\w.-]+\.(xlsx|csv|zip)\b", "[file]", re.sub(r"(?<!\w)(/[\w.-]+){2,}", "[path]", value))
    return value


def context_bundle(sections: Mapping[str, object], budget_tokens: int, drop_order: Sequence[str]) -> dict:
    """Sections as far as an estimate of four characters a token fits; others go in a fixed order."""
    kept = dict(sections)
    size = lambda: -(-len(json.dumps(kept, ensure_ascii=False, default=str)) // 4)
    dropped = []
    for name in drop_order:
        if size() <= budget_tokens:
            break
        if name in kept:
            del kept[name]
            dropped.append(name)
    return {"sections": kept, "dropped": dropped, "tokens": size()}


# The codes of errors, and the exit codes of their kinds.
ERROR_CODES = (
    "GENERAL_ERROR DATA_DIR_NOT_INITIALIZED NO_DATA RULES_FILE_NOT_FOUND RULE_NOT_FOUND FILE_NOT_FOUND FILE_ACCESS_ERROR VALIDATION_FAILED INVALID_ARGS "
    "TAGGING_FAILED TRANSFER_FAILED EXPORT_FAILED QUERY_ERROR SIMULATION_FAILED INSPECTION_FAILED USER_CANCELLED UNEXPECTED_ERROR"
).split()
EXIT_CODES = {"SUCCESS": 0, "GENERAL_ERROR": 1, "USAGE_ERROR": 2, "VALIDATION_ERROR": 3, "NO_DATA": 4, "USER_CANCELLED": 130}


def envelope(data: object, command: str, **meta: object) -> dict:
    return {"data": data, "_meta": {"command": command, **meta}}


def failure(error: BaseException, command: str) -> dict:
    """An error as output: its code, exit code and message."""
    if isinstance(error, GuardError):
        code, kind = "QUERY_ERROR", "USAGE_ERROR"
    elif isinstance(error, FileNotFoundError):
        code, kind = "FILE_NOT_FOUND", "GENERAL_ERROR"
    elif isinstance(error, OSError):
        code, kind = "FILE_ACCESS_ERROR", "GENERAL_ERROR"
    elif isinstance(error, LookupError):
        code, kind = "NO_DATA", "NO_DATA"
    elif isinstance(error, ValueError):
        code, kind = "VALIDATION_FAILED", "VALIDATION_ERROR"
    elif isinstance(error, KeyboardInterrupt):
        code, kind = "USER_CANCELLED", "USER_CANCELLED"
    else:
        code, kind = "UNEXPECTED_ERROR", "GENERAL_ERROR"
    return {"error": {"code": code, "exit_code": EXIT_CODES[kind], "message": str(error)}, "_meta": {"command": command}}


def output_schema(df: DataFrame) -> dict:
    """JSON Schema of a result's rows."""
    kinds = {"string": "string", "boolean": "boolean", "double": "number", "float": "number", "int": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer"}

    def of(kind: T.DataType) -> dict:
        if isinstance(kind, T.ArrayType):
            return {"type": ["array", "null"], "items": of(kind.elementType)}
        if isinstance(kind, T.StructType):
            return {"type": ["object", "null"], "properties": {f.name: of(f.dataType) for f in kind.fields}}
        return {"type": ["number" if isinstance(kind, T.DecimalType) else kinds.get(kind.simpleString(), "string"), "null"]}

    return {"type": "array", "items": {"type": "object", "properties": {f.name: of(f.dataType) for f in df.schema.fields}, "required": df.columns}}
