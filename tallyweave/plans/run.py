"""One run of the whole ledger: import, normalise, tag, match transfers, export. A run that is repeated changes nothing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import read_export
from ..operators.rules import Rule, apply_rules
from ..operators.transfers import TOLERANCE, WINDOW_S, apply_matches, candidate_pairs, match_pairs
from ..schema import normalize_ledger
from ..session import release, scratch_path
from ..sources.files import export_master
from ..sources.store import Store


# The columns that rules and matches set.
DERIVED = "tags_rule category_rule tags_final category_final confidence needs_review is_transfer_candidate is_transfer transfer_group_id".split()


@dataclass(frozen=True)
class RunResult:
    new: int
    duplicates: int
    rejected: int
    tagged: int
    transfers: int
    changed: int


def _near(months: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The months and those beside them: a transfer may cross the end of a month."""
    near = {y * 12 + m - 1 + d for y, m in months for d in (-1, 0, 1)}
    return sorted((k // 12, k % 12 + 1) for k in near)


def retag(store: Store, rules: Sequence[Rule], months: Sequence[tuple[int, int]], tolerance: float = TOLERANCE, window_s: int = WINDOW_S) -> tuple[int, int, int]:
    """Tags, categories and transfer state of some months, and of those beside them, derived anew; only months with rows that
    change are written: a new row may pair with one across the end of its month. A row is held against what it was itself,
    so neither that nor the writing looks up a key.

    Returns the numbers of tagged rows, of transfer pairs that touch the months, and of changed rows."""
    months = _near(months)
    rows = store.with_parts("transactions", _near(months))
    pairs = match_pairs(candidate_pairs(rows, tolerance, window_s))
    # the months around them were only needed for pairs
    rows = store.of_months(rows, months).withColumn("__was", F.struct(*DERIVED))
    state = apply_matches(apply_rules(rows, rules), pairs)
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__was.{c}")) for c in DERIVED])
    counts = state.groupBy("year", "month").agg(F.count_if(differs).alias("changed"), F.count_if(F.size("tags_final") > 0).alias("tagged")).collect()
    found = state.where("transfer_group_id is not null").select("transfer_group_id").distinct().count()
    touched = [(r["year"], r["month"]) for r in counts if r["changed"]]
    if touched:
        store.replace_months("transactions", store.of_months(state, touched))
    return sum(r["tagged"] for r in counts), found, sum(r["changed"] for r in counts)


def run(store: Store, exports: Sequence[tuple[str, DataFrame]], rules: Sequence[Rule] = (), force: bool = False) -> RunResult:
    """Imports raw exports (file id, table of text), then tags and matches the months that have new rows; all with ``force``.

    An export is read once, into a scratch table that goes when its rows are stored."""
    new = duplicates = rejected = 0
    months: set[tuple[int, int]] = set()
    for file_id, raw in exports:
        path, rows = scratch_path(store.spark, "import"), read_export(raw, file_id)
        try:
            rows.write.parquet(path)
            read = store.spark.read.schema(rows.schema).parquet(path)
            rejected += read.where("reason is not null").count()
            result = store.append("transactions", normalize_ledger(read.where("reason is null")))
        finally:
            release(store.spark, path)
        new, duplicates = new + result.new, duplicates + result.duplicates
        months |= set(result.months)
    if force:
        months = set(store.months("transactions"))
    tagged, transfers, changed = retag(store, rules, sorted(months)) if months else (0, 0, 0)
    return RunResult(new, duplicates, rejected, tagged, transfers, changed)


def export(store: Store) -> DataFrame:
    """The master export of everything that is stored."""
    return export_master(store.read("transactions"))
