"""Month-partitioned Parquet store with idempotent appends, upserts, previews, and range scans.

Layout ``<base>/<table>/year=YYYY/month=MM``. Writes replace only the partitions that they touch (dynamic overwrite), so a
rerun changes nothing. A batch is read against those months of the store only that the batch has."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import anti_join, keep_first
from ..schema import TABLES, TableSpec
from ..session import release

_PARTS = ("year", "month")


@dataclass(frozen=True)
class AppendResult:
    """Counts of an append; ``months`` are those that got rows, without one whose date is unknown."""

    new: int
    duplicates: int
    partitions: int
    months: tuple[tuple[int, int], ...] = field(default=(), compare=False)


class Store:
    """One base folder with any of the known tables."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def _month_of(self, spec: TableSpec) -> Column:
        date = F.col(spec.date_column)
        return F.substring(F.coalesce(date, F.col(spec.fallback_date)) if spec.fallback_date else date, 1, 7)

    def _stored(self, spec: TableSpec) -> DataFrame:
        """All rows with their partition columns; an empty typed table where nothing has been written."""
        schema = T.StructType([*spec.schema.fields, *[T.StructField(p, T.IntegerType()) for p in _PARTS]])
        try:
            return self.spark.read.schema(schema).parquet(self.path(spec.name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """The transactions view over the store. Its ``month`` is made of the partition columns, so that a filter on it
        reads only the months it asks for."""
        from ..adapters import transactions_source

        month = F.concat(F.lpad(F.col("year").cast("string"), 4, "0"), F.lit("-"), F.lpad(F.col("month").cast("string"), 2, "0"))
        return transactions_source(self._stored(TABLES["transactions"]).withColumn("month", month).drop("year"))

    def read(self, table: str, columns: Sequence[str] | None = None) -> DataFrame:
        out = self._stored(TABLES[table]).drop(*_PARTS)
        return out.select(*columns) if columns else out

    def read_month(self, table: str, year: int, month: int, columns: Sequence[str] | None = None) -> DataFrame:
        out = self._stored(TABLES[table]).where((F.col("year") == year) & (F.col("month") == month)).drop(*_PARTS)
        return out.select(*columns) if columns else out

    def read_range(self, table: str, start: str, end: str, columns: Sequence[str] | None = None) -> DataFrame:
        """Inclusive date range: the months prune partitions, the dates prune rows, sorted by the table's order."""
        spec = TABLES[table]
        ordinal = F.col("year") * 12 + F.col("month")
        months = [int(d[:4]) * 12 + int(d[5:7]) for d in (start, end)]
        out = self._stored(spec).where(ordinal.between(*months) & F.col(spec.date_column).between(start, end))
        out = out.orderBy(*(spec.sort or (spec.date_column,))).drop(*_PARTS)
        return out.select(*columns) if columns else out

    def in_months(self, table: str, months: Sequence[tuple[int, int]], columns: Sequence[str] | None = None) -> DataFrame:
        """Rows of a list of months."""
        out = self.with_parts(table, months).drop(*_PARTS)
        return out.select(*columns) if columns else out

    def with_parts(self, table: str, months: Sequence[tuple[int, int]]) -> DataFrame:
        """Rows of a list of months with their partition columns, by which ``of_months`` and ``replace_months`` know them."""
        return self.of_months(self._stored(TABLES[table]), months)

    def of_months(self, rows: DataFrame, months: Sequence[tuple[int, int]]) -> DataFrame:
        """Those of ``with_parts`` rows that are stored in a list of months."""
        return self._in(rows, list(months))

    def months(self, table: str) -> list[tuple[int, int]]:
        """Months that the store has rows of, without those whose date is unknown."""
        return sorted((y, m) for y, m in self._months(self._stored(TABLES[table])) if y and m)

    def read_partitions(self, table: str, pattern: str, columns: Sequence[str] | None = None) -> DataFrame:
        """Partitions by a relative glob such as ``year=2024/month=*``."""
        if pattern.startswith("/") or ".." in pattern.split("/"):
            raise ValueError("the pattern must stay below the table")
        out = self.spark.read.option("basePath", self.path(table)).schema(TABLES[table].schema).parquet(f"{self.path(table)}/{pattern}")
        return out.select(*columns) if columns else out.select(*TABLES[table].schema.names)

    def count(self, table: str) -> int:
        return self.read(table).count()

    def register_views(self, filters: object = None) -> None:
        """``transactions_raw``, ``transactions_source`` and, with report filters applied, ``transactions``."""
        raw, source = self.read("transactions"), self.ledger()
        raw.createOrReplaceTempView("transactions_raw")
        source.createOrReplaceTempView("transactions_source")
        (filters.apply(source) if filters is not None else source).createOrReplaceTempView("transactions")

    def _prepared(self, spec: TableSpec, batch: DataFrame, dedup: bool) -> DataFrame:
        missing = [f for f in spec.schema.fields if f.name not in batch.columns]
        for f in missing:
            batch = batch.withColumn(f.name, F.lit(None).cast(f.dataType))
        batch = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema.fields])
        month = self._month_of(spec)
        if spec.name == "cashflow":
            month = F.when(month.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), month).otherwise(F.raise_error(F.concat(F.lit("no month: "), F.coalesce(month, F.lit("null")))).cast("string"))
        batch = batch.withColumns({"year": F.substring(month, 1, 4).try_cast("int"), "month": F.substring(month, 6, 2).try_cast("int")})
        if dedup:
            order = [c for c in ("source_row", "file_id") if c in spec.schema.names] or list(spec.key)
            batch = keep_first(batch, spec.key, order)
        return batch

    def _months(self, batch: DataFrame) -> list[tuple[int, int]]:
        return [(r["year"], r["month"]) for r in batch.select(*_PARTS).distinct().collect()]

    def _in(self, df: DataFrame, months: list[tuple[int | None, int | None]]) -> DataFrame:
        """Rows of some months; rows without a readable date are in a month of their own."""
        by_year: dict[int, list[int]] = {}
        cond = F.lit(False)
        for y, m in months:
            if y is None or m is None:
                cond = cond | F.col("year").eqNullSafe(F.lit(y)) & F.col("month").eqNullSafe(F.lit(m))
            else:
                by_year.setdefault(y, []).append(m)
        for y, ms in by_year.items():
            cond = cond | ((F.col("year") == y) & F.col("month").isin(*ms))
        return df.where(cond)

    def new_rows(self, table: str, batch: DataFrame, deduplicate: bool = True) -> tuple[DataFrame, list[tuple[int, int]]]:
        """Rows of a batch that the store lacks, with their partition columns, and the batch's months."""
        spec = TABLES[table]
        rows = self._prepared(spec, batch, deduplicate)
        months = self._months(rows)
        if not deduplicate:
            return rows, months
        old = self._in(self._stored(spec), months)
        return anti_join(rows, old, list(spec.key), spec.null_safe), months

    def append(self, table: str, batch: DataFrame, deduplicate: bool = True) -> AppendResult:
        """Adds what is new as further files of its partitions; what is stored is not rewritten."""
        total = batch.count()
        fresh, _ = self.new_rows(table, batch, deduplicate)
        fresh = fresh.persist()
        try:
            by_month = {(r["year"], r["month"]): r["n"] for r in fresh.groupBy(*_PARTS).agg(F.count("*").alias("n")).collect()}
            new = sum(by_month.values())
            if new:
                spec = TABLES[table]
                fresh.repartition(*_PARTS).sortWithinPartitions(*_PARTS, *(spec.sort or spec.key)).write.mode("append").partitionBy(*_PARTS).parquet(self.path(table))
        finally:
            fresh.unpersist()
        return AppendResult(new, total - new, len(by_month), tuple(sorted((y, m) for y, m in by_month if y and m)))

    def preview(self, table: str, batch: DataFrame) -> AppendResult:
        """What ``append`` would do, without writing."""
        total = batch.count()
        fresh, _ = self.new_rows(table, batch)
        new, parts = fresh.agg(F.count("*"), F.count_distinct(F.struct(*_PARTS))).first()
        return AppendResult(new, total - new, parts)

    def write_month(self, table: str, rows: DataFrame, year: int, month: int) -> None:
        """Replaces one partition."""
        spec = TABLES[table]
        out = self._prepared(spec, rows, False).withColumns({"year": F.lit(year), "month": F.lit(month)})
        out = out.repartition(*_PARTS).sortWithinPartitions(*(spec.sort or spec.key))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PARTS).parquet(self.path(table))

    def _put(self, spec: TableSpec, rows: DataFrame) -> None:
        """Rows with their partition columns in place of all that is stored in their months."""
        rows = rows.repartition(*_PARTS).sortWithinPartitions(*_PARTS, *(spec.sort or spec.key))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PARTS).parquet(self.path(spec.name))

    def replace_months(self, table: str, rows: DataFrame) -> None:
        """Replaces whole months by ``with_parts`` rows that no longer differ in keys and dates, only in other columns: no key
        is looked up. Staged beside the table first, as in ``upsert``."""
        spec = TABLES[table]
        stored = self._stored(spec)
        stage = f"{self.base}/_staged_{table}_{uuid.uuid4().hex}"
        try:
            rows.select(*stored.columns).write.parquet(stage)
            self._put(spec, self.spark.read.schema(stored.schema).parquet(stage))
        finally:
            release(self.spark, stage)

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Replaces rows by key, wherever they are stored: also one whose new date lies in another month. The keys alone
        are looked up in all months; read and replaced are only the months of the new and of the found rows. The result is
        staged beside the table first, because a partition cannot be read and replaced in one job."""
        spec = TABLES[table]
        new = self._prepared(spec, rows, True)
        keys = list(spec.key)
        stored = self._stored(spec).select(*keys, *_PARTS)
        right = new.select(*[F.col(k).alias(f"__{k}") for k in keys])
        same = reduce(lambda a, b: a & b, [stored[k].eqNullSafe(right[f"__{k}"]) if spec.null_safe else stored[k] == right[f"__{k}"] for k in keys])
        months = sorted({*self._months(new), *self._months(stored.join(right, same, "left_semi"))}, key=str)
        kept = anti_join(self._in(self._stored(spec), months), new, keys, spec.null_safe)
        stage = f"{self.base}/_staged_{table}_{uuid.uuid4().hex}"
        try:
            kept.unionByName(new).write.parquet(stage)
            staged = self.spark.read.schema(self._stored(spec).schema).parquet(stage)
            left = {(r["year"], r["month"]) for r in staged.select(*_PARTS).distinct().collect()}
            self._put(spec, staged)
            for y, m in set(months) - left:  # a month whose last row moved away
                release(self.spark, f"{self.path(table)}/year={y}/month={m}")
        finally:
            release(self.spark, stage)

    def find(self, row_hash: str) -> DataFrame:
        """The row of a hash; an error where there is none or more than one."""
        found = self.read("transactions").where(F.col("row_hash") == row_hash)
        n = found.limit(2).count()
        if n != 1:
            raise LookupError(f"{row_hash}: {'no row' if not n else 'several rows'}")
        return found

    def validate(self, table: str) -> list[str]:
        """Differences between the stored files' schema and the table's; nothing is repaired."""
        try:
            have = dict(self.spark.read.parquet(self.path(table)).drop(*_PARTS).dtypes)
        except AnalysisException:
            return ["no partitions"]
        want = {f.name: f.dataType.simpleString() for f in TABLES[table].schema.fields}
        return [f"{c}: {have.get(c, 'missing')} instead of {want[c]}" for c in want if have.get(c) != want[c]] + [f"{c}: unknown column" for c in have if c not in want]

    def index(self) -> DataFrame:
        """Row counts per table and month."""
        out: DataFrame | None = None
        for name, spec in TABLES.items():
            rows = self._stored(spec).groupBy(*_PARTS).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), *_PARTS, "rows")
            out = rows if out is None else out.unionByName(rows)
        return out.orderBy("table", *_PARTS)

