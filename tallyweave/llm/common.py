"""Shared helpers: table access, scratch tables, literal rows, let-binding for higher-order expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release, scratch_path

#: ASCII white space, as a Java character class body.
WS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of scratch tables by the scopes that are open, the innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Releases at its end the tables that were materialised in it, but for those that are kept: they belong to the scope
    around it, if there is one. No plan that reads them may run after that."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            release(spark, path)


def materialise(df: DataFrame, name: str, keep: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared scratch folder and read it back: later stages restart from
    the files when an executor is lost, and no plan is computed twice. Returns the table and its path, which goes with the
    innermost scope (``keep``: the one around that), or when the session ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    scopes = _SCOPES[:-1] if keep else _SCOPES
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Bits of a bitmap that keys are looked up in, at least and at most (64 MB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29


def bitmap_of(keys: DataFrame, *names: str) -> tuple[DataFrame, Callable[..., Column]]:
    """A bitmap of the keys' hashes, as a table of (``__bucket``, ``__bits``) to broadcast, and the bit of a key.

    Sixteen bits a key, at most MOST_BITS: beyond that it lets more other keys pass to the join that decides, and loses
    none. ``keys`` is read twice, so it should be a table."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    place = lambda *key: F.pmod(F.xxhash64(*key), F.lit(size))
    at = place(*names) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(at).alias("__bucket"))
    return rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits")), place


def split_by_bitmap(df: DataFrame, bitmap: tuple[DataFrame, Callable[..., Column]], *key: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be in the bitmap, and those whose key is not; a null key is not. No shuffle."""
    table, place = bitmap
    own = free_prefix(df.columns)
    table = table.select(F.col("__bucket").alias(f"{own}bucket"), F.col("__bits").alias(f"{own}bits"))
    at, present = place(*key), reduce(lambda a, b: a & b, [k.isNotNull() for k in key])
    known = df.join(F.broadcast(table), F.floor(at / 32768) + 1 == F.col(f"{own}bucket"), "left")
    byte = F.substring(F.col(f"{own}bits"), (F.floor(F.pmod(at, F.lit(32768)) / 8) + 1).cast("int"), F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(at, F.lit(8)).cast("int")) == 1
    hit = F.coalesce(present & bit, F.lit(False))
    return known.where(hit).select(*[F.col(f"`{c}`") for c in df.columns]), known.where(~hit).select(*[F.col(f"`{c}`") for c in df.columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``, also within its lambdas.

    An expression named inside a lambda would otherwise be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_prefix(columns: Iterable[str]) -> str:
    """A beginning of names that none of the columns has."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def words_of(text: Column) -> Column:
    """Array of maximal runs of characters other than ASCII white space; empty for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WS}]+"))


def values(spark: SparkSession, columns: str, rows: Iterable[tuple[str | int, ...]]) -> DataFrame:
    """A few literal rows, at least one, as SQL VALUES: no Python step in the plan. ``columns`` are name and type pairs."""
    names = [c.split()[0] for c in columns.split(", ")]
    quoted = lambda v: str(v) if isinstance(v, int) else "r'" + v + "'"
    body = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in columns.split(", "))
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({', '.join(names)})")
