"""Ledger views over the star-schema tables. A dimension is joined only where a wanted column needs it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import parse_tags

MONEY = "decimal(18,2)"
VIEW_COLUMNS = ("month", "is_transfer_bool", "tags_list")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def confirmed_transfer(flag: Column | None, group: Column | None) -> Column:
    """A flag and a non-blank group. Without a group column the flag alone decides; without a flag nothing is a transfer."""
    if flag is None:
        return F.lit(False)
    flagged = F.coalesce(flag == 1, F.lit(False))
    return flagged if group is None else flagged & (F.trim(F.coalesce(group, F.lit(""))) != "")


def transactions_source(ledger: DataFrame) -> DataFrame:
    """The ledger with ``month``, ``is_transfer_bool`` and ``tags_list``, from whatever of their columns it has."""
    have, kinds = set(ledger.columns), dict(ledger.dtypes)
    out = ledger
    if "date" in have and "month" not in have:
        out = out.withColumn("month", F.substring("date", 1, 7))
    flag = F.col("is_transfer") if "is_transfer" in have else None
    out = out.withColumn("is_transfer_bool", confirmed_transfer(flag, F.col("transfer_group_id") if "transfer_group_id" in have else None))
    if "tags_final" in have:
        out = out.withColumn("tags_list", parse_tags(F.col("tags_final")) if kinds["tags_final"] == "string" else F.col("tags_final"))
    return out


def ledger_from_orders(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """``orders`` as a ledger of months; region, nation and customer give categories and merchants."""
    key = F.col("o_orderkey")
    mod = lambda n: key % n == 0
    text = key.cast("string")
    row_hash = F.substring(F.sha2(F.concat(F.lit("o|"), text), 256), 1, 16)
    amount = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).cast(MONEY)
    two = lambda n: F.lpad((key % n).cast("string"), 2, "0")
    date, time = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"), F.concat(two(24), F.lit(":"), two(60))
    null = F.lit(None).cast("string")
    made: dict[str, tuple[str, Column]] = {
        "row_hash": ("", row_hash),
        "date": ("", date),
        "time": ("", time),
        "datetime": ("", F.concat(date, F.lit("T"), time, F.lit(":00"))),
        "type_raw": ("", F.when(F.col("o_orderstatus") == "P", "수입").otherwise("지출")),
        "type_norm": ("", F.when(F.col("o_orderstatus") == "P", "income").otherwise("expense")),
        "major_raw": ("r", F.col("r_name")),
        "minor_raw": ("n", F.col("n_name")),
        "merchant_raw": ("c", F.col("c_name")),
        "memo_raw": ("", F.when(mod(3), F.concat(F.lit("memo "), (key % 7).cast("string")))),
        "notes_manual": ("", F.lit("")),
        "amount": ("", amount),
        "account": ("", F.col("o_orderpriority")),
        "currency": ("", F.lit("KRW")),
        "counterparty": ("", null),
        "category_rule": ("c", F.when(mod(4), F.col("c_mktsegment"))),
        "category_final": ("c", F.when(mod(17), null).when(mod(19), "").otherwise(F.col("c_mktsegment"))),
        "tags_rule": ("", F.when(mod(4), '["rule"]').otherwise("[]")),
        "tags_ai": ("", F.lit("[]")),
        "tags_manual": ("", F.when(mod(29), '["vip"]').otherwise("[]")),
        "tags_final": (
            "c",
            F.when(mod(5), "[]").otherwise(F.concat(F.lit('["'), F.lower("c_mktsegment"), F.lit('","'), F.lower("o_orderpriority"), F.lit('"]'))),
        ),
        "confidence": ("", F.when(~mod(13), (key % 10) / 10.0)),
        "needs_review": ("", F.when(mod(13), 1).otherwise(0).cast("long")),
        "is_transfer_candidate": ("", F.when(mod(11), 1).otherwise(0).cast("long")),
        "is_transfer": ("", F.when(mod(11), 1).otherwise(0).cast("long")),
        "transfer_group_id": ("", F.when(mod(22), F.concat(F.lit("T_"), F.substring(row_hash, 1, 8))).when(mod(33), " ")),
        "file_id": ("", F.concat(F.lit("f"), (key % 3).cast("string"))),
        "source_row": ("", key),
    }
    names = list(made) if columns is None else [c for c in made if c in set(columns)]
    rows = read(spark, sf_dir, "orders")
    needs = {made[c][0] for c in names}
    if needs & set("cnr"):
        rows = rows.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    # nation and region have 25 and 5 rows at every scale
    if needs & set("nr"):
        rows = rows.join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    if "r" in needs:
        rows = rows.join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select(*[made[c][1].alias(c) for c in names])


def ledger_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a ledger of seconds: even ids are outflows, the event type is account and category."""
    key = F.col("event_id")
    stamp = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select(
        F.substring(F.sha2(F.concat(F.lit("e|"), key.cast("string")), 256), 1, 16).alias("row_hash"),
        F.date_format(stamp, "yyyy-MM-dd").alias("date"),
        F.date_format(stamp, "HH:mm").alias("time"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"),
        F.lit("이체").alias("type_raw"),
        F.lit("transfer").alias("type_norm"),
        F.col("event_type").alias("major_raw"),
        F.get_json_object("props", "$.k").alias("minor_raw"),
        F.col("user_id").cast("string").alias("merchant_raw"),
        F.lit("memo").alias("memo_raw"),
        F.when(key % 2 == 0, -F.col("value")).otherwise(F.col("value")).cast(MONEY).alias("amount"),
        F.col("event_type").alias("account"),
        F.lit("KRW").alias("currency"),
        F.lit(None).cast("string").alias("counterparty"),
        F.lit(0).cast("long").alias("is_transfer"),
        F.lit(None).cast("string").alias("transfer_group_id"),
        key.alias("source_row"),
    )
