"""A training-data pipeline over ``documents``: five stages, each one operator of ``tallyweave.llm``.

Each stage takes what its predecessor kept and writes it as Parquet in the shared folder, so a lost executor costs
one stage's tasks. All but the last return the columns of ``documents``, and further ones that the table has, whatever
their names.

Defined cases, of every stage: a row with a null or blank text, or with a null id, is kept as it is (null encodes to no
tokens); rows that share a doc_id are one document to line dedup and near-duplicates, and stay or go together; very long
texts are worked on whole; of near-duplicates and of recurring lines the smallest id keeps its copy; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, decontam, linededup, minhash, toxicity
from tallyweave.llm.common import bitmap_of, free_prefix, materialise, scratch_scope, split_by_bitmap, table
from tallyweave.llm.queries import word_tokenizer
from tallyweave.session import release, scratch_path


def _aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with all columns but id and text under names that no operator uses, and the way back."""
    own = free_prefix(docs.columns)
    names = {c: c if c in ("doc_id", "text") else f"{own}{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[docs[c].alias(n) for c, n in names.items()]), lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier calls toxic."""
    rows, back = _aside(docs)
    model = toxicity.fit(rows, table(spark, sf_dir, "labels"))
    scored = toxicity.score(rows, model, keep=tuple(rows.columns))
    return back(scored.where(F.col("predicted") == 0))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes recurring lines, and sets ``n_chars`` of texts that lose some. A document that would lose all of its lines
    goes only if the documents that keep their templates hold each of them byte for byte; else it stays as it was, and if
    it is a near duplicate the next stage drops it. DataFrame functions only."""
    rows, back = _aside(docs)
    cleaned = linededup.drop_recurring_lines(rows, sources=True)
    at = rows.columns[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None
    if at:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn(at, F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col(at)))
    words = r"[^\x20\x09-\x0D]"
    empty = (F.col("n_dropped") > 0) & ~F.coalesce(F.col("text").rlike(words), F.lit(False))
    kept = back(cleaned.where(~empty))
    emptied = cleaned.where(empty).withColumn("text", F.col("raw_text"))
    if at:
        emptied = emptied.withColumn(at, F.length("text").cast(kind))
    emptied, _ = materialise(emptied.select(*rows.columns, "owners"), "emptied")
    if emptied.isEmpty():
        return kept
    # by hash alone: what lines the owners hold, and what lines the emptied texts need
    needed = emptied.select("doc_id", F.sha2("text", 256).alias("of"), F.explode(F.split("text", "\n", -1)).alias("line")).where(F.col("line").rlike(words))
    needed, _ = materialise(needed.select("doc_id", "of", F.xxhash64("line").alias("short"), F.sha2("line", 256).alias("address")), "needed-lines")
    owners, _ = materialise(emptied.select(F.explode("owners").alias("owner")).distinct(), "owners")
    texts, _ = split_by_bitmap(rows.select("doc_id", "text"), bitmap_of(owners, "owner"), F.col("doc_id"))
    lines = texts.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).select("doc_id", F.xxhash64("line").alias("short"), F.sha2("line", 256).alias("address"))
    lines, _ = split_by_bitmap(lines, bitmap_of(needed, "short"), F.col("short"))
    held = lines.join(owners.hint("merge"), F.col("doc_id") == F.col("owner"), "left_semi").select(F.col("address").alias("held")).distinct()
    alone = needed.join(held.hint("merge"), F.col("address") == F.col("held"), "left_anti").select(F.col("doc_id").alias("alone"), "of").distinct()
    same = (F.col("doc_id") == F.col("alone")) & (F.sha2("text", 256) == F.col("of"))
    return kept.unionByName(back(emptied.join(alone.hint("merge"), same, "left_semi")))


def _firsts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with the smallest id of their group of near duplicates."""
    kept = found.where("kept").select(F.col("doc_id").alias("__kept")).distinct().hint("merge")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept"]), "left_semi").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return _firsts(docs, minhash.near_duplicates(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a test item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each remaining text, with the check that they decode to as many vocabulary strings."""
    out = bpe.encode_decode(docs, word_tokenizer())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the similarity join; tests hold the result against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's input and scratch tables are freed once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            release(spark, before)
        before = path
    return docs
