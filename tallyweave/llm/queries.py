"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, linededup, minhash, pii, quality, secrets, toxicity, urlfilter
from .common import scratch_path, table, values


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), word_tokenizer())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    label = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *[secrets.count_kind(F.col("pii"), k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", label), ",").alias("spans"),
    )


# A dated list of unwanted domains.
LIST_ENTRIES = (
    ("spam", "spam-farm.example.org", "2024-01-10", "add"),
    ("spam", "casino-win.example.net", "2024-02-01", "add"),
    ("spam", "casino-win.example.net", "2024-08-01", "remove"),
    ("spam", "free-bets.example.net", "2024-03-05", "add"),
    ("pharma", "cheap-pills.example.net", "2024-01-01", "add"),
    ("adult", "adult-x.example.com", "2024-04-15", "add"),
    ("ads", "ads-track.example.com", "2024-05-20", "add"),
    ("ads", "ads-track.example.com", "2024-06-20", "remove"),
    ("ads", "ads-track.example.com", "2024-09-20", "add"),
)


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` has neither fetch dates nor lists: page ``p`` counts as fetched on day ``p % 366`` of 2024, and
    beside the fixed list a feed is derived from the hosts themselves, about one in twelve of them being listed
    for ninety days, so that the list grows with the captures."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")))
    fixed = values(spark, "list string, domain string, at date, action string", LIST_ENTRIES)
    hosts = captures.select(urlfilter.host_of(F.col("url")).alias("domain")).where("domain is not null").distinct()
    code = lambda at: F.conv(F.substring(F.md5("domain"), at, 4), 16, 10).cast("int")
    hosts = hosts.where(code(1) % 12 == 0).withColumn("from", code(5) % 300)
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n).alias("at")
    feed = hosts.select(F.lit("feed").alias("list"), "domain", day(F.col("from")), F.lit("add").alias("action")).unionByName(
        hosts.select(F.lit("feed").alias("list"), "domain", day(F.col("from") + 90), F.lit("remove").alias("action"))
    )
    return urlfilter.evaluate(captures, fixed.unionByName(feed))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` has no token counts: the budget of 512 is of estimated tokens, characters over four."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = values(spark, "conv_id bigint, turn bigint, role string, text string", [(-1, 0, "user", said), (-1, 1, "assistant", said)])
    windows = chat.format_windows(rows.unionByName(probe))
    read = windows.select(
        "conv_id",
        "part",
        "window",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"),
        F.length("formatted").cast("long").alias("chars"),
    )
    item = F.struct("window", "turns", "learned")
    whole = read.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(item)).alias("w"), F.sum("chars").alias("formatted_chars"))
    whole = whole.select(
        "conv_id",
        F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"),
        F.array_join(F.transform("w", lambda x: x["learned"]), "").alias("learned"),
        "formatted_chars",
    )
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans into one ledger, as of a repository that grows: the even documents first, then all of them, of which only
    blobs that the first scan has not seen are scanned. The result is that of the second scan, over every document."""
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, scratch_path(spark, "secret-ledger"))
    ledger.scan(docs.where("doc_id % 2 = 0"), "first")
    found = ledger.scan(docs, "all")
    return found.select(
        "doc_id",
        *[secrets.count_kind(F.col("findings"), k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(secrets.spans_text(F.col("findings"), secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.spans_text(F.col("findings")).alias("spans"),
    )


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of this query links on two-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


QUERIES = {
    "op1_linededup": op1_linededup,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_urlfilter": op4_urlfilter,
    "op5_chat": op5_chat,
    "op6_decontam": op6_decontam,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_minhash": op10_minhash,
}
