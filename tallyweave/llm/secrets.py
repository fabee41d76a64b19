"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every text is addressed by its SHA-256. A (blob, rule version) pair that the ledger holds is not scanned
again; of the others one copy of each blob is scanned, and findings are joined back to every path that holds the blob or
ever held it. The ledger is a pair of tables that outlive the session (see ``Ledger``).

Match positions: ``split`` gives the pieces between matches and ``regexp_extract_all`` the matches, so running
lengths give code point offsets. The rules below match exactly what the looser base patterns match and keep:
runs of hex digits are cut only at run ends, so asking for 32 at once drops no and adds no match.

Defined cases: a null text is the empty blob; a null id is a path like any other; repeated rows are further paths of one
blob; a very long text is scanned whole; spans of one start go by the order of the rules; an empty table gives empty
results; columns other than id and text are not looked at, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, materialise, split_by_bitmap


@dataclass(frozen=True)
class Rule:
    """``pattern`` in Java syntax. With ``value_group``, that group needs ``min_value`` characters."""

    kind: str
    pattern: str
    hint: str
    value_group: int = 0
    min_value: int = 0


# The detection patterns. ``hint`` is a cheap necessary condition tested first.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"[:=]", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", r"AKIA"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", r"[0-9a-f]{32}"),
    Rule("ghtoken", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", r"-----BEGIN "),
)
BASE_KINDS = ("assign", "access", "hex")
RULE_VERSION = "2024.1"
SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    pieces = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value_group))
    found = F.arrays_zip(pieces.alias("piece"), matches.alias("match"), values.alias("value"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.length(x["match"])
        span = F.array(F.struct(begin.cast("bigint").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.cast("bigint").alias("end")))
        good = x["match"].isNotNull() & (F.length(x["value"]) >= rule.min_value)
        return F.struct(F.coalesce(end, begin).cast("bigint").alias("at"), F.when(good, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(rule.hint), F.aggregate(found, start, step, lambda acc: acc["out"])).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob`` and ``findings`` (by start, then rule order) of each row of (blob, text)."""
    found = F.concat(*[_spans(F.col("text"), r, k) for k, r in enumerate(rules)])
    return blobs.select("blob", F.sort_array(found).alias("findings"))


class Ledger:
    """The lasting record of scans in one folder: ``blobs`` (``blob``, ``version``, ``findings``) holds each blob and rule
    version once scanned, ``paths`` (``doc_id``, ``blob``, ``seen``) each blob that a path ever held, by the scan that saw it
    first. Both are Parquet tables that only grow; a scan that failed half-way is repeated, and what it wrote twice counts once."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def _load(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def blobs(self, version: str | None = None) -> DataFrame | None:
        """What has been scanned, each pair of blob and version once; None before the first scan."""
        rows = self._load("blobs", f"blob string, version string, findings array<{SPAN}>")
        if rows is None:
            return None
        return (rows if version is None else rows.where(F.col("version") == version)).dropDuplicates(["blob", "version"])

    def paths(self, kind: str = "bigint") -> DataFrame | None:
        return self._load("paths", f"doc_id {kind}, blob string, seen string")

    def scan(self, docs: DataFrame, name: str, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
        """Scans what is unseen, records it under the scan's name, and returns ``doc_id``, ``blob`` and ``findings`` per row.

        Texts of unseen blobs cross the network once, already reduced to one copy of each blob per map task; a bitmap of
        the known ones keeps the others where they are. Paths carry only the blob address; when most rows share one blob,
        AQE splits that partition of the join."""
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        addressed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("blob", F.sha2("text", 256))
        known, kind = self.blobs(version), addressed.schema["doc_id"].dataType.simpleString()
        unseen = addressed.select("blob", "text")
        if known is not None:
            known = known.select(F.col("blob").alias("known"))
            maybe, unseen = split_by_bitmap(unseen, bitmap_of(known, "known"), F.col("blob"))
            # blobs that only seem to be known: a few in ten thousand
            missed = maybe.select("blob").distinct().join(known.hint("merge"), F.col("blob") == F.col("known"), "left_anti")
            missed, _ = materialise(missed.select(F.col("blob").alias("missed")), "missed-blobs")
            if not missed.isEmpty():
                more, _ = split_by_bitmap(maybe, bitmap_of(missed, "missed"), F.col("blob"))
                unseen = unseen.unionByName(more.join(missed.hint("merge"), F.col("blob") == F.col("missed"), "left_semi"))
        unseen = unseen.groupBy("blob").agg(F.first("text").alias("text"))
        scan_blobs(unseen, rules).select("blob", F.lit(version).alias("version"), "findings").write.mode("append").parquet(f"{self.base}/blobs")
        seen, now = self.paths(kind), addressed.select("doc_id", "blob").distinct()
        if seen is not None:
            now = now.join(seen.select(F.col("doc_id").alias("__id"), F.col("blob").alias("__blob")), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("blob") == F.col("__blob")), "left_anti")
        now.select("doc_id", "blob", F.lit(name).alias("seen")).write.mode("append").parquet(f"{self.base}/paths")
        return _with_findings(addressed.select("doc_id", "blob"), self.blobs(version))

    def findings(self, version: str = RULE_VERSION, kind: str = "bigint") -> DataFrame:
        """``doc_id``, ``blob``, ``seen`` and ``findings`` of every version that a path ever held."""
        return _with_findings(self.paths(kind).dropDuplicates(["doc_id", "blob"]), self.blobs(version))


def _with_findings(paths: DataFrame, blobs: DataFrame) -> DataFrame:
    # most blobs hold nothing: only findings are joined back
    hits = blobs.where(F.size("findings") > 0).select("blob", "findings")
    joined = paths.join(hits, "blob", "left")
    cols = [c for c in paths.columns if c != "blob"]
    return joined.select(cols[0], "blob", *cols[1:], F.coalesce("findings", F.array().cast(f"array<{SPAN}>")).alias("findings"))


def spans_text(findings: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined, of all findings or of some kinds."""
    kept = findings if kinds is None else F.filter(findings, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda x: x["kind"] == kind)).cast("long")
