"""URL filters by a temporal list join, in DataFrame functions only.

Dated list entries (a domain is added to or removed from a list) become validity intervals, and each capture is
evaluated against the entries that were active when it was fetched. An entry for a domain, a top-level one too, covers its
subdomains; of several, the longest domain decides, then the list's name. An entry for an IP address covers that address
only.

Captures are first reduced to distinct pairs of host and fetch time, which is what the verdict depends on, so a host
with a third of all captures costs the join no more than its distinct times; verdicts are then joined back.

The host is what browsers reach: it follows the last ``@`` of the authority, ends before the port, keeps the brackets of
an IPv6 address, and a backslash ends the authority as a slash does.

Defined cases: a null or unparsable URL has a null host and is not blocked; a very long URL costs its authority only, and
a host over 253 characters, which no domain name can be, is matched whole; a null fetch time matches nothing;
entries with a null domain, list or date are ignored; repeated entries and repeated captures change nothing; of
entries for one list, domain and time, "remove" wins; an empty list blocks nothing; an empty table of captures gives
an empty result; further columns are carried along, whatever their names, unless the operator's results bear them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_prefix

RESULTS = ("host", "blocked", "list", "matched_domain", "since")


#: Characters of the longest domain name.
LONGEST_DOMAIN = 253


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; null where there is none."""
    raw = F.regexp_extract(F.lower(F.btrim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#\\]*@)?(\[[^\]/?#\\]*\]|[^/?#\\:@\[\]]+)", 1)
    return F.nullif(F.regexp_replace(raw, r"\.$", ""), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains down to the last label, longest first; an IP address is only itself."""
    labels = F.split(host, r"\.")
    whole = host.rlike(r"^\[|^[0-9]+(\.[0-9]+){3}$") | (F.length(host) > LONGEST_DOMAIN)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return F.when(whole, F.array(host)).otherwise(parents)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``list``, ``domain``, ``since``, ``until`` (null: still valid) from dated ``action`` rows add or remove."""
    rows = entries.select("list", F.lower(F.btrim("domain")).alias("domain"), "at", "action")
    rows = rows.where("list is not null and domain is not null and at is not null and action in ('add', 'remove')")
    rows = rows.groupBy("list", "domain", "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "domain").orderBy("at")
    rows = rows.withColumn("before", F.lag("action").over(order)).where("before is null or before <> action")
    rows = rows.withColumn("until", F.lead("at").over(order)).where("action = 'add'")
    return rows.select("list", "domain", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Captures with ``host``, ``blocked``, and the deciding ``list``, ``matched_domain`` and ``since``."""
    kept = captures.drop(*[c for c in RESULTS if c not in (url_col, time_col)])
    own = free_prefix(kept.columns)  # of helper columns: the host, the time and the verdict's fields
    rows = kept.withColumn(f"{own}h", host_of(F.col(url_col)))
    keys = rows.select(F.col(f"{own}h").alias("host"), F.col(time_col).alias("asked")).where("host is not null and asked is not null").distinct()
    asked = keys.select("host", "asked", F.explode(domains_of(F.col("host"))).alias("domain"))
    active = asked.join(validity_intervals(entries), "domain").where("since <= asked and (until is null or asked < until)")
    best = F.min(F.struct((-F.length("domain")).alias("rank"), "list", "domain", "since")).alias("best")
    verdict = active.groupBy("host", "asked").agg(best).select(F.col("host").alias(f"{own}host"), F.col("asked").alias(f"{own}at"), F.col("best").alias(f"{own}best"))
    out = rows.join(verdict, (F.col(f"{own}h") == F.col(f"{own}host")) & (rows[time_col] == F.col(f"{own}at")), "left")
    found = [F.col(f"{own}best.{c}") for c in ("list", "domain", "since")]
    return out.select(*kept.columns, F.col(f"{own}h").alias("host"), found[0].isNotNull().alias("blocked"), *[c.alias(n) for c, n in zip(found, RESULTS[2:])])
