"""Line dedup by a log-template tree, in DataFrame functions only.

Each line goes down a tree of fixed depth: by token count, then by its leading tokens, tokens with digits being
wildcards. In a leaf the most frequent line leads a template; lines that agree with it in enough positions belong
to the template, their other positions being its variable fields. The most frequent of what agrees with no leader
leads the next template of the leaf, until every line has one. A template found in two documents or more
recurs: its lines are dropped everywhere but in the document with the smallest id that has it, so one copy stays.

Agreement is taken over all tokens, each as two bytes of its hash, so that no line text is shuffled. Lines more than
half of whose tokens are variable belong to no template and recur only token for token. Lines under ``min_tokens``
tokens are never dropped; lines of fewer than ``long_tokens`` tokens must occur ``short_count`` times, as chance
repeats them.

A leaf of many lines is dealt out in parts, each of which meets all leaders of a round; only the lines that may lead
are ever together. Each round places at least all lines that its leaders lead, so a leaf of many templates takes
several rounds.

Defined cases: a null text stays null and has no lines; a null doc_id is passed through as it is; rows that share a
doc_id are one document; a text without recurring lines comes back unchanged, byte for byte; a very long text or line is
compared whole; of lines that are equally frequent the one whose tokens hash highest leads, so the result does not
depend on the order of rows; repeated rows drop nothing, as they are one document; an empty table gives
an empty result. Columns named ``n_lines`` or ``n_dropped`` in the input are replaced by the operator's, others are
carried along, also where they bear names that the operator uses inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, bitmap_of, free_prefix, let, materialise, scratch_scope, split_by_bitmap

LEADING = 3
#: Lines of a leaf that a round looks for leaders among: at first, and at most. Later rounds take more. Up to a thousand,
#: map tasks cut the ranking off, so no task sorts a hot leaf.
CANDIDATES, MOST_CANDIDATES = 16, 1000
#: Lines of a leaf in one part, about.
PART_LINES = 1024
#: Last token of a line that is compared as it is; no token of a line can be this.
EXACT = "\n"
_VARIABLE = rf"(?<![^{WS}])[^0-9{WS}]*+[0-9][^{WS}]*+"


def _tokens(line: Column) -> Column:
    """Tokens of a line, those with digits as wildcards. Where these are more than half, the line has too few words to
    make a template: its tokens stay as they are, and ``EXACT`` is added to them."""
    plain = F.btrim(line, F.lit(WS_CHARS))
    split = lambda x: F.split(x, f"[{WS}]+")
    masked = split(F.regexp_replace(plain, _VARIABLE, "<*>"))
    mostly = lambda t: 2 * F.size(F.filter(t, lambda x: x == "<*>")) > F.size(t)
    exact = lambda t: F.when(mostly(t), F.array_append(split(plain), F.lit(EXACT))).otherwise(t)
    return F.when(plain.rlike("[0-9]"), let(masked, exact)).otherwise(split(plain))


def _lines(docs: DataFrame, min_tokens: int) -> DataFrame:
    """One row per line of enough tokens: document, line number, leaf, line address, probes, token count.

    Tokens are made inside the generator: a filter on them would otherwise be pushed below and make them again."""
    split = F.transform(F.split("text", "\n", -1), _tokens)
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(split).alias("line_no", "tokens"))
    exact = F.element_at("tokens", -1) == EXACT
    n = F.size("tokens") - exact.cast("int")
    rows = rows.where(n >= min_tokens)
    # two bytes of each token's hash
    probes = F.when(exact, F.array().cast("array<smallint>")).otherwise(
        F.transform("tokens", lambda t: (F.pmod(F.xxhash64(t), F.lit(65536)) - 32768).cast("smallint"))
    )

    return rows.select(
        "doc_id",
        "line_no",
        n.alias("n"),
        # an exact line has a leaf of its own
        F.when(exact, F.xxhash64(n, "tokens")).otherwise(F.xxhash64(n, F.slice("tokens", 1, LEADING))).alias("leaf"),
        F.xxhash64("tokens").alias("line"),
        probes.alias("probes"),
    )


def _agree(a: Column, b: Column, similarity: float) -> Column:
    """Whether two lines of a leaf agree in enough positions; lines without probes are alone in theirs."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same >= similarity * F.size(a)


def _leaders(similarity: float) -> Column:
    """The leaders among the ``CANDIDATES`` first lines of a leaf: each that agrees with none before it."""
    first = F.sort_array(F.collect_list(F.struct("count", "line", "probes")), asc=False)

    def more(led: Column, x: Column) -> Column:
        follows = F.exists(led, lambda l: _agree(l["probes"], x["probes"], similarity))
        return F.when(follows, led).otherwise(F.concat(led, F.array(x)))

    return let(first, lambda c: F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1))), F.slice(c, 1, 1), more))


def _templates(rest: DataFrame, similarity: float) -> DataFrame:
    """Lines of ``rest`` (``leaf``, ``line``, ``probes``, ``n``, ``count``, ``low``, ``high``, ``parts``) with ``template``, its leading line.

    A line follows the first leader of its leaf, in falling order of count, that it agrees with, or leads. Each round
    finds the leaders among a leaf's first unplaced lines and places all that agree with one, until none is left."""
    rest, _ = materialise(rest.withColumn("part", F.pmod(F.xxhash64("line"), F.col("parts"))), "leaves")
    found, most = None, CANDIDATES
    while found is None or not rest.isEmpty():
        order = Window.partitionBy("leaf").orderBy(F.desc("count"), F.desc("line"))
        first = rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        leaders = first.groupBy("leaf").agg(_leaders(similarity).alias("leaders"), F.first("parts").alias("of"))
        leaders = leaders.select("leaf", "leaders", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("of") - 1)).alias("part"))
        agrees = F.filter("leaders", lambda l: _agree(l["probes"], F.col("probes"), similarity))
        placed = rest.join(leaders.hint("merge"), ["leaf", "part"])
        placed, _ = materialise(placed.select(*[rest[c] for c in rest.columns], F.get(agrees, F.lit(0))["line"].alias("template")), "leaves")
        followers = placed.where("template is not null").drop("probes", "parts", "part")
        found = followers if found is None else found.unionByName(followers)
        rest, most = placed.where("template is null").drop("template"), min(4 * most, MOST_CANDIDATES)
    return found


def recurring_lines(
    docs: DataFrame,
    *,
    min_tokens: int = 3,
    long_tokens: int = 6,
    short_count: int = 5,
    similarity: float = 0.7,
) -> DataFrame:
    """``doc_id``, ``drop``, the numbers of the lines that the document loses, and ``owners``, the documents that keep
    a line of the same templates. ``docs``: ``doc_id``, ``text``.

    What is shuffled whole are the distinct lines, once. Most are alone in their leaf; a bitmap of the leaves that several
    lines share, and one of the lines that are dropped, keep the others out of the joins."""
    with scratch_scope(docs.sparkSession):
        occurrences, _ = materialise(_lines(docs, min_tokens), "lines")
        lines = occurrences.groupBy("leaf", "line", "probes", "n").agg(
            F.count("*").alias("count"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
        )
        lines, _ = materialise(lines, "distinct-lines")
        shared = lines.groupBy("leaf").agg(F.count("*").alias("k")).where("k > 1")
        shared, _ = materialise(shared.select("leaf", F.ceil(F.col("k") / PART_LINES).alias("parts")), "shared-leaves")
        rest, alone = split_by_bitmap(lines, bitmap_of(shared, "leaf"), F.col("leaf"))
        rest = rest.join(shared.hint("merge"), "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
        placed, _ = materialise(_templates(rest, similarity), "placed-lines")
        recurs = lambda low, high, n, count: (low < high) & ((n >= long_tokens) | (count >= short_count))
        templates = placed.groupBy("leaf", "template").agg(F.min("low").alias("owner"), recurs(F.min("low"), F.max("high"), F.max("n"), F.sum("count")).alias("recurs"))
        dropped = placed.join(templates.where("recurs").select("leaf", "template", "owner").hint("merge"), ["leaf", "template"]).select("leaf", "line", "owner")
        single = alone.where(recurs(*map(F.col, ("low", "high", "n", "count")))).select("leaf", "line", F.col("low").alias("owner"))
        dropped, _ = materialise(dropped.unionByName(single), "dropped")
        gone, _ = split_by_bitmap(occurrences.select("doc_id", "line_no", "leaf", "line"), bitmap_of(dropped, "line"), F.col("line"))
        gone = gone.join(dropped.hint("merge"), ["leaf", "line"]).where("doc_id <> owner")
        gone = gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("drop"), F.collect_set("owner").alias("owners"))
        return materialise(gone, "dropped-lines", keep=True)[0]


def drop_recurring_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sources: bool = False, **options: float
) -> DataFrame:
    """All columns of ``docs`` with the cleaned text, and ``n_lines`` and ``n_dropped``; with ``sources`` also
    ``raw_text`` and ``owners``, the documents that keep the lines' templates. Only texts that may lose a line are shuffled."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    drops = recurring_lines(plain, **options)
    more = ("raw_text", "owners") if sources else ()
    rest = docs.drop("n_lines", "n_dropped", *more)
    losing, whole = split_by_bitmap(rest, bitmap_of(drops, "doc_id"), F.col(id_col))
    own = free_prefix(rest.columns)  # of the columns that are joined
    drops = drops.select(*[F.col(c).alias(own + c) for c in drops.columns])
    joined = losing.join(drops.hint("merge"), F.col(id_col) == F.col(f"{own}doc_id"), "left")
    text, gone, owners = F.col(text_col), F.col(f"{own}drop"), F.col(f"{own}owners")
    lines = F.split(text, "\n", -1)

    def kept(x: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone)
        return F.array_join(F.transform(numbers, lambda i: F.get(x, i)), "\n")

    cleaned = F.when(gone.isNull(), text).otherwise(let(lines, kept))
    count = lambda x: F.coalesce(F.when(x.isNotNull(), F.size(x)), F.lit(0)).cast("long")
    shown = lambda said, n, found: [
        *[(said.alias(c) if c == text_col else F.col(f"`{c}`")) for c in rest.columns], count(lines).alias("n_lines"), n.alias("n_dropped"), *[c.alias(k) for k, c in zip(more, (text, found))]
    ]
    out = joined.select(*shown(cleaned, count(gone), owners))
    return out.unionByName(whole.select(*shown(text, F.lit(0).cast("long"), F.lit(None).cast(drops.schema[f"{own}owners"].dataType))))
