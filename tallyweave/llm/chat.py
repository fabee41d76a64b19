"""Chat formatting in token-budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens choose turn-aligned windows. Each window repeats the conversation's leading system
turn and as much recent history as its allowance holds; repeated turns stand there for context only and are
masked, so every assistant turn carries loss exactly once. A turn longer than the budget gets a window of its
own: nothing is cut.

Template: a turn is ``<|turn|>role\\ntext<|end|>``, a repeated one ``<|seen|>role\\ntext<|end|>``. In roles and
texts a backslash becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so no text can forge a marker, and unescaping
gives back the text. Line breaks in a role become ``\\n``.

Tokens are those of a column where one is named, such as the counts of a tokenizer that has run before; else an
estimate from the text, by default its characters over four, rounded up, plus four for the markers.

Defined cases: null role or text counts as empty, a null or negative token count as none; turns are ordered by turn (null
first), then role, then text, so ties and repeated rows have one order; a very long turn has a window of its own and is not
cut; rows without conv_id belong to no common conversation: equal ones are one conversation, told apart by ``part``; an
empty table gives no window; columns other than those named are not looked at, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

TURN, SEEN, END = "<|turn|>", "<|seen|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: every backslash stands before the character that it protects."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def role_in(role: Column) -> Column:
    """The inverse of ``_role_out``: an odd backslash before n stands for a line break."""
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long") + 4


def format_windows(
    conversations: DataFrame,
    *,
    budget: int = 512,
    history: int = 128,
    tokens_col: str | None = None,
    estimate: Callable[[Column], Column] = estimated_tokens,
) -> DataFrame:
    """One row per window: ``conv_id``, ``part`` (null but for rows without conv_id), ``window``, ``formatted``, ``loss``
    (array of code point (start, end)), ``tokens``.

    A turn's tokens are ``tokens_col`` or ``estimate`` of its text. Prefix sums are cut into cells of ``budget - history -
    system`` tokens. A turn belongs to the cell in which it begins; one that runs over the cell's end stays in its window
    if the window still fits, or else has a window to itself. So a window exceeds the budget only where a single turn does.
    History is the run of turns at the end of the window before whose tokens stay within ``history``."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    tokens = estimate(text) if tokens_col is None else F.greatest(F.lit(0), F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)))
    part = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", role, text))
    rows = conversations.select("conv_id", part.alias("part"), "turn", role.alias("role"), text.alias("text"), tokens.alias("tokens"))
    conv = Window.partitionBy("conv_id", "part")
    order = conv.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"pos": F.row_number().over(order), "upto": F.sum("tokens").over(upto)})
    is_system = (F.col("pos") == 1) & (F.col("role") == "system")
    rows = rows.withColumns(
        {
            "sys_role": F.first(F.when(is_system, F.col("role"))).over(upto),
            "sys_text": F.first(F.when(is_system, F.col("text"))).over(upto),
            "sys_tokens": F.first(F.when(is_system, F.col("tokens")).otherwise(0)).over(upto),
        }
    )
    width = F.greatest(F.lit(1), budget - history - F.col("sys_tokens"))
    begin, end = F.greatest(F.lit(0), F.col("upto") - F.col("tokens") - F.col("sys_tokens")), F.col("upto") - F.col("sys_tokens")
    rows = rows.withColumns({"begin": begin, "end": end, "width": width}).withColumn("cell", F.floor(F.col("begin") / F.col("width")))
    rows = rows.withColumn("first", F.min("begin").over(Window.partitionBy("conv_id", "part", "cell")))
    alone = (F.col("end") > (F.col("cell") + 1) * F.col("width")) & (F.col("end") - F.col("first") > F.col("width"))
    rows = rows.withColumn("cell", 2 * F.col("cell") + F.when(alone, 1).otherwise(0))
    rows = rows.withColumn("window", F.dense_rank().over(conv.orderBy("cell")) - 1)
    backwards = Window.partitionBy("conv_id", "part", "window").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"to_end": F.sum("tokens").over(backwards), "last": F.max("window").over(conv)})
    again = rows.where((F.col("to_end") <= history) & ~is_system & (F.col("window") < F.col("last"))).select(
        "conv_id", "part", (F.col("window") + 1).alias("window"), "pos", "role", "text", "tokens", F.lit(True).alias("seen")
    )
    head = (
        rows.where((F.col("window") > 0) & F.col("sys_text").isNotNull())
        .groupBy("conv_id", "part", "window")
        .agg(F.lit(0).alias("pos"), F.first("sys_role").alias("role"), F.first("sys_text").alias("text"), F.first("sys_tokens").alias("tokens"))
        .withColumn("seen", F.lit(True))
    )
    parts = rows.select("conv_id", "part", "window", "pos", "role", "text", "tokens", F.lit(False).alias("seen")).unionByName(again).unionByName(head)
    lead = F.concat(F.when(F.col("seen"), SEEN).otherwise(TURN), _role_out(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    item = F.struct(
        "pos",
        F.concat(lead, body, F.lit(END)).alias("piece"),
        F.length(lead).alias("before"),
        F.length(body).alias("inside"),
        (~F.col("seen") & (F.col("role") == "assistant")).alias("learn"),
    )
    windows = parts.groupBy("conv_id", "part", "window").agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum("tokens").alias("tokens"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["before"]
        span = F.array(F.struct(start.alias("start"), (start + x["inside"]).alias("end")))
        return F.struct((acc["at"] + F.length(x["piece"])).alias("at"), F.when(x["learn"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    return windows.select(
        "conv_id",
        "part",
        "window",
        F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("formatted"),
        F.aggregate("items", zero, step, lambda acc: acc["loss"]).alias("loss"),
        "tokens",
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of the turns that a window shows for the first time, parsed from the formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: F.startswith(p, F.lit(TURN)))

    def parse(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(TURN) + 1))
        return let(body, lambda b: F.struct(role_in(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substr(b, F.instr(b, F.lit("\n")) + 1)).alias("text")))

    return F.transform(pieces, parse)


def read_loss(formatted: Column, loss: Column) -> Column:
    """Unescaped text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
