"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's character-class histogram and common-word histogram are compared with its language's
reference by Jensen-Shannon distance. The references are counted over all documents of the language. A
document with fewer than ``min_words`` words is never rejected by the distances: its histograms are noise.

Defined cases: null text counts as empty (no words, ``base_failed``); an unknown or null language has no
reference, so only the base rules decide; a very long text is counted whole; a value or distance at its limit passes;
repeated rows give repeated results and count in the references as often as they stand; an empty table gives an
empty result; columns other than id, text and language are not looked at, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, let, materialise, words_of

# Frequent function words of each reference language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er aus".split(),
    "en": "the of and to in a is that for it as was with be by on not he are this at from or an have".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il".split(),
}
N_COMMON = 25
# Character classes, as Java character class bodies; what is in none of them is the last bin.
CHAR_CLASSES = ("a-z", "A-Z", "0-9", r"\x20\x09-\x0D", ".,;:'\"!?()\\x2D", "\\u0080-\\uFFFF")


def _js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of two count arrays."""

    def shares(x: Column) -> Column:
        return let(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(x, lambda v: v / s))

    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    parts = F.zip_with(shares(p), shares(q), lambda a, b: (half(a, b) + half(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)))


def _repeated_words(words: Column, window: int) -> Column:
    """Number of words inside ``window``-word windows that occur twice or more in the text."""
    hashes = F.when(
        F.size(words) > window,
        F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window))),
    )

    def covered(starts: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(starts, start, step)["n"]

    def repeated(by_hash: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(by_hash, j)["h"] == x["h"], F.lit(False))
        found = F.filter(by_hash, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def counted(h: Column) -> Column:
        pairs = F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(pairs), repeated))

    return F.coalesce(let(hashes, lambda h: F.when(h.isNotNull(), counted(h))), F.lit(0))


def _class_counts(text: Column) -> Column:
    """Struct of the characters per class (``counts``, the last bin for the rest) and the symbols (``symbols``).

    Each class is counted on what the classes before it have left, so only the first pass reads the whole text."""
    symbols = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"[#*$%&|<>]+", ""))

    def count(rest: Column, k: int, found: list[Column], marks: Column) -> Column:
        if k == len(CHAR_CLASSES):
            return F.struct(F.array(*[c.cast("double") for c in (*found, F.length(rest))]).alias("counts"), marks.alias("symbols"))
        less = F.regexp_replace(rest, f"[{CHAR_CLASSES[k]}]+", "")
        # the first class holds no symbol, so they can be counted on what it leaves
        return let(less, lambda x: count(x, k + 1, [*found, F.length(rest) - F.length(x)], marks if k else symbols(x)))

    return count(text, 0, [], F.lit(0))


def _common_counts(words: Column, listed: Column) -> Column:
    """How often each listed word occurs, and all other words. Listed words become letters of one string: counting a
    letter by its removal is much cheaper than filtering an array for each."""
    letters = "".join(map(chr, range(65, 65 + N_COMMON)))
    short = F.filter(words, lambda w: F.octet_length(w) <= 5)
    codes = F.array_join(F.transform(short, lambda w: F.substring(F.lit(letters), F.nullif(F.array_position(listed, F.lower(w)), F.lit(0)).cast("int"), F.lit(1))), "")
    return let(
        codes,
        lambda c: F.array(
            *[(F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("double") for x in letters],
            (F.size(words) - F.length(c)).cast("double"),
        ),
    )


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: base counts, ``chars`` and ``common`` histograms. One scan, no shuffle."""
    text, lang = F.coalesce(F.col("text"), F.lit("")), F.col("lang")
    lists = F.lit(None).cast("array<string>")
    for name, found in COMMON_WORDS.items():
        lists = F.when(lang == name, F.array(*map(F.lit, found))).otherwise(lists)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    base = base.withColumns({"words": words_of(F.col("text")), "listed": lists, "classes": _class_counts(text)})
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return base.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("classes.symbols").cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        _repeated_words(F.col("words"), 8).cast("long").alias("n_repeat_words"),
        F.col("classes.counts").alias("chars"),
        F.when(F.col("listed").isNotNull(), _common_counts(F.col("words"), F.col("listed"))).alias("common"),
    )


def language_references(stats: DataFrame) -> DataFrame:
    """Per reference language the summed histograms of all its documents; at most ``len(COMMON_WORDS)`` rows."""
    sums = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    return (
        stats.where(F.col("lang").isin(*COMMON_WORDS))
        .groupBy("lang")
        .agg(sums("chars", len(CHAR_CLASSES) + 1).alias("ref_chars"), sums("common", N_COMMON + 1).alias("ref_common"))
    )


def score_quality(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    references: DataFrame | None = None,
    min_words: int = 50,
    max_char_distance: float = 0.28,
    max_word_distance: float = 0.36,
) -> DataFrame:
    """Base counts, both distances (null without a reference or under ``min_words``) and the verdict per document.

    The per-document histograms are written once to shared scratch storage: the corpus pass for the
    references and the verdict pass then both read a few hundred bytes a document instead of the texts."""
    stats, _ = materialise(document_stats(docs, id_col, text_col, lang_col), "quality")
    refs = references if references is not None else language_references(stats)
    # one row per reference language, so the broadcast is bounded by COMMON_WORDS
    scored = stats.join(F.broadcast(refs), "lang", "left")
    judged = (F.col("n_words") >= min_words) & F.col("ref_chars").isNotNull()
    scored = scored.withColumns(
        {
            "char_distance": F.when(judged, _js_distance(F.col("chars"), F.col("ref_chars"))),
            "word_distance": F.when(judged, _js_distance(F.col("common"), F.col("ref_common"))),
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )
    off = (F.col("char_distance") > max_char_distance) | (F.col("word_distance") > max_word_distance)
    return scored.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "char_distance", "word_distance", (~F.col("base_failed") & ~F.coalesce(off, F.lit(False))).alias("kept"),
    )
