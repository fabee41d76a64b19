"""Benchmark decontamination: every passage of every text queries a BM25 index of the test items.

The inverted index holds the test items (long ones in segments), with impacts divided by the item's own score, so
a score is the share of an item's BM25 mass that a passage holds and the threshold is one for all items. Each
passage is a query: block-max WAND retrieves all items at or above the threshold. Terms are split as MaxScore does:
the common ones together can give no item more than half the threshold, so an item's bound for a passage is what
the passage's other terms give it and all that common terms could add. These bounds are taken for all passages of a
text at once; where none reaches the threshold, the query is over. Retrieved items are then verified: word pairs of
the item's question and the words of its answer (its last sentence) must be found in the passage. An item in several
segments is found by any of them: the pairs are those of the segment, and the whole answer must be in some passage of the text.

Passages are windows of two segment lengths every segment length, so that every stretch as long as a segment lies
whole in one of them. The index is broadcast: its size is that of the test items, which are read in blocks of about
``INDEX_CHARS`` characters. Of several blocks each is searched, written and freed before the next one is built, so one
index is in memory at a time; unit counts, mean and greatest length are those of all items.

Defined cases: a null or blank text has no passages; a null or blank item is ignored; items that share an id are one
item with the texts' union of hits; a very long text is searched whole, passage by passage; a score that equals the
threshold reaches it (to 1e-9); repeated documents give repeated rows; without items or documents the result is empty;
``find_leaks`` looks at id and text only, ``without_leaks`` carries all columns along, whatever their names.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, ship_package
from .common import materialise

K1, B = 1.2, 0.75
SEGMENT_WORDS = 128
BLOCK_POSTINGS = 64
#: Threshold that the split into common and other terms is made for; a lower one only prunes less.
SPLIT_AT = 0.6
INDEX_CHARS = 32_000_000
CACHE_ENTRIES = 300_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def term(piece: str) -> str:
    return _EDGE.sub("", piece)


def terms(text: str) -> list[str]:
    return [t for t in map(term, text.lower().split()) if t]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Terms of all sentences but the last, and of the last; a single sentence is all question."""
    parts = [p for p in (terms(x) for x in _SENTENCE.split(text)) if p]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [t for p in parts[:-1] for t in p], parts[-1]


def _segments(n: int) -> list[int]:
    """Starts of the segments of an item of ``n`` terms; the last one ends with the item and overlaps the one before."""
    return [min(at, max(0, n - SEGMENT_WORDS)) for at in range(0, n, SEGMENT_WORDS)]


class Index:
    """Impact-ordered by document: per term, blocks of (unit ids, impacts) with their highest impact."""

    def __init__(self, items: list[tuple[int, str]], counts: Callable[[set[str]], tuple[int, float, int, dict[str, int]]] | None = None) -> None:
        """``counts``: for a set of terms, number of units, their mean and greatest length and the terms' unit counts over
        all blocks;
        without it the items are all there are."""
        self.key = uuid.uuid4().hex
        self.items: list[int] = []
        self.checks: list[tuple[set[tuple[str, str]], set[str]]] = []
        #: Terms of the answer, for the units of items in several segments: it is looked for in the whole text.
        self.apart: dict[int, int] = {}
        units: list[Counter] = []
        self.span = 16
        for item, text in items:
            question, answer = question_answer(text)
            all_terms = question + answer
            for at in _segments(len(all_terms)):
                part = all_terms[at : at + SEGMENT_WORDS]
                cut = max(0, min(len(part), len(question) - at))
                asked = part[:cut]
                if len(part) < len(all_terms):
                    self.apart[len(self.items)] = len(answer)
                self.items.append(item)
                self.checks.append((set(zip(asked, asked[1:])) or {(t, "") for t in asked}, set(answer)))
                units.append(Counter(part))
                self.span = max(self.span, len(part))
        n, mean = len(units), (sum(map(Counter.total, units)) / len(units) if units else 1)
        df: dict[str, int] = Counter(t for u in units for t in u)
        if counts:
            total, mean, longest, df = counts(set(df))
            self.span = max(self.span, longest)
        else:
            total = n
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, u in enumerate(units):
            norm = K1 * (1 - B + B * u.total() / mean)
            impact = {t: math.log(1 + (total - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in u.items()}
            own = sum(impact.values())
            for t, x in impact.items():
                postings[t].append((k, x / own))
        self.blocks = {t: [(p[i : i + BLOCK_POSTINGS], p[min(i + BLOCK_POSTINGS, len(p)) - 1][0], max(x for _, x in p[i : i + BLOCK_POSTINGS])) for i in range(0, len(p), BLOCK_POSTINGS)] for t, p in postings.items()}
        self.most = {t: max(b[2] for b in bs) for t, bs in self.blocks.items()}
        self._split(postings, n)

    def _split(self, postings: dict[str, list[tuple[int, float]]], n: int) -> None:
        """Common terms, by falling frequency as far as half of ``SPLIT_AT`` allows, and the arrays of all others."""
        self.common = np.zeros(n)
        rare: list[str] = []
        for t in sorted(postings, key=lambda t: (-len(postings[t]), t)):
            if not rare:
                more = self.common.copy()
                for k, x in postings[t]:
                    more[k] += x
                if more.max(initial=0.0) <= SPLIT_AT / 2:
                    self.common = more
                    continue
            rare.append(t)
        self.rare = {t: k for k, t in enumerate(rare)}
        self.starts = np.cumsum([0, *(len(postings[t]) for t in rare)])
        flat = [p for t in rare for p in postings[t]]
        self.units = np.array([k for k, _ in flat], np.int64)
        self.impacts = np.array([x for _, x in flat])

    def hopeful(self, ids: np.ndarray, threshold: float) -> np.ndarray:
        """Passages, of a text given as rare-term ids (-1 for other words), in which some item's bound reaches the threshold."""
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return np.arange(0 if self.common.max(initial=0.0) < threshold else -(-len(ids) // self.span))
        first, count = self.starts[ids[at]], self.starts[ids[at] + 1] - self.starts[ids[at]]
        place = np.repeat(first - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        unit, impact, cell = self.units[place], self.impacts[place], np.repeat(at // self.span, count)
        n = len(self.common)
        # a passage is its own cell and the next
        keys, which = np.unique(np.concatenate([cell * n + unit, (cell - 1) * n + unit]), return_inverse=True)
        bound = np.bincount(which, np.concatenate([impact, impact])) + self.common[keys % n]
        found = np.unique(keys[bound >= threshold - 1e-6] // n)
        return found[found >= 0]

    def search(self, query: set[str], threshold: float) -> list[tuple[int, float]]:
        """(unit, score) of all units that reach the threshold, by block-max WAND."""
        # a cursor: [unit, term, block number, place in the block]
        cursors = [[self.blocks[t][0][0][0][0], t, 0, 0] for t in query if t in self.blocks]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.most[c[1]]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            unit = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
                pivot += 1
            # blocks that could hold the pivot unit: their maxima bound its score, and up to the nearest end any other's
            upto, tight = math.inf, 0.0
            for c in cursors[: pivot + 1]:
                blocks, k = self.blocks[c[1]], c[2]
                while k < len(blocks) and blocks[k][1] < unit:
                    k += 1
                if k < len(blocks):
                    tight += blocks[k][2]
                    upto = min(upto, blocks[k][1])
            if tight < threshold - 1e-9:
                to = min(upto + 1, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf)
                cursors = [c for k, c in enumerate(cursors) if k > pivot or self._forward(c, max(to, unit + 1))]
                continue
            if cursors[0][0] == unit:
                total = 0.0
                for c in cursors[: pivot + 1]:
                    total += self.blocks[c[1]][c[2]][0][c[3]][1]
                if total >= threshold - 1e-9:
                    found.append((unit, total))
                cursors = [c for k, c in enumerate(cursors) if k > pivot or self._forward(c, unit + 1)]
            else:
                cursors = [c for k, c in enumerate(cursors) if k > pivot or c[0] >= unit or self._forward(c, unit)]
        return found

    def _forward(self, cursor: list, unit: float) -> bool:
        """Move a cursor to the first posting at or after the unit; False at the end of its list."""
        blocks = self.blocks[cursor[1]]
        while cursor[2] < len(blocks) and blocks[cursor[2]][1] < unit:
            cursor[2] += 1
            cursor[3] = 0
        if cursor[2] >= len(blocks):
            return False
        postings = blocks[cursor[2]][0]
        while postings[cursor[3]][0] < unit:
            cursor[3] += 1
        cursor[0] = postings[cursor[3]][0]
        return True

    def verify(self, unit: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's word pairs and of the answer's words that the passage holds."""
        asked, answer = self.checks[unit]
        pairs = set(zip(passage, passage[1:])) | {(t, "") for t in passage}
        question = len(asked & pairs) / len(asked) if asked else 1.0
        return question, (len(answer & set(passage)) / len(answer) if answer else 1.0)


class _Ids(dict):
    """Bounded cache: the rare-term id of a piece, or -1."""

    def __init__(self, rare: dict[str, int]) -> None:
        super().__init__()
        self.rare = rare

    def __missing__(self, piece: str) -> int:
        value = self.rare.get(term(piece), -1)
        if len(piece) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = value
        return value


_CACHE: dict[str, _Ids] = {}


def _answer_share(index: Index, unit: int, pieces: list[str]) -> float:
    """The largest share of the answer of a long item that a passage of the text holds. A passage for an answer longer than
    a segment is as much longer."""
    answer, step = index.checks[unit][1], index.span
    width = (1 + max(1, -(-index.apart[unit] // step))) * step
    windows = (set(map(term, pieces[at : at + width])) for at in range(0, len(pieces), step))
    return max((len(answer & w) / len(answer) for w in windows), default=0.0)


def _search_text(index: Index, known: _Ids, text: str, threshold: float, question: float, answer: float) -> dict[int, tuple[int, float, float, float]]:
    """item -> (passages, best score, question overlap, answer overlap) of one text."""
    pieces = text.lower().split()
    step = index.span
    ids = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
    out: dict[int, tuple[int, float, float, float]] = {}
    for at in (index.hopeful(ids, threshold) * step).tolist():
        passage = [t for t in map(term, pieces[at : at + 2 * step]) if t]
        for unit, score in index.search(set(passage), threshold):
            q, a = index.verify(unit, passage)
            if q >= question and a < answer and unit in index.apart:
                a = max(a, _answer_share(index, unit, pieces))
            if q >= question and a >= answer:
                was = out.get(index.items[unit], (0, 0.0, 0.0, 0.0))
                out[index.items[unit]] = (was[0] + 1, *max(was[1:], (score, q, a)))
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of about INDEX_CHARS characters; a block is on the driver, the items never all. Items that
    share an id are in one block."""
    held, chars = [], 0
    for r in items.toLocalIterator():
        if held and chars + len(r["text"]) > INDEX_CHARS and held[-1][0] != r["item_id"]:
            yield held
            held, chars = [], 0
        held.append((r["item_id"], r["text"]))
        chars += len(r["text"])
    if held:
        yield held


def _counts(items: DataFrame) -> Callable[[set[str]], tuple[int, float, int, dict[str, int]]]:
    """Unit counts of terms over all items: a table, read through once for each block for the block's own terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            df: Counter = Counter()
            units = length = longest = 0
            for text in b.column(0).to_pylist():
                question, answer = question_answer(text)
                all_terms = question + answer
                for at in _segments(len(all_terms)):
                    part = all_terms[at : at + SEGMENT_WORDS]
                    df.update(set(part))
                    units, length, longest = units + 1, length + len(part), max(longest, len(part))
            # no term is empty or blank
            rows = [("", units), (" ", length), ("\n", longest), *df.items()]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.int64())], names=["term", "df"])

    total = F.when(F.col("term") == "\n", F.max("df")).otherwise(F.sum("df"))
    table, _ = materialise(items.select("text").mapInArrow(run, "term string, df bigint").groupBy("term").agg(total.alias("df")), "item-terms")

    def counts(wanted: set[str]) -> tuple[int, float, int, dict[str, int]]:
        df = {r["term"]: r["df"] for r in table.toLocalIterator() if r["term"] in wanted or not r["term"].strip()}
        units, length, longest = df.pop(""), df.pop(" "), df.pop("\n")
        return units, length / max(units, 1), longest, df

    return counts


def _indexes(items: DataFrame) -> Iterator[tuple[Index, bool]]:
    """The index of each block, and whether another one follows."""
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    wanted = wanted.where("text is not null and item_id is not null")
    counts = None
    for block, more in _with_more(_blocks(wanted.orderBy("item_id", "text"))):
        if more and counts is None:
            counts = _counts(wanted)
        yield Index(block, counts), more


def _with_more(blocks: Iterator[list[tuple[int, str]]]) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Each block, and whether another one follows."""
    held = next(blocks, None)
    while held is not None:
        after = next(blocks, None)
        yield held, after is not None
        held = after


def _searched(index: Index, texts: list[str | None], limits: tuple[float, float, float]) -> list[dict]:
    if index.key not in _CACHE:
        _CACHE.clear()
        _CACHE[index.key] = _Ids(index.rare)
    known = _CACHE[index.key]
    return [_search_text(index, known, t, *limits) if t and not t.isspace() else {} for t in texts]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.6,
    question_overlap: float = 0.6,
    answer_overlap: float = 0.6,
) -> DataFrame:
    """One row per document and test item that one of its passages holds: ``doc_id``, ``item_id``, ``n_passages``,
    ``score``, ``question_overlap``, ``answer_overlap``. No shuffle."""
    spark = docs.sparkSession
    ship_package(spark)
    limits = (threshold, question_overlap, answer_overlap)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, n_passages int, score double, question_overlap double, answer_overlap double"
    out: DataFrame | None = None
    for index, more in _indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(k, item, *x) for k, hits in enumerate(_searched(shared.value, b.column(1).to_pylist(), limits)) for item, x in hits.items()]
                of, *cols = list(zip(*found)) or [[]] * 6
                kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
                arrays = [b.column(0).take(pa.array(of, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "n_passages", "score", "question_overlap", "answer_overlap"])

        found = rows.mapInArrow(run, schema)
        if more or out is not None:
            found, _ = materialise(found, "leaks")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    threshold: float = 0.6,
    question_overlap: float = 0.6,
    answer_overlap: float = 0.6,
) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts hold no test item. No shuffle."""
    spark = docs.sparkSession
    ship_package(spark)
    limits = (threshold, question_overlap, answer_overlap)
    path = None
    for index, more in _indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = _searched(shared.value, b.column(b.schema.get_field_index(text_col)).to_pylist(), limits)
                yield b.filter(pa.array([not x for x in hits], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if more:
            docs, after = materialise(docs, "without-leaks")
            shared.destroy()
            if path is not None:
                release(spark, path)
            path = after
    return docs
