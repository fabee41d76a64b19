"""Toxicity scores by a counterfactual-regularised linear classifier.

Features are the distinct words of a text and word beginnings of three to eight letters. The most telling ones
are chosen from a bounded sample of labelled documents, and a logistic model over them is fitted with a second
penalty: each labelled text that names a group is paired with a copy in which the identity terms are swapped for
others of their kind, and any change of score between the two costs. So mentioning a group carries no weight by
itself. Labels come only from rows outside the held-out fold; language, source and id are never inputs.

``sample_rows`` bounds the labelled rows that are fitted on and ``max_features`` the model, and so what the driver holds;
both are parameters, and nothing else is capped: every text is scored whole.

Defined cases: a null text counts as empty and gets the score of no evidence; without labels of both classes
every score is the smoothed share of toxic labels; rows of ``labels`` with a null id or label are ignored, several
for one id count as toxic if any is; a null id is in no fold; a very long text is a set of words like any other; features of
equal surprise are taken in the order of their text; repeated rows get repeated scores; an empty table gives an empty result;
other columns are not looked at, and carried along only where ``keep`` names them and no result bears their name.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import free_prefix

SAMPLE_ROWS = 8192
MAX_FEATURES = 4000
MIN_DOCUMENTS = 4
#: Standard deviations that a feature's toxic share must be off by: weaker ones are mostly chance.
MIN_SURPRISE = 3.0
CACHE_ENTRIES = 100_000
# Identity terms by kind, each swapped for the next of its kind.
IDENTITY_TERMS = {
    "religion": "christian muslim jewish hindu buddhist atheist".split(),
    "religions": "christians muslims jews hindus buddhists atheists".split(),
    "gender": "man woman".split(),
    "genders": "men women".split(),
    "orientation": "gay lesbian straight bisexual transgender queer".split(),
    "origin": "african asian european american mexican chinese arab".split(),
    "colour": "black white brown".split(),
    "ability": "deaf blind disabled autistic".split(),
    "religion_fr": "chrétien musulman juif".split(),
    "religion_de": "christ moslem jude".split(),
    "religion_es": "cristiano musulmán judío".split(),
}
SWAP = {t: terms[(k + 1) % len(terms)] for terms in IDENTITY_TERMS.values() for k, t in enumerate(terms)}
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def held_out(doc_id: Column) -> Column:
    """True for the fold whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_features(piece: str) -> list[str]:
    """Features of one piece between white space."""
    word = _EDGE.sub("", piece)
    if not word:
        return []
    return ["=" + word, *[word[:k] for k in range(3, min(8, len(word)) + 1)]]


def text_features(pieces: Iterable[str]) -> set[str]:
    return {f for p in pieces for f in word_features(p)}


def swapped(pieces: set[str]) -> set[str] | None:
    """The pieces with identity terms exchanged, or None where there is none."""
    if not any(_EDGE.sub("", p) in SWAP for p in pieces):
        return None
    return {SWAP.get(_EDGE.sub("", p), p) for p in pieces}


def _features_table(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                own, other = [], []
                for t in b.column("text").to_pylist():
                    pieces = set((t or "").lower().split())
                    cf = swapped(pieces)
                    own.append(sorted(text_features(pieces)))
                    other.append(None if cf is None else sorted(text_features(cf)))
                kind = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(own, kind), pa.array(other, kind)], names=["toxic", "own", "other"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, own array<string>, other array<string>")


class ToxicityModel:
    """Bias and weights of features."""

    def __init__(self, bias: float, weights: dict[str, float]) -> None:
        self.bias, self.weights, self.key = bias, weights, uuid.uuid4().hex

    def score(self, text: str | None) -> float:
        return _sigmoid(self.bias + sum(self.weights.get(f, 0.0) for f in text_features(set((text or "").lower().split()))))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES, counterfactual: float = 1.0
) -> ToxicityModel:
    """Learn from at most ``sample_rows`` labelled documents, those whose ids hash lowest, with at most ``max_features``
    features, those whose toxic share differs most from the overall one."""
    ship_package(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(sample_rows)  # so the broadcast is bounded by sample_rows
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marks), "id")
    table = _features_table(rows.select("toxic", "text")).persist()
    try:
        n, toxic = table.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        prior = (toxic + 1) / (n + 2)
        if not 0 < toxic < n:
            return ToxicityModel(math.log(prior / (1 - prior)), {})
        seen = table.select("toxic", F.explode("own").alias("f")).groupBy("f").agg(F.sum("toxic").alias("pos"), F.count("*").alias("all"))
        # surprise: how far the toxic share of the documents with the feature is from the overall one
        share = F.lit(toxic / n)
        surprise = F.abs(F.col("pos") - F.col("all") * share) / F.sqrt(F.col("all") * share * (1 - share))
        picked = seen.where((F.col("all") >= MIN_DOCUMENTS) & (surprise >= MIN_SURPRISE)).orderBy(surprise.desc(), "f").limit(max_features).select("f")
        names = sorted({r["f"] for r in picked.collect()} | {"=" + t for t in SWAP})
        at = {f: k for k, f in enumerate(names)}
        known = docs.sparkSession.sparkContext.broadcast(at)

        def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = known.value
            pick = lambda x: None if x is None else [ids[f] for f in x if f in ids]
            for b in batches:
                own = [pick(x) for x in b.column("own").to_pylist()]
                other = [pick(x) for x in b.column("other").to_pylist()]
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(own, kind), pa.array(other, kind)], names=["toxic", "own", "other"])

        sample = table.mapInArrow(indexed, "toxic int, own array<int>, other array<int>").toArrow()
    finally:
        table.unpersist()
    y = sample.column("toxic").to_numpy().astype(float)
    own, other = sample.column("own").to_pylist(), sample.column("other").to_pylist()
    order = sorted(range(len(y)), key=lambda i: (y[i], own[i], other[i] or []))  # independent of the order of arrival
    y, own, other = y[order], [own[i] for i in order], [other[i] for i in order]
    bias, w = _train(own, other, y, len(names), counterfactual)
    return ToxicityModel(bias, {f: float(v) for f, v in zip(names, w) if v})


def _csr(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows)), lens), np.array([c for r in rows for c in r], dtype=np.int64)


def _train(own: list[list[int]], other: list[list[int] | None], y: np.ndarray, n_features: int, counterfactual: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Full-batch Adam on balanced log loss + ridge + counterfactual penalty on the change of the logit."""
    row, col = _csr(own)
    pairs = [i for i, x in enumerate(other) if x is not None]
    p_row, p_col = _csr([own[i] for i in pairs])
    q_row, q_col = _csr([other[i] for i in pairs])
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    theta = np.zeros(n_features + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, b = theta[:-1], theta[-1]
        s = b + np.bincount(row, w[col], len(y))
        err = weight * (1 / (1 + np.exp(-np.clip(s, -50, 50))) - y)
        grad = np.append(np.bincount(col, err[row], n_features) + 2e-4 * w, err.sum())
        if pairs:
            d = np.bincount(p_row, w[p_col], len(pairs)) - np.bincount(q_row, w[q_col], len(pairs))
            pull = 2 * counterfactual * d / len(y)
            grad[:-1] += np.bincount(p_col, pull[p_row], n_features) - np.bincount(q_col, pull[q_row], n_features)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(theta[-1]), theta[:-1]


class _Known(dict):
    """Bounded cache: a piece's features that have a weight."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, piece: str) -> tuple[str, ...]:
        found = tuple(f for f in word_features(piece) if f in self.weights)
        if len(piece) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = found
        return found


_CACHE: dict[str, _Known] = {}


def _known(key: str, weights: dict[str, float]) -> _Known:
    """The features of a model's key; a worker keeps those of the last model over its tasks."""
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = _Known(weights)
    return _CACHE[key]


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` per row. One pass over the texts, no shuffle.

    ``keep`` names columns of ``docs`` to carry along; a column that clashes with a result is the result's."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast((model.key, model.bias, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bias, weights = shared.value
        known = _known(key, weights).__getitem__
        for b in batches:
            out = []
            for t in b.column(b.num_columns - 1).to_pylist():
                hits: set[str] = set()
                if t:
                    for found in filter(None, map(known, set(t.lower().split()))):
                        hits.update(found)
                out.append(_sigmoid(bias + sum(map(weights.__getitem__, sorted(hits)))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], names=[*b.schema.names[:-1], "score"])

    results = ("doc_id", "held_out", "score", "predicted")
    kept = [F.col(c) for c in keep if c not in results]
    rows = docs.select(F.col(id_col).alias("doc_id"), *kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(free_prefix(docs.columns)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    scored = rows.mapInArrow(run, f"{schema}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[c for c in keep if c not in results])
