"""BPE encoding and decoding of whole texts.

Encoding merges with a priority queue of merge ranks over a doubly linked list of symbols; queue entries whose
symbols have changed meanwhile are stale and skipped. Decoding concatenates vocabulary strings, with the spaces
that the library puts between them where a tokenizer file names no decoder.

Supported are tokenizer files of the kind ``word_bpe_49k.json``: NFC, white space collapsed, lower case, split by
the file's pattern, byte-level alphabet, word-end suffix. Their path is a parameter; the parsed tables are
broadcast once (their size is that of the file). Each Python worker keeps bounded caches of encoded words.

Defined cases: a null or blank text has no tokens and decodes to the empty string; special token strings inside
a text become their ids, as in the library; a very long text or word is encoded whole, the word in n log n; pairs of one
rank merge from left to right; repeated rows give repeated results; an empty table gives an empty result; only id and
text are looked at, whatever the other columns are called.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
#: Encoded words and white-space-free pieces kept per Python worker; beyond it the cache starts anew.
CACHE_ENTRIES = 300_000
#: Rows of an output batch: texts and ids of a batch are in memory together.
BATCH_ROWS = 128


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def load(path: str) -> dict:
    """The tables of a tokenizer file that encoding needs."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model = spec["model"]
    steps = spec["pre_tokenizer"]["pretokenizers"]
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        raise ValueError(f"{path}: a tokenizer of another kind")
    return {
        "vocab": model["vocab"],
        "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
        "suffix": model["end_of_word_suffix"] or "",
        "split": steps[0]["pattern"]["Regex"],
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


class Bpe:
    """One tokenizer. ``encode`` gives ids, ``decode`` the library's text for ids."""

    def __init__(self, tables: dict) -> None:
        vocab, suffix = tables["vocab"], tables["suffix"]
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in tables["special"].items()}
        self.special = tables["special"]
        self._cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._split = regex.compile(tables["split"])
        alphabet = byte_alphabet()
        self._inner = [vocab.get(c) for c in alphabet]
        self._final = [vocab.get(c + suffix) for c in alphabet]
        self._rank = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(tables["merges"])}
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _merge(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        symbols = [self._inner[b] for b in raw]
        symbols[-1] = self._final[raw[-1]]
        n = len(symbols)
        rank = self._rank
        if n > 1:
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            queue = []
            for k in range(n - 1):
                found = rank.get((symbols[k], symbols[k + 1]))
                if found:
                    queue.append((found[0], k, symbols[k], symbols[k + 1], found[1]))
            heapq.heapify(queue)
            while queue:
                _, k, a, b, merged = heapq.heappop(queue)
                right = after[k]
                if symbols[k] != a or right >= n or symbols[right] != b:
                    continue  # stale: one of the two symbols has been merged since
                symbols[k], symbols[right] = merged, -1
                after[k] = follower = after[right]
                if follower < n:
                    before[follower] = k
                    if found := rank.get((merged, symbols[follower])):
                        heapq.heappush(queue, (found[0], k, merged, symbols[follower], found[1]))
                if (left := before[k]) >= 0 and (found := rank.get((symbols[left], merged))):
                    heapq.heappush(queue, (found[0], left, symbols[left], merged, found[1]))
        return array("i", [s for s in symbols if s != -1]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of text without white space."""
        if (known := self._pieces.get(piece)) is not None:
            return known
        out = []
        for word in self._split.findall(piece):
            ids = self._words.get(word)
            if ids is None:
                ids = self._merge(word)
                if len(word) <= 64:
                    if len(self._words) >= CACHE_ENTRIES:
                        self._words.clear()
                    self._words[word] = ids
            out.append(ids)
        ids = b"".join(out)
        if len(piece) <= 64:
            if len(self._pieces) >= CACHE_ENTRIES:
                self._pieces.clear()
            self._pieces[piece] = ids
        return ids

    def _plain(self, text: str) -> list[bytes]:
        # lower case is taken letter by letter, without the rule for a sigma that ends a word
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, but not to the pattern
            pieces = regex.split(r"[\s--[\x1c-\x1f]]+", text, flags=regex.V1)
        else:
            pieces = text.split()
        known, piece = self._pieces.get, self._piece
        return [known(p) or piece(p) for p in pieces]

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        out: list[bytes] = []
        if self._cut is None or "<|" not in text:
            out = self._plain(text)
        else:
            at = 0
            for m in self._cut.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(array("i", [self.special[m.group()]]).tobytes())
                at = m.end()
            out += self._plain(text[at:])
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.names.__getitem__, ids.tolist()))


_LOADED: dict[str, Bpe] = {}


def _tokenizer(key: str, tables: Broadcast) -> Bpe:
    """The tokenizer of a key; a worker keeps the last one over its tasks."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(tables.value)
    return _LOADED[key]


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` per row; one pass over the texts, no shuffle."""
    spark = docs.sparkSession
    ship_package(spark)
    tables, key = spark.sparkContext.broadcast(load(path)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(key, tables)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(map(bpe.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
