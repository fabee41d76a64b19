"""Near-duplicate documents by a chosen-path set similarity join.

After Christiani, Pagh and Sivertsen, "Scalable and Robust Set Similarity Join" (ICDE 2018). Documents branch
recursively by selected minwise tokens: at each node of a tree a document goes to one child for each of
``BRANCH`` sketch positions, named by its minwise token there. Nodes of at most ``SMALL`` documents are compared
exhaustively; in a larger one each document is compared with a few anchors, and the node branches on. Independent
trees repeat this to the target recall: a pair of similarity 0.8 is missed by one tree with probability 0.2 **
BRANCH, about 0.008, and by both with 0.00006; where all its nodes branch down to the last level, by one with 0.0089 and
by both with 0.00008. A node that is still over-full on the last level is taken for one cluster.

What is compared in the trees are sketches; links are confirmed on full sets afterwards, inside the clusters that
the sketches leave connected. Identical sets are one node throughout. Clusters too large for one task are dealt
out over blocks that share anchors; what is then outside a cluster's largest component meets the others by its rare
shingles, exactly but for 0.000003 of the pairs, which the bits that go with them part.

Only star links and pairs of different components are ever emitted, never all pairs of a group, and no group is gathered in
one task beyond the stated limits.

Defined cases: a null or blank text has an empty set, is linked with nothing and kept; a text of fewer words than a shingle
is one shingle; a very long text is taken whole; a pair at exactly the similarity is linked, in whole numbers; rows that
share a doc_id are one document; rows with a null doc_id are never linked, have no component and are kept; an empty table
gives an empty result; columns other than id and text are not looked at, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialise, scratch_scope
from .components import connected_components

#: Sketch positions, independent trees, children per node and level, levels.
POSITIONS, TREES, BRANCH, LEVELS = 64, 2, 3, 3
#: Nodes of at most SMALL documents, on the last level LAST, are compared exhaustively. Larger ones are dealt out in blocks
#: of LARGE, on the last level not at all. A node of one block is done with if comparison with its anchors leaves at most
#: FEW outside one cluster.
SMALL, LARGE, LAST, FEW, ANCHORS = 1024, 16384, 2048, 1024, 32
#: Documents and set elements of a block in which links are confirmed.
BLOCK_DOCS, BLOCK_ITEMS = 4096, 1_000_000
#: Documents of either side in a task that looks for pairs under one rare shingle, and buckets of the shingles' counts.
CELL_DOCS, COUNT_BITS = 8192, 20
#: Bits of the bitmap that picks possible members of clusters (64 MB).
MAX_BITS = 1 << 29
CACHE_ENTRIES = 300_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


class _Words(dict):
    """Bounded cache of word hashes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles of a UTF-8 text, A-Z lower-cased."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=1)], np.uint64)
    h = _mix(np.fromiter(map(_WORDS.__getitem__, parts), np.uint64, len(parts)))
    n = len(parts) - words + 1
    out = h[:n].copy()
    for k in range(1, words):
        out = out * _ODD + h[k : k + n]
    return np.unique(_mix(out))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_MULT = _multipliers()


def minwise(items: np.ndarray) -> np.ndarray:
    """The minwise token at each position, as 64-bit values."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 4096):
        least = np.minimum(least, (items[at : at + 4096, None] * _MULT[None, :]).min(axis=0))
    return _mix(least)


def _child(key: np.ndarray | int, position: int, token: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix((np.uint64(key) ^ _mix(np.uint64(token) * _ODD)) * _ODD + np.uint64(position))


def _positions(key: int, level: int) -> list[int]:
    """The positions that the node named ``key`` selects: a rule of its name, the same in every task."""
    return [int(x) for x in np.random.default_rng([int(key) & (2**63 - 1), level]).choice(POSITIONS, BRANCH, replace=False)]


def sketch_table(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``doc_id``, set size, set address, sketch, and the names of the first nodes in each tree."""
    roots = [(t, p) for t in range(TREES) for p in _positions(t + 1, 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, address, sketch, keys = [], [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                if not len(s):
                    address.append(None), sketch.append(None), keys.append([])
                    continue
                m = minwise(s)
                address.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketch.append((m & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
                keys.append([int(_child(t + 1, p, m[p]).astype(np.int64)) for t, p in roots])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(address, pa.binary()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "address", "sketch", "keys"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, address binary, sketch binary, keys array<bigint>")


def _least_matches(similarity: float) -> int:
    """Matching positions that a pair of the similarity reaches but for 4.5 standard deviations."""
    return int(np.ceil(POSITIONS * (similarity - 4.5 * np.sqrt(similarity * (1 - similarity) / POSITIONS))))


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of equal leading columns from rows sorted by them; one run is in memory at a time."""
    held: list[pa.RecordBatch] = []
    at: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            key = tuple(k[lo] for k in keys)
            if key != at:
                if held:
                    yield at, held
                held, at = [], key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield at, held


def _column(parts: list[pa.RecordBatch], name: str) -> pa.Array:
    return pa.concat_arrays([p.column(name) for p in parts])


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), POSITIONS)


class _Labels:
    """Component labels of the members of one small group."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        hit = np.unique(self.of[np.append(others, i)])
        if len(hit) > 1:
            self.of[np.isin(self.of, hit[1:])] = hit[0]

    def stars(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(smallest node, member) of each component, for members other than the smallest."""
        order = np.lexsort((nodes, self.of))
        of, node = self.of[order], nodes[order]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        head = np.repeat(node[first], np.diff(np.append(first, len(of))))
        other = head != node
        return head[other], node[other]


def _links_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([cat(a), cat(b)], names=["a", "b"])


def _visit(rows: DataFrame, least: int, level: int) -> DataFrame:
    """One level of the trees. Rows: ``key``, ``node``, ``cluster``, ``sketch``, ``small``, ``anchor``, ``own``.

    Out come star links (``a``, ``b``) of documents whose sketches agree in ``least`` positions, and the children
    (``key``, ``b`` as node, ``sketch``) of the documents of large nodes. In a small node all members are compared. In a
    large one all are compared with its anchors first; where that leaves few outside one cluster, as among many copies
    of one text, these few are compared with all and the node is done. Members known to be in one cluster are not
    compared with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, held = [], 0
        for _, parts in _groups(batches, 1):
            node = _column(parts, "node").to_numpy()
            sk = _sketches(_column(parts, "sketch"))
            small, whole = (parts[0].column(c)[0].as_py() for c in ("small", "whole"))
            labels = _Labels(len(node))
            _, labels.of = np.unique(_column(parts, "cluster").to_numpy(), return_inverse=True)

            def compare(rows: np.ndarray, labels=labels, sk=sk) -> None:
                for i in rows.tolist():
                    other = np.flatnonzero(labels.of != labels.of[i])
                    if len(other):
                        near = other[(sk[other] == sk[i]).sum(axis=1) >= least]
                        if len(near):
                            labels.join(i, near)

            if not small:
                compare(np.flatnonzero(_column(parts, "anchor").to_numpy(zero_copy_only=False)))
            rest = np.flatnonzero(labels.of != np.bincount(labels.of).argmax())
            if small or whole and len(rest) <= FEW:
                # all pairs that are not in one cluster already have a member in the rest
                compare(rest)
            else:
                mine = np.flatnonzero(_column(parts, "own").to_numpy(zero_copy_only=False))
                yield from _children(_column(parts, "parent").to_numpy()[mine], node[mine], sk[mine], level)
            links.append(labels.stars(node))
            held += len(links[-1][0])
            if held > 50_000:
                yield _links_out(links)
                links, held = [], 0
        yield _links_out(links)

    cols = ("key", "parent", "node", "cluster", "sketch", "small", "whole", "anchor", "own")
    dealt = rows.select(*cols).repartition(F.col("key")).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a bigint, b bigint, key bigint, sketch binary")


def _links_out(links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    b = _links_batch([x for x, _ in links], [x for _, x in links])
    return pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.binary())], names=["a", "b", "key", "sketch"])


def _children(parent: np.ndarray, node: np.ndarray, sk: np.ndarray, level: int) -> Iterator[pa.RecordBatch]:
    """Rows of the children of one node, by the positions that it selects; their names come from its name."""
    if not len(node):
        return
    base = parent.astype(np.uint64)
    flat = pa.array([x.tobytes() for x in sk], pa.binary())
    for position in _positions(int(parent[0]), level):
        key = _mix((base ^ _mix(sk[:, position].astype(np.uint64) * _ODD)) * _ODD + np.uint64(position))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(node), pa.int64()), pa.array(node), pa.array(key.astype(np.int64)), flat], names=["a", "b", "key", "sketch"])


def _dealt(rows: DataFrame, size: int, block: int) -> DataFrame:
    """Rows of nodes with ``n`` members. One over ``size`` is dealt out in blocks of about ``block`` members, each of
    which also gets about ANCHORS members of the whole node."""
    small = F.col("n") <= size
    blocks = F.when(small, F.lit(1).cast("bigint")).otherwise(F.ceil(F.col("n") / block))
    chance = F.pmod(F.xxhash64(F.col("node"), F.lit(7)), F.lit(1_000_000)) / 1_000_000
    home = F.pmod(F.xxhash64(F.col("node"), F.col("key")), blocks)  # other neighbours in every node
    rows = rows.withColumns({"small": small, "whole": blocks == 1, "anchor": ~small & (chance < ANCHORS / F.col("n")), "home": home, "parent": F.col("key")})
    to = F.when(F.col("anchor"), F.sequence(F.lit(0).cast("bigint"), blocks - 1)).otherwise(F.array("home"))
    rows = rows.withColumn("block", F.explode(to))
    return rows.withColumns({"own": F.col("block") == F.col("home"), "key": F.when(blocks > 1, F.xxhash64("key", "block")).otherwise(F.col("key"))})


def candidate_links(reps: DataFrame, similarity: float) -> DataFrame:
    """Star links between nodes that the trees find alike by their sketches, and between all members of over-full nodes of
    the last level: such a node is one cluster, in which ``confirm`` then finds all links."""
    least = _least_matches(similarity)
    rows = reps.select(F.explode("keys").alias("key"), "node", "sketch", F.col("node").alias("cluster"))
    links: DataFrame | None = None
    for level in range(1, LEVELS + 1):
        size = LAST if level == LEVELS else SMALL
        # a node whose members are one cluster already has nothing more to find
        counts = rows.groupBy("key").agg(F.count("*").alias("n"), (F.min("cluster") < F.max("cluster")).alias("mixed"), F.min("node").alias("first"))
        counts, _ = materialise(counts.where("n > 1 and mixed").select("key", "n", "first"), "nodes")
        full = rows.join(counts.hint("merge"), "key")
        visited = _visit(_dealt(full.where(F.col("n") <= size) if level == LEVELS else full, size, LARGE), least, level)
        visited, _ = materialise(visited, "visited")
        found = visited.where("key is null").select("a", "b")
        links = found if links is None else links.union(found)
        if level == LEVELS:
            return links.union(full.where((F.col("n") > size) & (F.col("first") < F.col("node"))).select(F.col("first").alias("a"), F.col("node").alias("b")))
        children = visited.where("key is not null")
        if children.isEmpty():
            break
        # the smallest centre that a node hangs on: nodes with one centre are connected
        centre = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("centre")).hint("merge")
        rows = children.select("key", F.col("b").alias("node"), "sketch").join(centre, "node", "left")
        rows = rows.select("key", "node", "sketch", F.coalesce("centre", "node").alias("cluster"))
        rows, _ = materialise(rows, "branches")
    return links


def _member_bits(members: DataFrame) -> tuple[bytes, Callable[[Column], Column]]:
    """A bitmap of the members' hashes, and the bit of a node in it.

    Sixteen bits a member, at most MAX_BITS: beyond that it lets more other documents pass to the join that
    decides, and loses none."""
    n = members.count()
    size = min(MAX_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    member = lambda node: F.pmod(F.xxhash64(node), F.lit(size))
    at = member(F.col("node")) + 1
    rows = members.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = bytearray(size // 8)
    for r in rows.toLocalIterator():
        start = (r["bucket"] - 1) * 4096
        out[start : start + 4096] = r["bits"][: len(out) - start]
    return bytes(out), member


def confirm(texts: DataFrame, members: DataFrame, words: int, similarity: float) -> DataFrame:
    """``node`` and ``root`` over the pairs inside each cluster whose full sets reach the similarity.

    ``members``: ``node``, ``cluster``, ``n_shingles``; ``texts``: ``node``, ``text``. A cluster of more than one block
    is confirmed in two passes: first each block with the cluster's anchors; then what is outside the cluster's largest
    component by then meets all others by rare shingles, so that no link between blocks is lost."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("items"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("items") / BLOCK_ITEMS))
    sized = members.join(sizes.select("cluster", "docs", blocks.alias("blocks")).hint("merge"), "cluster")
    own = F.pmod(F.xxhash64(F.col("node"), F.lit(11)), F.col("blocks"))
    sized, _ = materialise(sized.withColumn("block", own), "members")
    chance = F.pmod(F.xxhash64(F.col("node"), F.lit(7)), F.lit(1_000_000)) / 1_000_000
    anchor = (F.col("blocks") > 1) & (chance < ANCHORS / F.col("docs"))
    everywhere = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    first = sized.select("node", "cluster", F.explode(F.when(anchor, everywhere).otherwise(F.array("block"))).alias("block"))
    first = first.select("node", "cluster", "block", F.col("node").alias("component"), F.lit(True).alias("ask"))
    links = _confirmed(texts, first, sized, words, similarity)
    found = connected_components(links)
    large = sized.where("blocks > 1")
    if large.isEmpty():
        return found
    state = large.join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("root", "node"))
    state, _ = materialise(state.select("node", "cluster", "component"), "components")
    counts = state.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"))
    state = state.join(main.where("rest > 0").hint("merge"), "cluster").withColumn("ask", F.col("component") != F.col("main"))
    state, _ = materialise(state.select("node", "cluster", "component", "ask"), "unfinished")
    if state.isEmpty():
        return found
    return connected_components(links.unionByName(_by_rare_shingles(texts, state, words, similarity)))


def _sets_of(texts: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """``node`` and ``items``, its set's hashes, of the members and of a few others: texts are never dealt out, a bitmap of
    bounded size picks those that may be members."""
    bits, member = _member_bits(members)
    bitmap = members.sparkSession.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bitmap.value, np.uint8)
        for whole in batches:
            at = whole.column("at").to_numpy()
            hits = whole.filter(pa.array((known[at >> 3] >> (at & 7)) & 1 == 1))
            for k in range(0, hits.num_rows, 256):
                b = hits.slice(k, 256)
                found = [shingles(t, words).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(found, pa.binary())], names=["node", "items"])

    maybe = texts.where("node is not null").select("node", member(F.col("node")).alias("at"), "text")
    return maybe.mapInArrow(sets, "node bigint, items binary")


def _shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many of the sets hold a shingle of each bucket of hashes: a table of fixed size, summed in parts of 4,096."""
    part = 4096

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            items = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)
            n += np.bincount((items >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(n))
        parts = n.reshape(-1, part)
        at = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([parts[k].tobytes() for k in at.tolist()], pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part bigint, counts binary"
    out = np.zeros(1 << COUNT_BITS, np.int64)
    for r in sets.select("items").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).toLocalIterator():
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["counts"], np.int64)
    return out.clip(max=2**32 - 1).astype(np.uint32)


def prefix_lengths(n: int, share: int) -> tuple[int, int]:
    """How many of its ``n`` rarest-first shingles a set is looked up by, as the smaller and as the larger of a pair.

    A pair of the similarity shares at least share / (100 + share) of the two sizes together: of a set 2 share / (100 +
    share) where the other is no smaller, and share / 100 where it is. So among so many of the first shingles of the one and
    of the other, one is common (Chaudhuri et al., ICDE 2006; Xiao et al., WWW 2008)."""
    return n + 1 - -(-2 * share * n // (100 + share)), n + 1 - -(-share * n // 100)


def _one_bits(items: np.ndarray) -> int:
    """A bit of the minwise token at each position: two sets agree in (1 + similarity) / 2 of them."""
    bits = (minwise(items) >> np.uint64(20)) & np.uint64(1)
    return int((bits << np.arange(POSITIONS, dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64))


def _by_rare_shingles(texts: DataFrame, state: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links between members of one cluster but different components, one of which ``ask``s.

    An exact prefix-filter join: shingles are ordered by how many members hold them, and each set is looked up by its rarest
    ones. What a family has in common is frequent and so no key, however many share it; keys that stand in one component
    only are dropped before anything is joined to them. What meets under a key, is of fitting size and agrees in enough of
    64 bits is a pair, and pairs are compared on their full sets. Keys of many documents are dealt out, CELL_DOCS by
    CELL_DOCS in a task. ``state``: ``node``, ``cluster``, ``component``, ``ask``."""
    spark = state.sparkSession
    share = round(similarity * 100)
    p = (1 + similarity) / 2
    least_bits = int(np.ceil(POSITIONS * (p - 4.5 * np.sqrt(p * (1 - p) / POSITIONS))))
    sets, _ = materialise(state.select("node", "cluster", "component", "ask").join(_sets_of(texts, state, words).hint("merge"), "node"), "unfinished-sets")
    counts = spark.sparkContext.broadcast(_shingle_counts(sets))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counts.value
        for b in batches:
            n, short, tokens, bits = [], [], [], []
            for raw in b.column("items").to_pylist():
                items = np.frombuffer(raw, np.uint64)
                seen = held[(items >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                few, many = prefix_lengths(len(items), share)
                order = np.lexsort((items, seen))[:many]
                keep = seen[order] > 1  # a shingle that no other member holds is no key
                n.append(len(items)), short.append(int(keep[:few].sum()))
                tokens.append(items[order][keep].astype(np.int64)), bits.append(_one_bits(items))
            lists = pa.array(tokens, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("node", "cluster", "component", "ask")], pa.array(n, pa.int64()), pa.array(short, pa.int32()), lists, pa.array(bits, pa.int64())], names=["node", "cluster", "component", "ask", "n", "short", "tokens", "bits"])

    kept, _ = materialise(sets.mapInArrow(prefixes, "node bigint, cluster bigint, component bigint, ask boolean, n bigint, short int, tokens array<bigint>, bits bigint"), "prefixes")
    keys = kept.select("cluster", "component", "ask", "short", F.posexplode("tokens").alias("pos", "token"))
    keys = keys.groupBy("cluster", "token").agg(
        F.count("*").alias("larger"), F.count_if(F.col("pos") < F.col("short")).alias("smaller"), F.max("ask").alias("asked"), F.min("component").alias("c0"), F.max("component").alias("c1")
    )
    cells = lambda c: F.ceil(F.col(c) / CELL_DOCS)
    keys = keys.where("smaller > 0 and asked and c0 < c1").select("cluster", "token", cells("larger").alias("ys"), cells("smaller").alias("xs"))
    rows = kept.select("node", "cluster", "component", "ask", "n", "bits", "short", F.posexplode("tokens").alias("pos", "token")).join(keys.hint("merge"), ["cluster", "token"])
    cols = ("cluster", "token", "node", "component", "ask", "n", "bits")
    small, one = F.col("pos") < F.col("short"), (F.col("xs") == 1) & (F.col("ys") == 1)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    home = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n)
    single = rows.where(one).select(*cols, F.lit(0).cast("bigint").alias("cell"), small.alias("x"), F.lit(True).alias("y"))
    hot = rows.where(~one)
    xs = hot.where(small).select(*cols, "ys", home(F.col("xs"), 17).alias("i"), each(F.col("ys")).alias("j")).select(*cols, F.xxhash64("i", "j").alias("cell"), F.lit(True).alias("x"), F.lit(False).alias("y"))
    ys = hot.select(*cols, "xs", home(F.col("ys"), 19).alias("j"), each(F.col("xs")).alias("i")).select(*cols, F.xxhash64("i", "j").alias("cell"), F.lit(False).alias("x"), F.lit(True).alias("y"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for _, parts in _groups(batches, 3):
            node, component, n, bits = (_column(parts, c).to_numpy() for c in ("node", "component", "n", "bits"))
            ask, x, y = (_column(parts, c).to_numpy(zero_copy_only=False) for c in ("ask", "x", "y"))
            for c in np.unique(component[x]).tolist():
                theirs = np.flatnonzero(y & (component != c))
                for k in np.flatnonzero(x & (component == c)).tolist() if len(theirs) else ():
                    fits = (n[theirs] >= n[k]) & (share * n[theirs] <= 100 * n[k]) & (ask[theirs] | ask[k])
                    fits &= POSITIONS - np.bitwise_count(bits[theirs].view(np.uint64) ^ bits[k : k + 1].view(np.uint64)) >= least_bits
                    met = node[theirs[fits]]
                    out.append((np.minimum(met, node[k]), np.maximum(met, node[k])))
                    held += len(met)
                    if held > 50_000:
                        yield _links_batch([a for a, _ in out], [b for _, b in out])
                        out, held = [], 0
        yield _links_batch([a for a, _ in out], [b for _, b in out])

    dealt = single.unionByName(xs).unionByName(ys).select("cluster", "token", "cell", "node", "component", "ask", "n", "bits", "x", "y")
    dealt = dealt.repartition("cluster", "token", "cell").sortWithinPartitions("cluster", "token", "cell")
    pairs, _ = materialise(dealt.mapInArrow(meet, "a bigint, b bigint").distinct(), "pairs")
    items = sets.select("node", "items")
    both = pairs.join(items.select(F.col("node").alias("a"), F.col("items").alias("mine")).hint("merge"), "a")
    both = both.join(items.select(F.col("node").alias("b"), F.col("items").alias("theirs")).hint("merge"), "b").select("a", "b", "mine", "theirs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                near = []
                for mine, theirs in zip(b.column("mine").to_pylist(), b.column("theirs").to_pylist()):
                    u, v = np.frombuffer(mine, np.uint64), np.frombuffer(theirs, np.uint64)
                    common = len(np.intersect1d(u, v, assume_unique=True))
                    near.append(100 * common >= share * (len(u) + len(v) - common))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    links, _ = materialise(both.mapInArrow(verify, "a bigint, b bigint"), "more-links")
    counts.destroy()
    return links


def _confirmed(texts: DataFrame, placed: DataFrame, members: DataFrame, words: int, similarity: float) -> DataFrame:
    """Star links found in each block of ``placed`` (``node``, ``cluster``, ``block``, ``component``, ``ask``)."""
    least = _least_matches(similarity)
    share = round(similarity * 100)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches, 2):
            items = [np.frombuffer(x, np.uint64) for x in _column(parts, "items").to_pylist()]
            node, component = (_column(parts, c).to_numpy() for c in ("node", "component"))
            ask = _column(parts, "ask").to_numpy(zero_copy_only=False)
            a, b = _exact_links(node, component, ask, items, least, share)
            if len(a):
                yield _links_batch([a], [b])

    joined = placed.join(_sets_of(texts, members, words).hint("merge"), "node").select("cluster", "block", "node", "component", "ask", "items")
    dealt = joined.repartition(F.col("cluster"), F.col("block")).sortWithinPartitions("cluster", "block")
    links, _ = materialise(dealt.mapInArrow(compare, "a bigint, b bigint"), "confirmed")
    return links


def _exact_links(node: np.ndarray, component: np.ndarray, ask: np.ndarray, items: list[np.ndarray], least: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of one block: sketches choose, full sets decide. Pairs in one component are not looked at, nor are
    pairs of which neither is asked for."""
    n = len(node)
    size = np.array([len(x) for x in items])
    sk = np.stack([(minwise(x) & np.uint64(0xFFFF)).astype(np.uint16) for x in items])
    starts = np.append(0, np.cumsum(size))[:-1]
    _, flat = np.unique(np.concatenate(items), return_inverse=True)
    mark = np.zeros(int(flat.max()) + 1, bool)
    labels = _Labels(n)
    _, labels.of = np.unique(component, return_inverse=True)
    for i in np.flatnonzero(ask).tolist():
        other = np.flatnonzero(labels.of != labels.of[i])
        if len(other):
            other = other[(sk[other] == sk[i]).sum(axis=1) >= least]
        if not len(other):
            continue
        mine = flat[starts[i] : starts[i] + size[i]]
        mark[mine] = True
        if len(other) * 8 < n:
            both = np.array([mark[flat[starts[j] : starts[j] + size[j]]].sum() for j in other.tolist()])
        else:
            both = np.add.reduceat(mark[flat].astype(np.int64), starts)[other]
        mark[mine] = False
        near = other[100 * both >= share * (size[other] + size[i] - both)]
        if len(near):
            labels.join(i, near)
    return labels.stars(node)


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = 5,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id reachable over links) and ``kept`` per row."""
    spark = docs.sparkSession
    ship_package(spark)
    table, _ = materialise(sketch_table(docs, words, id_col, text_col), "sketches")
    with scratch_scope(spark):
        full = table.where(F.col("address").isNotNull() & F.col("doc_id").isNotNull())
        reps = full.groupBy("address", "n_shingles", "sketch", "keys").agg(F.min(F.col("doc_id").cast("bigint")).alias("node"))
        reps, _ = materialise(reps, "sets")
        clusters = connected_components(candidate_links(reps, similarity))
        members = clusters.withColumnRenamed("root", "cluster").join(reps.select("node", "n_shingles").hint("merge"), "node")
        texts = docs.select(F.col(id_col).cast("bigint").alias("node"), F.col(text_col).cast("string").alias("text"))
        roots = confirm(texts, members, words, similarity)
        of_set = reps.select("address", "node").join(roots.hint("merge"), "node", "left").select("address", F.coalesce("root", "node").alias("root"))
        of_set, _ = materialise(of_set, "roots", keep=True)
    out = table.join(of_set.hint("merge"), "address", "left")
    component = F.when(F.col("address").isNull(), F.col("doc_id")).otherwise(F.col("root"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
