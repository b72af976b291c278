"""Near-duplicates by the similarity of word shingles, found by SimHash fingerprints and then checked exactly.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more link. Bands of minimum hashes name the
shards: two texts at 0.8 share one of the 20 bands with a probability of 0.9996, at 0.85 of 0.999998. In a shard the texts'
SimHash fingerprints, of 256 bits over their *distinct* shingles, tell which may be similar: at 0.8 two of them differ in 39 bits
on average with a standard deviation of 5.7, so beyond `radius` = 80 lies less than one pair in 10 ** 12. Sets of under
SMALL shingles, for which that count is too coarse, may all be similar. A shard's fingerprints are held as a BK-tree, that of
:mod:`simhash`, and searched at that radius. At 80 of 256 bits a search visits nearly every node of its tree, so a tree holds the
fingerprints of one block of a shard at most.

What is tied is only a candidate: the groups it makes are settled by the shingle sets themselves. Counts of the shingles by
bucket bound the intersection from above, so that most pairs need no intersection; the bound is exact.

Neither a shard nor a group is ever one task if it is large (:func:`settled`):

- it first meets its leaders, the nodes of least hash: what connects to one of them is in a cluster. Near copies of a text are
  in one cluster then, however many there are;
- blocks are cut inside clusters and among the other nodes; each pair of blocks that isn't of one cluster is a task, which
  compares what isn't connected yet and gives a spanning forest.

Components of these links are the result. Nothing but the bands can lose a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import Forest, connected_components
from .shared import materialize
from .simhash import SEED, BKTree, _offsets

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
BITS, RADIUS = 256, 80
SMALL = 32  # shingles
SHARD_BLOCK = 2048  # fingerprints of a shard in a block
SET_BLOCK = 1 << 20  # shingles of the sets in a block
LEADERS = 16
BUCKETS = 512  # of the counts that bound an intersection
AT_ONCE = 1 << 12

_RANDOM = np.random.default_rng(SEED)
_FACTOR = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERM = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_WORD_FACTOR = _RANDOM.integers(1, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles of text, repeats included; of fewer words the whole sequence, of none nothing."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    starts, ends = _offsets(words)
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist())], np.uint64)


def bands(distinct: np.ndarray) -> list[int]:
    """A key for each band of minimum hashes; none without shingles."""
    if not len(distinct):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), AT_ONCE):
        mixed = distinct[at : at + AT_ONCE, None] * _FACTOR + _TERM
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)]


def fingerprint(distinct: np.ndarray) -> bytes:
    """BITS bits, each set where it is in over half of the distinct shingles' hashes; each 64 of them mix the hashes anew."""
    out = []
    for factor in _WORD_FACTOR:
        mixed = distinct * factor
        mixed ^= mixed >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(mixed), AT_ONCE):
            ones += np.unpackbits(mixed[at : at + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(distinct), bitorder="little").tobytes())
    return b"".join(out)


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, place, node, n, fp, bands): place is a hash of the text, node one of its set of shingles, n how many it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, fps, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                distinct = np.unique(shingles(text, shingle))
                nodes.append(_long(xxhash.xxh64_intdigest(distinct.tobytes(), SEED)))
                sizes.append(len(distinct))
                fps.append(fingerprint(distinct))
                keys.append([_long(k) for k in bands(distinct)])
            made = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["id", "place", "node", "n", "fp", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("place"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, place bigint, node bigint, n int, fp binary, bands array<bigint>")


class Tied:
    """Sets of the numbers 0 to n - 1, as an array of labels; merging costs a pass over it, asking for many costs nothing."""

    def __init__(self, n: int, clusters: np.ndarray | None = None) -> None:
        self.label = np.arange(n)
        for c in np.unique(clusters[clusters >= 0]) if clusters is not None else ():
            of = np.flatnonzero(clusters == c)
            self.label[of] = of[0]

    def join(self, at: int, others: np.ndarray) -> None:
        labels = np.unique(np.append(self.label[others], self.label[at]))
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]

    def edges(self, nodes: np.ndarray) -> pa.Table:
        """An edge from each node that isn't the first of its set to the first."""
        _, first, of = np.unique(self.label, return_index=True, return_inverse=True)
        src, dst = nodes, nodes[first[of]]
        return pa.table({"src": pa.array(src[src != dst], pa.int64()), "dst": pa.array(dst[src != dst], pa.int64())})


EDGE = "src bigint, dst bigint"


def _sizes_fit(n: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(n, others) >= similarity * np.maximum(n, others)


def tied(
    nodes: np.ndarray, blocks: np.ndarray, n: np.ndarray, fps: list[bytes], radius: int, similarity: float, clusters: np.ndarray | None = None, small: int = SMALL
) -> pa.Table:
    """Edges that connect the nodes of a block, or of two blocks between each other, that may be similar: each asks the BK-tree
    of the fingerprints before it, of two blocks the second asks the tree of the first. Nodes of one cluster, a number from 0
    (-1: none), are known to be connected."""
    sets, tree, of = Tied(len(nodes), clusters), BKTree(), {}
    values, one = [int.from_bytes(f, "little") for f in fps], len(np.unique(blocks)) == 1
    first = np.arange(len(nodes)) if one else np.flatnonzero(blocks == blocks[0])
    if not one:
        for i in first.tolist():
            _plant(tree, of, values[i], i)
    for i in first.tolist() if one else np.flatnonzero(blocks != blocks[0]).tolist():
        # sets under `small` link at any distance, but only to sets of about their size
        reach = radius if similarity * n[i] >= small else BITS
        at = np.array([j for v in tree.within(values[i], reach) for j in of[v]], np.int64)
        if len(at):
            at = at[_sizes_fit(n[at], n[i], similarity) & (sets.label[at] != sets.label[i])]
        if len(at) and reach > radius:
            at = at[[bool(min(n[j], n[i]) < small or (values[j] ^ values[i]).bit_count() <= radius) for j in at.tolist()]]
        if len(at):
            sets.join(i, at)
        if one:
            _plant(tree, of, values[i], i)
    return sets.edges(nodes)


def _plant(tree: BKTree, of: dict[int, list[int]], value: int, i: int) -> None:
    """Node i into the tree; equal fingerprints are one node of it."""
    if value not in of:
        tree.add(value)
    of.setdefault(value, []).append(i)


def tied_few(nodes: list[int], n: list[int], fps: list[int], radius: int, similarity: float, small: int = SMALL) -> list[tuple[int, int]]:
    """:func:`tied` for the few nodes of most shards, by a tree of whole numbers without arrays."""
    forest, tree, of = Forest(), BKTree(), {}
    for i, value in enumerate(fps):
        for v in tree.within(value, radius if similarity * n[i] >= small else BITS):
            for j in of[v]:
                least, most = sorted((n[i], n[j]))
                if least >= similarity * most and (least < small or (v ^ value).bit_count() <= radius):
                    forest.join(nodes[i], nodes[j])
        _plant(tree, of, value, i)
    return forest.edges()


FEW = 8


def candidates(nodes: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, block: int = SHARD_BLOCK) -> DataFrame:
    """(src, dst) edges that connect the nodes (node, n, fp, bands), a table, that share a band and may be similar.

    Rows of a shard lie side by side in a task, as so many shards hold two or three texts that a call of Python for each would
    cost more than they do. Shards of more than `block` are settled by leaders and pairs of blocks."""
    shards = nodes.select(F.explode("bands").alias("label"), "node", "n", F.col("fp").alias("data"))
    sizes = shards.groupBy("label").agg(F.count(F.lit(1)).alias("all")).filter(F.col("all") > 1)
    sized = shards.join(sizes, "label")

    def search(held: list[tuple]) -> pa.RecordBatch:
        nodes_, n, fps = zip(*held)
        if len(held) <= FEW:
            edges = tied_few(nodes_, n, [int.from_bytes(f, "little") for f in fps], radius, similarity)
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["src", "dst"])
        made = tied(np.array(nodes_, np.int64), np.zeros(len(held), np.int64), np.array(n, np.int64), list(fps), radius, similarity)
        return pa.RecordBatch.from_arrays([made.column(k).combine_chunks() for k in (0, 1)], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for at, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if at != key:
                    if len(held) > 1:
                        yield search(held)
                    key, held = at, []
                held.append(row)
        if len(held) > 1:
            yield search(held)

    few = sized.filter(F.col("all") <= block).select("label", "node", "n", "data")
    found = few.repartition("label").sortWithinPartitions("label").mapInArrow(run, EDGE)
    large = sized.filter(F.col("all") > block).withColumn("weight", F.lit(1))
    if not large.limit(1).count():
        return found
    return found.unionByName(settled(materialize(large, "hot-bands"), lambda nodes, blocks, n, data, clusters=None: tied(nodes, blocks, n, list(data), radius, similarity, clusters), block))


def _counts(sets: list[np.ndarray], buckets: int) -> np.ndarray:
    """How many of each set's members fall into each bucket."""
    return np.stack([np.bincount((s % np.uint64(buckets)).astype(np.int64), minlength=buckets) for s in sets]).astype(np.uint16 if max(map(len, sets)) < 1 << 16 else np.int64)


def compared(nodes: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], similarity: float, clusters: np.ndarray | None = None) -> pa.Table:
    """Edges that connect what links among the nodes of a block, or between those of two blocks. sets: distinct numbers in
    order. Nodes of one cluster, a number from 0 (-1: none), are known to be connected."""
    if not len(nodes):
        return Tied(0).edges(nodes)
    n, held, one = np.fromiter(map(len, sets), np.int64, len(sets)), _counts(sets, BUCKETS), len(np.unique(blocks)) == 1
    known = Tied(len(nodes), clusters)
    least = similarity / (1 + similarity)
    for i in range(len(nodes)):
        maybe = _sizes_fit(n, n[i], similarity) & (known.label != known.label[i])
        if not one:
            maybe &= blocks != blocks[i]
        at = np.flatnonzero(maybe)
        if len(at):
            most = np.minimum(held[at], held[i]).sum(axis=1, dtype=np.int64)
            at = at[most >= least * (n[at] + n[i]) - 1e-9]
        for j in at.tolist():
            if known.label[i] == known.label[j]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared >= similarity * (n[i] + n[j] - shared):
                known.join(i, np.array([j]))
    return known.edges(nodes)


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def links(docs: DataFrame, made: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, block: int, shard_block: int) -> DataFrame:
    """(src, dst) edges between the nodes of `made`, the sketches of docs, that connect what is similar."""
    nodes = materialize(made.groupBy("node").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    groups = connected_components(candidates(nodes, similarity=similarity, block=shard_block))
    one = made.groupBy("node").agg(F.min(F.struct("place", "id")).alias("of"), F.min("n").alias("n")).select("node", "of.place", "of.id", "n")
    wanted = materialize(groups.join(one, "node"), "candidates")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("place"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, (texts.place == wanted.place) & texts.id.eqNullSafe(wanted.id)).select("label", "node", "n", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t, shingle)).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["label", "node", "n", "shingles"])

    # rows that share id and text give a node twice
    sets = materialize(texts.mapInArrow(cut, "label bigint, node bigint, n int, shingles binary").dropDuplicates(["label", "node"]), "sets")
    weight = sets.groupBy("label").agg(F.sum("n").alias("all"))
    sized = sets.join(weight, "label")
    few = sized.filter(F.col("all") <= block).drop("all")
    large = sized.filter(F.col("all") > block)

    def check(table: pa.Table) -> pa.Table:
        return compared(table["node"].to_numpy(), np.zeros(len(table), np.int64), _sets(table["shingles"]), similarity)

    found = few.groupBy("label").applyInArrow(check, EDGE)
    if not large.limit(1).count():
        return found
    rows = large.select("label", "node", "n", F.col("shingles").alias("data"), "all", F.col("n").alias("weight"))
    return found.unionByName(settled(rows, lambda nodes, blocks, n, data, clusters=None: compared(nodes, blocks, [np.frombuffer(x, np.uint64) for x in data], similarity, clusters), block))


def settled(large: DataFrame, compare, block: int) -> DataFrame:
    """(src, dst) edges that connect, in each group of large (label, node, n, data, weight, all: the group's weights), what
    compare(nodes, blocks, n, data, clusters) connects in a block or between two. Blocks weigh about `block`.

    Members meet the group's leaders first; what they connect to is one cluster, and blocks of one cluster meet no more."""
    led = materialize(_led(large, compare, block), "led")
    return led.unionByName(_between(large, led, compare, block))


def _led(large: DataFrame, compare, block: int) -> DataFrame:
    """Edges from the members of large groups to the leaders that they connect to."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("node"), "node"))
    leaders = large.withColumn("rank", rank).filter(F.col("rank") <= LEADERS)  # every task gives its first ones only
    slices = F.ceil(F.col("all") / block).cast("int")
    member = large.select("label", "node", "n", "data", F.pmod(F.xxhash64("node"), slices).cast("int").alias("slice"))
    lead = leaders.select(F.col("label").alias("of"), F.col("node").alias("lead"), F.col("n").alias("lead_n"), F.col("data").alias("lead_data"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("at"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes, n = (np.concatenate([right[a].to_numpy(), left[b].to_numpy()]) for a, b in (("lead", "node"), ("lead_n", "n")))
        return compare(nodes, np.repeat([0, 1], [len(right), len(left)]), n, [*right["lead_data"].to_pylist(), *left["data"].to_pylist()])

    return member.groupBy("label", "slice").cogroup(lead.groupBy("of", "at")).applyInArrow(meet, EDGE)


def _between(large: DataFrame, led: DataFrame, compare, block: int) -> DataFrame:
    """Edges between nodes of a large group that aren't of one cluster. led: edges that make the clusters."""
    clusters = connected_components(led).select("node", F.col("label").alias("cluster"))
    of = large.select("label", "node", "weight").join(clusters, "node", "left")
    weights = of.groupBy("label", "cluster").agg(F.sum("weight").alias("all"))
    parts = materialize(weights.select("label", "cluster", F.ceil(F.col("all") / block).cast("int").alias("parts")), "parts")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    mine = of.join(parts, (of.label == parts.label) & of.cluster.eqNullSafe(parts.cluster)).select(of.label, of.cluster, "node", part.alias("part"))
    blocks = parts.select("label", "cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = blocks.select(F.col("label").alias("l"), F.col("cluster").alias("c"), F.col("part").alias("p"))
    apart = (F.col("label") == F.col("l")) & ~(F.col("cluster").eqNullSafe(F.col("c")) & F.col("cluster").isNotNull())
    name = lambda c, p: F.concat_ws(":", F.coalesce(c.cast("string"), F.lit("")), p.cast("string"))
    own, met = name(F.col("cluster"), F.col("part")), name(F.col("c"), F.col("p"))
    rows = mine.join(other, apart).select("label", "cluster", "node", own.alias("own"), F.least(own, met).alias("a"), F.greatest(own, met).alias("b"))
    rows = rows.join(large.select("label", "node", "n", "data"), ["label", "node"])

    def check(table: pa.Table) -> pa.Table:
        _, blocks = np.unique(np.array(table["own"].to_pylist(), dtype=object).astype(str), return_inverse=True)
        label = table["cluster"].to_pylist()
        numbers = {c: i for i, c in enumerate(sorted({c for c in label if c is not None}))}
        known = np.array([-1 if c is None else numbers[c] for c in label])
        return compare(table["node"].to_numpy(), blocks, table["n"].to_numpy(), table["data"].to_pylist(), known)

    return rows.groupBy("label", "a", "b").applyInArrow(check, EDGE)


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    block: int = SET_BLOCK,
    shard_block: int = SHARD_BLOCK,
) -> DataFrame:
    """docs with one row of each group of texts that links connect: that of the least id, of rows with that id the one
    whose text has the least hash. All columns stay.

    Texts are compared by sets of lower-cased word shingles; those of fewer words by their whole sequence, and texts
    without words, null ones too, are copies of each other. Rows that share an id are judged by their texts. Rows
    without an id stay, as nothing can name them a copy of another row. No rows give no rows."""
    own = {c: f"sim_doc{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*own.values())
    named = plain.filter(F.col(own[id_col]).isNotNull())
    made = materialize(sketches(named, own[id_col], own[text_col], shingle), "sketches")
    labels = connected_components(links(named, made, own[id_col], own[text_col], shingle, similarity, block, shard_block))
    texts = made.groupBy("node", "id", "place").agg(F.count(F.lit(1)).alias("n"))
    joined = texts.join(labels, "node", "left").select(F.coalesce("label", "node").alias("label"), "id", "place", "n")
    kept = materialize(joined.groupBy("label").agg(F.min(F.struct("id", "place", "n")).alias("row")).select("row.*"), "kept")
    placed = plain.withColumn("place", F.xxhash64(own[text_col])).withColumnRenamed(own[id_col], "id")
    out = placed.join(kept.select("id", "place"), ["id", "place"], "left_semi")
    if kept.filter("n > 1").limit(1).count():  # rows that share id and text
        out = out.dropDuplicates(["id", "place"])
    out = out.select(*[F.col("id" if c == id_col else o).alias(c) for c, o in own.items()])
    return out.union(docs.filter(F.col(id_col).isNull()))
