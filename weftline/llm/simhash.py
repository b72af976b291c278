"""SimHash near-duplicates: 64-bit fingerprints, BK-trees over shards of fingerprints, linked components.

Two fingerprints within `radius` = 2 bits agree on at least three of five blocks of bits, so each distinct
fingerprint goes to the ten shards named by three of its blocks and every link shows in one of them. A shard is
held as a BK-tree (children keyed by their integer Hamming distance to the parent) and searched along the edges
whose distance is within the radius of the query's. The trees stay in the task that owns the shard: all trees
together grow with the corpus, so there is no size bound under which they could be broadcast.

A shard gives at most one edge for each fingerprint (a spanning forest of its links), never its pairs. A shard of
more than `max_tree` fingerprints isn't searched: each of its fingerprints is tied to the 65 values within one
bit of it, and two fingerprints share such a value exactly if they are within two bits. That is exact, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Forest, connected_components
from .shared import materialize

SEED = 42
RADIUS = 2
BLOCK_BITS = (13, 13, 13, 13, 12)
BLOCKS_SHARED = 3
MAX_TREE = 4096

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _offsets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return np.concatenate(([0], ends[:-1] + 1)), ends


def of_hashes(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of text; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII letters and spaces only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    starts, ends = _offsets(words)
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())],
        dtype=np.uint64,
    )
    return of_hashes(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, place, fp): place is a hash of the text, fp a signed long with the 64 bits. Null and empty texts have
    fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], names=[id_col, "place", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("place"), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, place bigint, fp bigint")


class BKTree:
    """children[i]: node at each distance from node i."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        self.value.append(x)
        self.children.append({})
        at, new = 0, len(self.value) - 1
        while new:
            d = (self.value[at] ^ x).bit_count()
            if (down := self.children[at].get(d)) is None:
                self.children[at][d] = new
                return
            at = down

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.value else []
        while todo:
            at = todo.pop()
            d = (self.value[at] ^ x).bit_count()
            if d <= radius:
                found.append(self.value[at])
            todo += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return found


def _shard_keys(fp: F.Column) -> F.Column:
    low, parts = 0, []
    for bits in BLOCK_BITS:
        parts.append(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1)))
        low += bits
    keys = []
    for k, chosen in enumerate(combinations(range(len(BLOCK_BITS)), BLOCKS_SHARED)):
        key = F.lit(k).cast("bigint")
        for i in chosen:
            key = F.shiftleft(key, BLOCK_BITS[i]).bitwiseOR(parts[i])
        keys.append(key)
    return F.array(*keys)


def _shard_edges(fps: list[int], radius: int) -> list[tuple[int, int]]:
    tree, forest = BKTree(), Forest()
    for x in fps:
        for y in tree.within(x, radius):
            forest.join(x, y)
        tree.add(x)
    return forest.edges()


def _signed(x: int) -> int:
    """The long with the 64 bits of x, which may be signed already."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _midpoints(fp: int) -> list[tuple[int, int]]:
    return [(_signed(fp), _signed(fp ^ (1 << b))) for b in range(64)]


def links(distinct: DataFrame, radius: int = RADIUS, max_tree: int = MAX_TREE) -> DataFrame:
    """(src, dst) edges that connect the distinct fingerprints `fp` exactly as all links within the radius do."""
    if radius > RADIUS:
        raise ValueError(f"the shards find links of at most {RADIUS} bits")
    if max_tree and radius != RADIUS:
        max_tree = 1 << 62  # midpoints are for two bits only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, over = None, [], False

        def close() -> list[tuple[int, int]]:
            return _shard_edges([x & (1 << 64) - 1 for x in held], radius) if len(held) > 1 and not over else []

        def rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
            ends = np.array(found, dtype=object).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array([_signed(x) for x in ends[:, i]], pa.int64()) for i in (0, 1)], names=["src", "dst"]
            )

        for batch in batches:
            found: list[tuple[int, int]] = []
            keys, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).tolist() + [len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != key:
                    found += close()
                    key, held, over = keys[a], [], False
                elif over:
                    for x in fps[a:b].tolist():
                        found += _midpoints(x & (1 << 64) - 1)
                    continue
                held += fps[a:b].tolist()
                if len(held) > max_tree:
                    over = True
                    for x in held:
                        found += _midpoints(x & (1 << 64) - 1)
                    held = []
            if found:
                yield rows(found)
        if last := close():
            yield rows(last)

    sharded = distinct.select(F.explode(_shard_keys(F.col("fp"))).alias("shard"), "fp")
    return sharded.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "src bigint, dst bigint")


def _labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, max_tree: int) -> tuple[DataFrame, DataFrame]:
    """(id_col, place, fp) of every row, and (fp, rep, label) of every fingerprint: rep is the least id that has it,
    label names its component."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = prints.groupBy("fp").agg(F.min(id_col).alias("rep"))
    labels = connected_components(links(reps.select("fp"), radius, max_tree))
    known = reps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    return prints, materialize(known, "labels")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = RADIUS,
    max_tree: int = MAX_TREE,
) -> DataFrame:
    """(id_col, fp, component_id): component_id is the least id reachable through links, the row's own included.

    Rows with equal ids are rows of their own. A null id takes the component of its fingerprint, which is null if
    no linked row has an id. Null, empty and blank texts have fingerprint 0 and link like any other. Other columns
    aren't read. No rows give no rows."""
    prints, labelled = _labelled(docs, id_col, text_col, shingle, radius, max_tree)
    least = materialize(labelled.groupBy("label").agg(F.min("rep").alias("component_id")), "components")
    known = labelled.join(least, "label").select("fp", "component_id")
    return prints.join(known, "fp").select(id_col, "fp", "component_id")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = RADIUS,
    max_tree: int = MAX_TREE,
) -> DataFrame:
    """docs with one row of each component: that of the least id, of rows with that id the one whose text has the
    least hash. All columns stay.

    Rows that share an id are judged by their texts, so each stays unless it is a copy of a row that does. Rows
    without an id stay, as nothing can name them a copy of another row."""
    prints, labelled = _labelled(docs, id_col, text_col, shingle, radius, max_tree)
    texts = prints.filter(F.col(id_col).isNotNull()).groupBy("fp", F.col(id_col).alias("id"), "place").agg(F.count(F.lit(1)).alias("n"))
    rows = texts.join(labelled.select("fp", "label"), "fp").groupBy("label").agg(F.min(F.struct("id", "place", "n")).alias("row"))
    kept = materialize(rows.select("row.*"), "kept")
    own = {c: f"sim_doc{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*own.values()).withColumn("place", F.xxhash64(own[text_col])).withColumnRenamed(own[id_col], "id")
    out = plain.join(kept.select("id", "place"), ["id", "place"], "left_semi")
    if kept.filter("n > 1").limit(1).count():  # rows that share id and text
        out = out.dropDuplicates(["id", "place"])
    out = out.select(*[F.col("id" if c == id_col else o).alias(c) for c, o in own.items()])
    return out.union(docs.filter(F.col(id_col).isNull()))
