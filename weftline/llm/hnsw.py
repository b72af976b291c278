"""Embedding near-duplicates with hierarchical navigable small-world graphs (Malkov and Yashunin, 2016).

Equal vectors become one node. The nodes are dealt to shards by hash; each shard becomes a graph in one task, which
writes it to a file of the shared folder. Queries go over all nodes in chunks, each of which loads one shard's graph
after another; a link counts only after its cosine in double precision. Searches run in step for many queries at once,
so the work per hop is a few array operations.

The beam of a shard starts at `beam` and doubles until an audit passes: of what brute force links to random members and
to vectors moved away from them to just above the threshold, `audit_recall` must be found. A beam as wide as the shard
compares the vectors themselves. A query whose links fill half its beam is searched again with a beam four times as
wide, up to the whole shard, so no number of partners is a cap.

Of two shards one is asked by the other, and of two nodes of a shard the earlier one asks, so each pair is found from one
side only and counts for both. A task returns a count for each of the nodes and a spanning forest of the links that it
found, never pairs; counts are summed and forests united to components.
"""

from __future__ import annotations

import logging
import math
import pickle
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Forest, connected_components
from .shared import delete, discard, materialize, new_path

THRESHOLD = 0.95
SHARD_BYTES = 1 << 27  # of its vectors in single precision
MIN_SHARDS = 4
CHUNK_BYTES = 1 << 26  # of the vectors of a chunk of queries
HELD_BYTES = 1 << 27  # of graphs that a worker keeps
NEIGHBOURS = 16
BUILD_BEAM = 48
BEAM = 64
AUDIT, AUDIT_RECALL = 256, 0.98
STEP = 256  # queries searched in step
EXPAND = 4  # beam entries expanded at once


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = np.asarray(vectors, np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


SEEN = 4 * 10**7  # flags of queries and nodes that are held at once
LOG = logging.getLogger(__name__)


class Graph:
    """links[l]: neighbours of each node on level l, -1 where none; top: entry node."""

    def __init__(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS, build_beam: int = BUILD_BEAM, seed: int = 7) -> None:
        self.x, n = vectors.astype(np.float32), len(vectors)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / math.log(neighbours)).astype(int), 12)
        if n:
            level[0] = max(level.max(), 0)
        self.entry, self.links, self.beam = 0, [], BEAM
        self.levels = int(level.max(initial=0)) + 1
        widths = [2 * neighbours] + [neighbours] * (self.levels - 1)
        self.links = [np.full((n, w), -1, np.int32) for w in widths]
        self.sims = [np.full((n, w), -np.inf, np.float32) for w in widths]
        done = 0
        while done < n:
            most = max(1, min(done, 512, SEEN // (done + 1)))  # a flag for each query and node is held
            new = np.arange(done, min(n, done + most))
            self._insert(new, level, neighbours, build_beam)
            done = int(new[-1]) + 1
        del self.sims

    def _insert(self, new: np.ndarray, level: np.ndarray, neighbours: int, beam: int) -> None:
        q = self.x[new]
        near = np.full((len(new), 1), self.entry, np.int32)
        for l in range(self.levels - 1, -1, -1):
            of = np.flatnonzero(level[new] >= l)
            if new[0]:
                ids, _ = self.search_level(l, q, near, beam if len(of) else 1)
                near = ids[:, : max(1, min(4, ids.shape[1]))]
            if not len(of):
                continue
            within = q[of] @ q[of].T
            np.fill_diagonal(within, -np.inf)
            cand_ids = np.broadcast_to(new[of].astype(np.int32), within.shape)
            cand_sims = within
            if new[0]:
                found = ids[of]
                sims = np.where(found >= 0, np.einsum("qkd,qd->qk", self.x[found], q[of]), -np.inf)
                cand_ids, cand_sims = np.concatenate((found, cand_ids), axis=1), np.concatenate((sims, cand_sims), axis=1)
            k = min(neighbours, cand_ids.shape[1])
            best = np.argsort(-cand_sims, axis=1, kind="stable")[:, :k]
            chosen, sims = np.take_along_axis(cand_ids, best, 1), np.take_along_axis(cand_sims, best, 1)
            ok = np.isfinite(sims)
            src, dst, sim = np.repeat(new[of], k)[ok.ravel()], chosen.ravel()[ok.ravel()], sims.ravel()[ok.ravel()]
            self._link(l, np.concatenate((src, dst)), np.concatenate((dst, src)), np.concatenate((sim, sim)))

    def _link(self, l: int, src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> None:
        """Add the links; three quarters of a node's places go to its most similar ones, the last quarter is spread
        evenly over the others, so that tight groups stay tied to the rest."""
        links, held = self.links[l], self.sims[l]
        nodes, counts = np.unique(src, return_counts=True)
        width, most = links.shape[1], int(counts.max(initial=0))
        order = np.argsort(src, kind="stable")
        place = np.arange(len(src)) - np.repeat(np.cumsum(counts) - counts, counts)
        ids, sims = np.full((len(nodes), width + most), -1, np.int32), np.full((len(nodes), width + most), -np.inf, np.float32)
        ids[:, :width], sims[:, :width] = links[nodes], held[nodes]
        row = np.repeat(np.arange(len(nodes)), counts)
        ids[row, width + place], sims[row, width + place] = dst[order], sim[order]
        by_id = np.argsort(ids, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(ids, by_id, 1)
        again = np.zeros_like(ids, bool)
        np.put_along_axis(again, by_id[:, 1:], (sorted_ids[:, 1:] == sorted_ids[:, :-1]) & (sorted_ids[:, 1:] >= 0), 1)
        sims[again], ids[again] = -np.inf, -1
        best = np.argsort(-sims, axis=1, kind="stable")
        keep = best[:, :width].copy()
        spare = max(1, width // 4)  # the last quarter: spread over the rest instead of the next best
        if best.shape[1] > width:
            rest = best[:, width - spare :]
            size = np.isfinite(np.take_along_axis(sims, rest, 1)).sum(axis=1)
            step = np.maximum(size, spare)[:, None] / spare
            at = np.minimum((np.arange(spare)[None] * step).astype(int), rest.shape[1] - 1)
            keep[:, width - spare :] = np.take_along_axis(rest, at, 1)
        links[nodes], held[nodes] = np.take_along_axis(ids, keep, 1), np.take_along_axis(sims, keep, 1)

    def search_level(self, l: int, q: np.ndarray, entries: np.ndarray, beam: int, above: float | None = None):
        """Node ids by descending similarity, (queries, beam), -1 where none; with `above` also (query, node) pairs
        of everything met at that similarity or more."""
        links, n, nq = self.links[l], len(self.x), len(q)
        seen = np.zeros((nq, n + 1), bool)
        seen[:, n] = True
        rows = np.arange(nq)[:, None]
        ids = np.full((nq, beam), -1, np.int32)
        sims = np.full((nq, beam), -np.inf, np.float32)
        fresh = np.zeros((nq, beam), bool)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def merge(act: np.ndarray, new: np.ndarray) -> None:
            """new: (active, k) node ids, -1 where none."""
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new = np.where(seen[act[:, None], new], -1, new)  # -1 is the column of what counts as seen
            sim = np.where(new >= 0, np.einsum("akd,ad->ak", self.x[new], q[act], optimize=False), -np.inf).astype(np.float32)
            seen[act[:, None], new] = True
            if above is not None:
                a, b = np.nonzero(sim >= above)
                if len(a):
                    pairs.append((act[a], new[a, b]))
            all_ids = np.concatenate((ids[act], new), axis=1)
            all_sims = np.concatenate((sims[act], sim), axis=1)
            all_fresh = np.concatenate((fresh[act], new >= 0), axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam] if all_sims.shape[1] > beam else np.arange(all_sims.shape[1])[None].repeat(len(act), 0)
            ids[act], sims[act] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            fresh[act] = np.take_along_axis(all_fresh, best, 1)

        merge(np.arange(nq), np.ascontiguousarray(entries, dtype=np.int32))
        width = min(EXPAND, beam)
        while True:
            act = np.flatnonzero((fresh & np.isfinite(sims)).any(axis=1))
            if not len(act):
                break
            open_ = np.where(fresh[act], sims[act], -np.inf)
            best = np.argpartition(-open_, width - 1, axis=1)[:, :width] if beam > width else np.arange(beam)[None].repeat(len(act), 0)
            fine = np.isfinite(np.take_along_axis(open_, best, 1))
            expand = np.where(fine, np.take_along_axis(ids[act], best, 1), -1)
            fresh[act[:, None], best] = False
            near = np.where(expand[:, :, None] >= 0, links[expand], -1).reshape(len(act), -1)
            merge(act, near)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids = np.take_along_axis(ids, order, 1)
        if above is None:
            return ids, None
        if not pairs:
            return ids, (np.zeros(0, int), np.zeros(0, int))
        return ids, (np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))

    def near(self, q: np.ndarray, above: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs at a similarity of `above` or more, as far as the search meets them, in parts; all of them
        where the beam is as wide as the graph, as the vectors themselves are compared then."""
        n = len(self.x)
        for at in range(0, len(q) if n else 0, STEP):
            todo, width = np.arange(at, min(len(q), at + STEP)), min(self.beam, n)
            while len(todo):
                if width >= n:
                    yield from ((todo[a], b) for a, b in self.linked(q[todo], above))
                    break
                rows = max(1, min(len(todo), SEEN // (n + 1)))
                wider: list[np.ndarray] = []
                for part in np.split(todo, range(rows, len(todo), rows)):
                    sub = q[part].astype(np.float32)
                    entry = np.full((len(part), 1), self.entry, np.int32)
                    for l in range(self.levels - 1, 0, -1):
                        entry = self.search_level(l, sub, entry, min(8, n))[0]
                    _, (a, b) = self.search_level(0, sub, entry, width, above)
                    full = np.bincount(a, minlength=len(part)) * 2 >= width
                    wider.append(part[full])
                    ok = ~full[a]
                    yield part[a[ok]], b[ok]
                todo, width = np.concatenate(wider), min(4 * width, n)

    def linked(self, q: np.ndarray, above: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (query, node) pairs at a similarity of `above` or more, by comparing the vectors, in parts."""
        rows = max(1, 4 * 10**6 // max(1, len(self.x)))
        for at in range(0, len(q), rows):
            a, b = np.nonzero(q[at : at + rows].astype(np.float32) @ self.x.T >= above)
            yield a + at, b

    def audit(self, threshold: float, sample: int = AUDIT, recall: float = AUDIT_RECALL) -> float:
        """Widen the beam until the search finds enough of what brute force links to sampled members and to vectors
        moved away from them; the recall reached. A shard that fails at every width ends at its whole size, where near()
        is exact."""
        n, d = self.x.shape
        if n <= self.beam:
            return 1.0
        rng = np.random.default_rng(11)
        chosen = rng.choice(n, min(sample, n), replace=False)
        noise = unit(rng.standard_normal((len(chosen), d)))
        base = self.x[chosen].astype(np.float64)
        noise = unit(noise - (noise * base).sum(axis=1, keepdims=True) * base) if d > 1 else 0 * base
        goal = min(1.0, threshold + 0.1 * (1 - threshold))
        asked = np.concatenate((base, goal * base + math.sqrt(1 - goal * goal) * noise))
        own = np.concatenate((chosen, np.full(len(chosen), -1)))  # that a member finds itself says nothing
        met = lambda pairs: sum(int(np.count_nonzero(own[a] != b)) for a, b in pairs)
        true = met(self.linked(asked, threshold - 1e-4))
        while self.beam < n:
            reached = met(self.near(asked, threshold - 1e-4)) / true if true else 1.0
            if reached >= recall:
                return reached
            self.beam = min(n, 2 * self.beam)
        return 1.0


class Shard:
    """A graph with the vectors as they came, and the names and weights of its nodes."""

    def __init__(self, graph: Graph, raw: np.ndarray, names: np.ndarray, weights: np.ndarray) -> None:
        self.graph, self.raw, self.names, self.weights = graph, raw, names, weights

    def save(self, folder: str) -> str:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        path = f"{base}/{uuid.uuid4().hex}.graph"
        graph = {k: v for k, v in self.graph.__dict__.items() if k != "x"}
        with where.open_output_stream(path) as out:
            pickle.dump((graph, self.raw, self.names, self.weights), out, protocol=5)
        return path

    @classmethod
    def load(cls, folder: str, path: str) -> Shard:
        """From its file, or from what this worker holds of the shards met lately."""
        if path in _HELD:
            _HELD.move_to_end(path)
            return _HELD[path]
        where, _ = fs.FileSystem.from_uri(folder)
        with where.open_input_stream(path) as source:
            kept, raw, names, weights = pickle.loads(source.read())
        graph = Graph.__new__(Graph)
        graph.__dict__.update(kept, x=unit(raw).astype(np.float32))
        out = cls(graph, raw, names, weights)
        _HELD[path] = out
        while len(_HELD) > 1 and sum(2 * s.raw.nbytes for s in _HELD.values()) > HELD_BYTES:
            _HELD.popitem(last=False)
        return out


_HELD: OrderedDict[str, Shard] = OrderedDict()


def _valid(c: Column) -> Column:
    number = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce((F.size(c) > 0) & F.forall(c, number) & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors as they came; in single precision where that loses nothing."""
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    raw = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(over="ignore"):
        single = raw.astype(np.float32)
    return single if (single == raw).all() else raw


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect what the edges (a, b) connect, at most one for each node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at.ravel()[: len(a)], at.ravel()[len(a) :]
    least = np.arange(len(nodes))
    while (least[x] != least[y]).any():
        low = np.minimum(least[x], least[y])
        for end in (x, y):
            np.minimum.at(least, least[end], low)
        while (least[least] != least).any():
            least = least[least]
    some = least != np.arange(len(nodes))
    return nodes[some].tolist(), nodes[least[some]].tolist()


def _asks(shard: int, other: int, shards: int) -> bool:
    """Whether the nodes of `shard` ask those of `other`: of two shards one does, and each asks half of the rest."""
    ahead = (other - shard) % shards
    return 2 * ahead < shards or 2 * ahead == shards and shard < other


def _verified(q: np.ndarray, raw: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a of q, b of raw) those whose cosine in double precision reaches the threshold."""
    ok = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 14):
        x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        ok[at : at + (1 << 14)] = np.einsum("id,id->i", q[x], unit(raw[y])) >= threshold
    return a[ok], b[ok]


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    shard_bytes: int = SHARD_BYTES,
    min_shards: int = MIN_SHARDS,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row.

    Vectors that are null, empty, all zero or hold a null or non-finite component link with nothing, nor do vectors
    of different lengths. Equal vectors always link. Repeated ids are rows of their own; a null id takes the
    component of its vector and isn't kept. Other columns aren't read."""
    spark = vectors.sparkSession
    rows = materialize(vectors.select(F.col(id_col).alias("vec"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("ok", _valid(F.col("v"))), "vectors")
    nodes = rows.filter("ok").groupBy("v").agg(F.min("vec").alias("rep"), F.count(F.lit(1)).alias("weight"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "*", F.size("v").alias("dim")), "nodes")
    size = 4 * nodes.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0]
    shards = max(min_shards, -(-size // shard_bytes))
    workers = spark.sparkContext.defaultParallelism
    chunks = max(1, -(-size // (shards * chunk_bytes)), -(-3 * workers // shards))
    folder = new_path(spark, "graphs")

    def build(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        raw = _matrix(table["v"], dim)
        graph = Graph(unit(raw))
        reached = graph.audit(threshold)
        path = Shard(graph, raw, table["node"].to_numpy(), table["weight"].to_numpy()).save(folder)
        return pa.table({"shard": [table["shard"][0].as_py()], "dim": pa.array([dim], pa.int32()), "path": [path], "beam": [graph.beam], "recall": [reached]})

    dealt = nodes.select(F.pmod(F.xxhash64("node"), F.lit(shards)).alias("shard"), "dim", "node", "weight", "v")
    # many more partitions than groups, so that few groups share one
    built = dealt.repartition(8 * shards, "shard", "dim").groupBy("shard", "dim").applyInArrow(build, "shard bigint, dim int, path string, beam bigint, recall double")
    graphs = materialize(built, "graphs")
    told = graphs.agg(F.count("shard"), F.min("recall"), F.avg("recall"), F.max("beam")).first()
    LOG.info("%s graphs, audited recall at least %s, %s on average, widest beam %s", *told)
    found_at = spark.sparkContext.broadcast([(r.shard, r.dim, r.path) for r in graphs.select("shard", "dim", "path").collect()])  # a row for each shard

    def search(table: pa.Table) -> pa.Table:
        mine, dim = table["shard"][0].as_py(), table["dim"][0].as_py()
        q, me, weight = unit(_matrix(table["v"], dim)), table["node"].to_numpy(), table["weight"].to_numpy()
        forest, counts = Forest(), []
        for shard, its_dim, path in found_at.value:
            if its_dim != dim or not _asks(mine, shard, shards):
                continue
            other = Shard.load(folder, path)
            mine_n, other_n = np.zeros(len(me)), np.zeros(len(other.names))
            for a, b in other.graph.near(q, threshold - 1e-4):
                later = (other.names[b] > me[a]) if shard == mine else np.ones(len(a), bool)
                a, b = _verified(q, other.raw, a[later], b[later], threshold)
                mine_n += np.bincount(a, other.weights[b], len(me))
                other_n += np.bincount(b, weight[a], len(other.names))
                for x, y in zip(*spanning(me[a], other.names[b])):
                    forest.join(x, y)
            for names, n in ((me, mine_n), (other.names, other_n)):
                some = np.flatnonzero(n)
                counts.append((names[some], n[some].astype(np.int64)))
        edges = np.array(forest.edges(), np.int64).reshape(-1, 2)
        src = np.concatenate([*(x for x, _ in counts), edges[:, 0]])
        n = pa.concat_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(n for _, n in counts)])), pa.nulls(len(edges), pa.int64())])
        dst = pa.concat_arrays([pa.nulls(len(src) - len(edges), pa.int64()), pa.array(edges[:, 1])])
        return pa.table({"src": pa.array(src.astype(np.int64)), "dst": dst, "n": n})

    chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(chunks)).alias("chunk")
    asked = dealt.select("*", chunk).repartition(8 * shards * chunks, "shard", "dim", "chunk").groupBy("shard", "dim", "chunk")
    found = materialize(asked.applyInArrow(search, "src bigint, dst bigint, n bigint"), "links")
    delete(spark, folder)
    discard(graphs)

    links = found.filter("n is not null").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("links"))
    labels = connected_components(found.filter("dst is not null").select("src", "dst"))
    labelled = materialize(
        nodes.join(labels, "node", "left").join(links, "node", "left").select("v", "rep", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")),
        "labelled",
    )
    least = materialize(labelled.groupBy("label").agg(F.min("rep").alias("component_id")), "components")
    known = labelled.join(least, "label").select("v", "n_links", "component_id")
    linked = rows.filter("ok").join(known, "v").select("vec", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec", F.lit(0).cast("bigint").alias("n_links"), F.col("vec").alias("component_id"))
    return linked.union(alone).select(
        F.col("vec").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec") == F.col("component_id"), F.lit(False)).alias("kept")
    )
