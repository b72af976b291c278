"""A beam as wide as the shard finds what no link leads to."""

from __future__ import annotations

import numpy as np
import pytest

from weftline.llm import hnsw
from weftline.llm.graph import Forest


def pairs(parts) -> set[tuple[int, int]]:
    return {pair for a, b in parts for pair in zip(a.tolist(), b.tolist())}


def test_nodes_without_links_are_found_at_full_width():
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 16))
    x = hnsw.unit(np.repeat(base, 5, axis=0) + 0.05 * rng.standard_normal((300, 16)))
    graph = hnsw.Graph(x)
    graph.links[0][100:] = -1
    graph.links[0][np.isin(graph.links[0], np.arange(100, 300))] = -1  # as if all of these had been evicted
    graph.beam = 8
    assert graph.audit(0.95) >= 0.98
    assert pairs(graph.near(x, 0.95)) == set(zip(*(i.tolist() for i in np.nonzero(x.astype(np.float32) @ x.astype(np.float32).T >= 0.95))))


def test_spanning_edges_connect_the_same_nodes():
    rng = np.random.default_rng(3)
    for n in (0, 5, 200):
        a, b = rng.integers(0, 300, n), rng.integers(300, 600, n)
        whole, few = Forest(), Forest()
        for x, y in zip(a.tolist(), b.tolist()):
            whole.join(x, y)
        edges = list(zip(*hnsw.spanning(a, b)))
        for x, y in edges:
            few.join(x, y)
        assert sorted(few.edges()) == sorted(whole.edges()) and len(edges) <= len(set(a) | set(b))


@pytest.mark.parametrize("shards", [1, 4, 5])
def test_query_recall_and_counts_of_both_ends(spark, shards):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((500, 24))
    x = (np.repeat(base, 5, axis=0) + 0.12 * rng.standard_normal((2500, 24))).astype(np.float32)
    x[100:250] = x[100] + 0.02 * rng.standard_normal((150, 24))  # more partners than a beam holds
    rows = [(i, [float(c) for c in v], 1, 2) for i, v in enumerate(x)]
    rows += [(None, rows[0][1], 1, 2), (3, rows[4][1], 1, 2), (7000, [1.0], 1, 2), (7001, [2.0], 1, 2), (7002, [-1.0], 1, 2), (7003, [], 1, 2)]
    found = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, node int, dim int"), min_shards=shards).collect()
    unit = hnsw.unit(np.array([r[1] for r in rows[:2502]]))
    true = unit @ unit.T >= 0.95
    np.fill_diagonal(true, False)
    got = {(r.vec_id): r for r in found if r.vec_id not in (None, 3)}
    links = np.array([got[i].n_links if i != 3 else 0 for i in range(2500)])
    expected = true[:2500].sum(axis=1)
    expected[3] = 0
    assert (links <= expected).all() and links.sum() >= 0.98 * expected.sum()
    assert len(found) == len(rows) and sum(r.n_links for r in found) % 2 == 0
    assert (got[7000].component_id, got[7001].component_id, got[7002].component_id, got[7003].kept) == (7000, 7000, 7002, True)
    assert all(got[i].component_id == got[100].component_id for i in range(100, 250))
