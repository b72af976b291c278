"""Shards of the pipeline's near-duplicates are searched as BK-trees, with the links that comparing every pair finds."""

from __future__ import annotations

import numpy as np
import pytest

from weftline.llm import similar
from weftline.llm.graph import Forest


def parts(edges) -> set[frozenset]:
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    out = {}
    for x in forest.parent.keys() | set(forest.parent.values()):
        out.setdefault(forest.find(x), set()).add(x)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("halves", [False, True])
def test_shards_are_searched_as_trees(monkeypatch, halves):
    rng, asked = np.random.default_rng(8), []
    values, n = [], []
    for _ in range(25):
        base = rng.integers(0, 2, 256)
        for _ in range(4):
            flips = np.zeros(256, int)
            flips[rng.choice(256, rng.integers(0, 60), replace=False)] = 1
            values.append(np.packbits(base ^ flips, bitorder="little").tobytes())
            n.append(int(rng.integers(20, 60)))
    values += values[:3]
    n += n[:3]
    nodes, sizes = rng.permutation(len(n)).astype(np.int64), np.array(n)
    blocks = np.arange(len(n)) % 2 if halves else np.zeros(len(n), np.int64)
    within = similar.BKTree.within
    monkeypatch.setattr(similar.BKTree, "within", lambda self, x, radius: asked.append(radius) or within(self, x, radius))
    linked = []
    for i in range(len(n)):
        for j in range(i):
            far = (int.from_bytes(values[i], "little") ^ int.from_bytes(values[j], "little")).bit_count()
            fits = min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) and (far <= 80 or min(n[i], n[j]) < similar.SMALL)
            if fits and (not halves or blocks[i] != blocks[j]):
                linked.append((int(nodes[i]), int(nodes[j])))
    found = similar.tied(nodes, blocks, sizes, values, 80, 0.8)
    assert parts(zip(found["src"].to_pylist(), found["dst"].to_pylist())) == parts(linked) and len(linked) > 20
    assert len(asked) == (len(n) // 2 if halves else len(n)) and set(asked) == {80, 256}
    if not halves:
        few = similar.tied_few(nodes.tolist(), n, [int.from_bytes(v, "little") for v in values], 80, 0.8)
        assert parts(few) == parts(linked) and len(asked) == 2 * len(n)
