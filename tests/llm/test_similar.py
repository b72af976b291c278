"""Near-duplicates by shingle similarity against comparing every pair."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from weftline.llm import similar
from weftline.llm.graph import Forest


def plain_shingles(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def brute_kept(rows: list[tuple]) -> list[tuple]:
    """Of each component of linked texts the row of the least id; ids are unique here."""
    sets = [plain_shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b) > 0:
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [r for i, r in enumerate(rows) if find(i) == i]


def edited(rng: random.Random, words: list[str], edits: int) -> str:
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(1000)}"
    return " ".join(out)


def texts() -> list[str | None]:
    rng = random.Random(7)
    out: list[str | None] = [None, "", "  ", "one two", "One  two", "one two three", "a b c d e", "A b c d e", "a b c d f"]
    for size in (12, 60, 200):
        for _ in range(6):
            base = [f"w{rng.randrange(3000)}" for _ in range(size)]
            out += [" ".join(base), edited(rng, base, 1), edited(rng, base, 1), edited(rng, base, size // 40 + 1), edited(rng, base, size // 8 + 1), " ".join(base[: size // 2])]
    chain = [f"c{i}" for i in range(400)]
    out += [" ".join(chain[i * 15 : i * 15 + 200]) for i in range(10)]  # neighbours link, ends don't
    hot = [f"h{rng.randrange(900)}" for _ in range(150)]
    out += [edited(rng, hot, 1) for _ in range(60)]
    return out


def template_texts() -> list[str]:
    """Pages of one template, some of them near copies of each other, and texts with a line that is repeated many times."""
    rng = random.Random(17)
    frame = [f"t{i}" for i in range(120)]
    pages = []
    for _ in range(60):
        own = [f"o{rng.randrange(10**6)}" for _ in range(50)]
        at = rng.randrange(60)
        pages += [" ".join(frame[:at] + own + frame[at:]), edited(rng, frame[:at] + own + frame[at:], rng.randrange(4))]
    for _ in range(6):
        line = [f"r{rng.randrange(10**6)}" for _ in range(200)]
        pages += [" ".join(line + [w] * n) for w, n in (("alpha", 300), ("beta", 300), ("alpha", 3))]
    return pages


@pytest.mark.parametrize("block, shard_block", [(1 << 20, 2048), (600, 9)])
def test_one_of_each_group_stays(spark, block, shard_block):
    rows = list(enumerate([*texts(), *template_texts()]))
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id bigint, text string, node int, place string, bands int")
    found = similar.keep_one(docs, block=block, shard_block=shard_block)
    assert found.columns == docs.columns
    assert sorted(r.doc_id for r in found.collect()) == [i for i, _ in brute_kept(rows)]


def test_repeated_and_missing_ids_and_no_rows(spark):
    some = "a text of some words that is long enough to have shingles", "another one, which shares no five words in a row with it"
    rows = [(1, some[0]), (2, some[1]), (2, some[0].upper()), (2, some[1]), (None, some[0]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in similar.keep_one(docs).collect()) == sorted([(0, some[0]), (0, ""), (1, some[0]), (2, some[1])])
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_sets_are_compared_as_by_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = []
    for i in range(120):
        own = rng.integers(0, 1 << 62, rng.integers(1, 90), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([base[rng.integers(0, 40) :], own]) if i % 3 else own))
    sets[5] = sets[4]
    nodes = rng.permutation(120).astype(np.int64)
    for blocks in (np.zeros(120, np.int64), np.arange(120) % 2):
        linked = []
        for i in range(120):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if (blocks.any() is np.False_ or blocks[i] != blocks[j]) and len(a & b) >= 0.8 * len(a | b):
                    linked.append((int(nodes[i]), int(nodes[j])))
        found = similar.compared(nodes, blocks, sets, 0.8)
        assert parts(linked) == parts(zip(found["src"].to_pylist(), found["dst"].to_pylist())) and len(linked) > 10


def parts(edges) -> set[frozenset]:
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    out = {}
    for x in forest.parent.keys() | set(forest.parent.values()):
        out.setdefault(forest.find(x), set()).add(x)
    return {frozenset(v) for v in out.values()}


def test_fingerprints_of_similar_sets_lie_within_the_radius():
    rng, far = np.random.default_rng(9), 0
    for _ in range(300):
        n = int(rng.integers(similar.SMALL, 400))
        both = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        own = max(1, int(n * 0.25)) // 2  # 0.8 of the union is in both
        a, b = (np.unique(np.append(both, rng.integers(0, 1 << 62, own, dtype=np.uint64))) for _ in range(2))
        x, y = (int.from_bytes(similar.fingerprint(s), "little") for s in (a, b))
        far = max(far, (x ^ y).bit_count())
    assert far <= similar.RADIUS - 10
    assert similar.fingerprint(np.zeros(0, np.uint64)) == bytes(32)


def test_a_template_that_very_many_texts_share_ends():
    """A block of 2,000 pages that are alike to 0.7, the worst case of a pair of blocks."""
    rng = np.random.default_rng(5)
    frame = rng.integers(0, 1 << 62, 350, dtype=np.uint64)
    sets = [np.unique(np.append(frame, rng.integers(0, 1 << 62, 75, dtype=np.uint64))) for _ in range(2000)]
    began = time.time()
    assert len(similar.compared(np.arange(2000), np.zeros(2000, np.int64), sets, 0.8)) == 0
    assert time.time() - began < 30
