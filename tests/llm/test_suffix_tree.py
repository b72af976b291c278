"""The suffix tree against one grown in plain dictionaries: contexts of any depth, rare next words, hot contexts."""

from __future__ import annotations

import collections
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import pst


def held_out(name: str) -> bool:
    return zlib.crc32(name.encode()) % 5 == 1


class Brute:
    def __init__(self, texts: dict, full: bool = False) -> None:
        """full: with next words that may_decide leaves out."""
        self.full = full
        self.cut = {d: [*t.lower().split(), ""] for d, t in texts.items()}
        train = [self.cut[d] for d in self.cut if not held_out(str(d))]
        self.counts = collections.Counter(w for t in train for w in t)
        self.denominator = sum(self.counts.values()) + 0.5 * (len(self.counts) + 1)
        self.nodes: dict = {}
        times = {(w,): n for w, n in self.counts.items() if n >= 2}  # of contexts that may be tested
        kept = {((), w) for w, n in self.counts.items() if n >= 2}
        self.depth = 0
        while True:
            d = self.depth + 1
            after = collections.defaultdict(collections.Counter)
            for t in train:
                for i in range(d, len(t)):
                    after[tuple(t[i - d : i])][t[i]] += 1
            new, times_next, kept_next = {}, {}, set()
            for context, total in times.items():
                if context[1:] and context[1:] not in self.nodes:
                    continue
                n = {w: k for w, k in after[context].items() if k >= 2 and (context[1:], w) in kept and self.may_decide(total, context[1:], w)}
                times_next |= {(*context, w): k for w, k in n.items() if w}
                if not n:
                    continue
                q = {w: self.probability(context[1:], w) for w in n}
                rest_p, rest_q = (max(1 - x, 1e-12) for x in (sum(n.values()) / total, sum(q.values())))
                gain = 2 * (sum(k * math.log(k / total / q[w]) for w, k in n.items()) + total * rest_p * math.log(rest_p / rest_q))
                if gain >= pst.MIN_GAIN + 2 * len(n):
                    p = {w: (k - 0.5) / total for w, k in n.items()}
                    new[context] = (1 - sum(p.values())) / rest_q, p
                    kept_next |= {(context, w) for w in n}
            if not new:
                break
            self.nodes |= new
            times, kept, self.depth = times_next, kept_next, d

    def may_decide(self, total: int, suffix: tuple, w: str) -> bool:
        """A context of two or three occurrences keeps one next word at most: would it, alone, make it a node?"""
        q = self.probability(suffix, w)
        return self.full or total > 3 or any(2 * (n * math.log(n / total / q) + (total - n) * math.log(max(1 - n / total, 1e-12) / max(1 - q, 1e-12))) >= pst.MIN_GAIN + 2 for n in range(2, total + 1))

    def probability(self, context: tuple, w: str) -> float:
        if not context:
            return (self.counts[w] + 0.5) / self.denominator
        weight, p = self.nodes[context]
        return p[w] if w in p else weight * self.probability(context[1:], w)

    def longest(self, words: list[str]) -> tuple:
        d = 0
        while d < len(words) and tuple(words[len(words) - d - 1 :]) in self.nodes:
            d += 1
        return tuple(words[len(words) - d :])

    def score(self, t: list[str]) -> float:
        return sum(math.log10(self.probability(self.longest(t[:i]), w)) for i, w in enumerate(t))


def texts_of_three_words() -> dict:
    rng = random.Random(11)
    texts = {}
    for d in range(40):
        bits = [rng.randint(0, 1) for _ in range(3)]
        while len(bits) < 300:  # decided by three words: two of them tell nothing
            bits.append(bits[-1] ^ bits[-2] ^ bits[-3] if rng.random() < 0.97 else rng.randint(0, 1))
        texts[d] = " ".join(f"{'ab'[b]}" for b in bits) + f" seldom{d % 20} found{d % 20} once{d}"
    for d in range(40, 80):
        words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 120))]
        texts[d] = " ".join(words)
    copy = " ".join(f"x{rng.randrange(60)}" for _ in range(80))
    return texts | {80: copy, 82: copy, 83: "", 84: copy + " tail"}


@pytest.mark.parametrize("options", [{}, {"hot": 3, "block_tokens": 400, "bucket_tokens": 3000}])
def test_scores_are_those_of_the_whole_tree(spark, options):
    texts = texts_of_three_words()
    brute = Brute(texts)
    assert brute.depth >= 3
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_id: r.score for r in pst.score(rows, **options).collect()}
    assert found == pytest.approx({d: brute.score(t) for d, t in brute.cut.items()}, rel=1e-6)


def test_words_that_cannot_decide_alone_hardly_matter(spark):
    """The whole divergence test also finds contexts of two or three occurrences whose children alone tell enough."""
    texts = texts_of_three_words()
    brute, full = Brute(texts), Brute(texts, full=True)
    assert set(brute.nodes) <= set(full.nodes) and len(full.nodes) - len(brute.nodes) <= 0.01 * len(full.nodes)
    for t in brute.cut.values():
        assert brute.score(t) == pytest.approx(full.score(t), rel=1e-3)


def test_a_task_that_runs_again_finds_its_files_gone(spark, tmp_path):
    folder = f"file://{tmp_path}"
    block = pst.Block.new(0, pst.Hashes().of([b"a", b"b", pst.END]), [3], [1])
    row = pst.save(folder, block, pa.array(["k"], pa.string()))
    batch = pa.record_batch({"path": [row["path"]]})
    for _ in range(2):
        assert [b.to_pydict() for b in pst.removed(folder, iter([batch]))] == [batch.to_pydict()]
    assert not list(tmp_path.glob("*.block"))


def test_tasks_may_fail_once_and_nothing_is_left(spark, tmp_path, monkeypatch):
    """Jobs run with a first attempt of each deleting task that fails after it has deleted."""
    rows = spark.createDataFrame(list(texts_of_three_words().items()), "doc_id bigint, text string")
    expected = {r.doc_id: r.score for r in pst.score(rows).collect()}
    once, plain = str(tmp_path / "failed"), pst.removed

    def failing(folder, batches):
        yield from plain(folder, batches)
        if not os.path.exists(once):
            open(once, "w").close()
            list(plain(folder, iter([])))
            raise OSError("lost")

    made = spark.createDataFrame([(i,) for i in range(4)], "i int").repartition(1)
    folder = f"file://{tmp_path}/blocks"
    paths = [pst.save(folder, pst.Block.new(i, pst.Hashes().of([b"a", pst.END]), [2], [1]), pa.array(["k"], pa.string()))["path"] for i in range(4)]
    first = pa.record_batch({"path": paths})
    with pytest.raises(OSError):
        list(failing(folder, iter([first])))
    assert [b.num_rows for b in failing(folder, iter([first]))] == [4] and made.count() == 4
    found = {r.doc_id: r.score for r in pst.score(rows, block_tokens=700).collect()}
    assert found == pytest.approx(expected, rel=1e-6)


def test_probabilities_after_each_context_add_up_to_one():
    brute = Brute(texts_of_three_words())
    for context in [(), *brute.nodes]:
        total = sum(brute.probability(context, w) for w in brute.counts)
        assert total + 0.5 / brute.denominator == pytest.approx(1, abs=1e-3)


def test_context_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(x for _ in range(200) for x in rng.choice([("new", "york", "city"), ("old", "man", "city"), ("city", "of", "man")])) for _ in range(30)]
    found = pst.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert sum(r.score for r in found if r.held_out) > 0.7 * sum(r.base_score for r in found if r.held_out)


def test_rows_without_training_documents_and_odd_ids(spark):
    docs = spark.createDataFrame([(None, "a b a b"), (None, None)], "doc_id string, text string")
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in pst.score(docs).collect()) == [(True, 1, 0, 0, 0.0, 0.0), (True, 5, 0, 0, 0.0, 0.0)]
    odd = spark.createDataFrame([(True, "a b"), (False, "a b"), (True, "c")], "doc_id boolean, text string")
    for r in pst.score(odd).collect():
        assert r.held_out == held_out("true" if r.doc_id else "false")


def test_planes_round_trip():
    for kind in pst.FIELDS.values():
        x = np.arange(1000).astype(kind)
        assert (pst.unpack(pst.pack(x), kind) == x).all() and len(pst.unpack(pst.pack(x[:0]), kind)) == 0
