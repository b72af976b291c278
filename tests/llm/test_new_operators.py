"""Alignment, importance resampling and sharding against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import alignment, queries, resampling, sharding
from weftline.llm.order import numbered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = {c: c + 32 for c in range(65, 91)}


def texts() -> list[str | None]:
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma,", "don't", "été", "日本語", "x1", "zeta.", "I'll", "naïve", "12345", "😀👍", "\n", "  ", "\t", "<|endoftext|>", "</s>", "<unk>", "<0x41>"]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    out += [out[0]] * 25 + [out[1]] * 3 + [None, None, "", " ", "\n\n  a", "a▁b", "x" * 5000, "́a ", "end ", " ".join(rng.choices(words, k=8000)), "\x00\x01 \x1f", "ﬁ é́"]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("more"))
    rows = [(i * 2, t, i) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id bigint, text string, key int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("q1", "alpha beta gamma " * 9), ("q2", None), ("q3", "Été x1 日本語")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{path}/none/{name}.parquet")
    return path


def plain_alignment(docs: dict[int, str | None]) -> dict[int, tuple]:
    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = {c: i for i, c in alignment_table().items()}

    def b_bytes(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    groups, counts = {}, collections.Counter()
    for doc, text in docs.items():
        groups[doc] = None
        if not text:
            continue
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        sides = [[bytes(table[c] for c in a_lib.id_to_token(i)) for i in a], [b_bytes(i) for i in b]]
        if any(b"".join(s) != (" " + text).encode() for s in sides):
            continue
        ends = []
        for s in sides:
            at, of = 0, {}
            for n, x in enumerate(s):
                at += len(x)
                of[at] = n + 1
            ends.append(of)
        shared = sorted(set(ends[0]) & set(ends[1]))
        cut = [(0, 0)] + [(ends[0][e], ends[1][e]) for e in shared]
        groups[doc] = (a, b, cut)
        counts.update((a[i - 1], b[j - 1]) for i, j in cut[1:])
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = {}
    for doc, found in groups.items():
        if found is None:
            out[doc] = (0,) * 6 + ("",)
            continue
        a, b, cut = found
        told = ";".join(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])) for (i, j), (x, y) in zip(cut, cut[1:]))
        linked = [counts[a[i - 1], b[j - 1]] for i, j in cut[1:]]
        n_best = sum(counts[a[i - 1], b[j - 1]] == best[b[j - 1]] for i, j in cut[1:])
        out[doc] = (len(a), len(b), len(linked), len(linked), n_best, sum(linked), hashlib.sha256(told.encode()).hexdigest())
    return out


def alignment_table() -> dict[int, str]:
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


def test_alignment_is_as_by_offsets(spark, folder):
    found = queries.op11_alignment(spark, folder).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found}
    assert len(found) == len(docs) and got == plain_alignment(docs)
    assert sum(v[0] > 0 for v in got.values()) > 80 and sum(v[0] == 0 for v in got.values()) >= 4


def test_alignment_does_not_depend_on_blocks(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(3)
    one, many = (sorted(map(tuple, alignment.link_counts(docs, block_chars=n).collect())) for n in (1 << 30, 200))
    assert one == many


def test_alignment_groups_and_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("block", F.lit(1)).withColumn("pairs", F.lit(2))
    counted = {r.doc_id: r for r in alignment.link_counts(docs).collect()}
    total = 0
    for r in alignment.groups(docs).collect():
        told = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in r.groups)
        assert (hashlib.sha256(told.encode()).hexdigest() if told else "") == counted[r.doc_id].groups_sha256
        total += len(r.groups)
    assert alignment.pair_counts(docs).agg(F.sum("n")).first()[0] == total
    assert queries.op11_alignment(spark, f"{folder}/none").count() == 0


def test_transducer_by_hand():
    t = alignment.Transducer([b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"abcd"], max_steps=0)
    assert t.groups([0, 1], [0, 1]) == ([2], [2])
    assert t.groups([2, 3, 2], [2, 0, 1]) == ([2, 3], [1, 3])
    assert t.groups([], []) == ([], [])


def plain_draw(docs, bench):
    def of(text):
        return WORD.findall((text or "").translate(AZ))

    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = (collections.Counter(bucket(w) for x in side for w in of(x)) for side in (docs.values(), bench))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    rows = {}
    for doc, text in docs.items():
        w = of(text)
        weight = sum(gain(bucket(x)) for x in w) // len(w) if w else 0
        h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
        rows[doc] = (len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((-r[2], doc) for doc, r in rows.items() if r[0] >= 20)
    ranks = {doc: i + 1 for i, (_, doc) in enumerate(able[: 10 * len(able) // 100])}
    return {doc: (*r, ranks.get(doc)) for doc, r in rows.items()}


def test_importance_resampling(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    bench = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = queries.op12_importance_resampling(spark, folder).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in found} == plain_draw(docs, bench)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    expected = con.execute(queries.ORACLE_SQL["op12_importance_resampling"]).fetchall()
    assert sorted(map(str, ((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found))) == sorted(map(str, expected))
    assert queries.op12_importance_resampling(spark, f"{folder}/none").count() == 0


def test_resampling_keeps_columns_ties_and_nulls(spark, folder):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(None, long, 1)] + [(7, long, i) for i in range(5)] + [(i, f"{long} tail{i}", 0) for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int").withColumn("weight", F.lit("w")).withColumn("row", F.lit(0))
    bench = spark.createDataFrame([("q", long)], "item_id string, text string")
    found = resampling.importance(docs, bench, percent=50).collect()
    assert len(found) == 46 and sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 23))  # half of 45 rows with an id
    assert [r.score for r in found if r.doc_id is None] == [None]
    kept = resampling.resample(docs, bench, percent=50)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r["rank"]}
    assert resampling.resample(docs.limit(0), bench).count() == 0


def test_runs_of_words(spark):
    df = spark.createDataFrame([("a b c",), ("a",), ("",), (None,)], "text string")
    made = df.select(resampling.features(resampling.words(F.col("text")), 3).alias("f")).collect()
    assert [r.f for r in made] == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], [], []]


def shards_of(found):
    held = collections.defaultdict(list)
    for r in found:
        held[r.shard].append(r.slot)
    return held


def check_law(found, n, shards=8):
    held = shards_of(found)
    sizes = [len(held[j]) for j in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in held.values())


def test_sharding(spark, folder):
    found = queries.op13_sharding(spark, folder).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in found) == sorted(docs)
    check_law(found, len(docs))
    for r in found:
        data = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    where = collections.defaultdict(set)
    for r in found:
        where[docs[r.doc_id] or ""].add(r.shard)
    quota = -(-len(docs) // 8)
    for text, of in where.items():
        n = sum((t or "") == text for t in docs.values())
        assert len(of) <= -(-n // quota) + (n > quota), (text[:20], n, of)
    assert queries.op13_sharding(spark, f"{folder}/none").count() == 0


LEAST_TOGETHER = {6: 350, 5: 0, 31: 450}  # of 1740, 0 and 1620 pairs; shards of 8, 1 and 13 rows can hold 396, 0 and 546


@pytest.mark.parametrize("sizes", [[30, 30, 1, 1, 1, 1], [1] * 5, [40] + [2] * 30])
def test_sharding_of_groups(spark, sizes):
    rows = [(i, f"text {g}") for g, n in enumerate(sizes) for i in range(n)]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("x")).withColumn("size", F.lit(1))
    found = sharding.deal(docs.withColumn("doc_id", F.monotonically_increasing_id())).collect()
    check_law(found, len(rows))
    where = collections.defaultdict(collections.Counter)
    for r in found:
        where[r.text_crc32][r.shard] += 1
    together = sum(n * (n - 1) for c in where.values() for n in c.values())
    assert together >= LEAST_TOGETHER[len(sizes)]


def test_rows_in_several_groups(spark):
    members = [(i, i // 4) for i in range(64)] + [(i, 100 + i // 8) for i in range(64)]
    state = sharding.propagate(spark.createDataFrame(members, "row bigint, grp bigint"), 80, rounds=8).filter("shard is not null").collect()
    assert len({r.row for r in state}) == len(state) >= 60
    of = {r.row: r.shard for r in state}
    assert max(collections.Counter(of.values()).values()) <= 10
    together = sum(of.get(a, a) == of.get(b, -1) for g in range(16) for a in range(4 * g, 4 * g + 4) for b in range(a + 1, 4 * g + 4))
    assert together >= 16 * 6 * 0.5  # 1 in 8 by chance


def test_places_in_an_order(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    found = numbered(df, [F.desc("x"), F.asc("id")], "at", "t").collect()
    assert [r.id for r in sorted(found, key=lambda r: r["at"])] == sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert sorted(r["at"] for r in found) == list(range(1000))
    assert numbered(df.limit(0), [F.asc("id")], "at", "t").count() == 0
