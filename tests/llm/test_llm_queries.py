"""The numbered queries against brute force, on small tables with nulls, empty and long texts, copies and repeated rows."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm import bitplanes, decontaminate, hnsw, html_text, pst, queries, simhash, token_counts, toxicity, warc
from weftline.llm.graph import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def fixture_texts() -> list[str | None]:
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "don't", "été", "日本", "x1", "zeta.", "I'll", "naïve", "12345", "😀👍"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    texts += [texts[0], texts[0] + " ", texts[1].upper(), None, "", "  \n\t ", "one", "one two", "x" * 3000, " ".join(rng.choices(words, k=20000))]
    long = " ".join(rng.choices(words[:6], k=400))
    texts += [long, long + " extra", long.replace("alpha", "alpha ", 3), "line one\nline two\n\nline four", "tab\there\r\nthere\x1cend"]
    return texts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    texts = fixture_texts()
    rows = [(i * 3, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    bench = [("q1", " ".join(f"w{i}" for i in range(20))), ("q2", "short item text"), ("q3", ""), ("q4", None), ("q5", "Alpha beta")]
    rows.append((1001, "start " + " ".join(f"W{i}" for i in range(3, 19)) + " end", "en", "s", 0))
    rows.append((1002, "A short, item! text and more", "en", "s", 0))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, int(i % 9 == 0)) for i, r in enumerate(rows)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, f"http://a/{i}", h) for i, h in enumerate(["<p>one</p>", "<p>two é</p>", "<p>one</p>", None, "", "<p>one</p>", "a\r\n\r\nb\n" * 50])]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 12))
    vectors = [*base, *(base[:20] + 0.08 * rng.standard_normal((20, 12))), *(base[0] + 0.15 * rng.standard_normal((30, 12))), base[3], base[3] * 2, np.zeros(12)]
    rows_v = [(i, [float(x) for x in v], "l") for i, v in enumerate(vectors)] + [(900, None, "l"), (901, [float("nan")] * 12, "l"), (902, [None] * 12, "l")]
    spark.createDataFrame(rows_v, "vec_id bigint, embedding array<float>, label string").write.parquet(f"{path}/embeddings.parquet")
    for name in ("documents", "benchmark", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{path}/none/{name}.parquet")
    return path


def documents(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op1(spark, folder):
    docs = documents(spark, folder)
    fps = {d: brute_fingerprint(t) for d, t in docs.items()}
    expected = components(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    found = queries.op1_simhash_near_dedup(spark, folder).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {d: (f"{fps[d]:016x}", expected[d]) for d in docs}


def test_links_are_whole_in_trees_and_beyond_their_size(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in base for _ in range(15)} | {base[0] ^ k for k in range(64)})
    expected = components(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    groups = {frozenset(v for v in values if expected[v] == k) for k in set(expected.values())}
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp bigint")
    for most in (4096, 8):
        label = {r.node: r.label for r in connected_components(simhash.links(df, max_tree=most)).collect()}
        got = collections.defaultdict(set)
        for v in values:
            got[label.get(simhash._signed(v), simhash._signed(v))].add(v)
        assert {frozenset(g) for g in got.values()} == groups


def test_op2_sections_share_out_all_tokens(spark, folder):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, found = documents(spark, folder), collections.defaultdict(list)
    for r in queries.op2_token_counts(spark, folder).collect():
        found[r.doc_id].append(r)
    for d, text in docs.items():
        ids = library.encode_ordinary(text or "")
        starts, at = [], 0
        for i in ids:
            starts.append(len((text or "").encode()[:at].decode(errors="ignore")))
            at += len(library.decode_single_token_bytes(i))
        sections = sorted(found[d], key=lambda r: r.section_no)
        assert [r.char_start for r in sections] == token_counts.line_starts(text or "")
        assert [r.n_tokens for r in sections] == [sum(r.char_start <= s < r.char_end for s in starts) for r in sections]
        assert sum(r.n_tokens for r in sections) == len(ids)


def multi():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op3(spark, folder):
    library = multi()
    for r in queries.op3_byte_bpe(spark, folder).collect():
        text = texts_of(spark, folder)[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


_KEPT: dict = {}


def texts_of(spark, folder):
    return _KEPT.setdefault(folder, documents(spark, folder))


def test_op4(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found, start = {r.doc_id: r for r in queries.op4_token_planes(spark, folder).collect()}, 0
    for d, text in sorted(texts_of(spark, folder).items()):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert tuple(found[d])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op4_added_tokens_repeated_and_null_ids_in_several_files(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["a <|endoftext|> b", "x<|startoftext|>y É", "<|ENDOFTEXT|> <|endoftext|", "日本<|endoftext|>", None, "plain", "plain", "a much longer text than the others"] * 3
    docs = spark.createDataFrame([(None if i % 5 == 0 else i % 4, t, 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, n bigint, ids int")
    for small in (1 << 26, 8):
        found = sorted(bitplanes.write_and_read(docs, shard_ids=small).collect(), key=lambda r: r.start)
        assert [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(len(found))]
        assert [r.doc_id if r.doc_id is not None else -1 for r in found] == sorted(-1 if i % 5 == 0 else i % 4 for i in range(len(texts)))
        ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]
        assert collections.Counter((r.n_tokens, r.ids_crc32) for r in found) == collections.Counter((len(x), zlib.crc32(x)) for x in ids)


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_round_trip(bits):
    ids = np.random.default_rng(0).integers(0, 49408, 1003).astype(np.uint32)
    planes = bitplanes.to_planes(ids, -(-16 // bits), bits)
    assert (bitplanes.from_planes(planes, len(ids), bits) == ids).all()


def test_op5(spark, folder):
    docs = texts_of(spark, folder)
    cut = {d: [w for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))] + [""] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    counts = collections.Counter(w for d in docs if not held[d] for w in cut[d])
    total = sum(counts.values())
    for r in queries.op5_suffix_tree_scores(spark, folder).collect():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in cut[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(cut[r.doc_id]), sum(counts[w] > 0 for w in cut[r.doc_id]), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0


def test_op6(spark, folder):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    good = {i: np.array(v, float) for i, v in rows.items() if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    linked = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.95]
    label, links = components(rows, linked), collections.Counter(x for pair in linked for x in pair)
    found = queries.op6_hnsw_near_dedup(spark, folder).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {i: (links[i], label[i], label[i] == i) for i in rows}


def test_hnsw_recall_on_many_vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 32))
    x = hnsw.unit(np.repeat(base, 5, axis=0) + 0.15 * rng.standard_normal((1500, 32)))
    graph = hnsw.Graph(x)
    assert graph.audit(0.95) >= 0.98
    found = {pair for a, b in graph.near(x, 0.95) for pair in zip(a.tolist(), b.tolist())}
    assert len(found) >= 0.9 * np.count_nonzero(x @ x.T >= 0.95)


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = words(text), set(), set()
    for item, item_text in items:
        v = words(item_text)
        n = min(13, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("small", [False, True])
def test_op7(spark, folder, small, monkeypatch):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    expected = {d: brute_hits(t, items) for d, t in texts_of(spark, folder).items()}
    if small:  # hash sets so small that they let nearly all places through
        monkeypatch.setattr(decontaminate, "LEAST_BITS", 2)
        monkeypatch.setattr(decontaminate, "MOST_BITS", 2)
    found = queries.op7_decontamination(spark, folder).collect()
    digest = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert {tuple(r) for r in found} == {(d, n, h, len(i), digest(i), h > 0 and 20 * h >= n) for d, (n, h, i) in expected.items()}
    one = decontaminate.find(spark.createDataFrame([(1, "x " * 5000 + "rare y")], "doc_id int, text string"), spark.createDataFrame([("a", "rare"), ("b", "x y " * 9), ("c", None)], "item_id string, text string"))
    assert [(r.n_words, r.n_hit, r["items"]) for r in one.collect()] == [(5002, 1, ["a"])]
    spans = {r.doc_id: r.text for r in decontaminate.remove_spans(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert spans[1001] == "start end" and spans[1002] == "a and more"


def test_op8_learns_and_scores_every_row(spark, folder):
    found = queries.op8_toxicity(spark, folder).collect()
    assert {r.doc_id for r in found} == set(texts_of(spark, folder))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    rng = random.Random(9)
    calm, rude = ["house", "river", "table", "green", "walk", "Sunday"], ["stupidhead", "grobian", "vilain"]
    rows = []
    for i in range(600):
        words = rng.choices(calm, k=rng.randint(5, 80))
        if i % 4 == 0:
            words[rng.randrange(len(words))] = "you " + rng.choice(rude)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    scored = {r.doc_id: r for r in toxicity.classify(docs.drop("toxic"), docs.drop("text")).collect()}
    out = [(scored[i].predicted, t) for i, _, t in rows if scored[i].held_out]
    assert sum(p == t for p, t in out) / len(out) > 0.95


def test_op9(spark, folder):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    first: dict = {}
    for p, h in sorted(pages.items()):
        first.setdefault(h, p)
    digest = lambda h: base64.b32encode(hashlib.sha1(h).digest()).decode()
    expected = {(p, len(h), digest(h), "response" if first[h] == p else "revisit", None if first[h] == p else first[h]) for p, h in pages.items()}
    assert {tuple(r) for r in queries.op9_warc(spark, folder).collect()} == expected
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))))


def test_op9_rows_that_share_ids_keep_their_payloads(spark, folder):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>b b</p>"), (1, "v", "<p>a</p>"), (2, None, "<p>a</p>"), (2, "u", "only here"), (2, "x y\r\nz", "<p>b b</p>"), (None, "u", "<p>a</p>"), (None, "u", "<p>a</p>"), (1, "u", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha", F.lit("x")).withColumn("row", F.lit(1))
    found = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(pages).collect())
    assert found == {
        (1, 8, "response", None): 1, (1, 8, "revisit", 1): 2, (1, 10, "response", None): 1, (2, 8, "revisit", 1): 1, (2, 9, "response", None): 1, (2, 10, "revisit", 1): 1, (None, 8, "response", None): 2,
    }
    assert all(r.record_type == "response" for r in warc.archive(pages, min_bytes=100).collect())
    odd = spark.createDataFrame([("", "u", "a"), ("a\r\nb>", "u", "a"), ("é 日", "u", "bb"), (None, None, None)], "page_id string, url string, html string")
    assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(odd).collect()} == {("", 1, "response", None), ("a\r\nb>", 1, "revisit", ""), ("é 日", 2, "response", None), (None, 0, "response", None)}
    path = f"{folder}/archives"
    manifest = warc.write(pages, "file://" + path, file_bytes=200)
    names = [r.file for r in manifest.collect()]
    kept = [h for n in names for h, _ in warc.records(open(f"{path}/{n}", "rb"))]
    assert len(names) > 2 and len({h["warc-record-id"] for h in kept}) == len(kept) == 9
    assert {h["warc-refers-to"] for h in kept if "warc-refers-to" in h} <= {h["warc-record-id"] for h in kept if h["warc-type"] == "response"}


def test_op10():
    page = """<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies on this site for everything</div>
    <article><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b> text that goes on for long enough to count.</p><script>var a = "<p>no</p>";</script>
    <p>Short.</p><div class="comments"><p>A reader says hello</p></div></article><footer>All rights reserved</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\nFirst paragraph with bold text that goes on for long enough to count.\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == "" and html_text.main_text("<p>a &lt;b&gt;") == "a <b>"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, folder, name):
    assert queries.QUERIES[name](spark, f"{folder}/none").count() == 0


def test_clashing_columns_and_repeated_ids(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as row", "2 as w", "3 as places", "4 as items", "'x' as fp", "5 as score", "6 as id", "7 as label")
    twice = docs.union(docs).union(docs.limit(1).selectExpr("cast(null as bigint) as doc_id", *docs.columns[1:]))
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").selectExpr("*", "1 as n", "2 as window")
    n = docs.count()
    assert simhash.near_duplicates(twice).count() == 2 * n + 1
    kept = simhash.keep_one(twice)
    assert kept.columns == docs.columns and kept.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").count() == 0
    some = "a text of some words that is long enough", "another one, which shares no three words in a row"
    odd = spark.createDataFrame([(1, some[0]), (2, some[1]), (2, some[0]), (2, some[1]), (None, some[0])], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(odd).collect()) == sorted([(0, some[0]), (1, some[0]), (2, some[1])])
    assert decontaminate.find(twice, bench).count() == 2 * n + 1
    assert decontaminate.remove_documents(twice, bench).columns == decontaminate.remove_spans(twice, bench).columns == docs.columns
    assert toxicity.reject(twice.withColumnRenamed("fp", "predicted"), spark.read.parquet(f"{folder}/labels.parquet")).columns[5:] == ["row", "w", "places", "items", "predicted", "score", "id", "label"]
    assert pst.score(twice).count() == 2 * n + 1
    assert toxicity.classify(twice, spark.read.parquet(f"{folder}/labels.parquet")).count() == 2 * n + 1


def test_pipeline(spark, folder):
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    toxic = {r.doc_id: r.predicted for r in queries.op8_toxicity(spark, folder).collect()}
    texts = {d: t for d, t in texts_of(spark, folder).items() if not toxic[d]}
    sets = {d: plain_shingles(t) for d, t in texts.items()}
    label = components(sets, [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)])
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hits = {d: brute_hits(t, items) for d, t in texts.items() if label[d] == d}
    clean = {d for d, (n, h, _) in hits.items() if not (h and 20 * h >= n)}
    library = multi()
    assert set(found) == clean
    assert all(found[d].n_tokens == len(library.encode_ordinary(texts[d] or "")) for d in clean)
