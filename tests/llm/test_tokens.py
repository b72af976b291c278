"""Offsets, sections and decoding on odd rows."""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from weftline.llm import byte_bpe, token_counts


def library(name: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_starts(own: tiktoken.Encoding, text: str) -> list[int]:
    """The character in which each token begins."""
    out, at = [], 0
    for i in own.encode_ordinary(text):
        out.append(len(text.encode()[:at].decode(errors="ignore")))
        at += len(own.decode_single_token_bytes(i))
    return out


TEXTS = ["Hello world, this is text", "日本語のテキスト 😀👍 naïve", "", None, "x"]


def test_sections_from_offsets_in_any_order(spark):
    own = library("byte_bpe_50k.tiktoken")
    offsets = [[9, 3, None, 3, 99, -1], [4, 0], [1], [2], None]
    rows = [(i % 2 or None, t, o, 7) for i, (t, o) in enumerate(zip(TEXTS, offsets))]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id bigint, text string, starts array<int>, n_tokens int")
    found = sorted((r.char_start, r.char_end, r.n_tokens, r.doc_tokens) for r in token_counts.section_counts(docs, starts_col="starts").collect())
    expected = []
    for text, given in [(t or "", o) for t, o in zip(TEXTS, offsets)] + [(TEXTS[0], offsets[0])]:
        cut = [*sorted({0} | {x for x in given or [] if x and 0 < x < len(text)}), len(text)]
        at = token_starts(own, text)
        expected += [(a, b, sum(a <= x < b for x in at), len(at)) for a, b in zip(cut, cut[1:])]
    assert found == sorted(expected)


def test_offsets_of_tokens(spark):
    own = library("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(None, t) for t in TEXTS] + [(1, TEXTS[1])] * 2, "doc_id bigint, text string")
    found = sorted((list(np.frombuffer(bytes(r.ids_le), "<u4")), list(r.char_start)) for r in byte_bpe.encode(docs, offsets=True).collect())
    assert found == sorted((own.encode_ordinary(t or ""), token_starts(own, t or "")) for t in [*TEXTS, TEXTS[1], TEXTS[1]])


def test_decoding_cut_ids(spark):
    own = library("byte_bpe_multi_50k.tiktoken")
    ids = own.encode_ordinary("ok 𓀀")
    docs = spark.createDataFrame([(1, bytearray(np.array(ids[:-1], "<u4").tobytes())), (2, None)], "doc_id bigint, ids_le binary")
    text = own.decode_bytes(ids[:-1]).decode("utf-8", "replace")
    assert [(bytes(r.decoded), r.decoded_text) for r in byte_bpe.decode(docs, as_text=True).orderBy("doc_id").collect()] == [(own.decode_bytes(ids[:-1]), text), (b"", "")] and "\ufffd" in text
    tokens = byte_bpe.token_bytes(byte_bpe.VOCABULARY)
    for bad in (b"abc", np.array([10**6], "<u4").tobytes()):
        with pytest.raises(ValueError):
            byte_bpe.joined(bad, tokens)
