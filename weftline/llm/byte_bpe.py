"""Byte-level BPE encoding and decoding over Arrow batches.

The rank file becomes a model of the tokenizers library over byte characters; the pattern cuts each text, each
distinct piece of a worker is merged once. Decoding goes from ids to byte characters to bytes, so tokens that
hold parts of a character join to whole characters again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import byte_level, in_blocks, text_length, token_bytes

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def char_starts(text: str, ids: np.ndarray, token_length: np.ndarray) -> np.ndarray:
    """The character of text in which each token begins; a token that begins inside a character has that one."""
    starts = np.cumsum(token_length[ids]) - token_length[ids]
    if text.isascii():
        return starts
    lead = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
    return (np.cumsum(lead) - 1)[starts]


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
    offsets: bool = False,
) -> DataFrame:
    """(id_col, n_tokens, ids_le) and, if asked for, char_start array<int>, one for each token.

    ids_le holds the ids as little-endian unsigned 32-bit integers. A null text counts as empty: no tokens. Rows
    stay rows whatever their id, null and repeated ones too; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_level(vocabulary, pattern)
        for batch in batches:
            at = 0
            for texts in in_blocks(batch.column(1).to_pylist(), text_length):
                ids = bpe.encode(texts)
                out = [
                    batch.column(0).slice(at, len(texts)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                ]
                if offsets:
                    out.append(pa.array([char_starts(t or "", x, bpe.token_length) for t, x in zip(texts, ids)], pa.list_(pa.int32())))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_tokens", "ids_le", "char_start"][: len(out)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_le binary" + ", char_start array<int>" * offsets
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def joined(ids: bytes, tokens: list[bytes]) -> bytes:
    """The bytes of ids_le; ValueError if these aren't whole ids or aren't in the vocabulary."""
    if len(ids) % 4:
        raise ValueError(f"{len(ids)} bytes are no whole number of ids")
    numbers = np.frombuffer(ids, "<u4")
    if len(numbers) and int(numbers.max()) >= len(tokens):
        raise ValueError(f"id {int(numbers.max())} isn't in the vocabulary")
    return b"".join(map(tokens.__getitem__, numbers.tolist()))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, as_text: bool = False) -> DataFrame:
    """All columns of encoded and decoded: the bytes that its ids_le stand for (null ids: no bytes).

    as_text: also decoded_text, in which bytes that make no whole character, as where ids were cut inside one, are
    U+FFFD. ids_le that aren't whole ids of the vocabulary fail with a ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(vocabulary)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids_le"))
            made = [joined(x.as_buffer().to_pybytes(), tokens) if x.is_valid else b"" for x in ids]
            out, names = [*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "decoded"]
            if as_text:
                out, names = [*out, pa.array([x.decode("utf-8", "replace") for x in made], pa.string())], [*names, "decoded_text"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kept = encoded.drop("decoded", "decoded_text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, decoded binary" + ", decoded_text string" * as_text)
