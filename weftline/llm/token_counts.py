"""Token counts of the sections of documents, from one encoding of each whole document.

Token spans come from the lengths of the tokens' bytes, so a document is never encoded section by section. The
interval join of the spans with the sections is a binary search in the task that holds the document: both sides
are sorted, nothing is shuffled. A token that crosses a boundary goes to the section in which its first character
lies; sections that tile the document therefore share out its tokens without a rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import PATTERN, char_starts
from .pieces import byte_level, in_blocks, text_length

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def line_starts(text: str) -> list[int]:
    """A section for each line, its line feed included; the empty text has one section."""
    starts, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def given_starts(offsets: list[int | None] | None, length: int) -> list[int]:
    """Where sections begin: the offsets in order, without nulls, repeats and what lies beyond the text; what comes before
    the first is a section, too."""
    return sorted({0} | {x for x in offsets or () if x is not None and 0 < x < length})


def section_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    starts_col: str | None = None,
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
) -> DataFrame:
    """(id_col, section_no, char_start, char_end, n_tokens, doc_tokens), a row for each section of each document.

    Sections are the lines of the text, or begin at 0 and the character offsets of `starts_col`, an array of integers
    in any order, in which nulls, repeats and offsets beyond the text don't count (null or empty: one section). Ends are exclusive. A null text is an empty one: one
    empty section without tokens. Sections without a token's first character have 0 tokens. Rows with equal or
    null ids are documents of their own; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_level(vocabulary, pattern)
        for batch in batches:
            rows = list(zip(range(len(batch)), batch.column(1).to_pylist(), batch.column(2).to_pylist() if starts_col else [None] * len(batch)))
            for block in in_blocks(rows, lambda r: text_length(r[1])):
                encoded = bpe.encode([text for _, text, _ in block])
                made: list[list[np.ndarray]] = [[] for _ in range(6)]
                for (row, text, given), ids in zip(block, encoded):
                    text = text or ""
                    starts = np.array(given_starts(given, len(text)) if starts_col else line_starts(text), np.int64)
                    of = np.searchsorted(starts, char_starts(text, ids, bpe.token_length), side="right") - 1
                    n = len(starts)
                    counts = np.bincount(of, minlength=n)
                    ends = np.append(starts[1:], len(text))
                    for out, x in zip(made, (np.full(n, row), np.arange(n), starts, ends, counts, np.full(n, len(ids)))):
                        out.append(x)
                cols = [np.concatenate(x) for x in made]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0])), *(pa.array(c.astype(np.int64)) for c in cols[1:])],
                    names=[id_col, "section_no", "char_start", "char_end", "n_tokens", "doc_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, section_no bigint, char_start bigint, char_end bigint, n_tokens bigint, doc_tokens bigint"
    return docs.select(id_col, text_col, *([starts_col] if starts_col else [])).mapInArrow(run, schema)
