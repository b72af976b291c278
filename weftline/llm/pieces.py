"""Piece-wise BPE: texts are cut into pieces that merges never cross, and each distinct piece is encoded once.

A table lives as long as its Python worker, so later batches and tasks find the frequent pieces encoded. It is
emptied beyond `max_pieces` or MAX_CHARS characters of pieces, so what it holds is bounded by these and one block of texts.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

MAX_PIECES = 100_000
MAX_CHARS = 16_000_000

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism


def byte_chars() -> dict[int, str]:
    """Byte-level BPE's table: printable Latin-1 bytes stand for themselves, the rest for U+0100 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = byte_chars()
CHAR_BYTES = {c: b for b, c in BYTE_CHARS.items()}
_TRANSLATE = {b: ord(c) for b, c in BYTE_CHARS.items()}


def as_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_TRANSLATE)


def as_bytes(chars: str) -> bytes:
    return bytes(map(CHAR_BYTES.__getitem__, chars))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes that each id stands for, by way of its byte characters; ids without a token stand for none."""
    vocabulary = {as_chars(token): rank for token, rank in read_ranks(path).items()}
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for chars, rank in vocabulary.items():
        out[rank] = as_bytes(chars)
    return out


class _Numbers(dict):
    """Numbers of pieces; a new piece gets the next one and waits in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class PieceTable:
    """ids of texts that are cut into pieces; each distinct piece goes through `encode` once while it is held."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], max_pieces: int = MAX_PIECES) -> None:
        self.encode, self.max_pieces = encode, max_pieces
        self.reset()

    def reset(self) -> None:
        self.numbers, self.chars = _Numbers(), 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.ends = np.zeros(1 << 14, np.int64)

    def _learn(self) -> None:
        """Encode the pieces that wait."""
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        self.chars += sum(map(len, new))
        ids, total = self.encode(new), len(self.numbers)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        if total > len(self.ends):
            self.ends = np.resize(self.ends, 2 * total)
        first = total - len(new)
        self.ends[first:total] = self.used + np.cumsum(lengths)
        end = self.used + int(lengths.sum())
        if end > len(self.flat):
            self.flat = np.resize(self.flat, 2 * end)
        self.flat[self.used : end] = np.fromiter(chain.from_iterable(ids), np.uint32, end - self.used)
        self.used = end

    def look_up(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece, one text after the other, and where each text ends among them."""
        if len(self.numbers) > self.max_pieces or self.chars > MAX_CHARS:
            self.reset()
        pieces = np.fromiter(map(len, cut), np.int64, len(cut))
        known = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(cut)), np.int64, int(pieces.sum()))
        self._learn()
        return known, np.cumsum(pieces)

    def flat_ids(self, known: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From :meth:`look_up` the ids of all texts, one after the other, and where each text ends among them."""
        start = np.where(known > 0, self.ends[known - 1], 0)
        counts = self.ends[known] - start
        ends = np.concatenate(([0], np.cumsum(counts)))
        places = np.repeat(start - ends[:-1], counts) + np.arange(ends[-1])
        return self.flat[places], ends[text_ends]

    def of_numbers(self, known: np.ndarray, text_ends: np.ndarray) -> list[np.ndarray]:
        flat, ends = self.flat_ids(known, text_ends)
        return np.split(flat, ends[:-1])

    def ids(self, cut: list[list[str]]) -> list[np.ndarray]:
        """The ids of each text from its pieces."""
        return self.of_numbers(*self.look_up(cut)) if cut else []


class ByteLevelBPE:
    """Byte-level BPE by the tokenizers library from a rank file. In the file's order every way to split a token
    into two known tokens is a merge, which picks the pairs that a merge by lowest rank picks."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer, models

        ranks = read_ranks(path)
        merges = [
            (as_chars(token[:i]), as_chars(token[i:]))
            for token in sorted(ranks, key=ranks.get)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.library = Tokenizer(models.BPE(vocab={as_chars(t): r for t, r in ranks.items()}, merges=merges))
        self.cut = regex.compile(pattern).findall
        self.token_length = np.array([len(b) for b in token_bytes(path)], np.int64)
        self.table = PieceTable(self._encode)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        chars = [as_chars(p.encode("utf-8", "surrogatepass")) for p in pieces]
        return [e.ids for e in self.library.encode_batch_fast(chars, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text; a null text has none."""
        return self.table.ids([self.cut(t) if t else [] for t in texts])


@lru_cache(maxsize=4)
def byte_level(path: str, pattern: str) -> ByteLevelBPE:
    """One for each worker process and vocabulary."""
    return ByteLevelBPE(path, pattern)


class WordBPE:
    """A tokenizers file whose pipeline lower-cases, drops white space and marks word ends.

    Texts of Latin letters (below U+0250, which the file's normal form leaves alone) take the file's steps here
    (lower case, cutting, byte table) and then the file's merges in the library, once for each distinct piece. White
    space ends every piece in that pipeline, so in other texts only the chunks between white space that hold other
    letters go through the library's whole pipeline. So do texts with the separators U+001C to U+001F, which Python
    and the library's pattern split differently, and texts that hold one of the file's added tokens."""

    CUT = r"[{L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{N}]|[^\s{L}{N}]+"  # the file's pattern; letters come first as most pieces are
    BEYOND = 0x250
    MAX_PIECES = 400_000
    WHOLE = " "  # begins what takes the whole pipeline; no piece holds white space

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.bare = Tokenizer(self.library.model)
        kinds = {c: unicodedata.category(c)[0] for i in range(self.BEYOND) for c in chr(i) + chr(i).lower()}
        letters, numbers = (re.escape("".join(sorted(c for c in kinds if kinds[c] == k))) for k in "LN")
        self.cut = re.compile(self.CUT.format(L=letters, N=numbers)).findall
        self.beyond = re.compile(f"[^\\x00-{chr(self.BEYOND - 1)}]").search
        self.table = PieceTable(self._encode, self.MAX_PIECES)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        plain = [as_chars(p.encode("utf-8", "surrogatepass")) for p in pieces if p[0] != self.WHOLE]
        merged = iter(self.bare.encode_batch_fast(plain, add_special_tokens=False))
        whole = iter(self.library.encode_batch_fast([p[1:] for p in pieces if p[0] == self.WHOLE], add_special_tokens=False))
        return [next(whole if p[0] == self.WHOLE else merged).ids for p in pieces]

    def _pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if text.isascii() or not self.beyond(text):
            return self.cut(text.lower())
        out: list[str] = []
        for chunk in text.split():
            if chunk.isascii() or not self.beyond(chunk):
                out += self.cut(chunk.lower())
            else:
                out.append(self.WHOLE + chunk)
        return out

    def _whole(self, text: str | None) -> bool:
        """Whether a text has to take the whole pipeline at once."""
        return bool(text) and any(c in text for c in ("\x1c", "\x1d", "\x1e", "\x1f", *self.added))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text; a null text has none. Texts that take the whole pipeline at once don't enter the table."""
        whole = [i for i, t in enumerate(texts) if self._whole(t)]
        made = self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False) if whole else []
        direct = {i: np.array(e.ids, np.uint32) for i, e in zip(whole, made)}
        by_piece = self.table.ids([[] if i in direct else self._pieces(t) for i, t in enumerate(texts)])
        return [direct.get(i, ids) for i, ids in enumerate(by_piece)]


@lru_cache(maxsize=2)
def word_level(path: str) -> WordBPE:
    return WordBPE(path)


def in_blocks(values: list, weight: Callable[[object], int], most: int = 500_000):
    """Runs of values of about `most` characters, so that a batch of long texts is never held cut in pieces."""
    block, size = [], 0
    for v in values:
        block.append(v)
        size += weight(v)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def text_length(text: str | None) -> int:
    return len(text) if text else 0
