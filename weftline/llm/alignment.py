"""Alignment of two tokenizers' ids over the same bytes by a dangling-suffix transducer.

The text, begun by one blank, is encoded by a byte-level BPE (A) and by pieces (B). The transducer reads both token streams at
once: its state is which side leads and the bytes that the other side hasn't matched yet, and the side behind gives the next
token. An empty residual closes a group: the tokens of both sides since the last one cover the same bytes. Transitions are
memoised by state and token. Both tokenizers end a token before a blank that stands between two other characters, so texts are
cut there, and each distinct chunk goes through the tokenizers and the transducer once while a table holds it.

Links are pairs of tokens whose bytes end together: the last ones of each group, as no token is empty. Counts of id pairs over
the corpus need every document, and each document then needs the counts of its pairs:

1. tasks align whole texts and close a block every BLOCK_CHARS characters; a document keeps its different pairs, a block those
   of all its documents, with numbers;
2. blocks' pairs are summed up (map-side first) and compared with the highest count of their B id, of which there are at most
   as many as A has ids;
3. sums go back to the blocks that asked, and meet the block's documents there.

So what is shuffled is a row for each block and pair rather than for each document and pair, and no group is larger than a block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import PieceTable, as_bytes, in_blocks, text_length
from .shared import materialize

A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
BLOCK_CHARS = 16_000_000
MAX_STEPS = 2_000_000
MAX_CHUNKS = 400_000  # held by a worker
CODE = "<u4"  # of a pair of ids
COLUMNS = ["block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "own_pairs", "own_counts", "pairs", "counts"]


class ByteLevel:
    """A tokenizers file of a byte-level BPE; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for chars, i in vocabulary.items():
            self.tokens[i] = b"" if chars in special else as_bytes(chars)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def encode(self, begun: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(begun, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model that changes no characters and puts a blank before a text. No piece holds a blank after another
    character, so texts may be cut before each run of blanks."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in names):
            raise ValueError("pieces hold blanks after other characters, so chunks can't be encoded apart")
        self.tokens = [b"" if self.library.is_control(i) or self.library.is_unknown(i) else self._bytes(i, p) for i, p in enumerate(names)]
        self.blank = self.library.piece_to_id(SPACE)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def _bytes(self, i: int, piece: str) -> bytes:
        return bytes([int(piece[1:-1], 16)]) if self.library.is_byte(i) else piece.replace(SPACE, " ").encode()

    def encode(self, begun: list[str]) -> list[list[int]]:
        """ids of texts given with their first blank, which the library puts there itself."""
        made = self.library.encode([t[1:] for t in begun], num_threads=1)
        return [ids if t != " " else [self.blank] for t, ids in zip(begun, made)]  # the library leaves an empty text empty


class _Moves(dict):
    """Of one state: the next state for each token, worked out when it is first asked for."""

    def __init__(self, of: "Transducer", leads: int, residual: bytes) -> None:
        super().__init__()
        self.of, self.leads, self.residual = of, leads, residual

    def __missing__(self, token: int) -> int:
        of = self.of
        data = of.tokens[1 - self.leads][token]  # the side behind gives it
        if self.residual.startswith(data):
            leads, residual = self.leads, self.residual[len(data) :]
        elif data.startswith(self.residual):
            leads, residual = 1 - self.leads, data[len(self.residual) :]
        else:
            raise ValueError("the two sides differ")
        of.steps += 1
        state = self[token] = of.state(leads, residual)
        return state


class Transducer:
    """States are numbers: even ones wait for a token of A, odd ones for one of B. 0 has no residual."""

    def __init__(self, a: list[bytes], b: list[bytes], max_steps: int = MAX_STEPS) -> None:
        self.tokens, self.max_steps = (a, b), max_steps
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[tuple[int, bytes], int] = {}
        self.moves: list[_Moves | None] = []
        self.steps = 0
        self.state(1, b"")

    def state(self, leads: int, residual: bytes) -> int:
        """leads: 0 if A does, 1 if B does; without a residual A goes first, as if B led."""
        leads = leads if residual else 1
        known = self.numbers.get((leads, residual))
        if known is None:
            known = self.numbers[leads, residual] = len(self.moves) + (len(self.moves) % 2 == leads)
            self.moves += [None] * (known - len(self.moves)) + [_Moves(self, leads, residual)]
        return known

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """Where the groups of two streams end in each, as numbers of tokens. The streams' bytes have to be equal."""
        if self.steps > self.max_steps:  # a memory, not a limit: transitions are worked out anew
            self.reset()
        moves, ends_a, ends_b = self.moves, [], []
        i = j = 0
        n = len(a)
        while i < n:
            state = moves[0][a[i]]
            i += 1
            while state:
                if state & 1:
                    state = moves[state][b[j]]
                    j += 1
                else:
                    state = moves[state][a[i]]
                    i += 1
            ends_a.append(i)
            ends_b.append(j)
        return ends_a, ends_b


class ChunkTable(PieceTable):
    """Chunks of texts with the numbers of their pairs as ids, and what else is told of them by the chunk's number."""

    #: A chunk begins with a blank between two other characters, or with other white space.
    CUT = re.compile(r"(?: (?=\S)|\s+)\S*(?:(?! \S)\s+\S*)*").findall

    def __init__(self, of: "Aligner") -> None:
        self.of = of
        super().__init__(self._encode, MAX_CHUNKS)

    def reset(self) -> None:
        super().reset()
        self.told: list[str | None] = []
        self.sizes = np.zeros((1 << 14, 2), np.int64)

    def _encode(self, chunks: list[str]) -> list[np.ndarray]:
        """All new chunks at once, as groups close at their ends: the streams of all of them run through the transducer as one."""
        of = self.of
        data = [c.encode("utf-8", "surrogatepass") for c in chunks]
        byte_ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        streams = []
        for side in (of.a, of.b):
            made = side.encode(chunks)
            ids = list(chain.from_iterable(made))
            streams.append((np.array(ids, np.int64), np.cumsum(np.fromiter(map(len, made), np.int64, len(made))), ids))
        whole = b"".join(data)
        if not all(
            b"".join(map(side.tokens.__getitem__, ids)) == whole and np.array_equal(np.concatenate(([0], np.cumsum(side.lengths[flat])))[ends], byte_ends)
            for side, (flat, ends, ids) in zip((of.a, of.b), streams)
        ):
            return self._one_by_one(chunks)
        (a, a_ends, a_ids), (b, b_ends, b_ids) = streams
        ends_a, ends_b = of.transducer.groups(a_ids, b_ids)
        told = of.groups_told(a_ids, b_ids, ends_a, ends_b)
        pairs, closed = of.pairs(a, b, ends_a, ends_b), np.searchsorted(np.array(ends_a), a_ends, side="right")
        begun = [0, *closed[:-1].tolist()]
        self._add(np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0), [";".join(told[i:j]) for i, j in zip(begun, closed.tolist())])
        return np.split(pairs, closed[:-1])

    def _one_by_one(self, chunks: list[str]) -> list[np.ndarray]:
        """Where some chunk isn't given back byte by byte: such a chunk has no groups."""
        pairs, sizes, told = [], [], []
        for a, b, ends_a, ends_b in self.of.align(chunks):
            pairs.append(self.of.pairs(a, b, ends_a, ends_b))
            sizes.append((len(a), len(b)))
            told.append(";".join(self.of.groups_told(a.tolist(), b.tolist(), ends_a, ends_b)) if ends_a else None)
        self._add(*np.array(sizes).T, told)
        return pairs

    def _add(self, n_a: np.ndarray, n_b: np.ndarray, told: list[str | None]) -> None:
        at, end = len(self.told), len(self.told) + len(told)
        if end > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros((end, 2), np.int64)])
        self.sizes[at:end, 0], self.sizes[at:end, 1] = n_a, n_b
        self.told += told

    def rows(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, np.ndarray]]:
        """(tokens of A, of B, the groups as text, numbers of the pairs) of each text; a text with a chunk that isn't given back
        byte by byte has no tokens."""
        known, ends = self.look_up([self.CUT(" " + t) if t else [] for t in texts])
        begin = 0
        for end, pairs in zip(ends.tolist(), self.of_numbers(known, ends)):
            numbers = known[begin:end]
            told = list(map(self.told.__getitem__, numbers.tolist()))
            begin = end
            if not told or None in told:
                yield 0, 0, "", pairs[:0]
                continue
            n_a, n_b = self.sizes[numbers].sum(axis=0).tolist()
            yield n_a, n_b, ";".join(told), pairs


class Aligner:
    def __init__(self, a_file: str, b_file: str) -> None:
        self.a, self.b = ByteLevel(a_file), Pieces(b_file)
        self.transducer = Transducer(self.a.tokens, self.b.tokens)
        self.names = [[str(i) for i in range(len(side.tokens))] for side in (self.a, self.b)]
        self.width = len(self.b.tokens)
        if len(self.a.tokens) * self.width > 1 << 32:
            raise ValueError("a pair of ids has to fit 32 bits")
        self.chunks = ChunkTable(self)

    def align(self, begun: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
        """ids of A and of B and where groups end in each, for every text, given with its first blank; nothing for a text that
        has no tokens."""
        for text, a, b in zip(begun, self.a.encode(begun), self.b.encode(begun)):
            data = text.encode("utf-8", "surrogatepass")
            if text and b"".join(map(self.a.tokens.__getitem__, a)) == data == b"".join(map(self.b.tokens.__getitem__, b)):
                yield np.array(a, np.int64), np.array(b, np.int64), *self.transducer.groups(a, b)
            else:
                yield np.zeros(0, np.int64), np.zeros(0, np.int64), [], []

    def groups_told(self, a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> list[str]:
        """a1,a2|b1 for each group: its ids."""
        names_a, names_b = list(map(self.names[0].__getitem__, a)), list(map(self.names[1].__getitem__, b))
        out, i, j = [], 0, 0
        for x, y in zip(ends_a, ends_b):
            left = names_a[i] if x == i + 1 else ",".join(names_a[i:x])
            out.append(left + "|" + (names_b[j] if y == j + 1 else ",".join(names_b[j:y])))
            i, j = x, y
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray, ends_a: list[int], ends_b: list[int]) -> np.ndarray:
        """A number for each link: A's id times B's number of ids, plus B's id."""
        if not ends_a:
            return np.zeros(0, np.int64)
        return a[np.array(ends_a) - 1] * self.width + b[np.array(ends_b) - 1]


@lru_cache(maxsize=2)
def aligner(a_file: str, b_file: str) -> Aligner:
    """One for each worker process and pair of files."""
    return Aligner(a_file, b_file)


def _kind(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(id_col, groups array<struct<a array<int>, b array<int>>>): the aligned ids of each text, a row for each row of docs.

    Null and empty texts, and those that a tokenizer doesn't give back byte by byte, have no groups. Null and repeated ids
    are rows of their own; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(a_file, b_file)
        for batch in batches:
            at = 0
            for texts in in_blocks(batch.column(1).to_pylist(), text_length):
                ends, offsets, values = [0], ([0], [0]), ([], [])
                for a, b, *of in work.align([" " + t if t else "" for t in texts]):
                    ends.append(ends[-1] + len(of[0]))
                    for k, ids in enumerate((a, b)):
                        begun = offsets[k][-1]
                        offsets[k].extend(begun + e for e in of[k])
                        values[k].append(ids.astype(np.int32))
                lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(np.concatenate(v))) for o, v in zip(offsets, values)]
                structs = pa.StructArray.from_arrays(lists, names=["a", "b"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)], names=[id_col, "groups"])
                at += len(texts)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {_kind(docs, id_col)}, groups array<struct<a:array<int>,b:array<int>>>")


def _blocks(docs: DataFrame, id_col: str, text_col: str, a_file: str, b_file: str, block_chars: int) -> DataFrame:
    """A row for each row of docs, with its block, numbers, digest and different pairs; and a row for each block, in which
    `pairs` and `counts` aren't null, with those of all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(a_file, b_file)
        block, chars = TaskContext.get().partitionId() << 24, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        kind = None

        def of_block() -> pa.RecordBatch:
            pairs = np.concatenate([p for p, _ in held] or [np.zeros(0, np.int64)])
            distinct, at = np.unique(pairs, return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in held] or [np.zeros(0, np.int64)]), len(distinct)).astype(np.int64)
            nulls = [pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (distinct, counts)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *nulls, *lists], names=COLUMNS)

        for batch in batches:
            at, kind = 0, batch.column(0).type
            for texts in in_blocks(batch.column(1).to_pylist(), text_length):
                rows: list[list] = [[] for _ in range(6)]
                for n_a, n_b, told, linked in work.chunks.rows(texts):
                    pairs, counts = np.unique(linked, return_counts=True)
                    held.append((pairs, counts))
                    digest = hashlib.sha256(told.encode()).hexdigest() if told else ""
                    for column, x in zip(rows, (n_a, n_b, len(linked), digest, pairs.astype(CODE).tobytes(), counts.astype("<u4").tobytes())):
                        column.append(x)
                n = len(texts)
                numbers = [pa.array(rows[k], pa.int64()) for k in (0, 1, 2, 2)]
                rest = [pa.array(rows[3], pa.string()), pa.array(rows[4], pa.binary()), pa.array(rows[5], pa.binary()), *[pa.nulls(n, pa.list_(pa.int64()))] * 2]
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), batch.column(0).slice(at, n), *numbers, *rest], names=COLUMNS)
                at += n
                chars += sum(map(text_length, texts))
                if chars >= block_chars:
                    yield of_block()
                    block, chars, held = block + 1, 0, []
        if held:
            yield of_block()

    schema = f"block bigint, id {_kind(docs, id_col)}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, own_pairs binary, own_counts binary, pairs array<bigint>, counts array<bigint>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _totals(asked: DataFrame, width: int) -> DataFrame:
    """(pair, total, best) from (block, pair, n): how often a pair is linked, and whether no pair of its B id is linked more often."""
    totals = asked.groupBy("pair").agg(F.sum("n").alias("total"))
    of_b = Window.partitionBy(F.col("pair") % width)  # at most as many rows as A has ids
    return totals.select("pair", "total", (F.col("total") == F.max("total").over(of_b)).alias("best"))


def pair_counts(docs: DataFrame, text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(a, b, n, best): how often each pair of ids is linked in all texts, and whether it is the most frequent of its B id."""
    width = len(aligner(a_file, b_file).b.tokens)
    made = materialize(_blocks(docs, text_col, text_col, a_file, b_file, block_chars), "aligned")
    asked = made.filter("pairs is not null").select("block", F.inline(F.arrays_zip("pairs", "counts")).alias("pair", "n"))
    return _totals(asked, width).select(F.floor(F.col("pair") / width).cast("int").alias("a"), (F.col("pair") % width).cast("int").alias("b"), F.col("total").alias("n"), "best")


def link_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs.

    n_best: links whose pair is linked as often as any with its B id, in all texts; count_sum: the sum of the pairs' counts over
    the links. Null and empty texts, and those that a tokenizer doesn't give back byte by byte, have zeros and an empty digest.
    Null and repeated ids are rows of their own, other columns aren't read; no rows give no rows."""
    width = len(aligner(a_file, b_file).b.tokens)
    kind = _kind(docs, id_col)
    made = materialize(_blocks(docs, id_col, text_col, a_file, b_file, block_chars), "aligned")
    asked = made.filter("pairs is not null").select("block", F.inline(F.arrays_zip("pairs", "counts")).alias("pair", "n"))
    totals = materialize(_totals(asked, width), "totals")
    told = asked.select("block", "pair").join(totals, "pair").select("block", "pair", "total", "best")
    rows = made.filter("pairs is null").drop("pairs", "counts")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.array(right["pair"].to_numpy(), np.int64)
        order = np.argsort(known)
        known, total, best = known[order], right["total"].to_numpy()[order], right["best"].to_numpy(zero_copy_only=False)[order]
        n_best, sums = [], []
        for pairs, counts in zip(left["own_pairs"].to_pylist(), left["own_counts"].to_pylist()):
            at, n = np.searchsorted(known, np.frombuffer(pairs, CODE).astype(np.int64)), np.frombuffer(counts, "<u4").astype(np.int64)
            n_best.append(int(n[best[at].astype(bool)].sum()))
            sums.append(int((n * total[at]).sum()))
        out = left.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    schema = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    out = rows.groupBy("block").cogroup(told.withColumnRenamed("block", "asked_by").groupBy("asked_by")).applyInArrow(meet, schema)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
