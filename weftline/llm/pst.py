"""Language-model scores from a probabilistic suffix tree over words (Ron, Singer and Tishby, 1996).

Root: smoothed word probabilities over every distinct word of the training documents. A context, the words before a
token, becomes a node if it occurs LEAST times or more and its next-word counts diverge from those of its suffix: twice
the log likelihood ratio has to reach `min_gain` nats and two more for each next word that it keeps. It is tested only
if its suffix is a node and its own count is known, for which the context without its newest word has to have been
tested with that word among those that could make it a node. A node keeps next words with LEAST counts or more, discounted by DISCOUNT, and backs off to its suffix with
the weight that makes its probabilities add up to 1, so scores are those of a distribution: a token's longest suffix
that is a node decides, by way of shorter ones where it doesn't keep the token. Levels are added until no context
diverges; nothing else limits depth, contexts or next words, so the tree grows with the corpus.

The tree is never held in one place. Equal texts are put together first, with the number of their training documents,
so a text of many copies is read once. Texts are cut into blocks of tokens once, held-out ones too; a block is a file
of the shared folder, and a table says which file is whose. On each level a block asks for what it needs: its distinct
contexts and next words, sorted, with its own training counts, packed by ranges of the contexts' hashes ("buckets"). A
bucket adds up the counts of all blocks, tests its contexts and answers each block in the order of its question, so both
ways cost a few bytes for each distinct entry of a block. The block then moves its tokens one level down, adds to its
documents' scores, and becomes a new file; files are named at random, so a repeated task harms nothing. A context that occurs `hot` times or more is
dealt by its next words instead; the sums of its parts are put together afterwards, and as there are at most N / hot
such contexts (a million at most), every task gets their weights. Contexts are 64-bit hashes, next words 48 bits more.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import in_blocks, text_length
from .shared import delete, discard, materialize, new_path

LEAST = 2  # counts of contexts and of their next words
MIN_GAIN = 10.0
DISCOUNT = 0.5
PASSES = 2  # in which a level on which every token asks is counted: less disk, more work
FOLDS, HELD_OUT = 5, 1
BLOCK_TOKENS = 3 << 18
BUCKET_TOKENS = 1 << 20
HOT, MOST_HOT = 1 << 20, 1_000_000
WORDS_KEPT = 1_000_000
SEED = 42
END = b""  # no word is empty


def held_out(name: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 1. A null id is held out."""
    return F.coalesce(F.crc32(name.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def tokens(text: str | None) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    words.append(END)
    return words


class Hashes(dict):
    """Hashes of words, kept for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, SEED)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = h * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def moved(x: np.ndarray, by: int) -> np.ndarray:
    """For each token what x has `by` tokens before it; 0 before the first."""
    return np.concatenate((np.zeros(min(by, len(x)), x.dtype), x[: max(0, len(x) - by)]))


def sorting(x: np.ndarray, small: bool = False) -> np.ndarray:
    """The places that sort x: hashes, or `small` numbers. Sorting values with the place in their low bits is several
    times as fast as an argsort; of hashes the low bits make room for it, which is checked."""
    bits = np.uint64(max(1, len(x) - 1).bit_length())
    low, at = np.uint64((1 << int(bits)) - 1), np.arange(len(x), dtype=np.uint64)
    both = (x.astype(np.uint64) << bits if small else x & ~low) | at
    both.sort()
    order = (both & low).astype(np.int64)
    if not small and (x[order[1:]] < x[order[:-1]]).any():
        return np.argsort(x)
    return order


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct values of x, a place of each in x, and for each of x the number of its value."""
    order = sorting(x)
    ordered = x[order]
    new = np.concatenate((np.ones(min(1, len(x)), bool), ordered[1:] != ordered[:-1]))
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


def pack(x: np.ndarray) -> bytes:
    """x by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


#: What a block holds besides the keys of its documents, which are distinct texts; each by document, word or token.
#: lengths: tokens that are held, none once no token of the document is asked for; copies: training rows of the text.
DOCS = {"n_tokens": "<i8", "lengths": "<i8", "copies": "<i8", "known": "<i8", "base": "<f8", "added": "<f8"}
WORDS = {"words": "<u8", "counts": "<i8"}
TOKENS = {"local": "<u4", "state": "|u1"}  # state: 1 context asked for on this level, 2 next word, too
ASKED = {"times": "<i8", "q": "<f4"}  # of tokens with state 1 and 2: the context's count; the probability so far. Not
# held for the first level, whose words' counts tell both
FIELDS = {**DOCS, **WORDS, **TOKENS, **ASKED}


class Block:
    """A run of whole documents as numbers, with how far each of its tokens has come."""

    def __init__(self, number: int, **arrays: np.ndarray) -> None:
        self.number = number
        self.__dict__.update(arrays)

    @classmethod
    def new(cls, number: int, hashes: np.ndarray, lengths: list[int], copies: list[int]) -> Block:
        words, _, local = distinct(hashes)
        often = np.argsort(-np.bincount(local, minlength=len(words)), kind="stable")  # frequent words get small numbers, which pack well
        place = np.empty(len(words), np.uint32)
        place[often] = np.arange(len(words), dtype=np.uint32)
        docs = len(lengths)
        return cls(
            number, n_tokens=np.array(lengths, np.int64), lengths=np.array(lengths, np.int64), copies=np.array(copies, np.int64), known=np.zeros(docs, np.int64), base=np.zeros(docs), added=np.zeros(docs),
            words=words[often], counts=np.zeros(len(words), np.int64), local=place[local], state=np.ones(len(hashes), np.uint8),
            times=np.zeros(0, np.int64), q=np.zeros(0, np.float32),
        )

    @classmethod
    def of_row(cls, row: dict) -> Block:
        return cls(row["block"], **{k: unpack(row[k], kind) for k, kind in FIELDS.items()})

    def row(self) -> dict:
        return {k: pack(np.asarray(getattr(self, k), kind)) for k, kind in FIELDS.items()}

    def first_level(self, total: int, distinct_words: int) -> None:
        """Set times and q from the words' counts."""
        own = self.counts[self.local]
        p = (self.counts + 0.5) / (total + 0.5 * (distinct_words + 1))
        self.times, self.q = moved(own, 1)[self.state > 0], p[self.local][self.state == 2].astype(np.float32)

    def shed(self) -> None:
        """Let go of the tokens of documents that have none to ask for, and of words that no token has."""
        doc = self.doc_of()
        stays = np.bincount(doc, self.state > 0, len(self.lengths)) > 0
        if stays.all():
            return
        kept = stays[doc]
        self.lengths = np.where(stays, self.lengths, 0)
        self.state = self.state[kept]
        local = self.local[kept]
        used = np.bincount(local, minlength=len(self.words)) > 0
        self.local = (np.cumsum(used) - 1)[local].astype(np.uint32)
        self.words, self.counts = self.words[used], self.counts[used]

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def place(self) -> np.ndarray:
        """Tokens before each token in its document."""
        starts = np.cumsum(self.lengths) - self.lengths
        return np.arange(len(self.local)) - np.repeat(starts, self.lengths)

    def grams(self, n: int) -> np.ndarray:
        """The key of the n words that end with each token; it grows from the newest word to the oldest."""
        hashes = self.words[self.local]
        out = hashes
        for back in range(1, n):
            out = mix(out, moved(hashes, back))
        return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's run of sorted keys begins, and the end of the last."""
    edges = np.array([-(-(i << 32) // buckets) << 32 for i in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


class Question:
    """A block's distinct contexts and next words of one level, sorted so that each bucket's are together; or what of
    them is for the buckets of a turn."""

    def __init__(self, block: Block, depth: int, buckets: int, hot: float, turn: int = 0, turns: int = 1) -> None:
        self.asked = np.flatnonzero(block.state)
        self.buckets, self.turn, self.turns = buckets, turn, turns
        both = block.state[self.asked] == 2
        gram = block.grams(depth)
        context, times, q = moved(gram, 1)[self.asked], block.times, block.q
        if turns > 1:  # of hot contexts all next words, as these have buckets of their own
            mine = (bucket_of(context, buckets) % turns == turn) | (times >= hot)
            self.asked, context, times, q, both = self.asked[mine], context[mine], times[mine], q[mine[both]], both[mine]
        self.followed = self.asked[both]
        contexts, first, self.context_of = distinct(context)
        self.contexts, self.times = contexts, times[first]
        pairs = mix(gram, moved(block.words[block.local], depth))[self.followed]
        keys, first, pair_of = distinct(pairs)
        n = np.bincount(pair_of, block.copies[block.doc_of()[self.followed]], len(keys)).astype(np.int64)
        context = self.context_of[both][first]
        self.is_hot = self.times >= hot
        # pairs of hot contexts come last, by their own keys
        order = sorting(np.where(self.is_hot[context], len(contexts) + np.arange(len(keys)), context), small=True)
        back = np.empty(len(keys), np.int64)
        back[order] = np.arange(len(keys))
        self.pair_of = back[pair_of]
        self.keys, self.n, self.q, self.context = keys[order], n[order], q[first][order], context[order]

    def parts(self) -> Iterator[tuple[int, dict]]:
        """(bucket, arrays); buckets from `buckets` on hold hot contexts, whose keys stand beside each pair."""
        cold = int(np.count_nonzero(~self.is_hot[self.context]))
        many = np.bincount(self.context[:cold], minlength=len(self.contexts))
        pair_at = np.concatenate(([0], np.cumsum(many)))
        cut = bucket_cuts(self.contexts, self.buckets)
        for bucket in np.flatnonzero(np.diff(cut)).tolist():
            if bucket % self.turns != self.turn:
                continue
            a, b = cut[bucket : bucket + 2]
            x, y = pair_at[a], pair_at[b]
            yield bucket, {"contexts": self.contexts[a:b], "times": self.times[a:b], "many": many[a:b], "keys": self.keys[x:y], "n": self.n[x:y], "q": self.q[x:y]}
        cut = cold + bucket_cuts(self.keys[cold:], self.buckets)
        for bucket in np.flatnonzero(np.diff(cut)).tolist():
            if bucket % self.turns != self.turn:
                continue
            x, y = cut[bucket : bucket + 2]
            whose = self.context[x:y]
            yield self.buckets + bucket, {"contexts": self.contexts[whose], "times": self.times[whose], "many": np.ones(y - x, np.int64), "keys": self.keys[x:y], "n": self.n[x:y], "q": self.q[x:y]}


#: Arrays of a question as they travel: contexts as differences, as they are sorted (those of hot ones rise only within
#: a run of keys, but differences wrap around); of keys the upper 48 bits, as they stand beside their contexts.
ASKS = {"contexts": "<u8", "times": "<f4", "many": "<u4", "keys": "<u8", "n": "<u4", "q": "<f4"}


def packed(part: dict) -> dict:
    out = {k: pack(np.asarray(part[k], kind)) for k, kind in ASKS.items() if k not in ("contexts", "keys")}
    contexts = np.asarray(part["contexts"], "<u8")
    out["contexts"] = pack(np.diff(contexts, prepend=np.uint64(0)))
    return out | {"keys": np.asarray(part["keys"], "<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()}


def unpacked(row: dict) -> dict:
    out = {k: unpack(row[k], kind) for k, kind in ASKS.items() if k != "keys"}
    out["contexts"] = np.cumsum(out["contexts"], dtype=np.uint64)
    raw = np.frombuffer(row["keys"], np.uint8).reshape(-1, 6)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, 2:] = raw
    return out | {"keys": mix(np.repeat(out["contexts"], out["many"]), keys.view("<u8").ravel())}


def weights(c: np.ndarray, k: np.ndarray, q: np.ndarray, s: np.ndarray, total: np.ndarray, min_gain: float) -> np.ndarray:
    """The log weight of each context's suffix, NaN where the context is no node. c, k, q: counts, number and
    probabilities after the suffix of the next words that it keeps; s: sum of n log(n / q) over them."""
    with np.errstate(divide="ignore", invalid="ignore"):
        rest_p, rest_q = np.maximum(1 - c / total, 1e-12), np.maximum(1 - q, 1e-12)
        gain = 2 * (s - c * np.log(total) + total * rest_p * np.log(rest_p / rest_q))
        weight = np.log(np.maximum(1 - (c - DISCOUNT * k) / total, 1e-12) / rest_q)
    return np.where((k > 0) & (gain >= min_gain + 2 * k), weight, np.nan)


def may_decide(times: np.ndarray, q: np.ndarray, min_gain: float) -> np.ndarray:
    """Whether a next word of probability q after the suffix can make a context that occurs `times` times a node. One
    that occurs less than 2 * LEAST times keeps one word at most, so the word's own counts tell."""
    out = times >= 2 * LEAST
    for total in range(LEAST, 2 * LEAST):
        at = np.flatnonzero(times == total)
        p, t, one = np.maximum(q[at], 1e-300), np.full(len(at), float(total)), np.ones(len(at))
        for n in range(LEAST, total + 1):
            out[at] |= ~np.isnan(weights(n * one, one, p, n * np.log(n / p), t, min_gain))
    return out


def answer(parts: list[dict], min_gain: float, hot: bool) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, ...]]:
    """For each part of a bucket the counts of its pairs, 0 below LEAST, and the weights of its contexts; of a bucket of
    hot contexts no weights, but the sums of each context: key, count, c, k, q, s."""
    keys, n, q = (np.concatenate([p[x] for p in parts]) for x in ("keys", "n", "q"))
    contexts, times = (np.concatenate([p[x] for p in parts]) for x in ("contexts", "times"))
    many = np.concatenate([p["many"] for p in parts]).astype(np.int64)
    pairs, first, pair_of = distinct(keys)
    total = np.bincount(pair_of, n, len(pairs))
    total[total < LEAST] = 0
    of, first_context, context_of = distinct(contexts)
    kept = np.flatnonzero(total)
    owner = context_of[np.repeat(np.arange(len(contexts)), many)[first[kept]]]
    n_kept, q_kept = total[kept], q[first[kept]].astype(np.float64)
    c, k, sq, s = (np.bincount(owner, w, len(of)) for w in (n_kept, np.ones(len(kept)), q_kept, n_kept * np.log(n_kept / q_kept)))
    counts = times[first_context].astype(np.float64)
    pair_ends = np.cumsum([len(p["keys"]) for p in parts])[:-1]
    context_ends = np.cumsum([len(p["contexts"]) for p in parts])[:-1]
    found = np.split(total[pair_of].astype(np.int64), pair_ends)
    if hot:
        return [(x, np.zeros(0, np.float32)) for x in found], (of, counts, c, k, sq, s)
    weight = weights(c, k, sq, s, counts, min_gain)[context_of].astype(np.float32)
    return list(zip(found, np.split(weight, context_ends))), ()


def step(block: Block, question: Question, n: np.ndarray, weight: np.ndarray, depth: int, min_gain: float) -> None:
    """Move the tokens of a block down by the answers to its question: score them, and set what the next level asks."""
    size = len(block.local)
    doc = block.doc_of()
    token_weight = weight[question.context_of].astype(np.float64)
    node = ~np.isnan(token_weight)
    followed = block.state[question.asked] == 2
    count = np.zeros(len(question.asked), np.int64)
    count[followed] = n[question.pair_of]
    kept = node & (count > 0)
    p = np.zeros(len(question.asked))
    p[kept] = (count[kept] - DISCOUNT) / block.times[kept]
    old = np.ones(len(question.asked))
    old[followed] = block.q
    gained = np.where(kept, np.log(np.where(kept, p, 1.0)) - np.log(old), np.where(node, token_weight, 0.0))
    block.added = block.added + np.bincount(doc[question.asked], gained, len(block.lengths))
    known = np.zeros(size, np.int64)  # occurrences of the context and the token together
    known[question.asked] = count
    times, goes_on, keeps = moved(known, 1), np.zeros(size, bool), np.zeros(size, bool)
    goes_on[question.asked[node]] = True
    keeps[question.asked[kept]] = True
    goes_on &= (block.place() > depth) & (times >= LEAST)
    probability = np.zeros(size)
    probability[question.asked] = p
    both = np.flatnonzero(goes_on & keeps)
    keeps[both] = may_decide(times[both], probability[both].astype(np.float32).astype(np.float64), min_gain)
    block.state = goes_on.astype(np.uint8) + (goes_on & keeps)
    block.times, block.q = times[goes_on], probability[block.state == 2].astype(np.float32)
    block.shed()


def _begin(block: Block, counts: np.ndarray, total: int, distinct_words: int, min_gain: float) -> None:
    """Score a block by its words' counts, and set what the first level asks."""
    block.counts = counts
    p = (counts + 0.5) / (total + 0.5 * (distinct_words + 1)) if total else np.ones(len(counts))
    doc, docs = block.doc_of(), len(block.lengths)
    block.known = np.bincount(doc, counts[block.local] > 0, docs).astype(np.int64)
    block.base = np.bincount(doc, np.log10(p)[block.local], docs)
    own = counts[block.local]
    times = moved(own, 1)
    goes_on = (block.place() > 0) & (times >= LEAST)
    both = goes_on & (own >= LEAST)
    both[both] = may_decide(times[both], p[block.local[both]].astype(np.float32).astype(np.float64), min_gain)
    block.state = goes_on.astype(np.uint8) + both
    block.shed()


MANIFEST = "block bigint, path string, asks bigint, tokens bigint"


def save(folder: str, block: Block, keys: pa.Array) -> dict:
    """Write a block and the keys of its documents; its row of the manifest."""
    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    path = f"{base}/{uuid.uuid4().hex}.block"
    made = pa.record_batch({"keys": pa.array([keys.to_pylist()], pa.list_(pa.string()))} | {k: pa.array([v], pa.binary()) for k, v in block.row().items()})
    with where.open_output_stream(path) as out, pa.ipc.new_stream(out, made.schema) as stream:
        stream.write_batch(made)
    return {"block": block.number, "path": path, "asks": int(np.count_nonzero(block.state)), "tokens": len(block.local)}


def load(folder: str, number: int, path: str) -> tuple[Block, pa.Array]:
    where, _ = fs.FileSystem.from_uri(folder)
    with where.open_input_stream(path) as source, pa.ipc.open_stream(source) as stream:
        made = stream.read_next_batch()
    return Block.of_row({"block": number, **{k: made.column(k)[0].as_py() for k in FIELDS}}), made.column("keys")[0].values


def _manifest(rows: list[dict]) -> pa.Table:
    kinds = {"block": pa.int64(), "path": pa.string(), "asks": pa.int64(), "tokens": pa.int64()}
    return pa.table({k: pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()})


def blocks(texts: DataFrame, folder: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The manifest of the blocks of texts (key, copies, text). A text is never split, so a block has at least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, number = Hashes(), TaskContext.get().partitionId() << 33
        hashes: list[np.ndarray] = []
        lengths: list[int] = []
        copies: list[int] = []
        keys: list[str] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            made = save(folder, Block.new(number, np.concatenate(hashes), lengths, copies), pa.array(keys, pa.string()))
            number, size = number + 1, 0
            for x in (hashes, lengths, copies, keys):
                x.clear()
            return _manifest([made]).to_batches()[0]

        for batch in batches:
            for rows in in_blocks(list(zip(*(c.to_pylist() for c in batch.columns))), lambda r: text_length(r[2])):
                cut = [tokens(text) for _, _, text in rows]
                keys += [r[0] for r in rows]
                copies += [r[1] for r in rows]
                lengths += map(len, cut)
                hashes.append(cache.of([w for t in cut for w in t]))
                size += len(hashes[-1])
                if size >= block_tokens:
                    yield flush()
        if keys:
            yield flush()

    return materialize(texts.mapInArrow(run, MANIFEST), "blocks")


def spread(held: DataFrame) -> DataFrame:
    """Rows of a manifest dealt out evenly: a task has one block, or a few where there are many."""
    n, workers = held.count(), held.sparkSession.sparkContext.defaultParallelism
    return held.repartition(max(1, min(n, 3 * workers), -(-n // 8)))


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}


ANSWER = "block bigint, path string, bucket bigint, n binary, weight binary, sums binary"


def _answers(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["block", "path", "bucket", "n", "weight", "sums"])


def count_words(held: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Answers to all blocks' words: counts over the training documents; sums: (distinct words, tokens) of a bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block, _ = load(folder, row["block"], row["path"])
                n = np.bincount(block.local, block.copies[block.doc_of()], len(block.words)).astype(np.int64)
                order = np.argsort(block.words)
                keys, n = block.words[order], n[order]
                cut = bucket_cuts(keys, buckets)
                some = np.flatnonzero(np.diff(cut)).tolist()
                packed_n = [pack(n[cut[i] : cut[i + 1]]) for i in some]
                yield pa.RecordBatch.from_pydict({"block": [row["block"]] * len(some), "path": [row["path"]] * len(some), "bucket": some, "keys": [keys[cut[i] : cut[i + 1]].tobytes() for i in some], "n": packed_n})

    def add(table: pa.Table) -> pa.Table:
        rows = list(_rows(table))
        keys = [np.frombuffer(r["keys"], "<u8") for r in rows]
        words, _, of = distinct(np.concatenate(keys))
        total = np.bincount(of, np.concatenate([unpack(r["n"], "<i8") for r in rows]), len(words)).astype(np.int64)
        found = np.split(total[of], np.cumsum([len(k) for k in keys])[:-1])
        sums = np.array([np.count_nonzero(total), total.sum()], np.int64).tobytes()
        return _answers([(r["block"], r["path"], r["bucket"], pack(n), b"", sums if i == 0 else None) for i, (r, n) in enumerate(zip(rows, found))])

    asked = spread(held).mapInArrow(ask, "block bigint, path string, bucket bigint, keys binary, n binary")
    return materialize(asked.groupBy("bucket").applyInArrow(add, ANSWER), "word-answers")


def question_of(block: Block, depth: int, buckets: int, hot: float, total: int, distinct_words: int, turn: int = 0, turns: int = 1) -> Question:
    if depth == 1:
        block.first_level(total, distinct_words)
    return Question(block, depth, buckets, hot, turn, turns)


def count_contexts(held: DataFrame, folder: str, depth: int, buckets: int, hot: float, total: int, distinct_words: int, min_gain: float, turn: int = 0, turns: int = 1) -> DataFrame:
    """Answers to all blocks' questions of a level, as far as they are for the buckets of a turn; sums: those of a
    bucket's hot contexts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block, _ = load(folder, row["block"], row["path"])
                made = [(bucket, packed(part)) for bucket, part in question_of(block, depth, buckets, hot, total, distinct_words, turn, turns).parts()]
                yield pa.RecordBatch.from_pydict(
                    {"block": [row["block"]] * len(made), "path": [row["path"]] * len(made), "bucket": [b for b, _ in made], **{k: pa.array([p[k] for _, p in made], pa.binary()) for k in ASKS}}
                )

    def add(table: pa.Table) -> pa.Table:
        rows = list(_rows(table))
        is_hot = rows[0]["bucket"] >= buckets
        answers, sums = answer([unpacked(r) for r in rows], min_gain, is_hot)
        told_ = b"".join(np.asarray(x, "<u8" if i == 0 else "<f8").tobytes() for i, x in enumerate(sums)) if is_hot else None
        return _answers([(r["block"], r["path"], r["bucket"], pack(n), pack(w), told_ if i == 0 else None) for i, (r, (n, w)) in enumerate(zip(rows, answers))])

    asked = spread(held).mapInArrow(ask, "block bigint, path string, bucket bigint, " + ", ".join(f"{k} binary" for k in ASKS))
    return materialize(asked.groupBy("bucket").applyInArrow(add, ANSWER), "answers")


def hot_weights(answers: DataFrame, min_gain: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and weights of the hot contexts from the sums of their parts: at most N / hot of them, added up in
    Spark."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                n = len(data) // 48
                columns = [np.frombuffer(data, "<i8" if i == 0 else "<f8", n, 8 * n * i) for i in range(6)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["context", "total", "c", "k", "q", "s"])

    parts = answers.filter("sums is not null").select("sums").mapInArrow(rows_of, "context bigint, total double, c double, k double, q double, s double")
    rows = parts.groupBy("context").agg(F.max("total").alias("total"), *[F.sum(x).alias(x) for x in "ckqs"]).toArrow()
    keys = rows.column("context").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    total, c, k, q, s = (rows.column(x).to_numpy()[order] for x in ("total", "c", "k", "q", "s"))
    return keys[order], weights(c, k, q, s, total, min_gain)


def removed(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Delete the files that the batches name. A task that runs again finds some of them gone already, which is as well."""
    where, _ = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                where.delete_file(path)
            except FileNotFoundError:
                pass
        yield batch


def told(held: DataFrame, parts: list[DataFrame], folder: str, apply) -> DataFrame:
    """The manifest after apply(block, its answers by bucket); blocks that have asked nothing stay. parts: the answers."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(_rows(table), key=lambda r: r["bucket"])
        block, keys = load(folder, rows[0]["block"], rows[0]["path"])
        apply(block, rows)
        return _manifest([save(folder, block, keys)])

    moved_on = reduce(DataFrame.union, parts).select("block", "path", "bucket", "n", "weight").groupBy("block").applyInArrow(run, MANIFEST)
    after = materialize(moved_on.union(held.filter("asks = 0")), "blocks")
    discard(materialize(held.filter("asks > 0").select("path").mapInArrow(lambda batches: removed(folder, batches), "path string"), "removed"))
    for done in (held, *parts):
        discard(done)
    return after


def _joined(rows: list[dict], field: str, kind: str) -> np.ndarray:
    return np.concatenate([unpack(r[field], kind) for r in rows] or [np.zeros(0, kind)])


def grown(texts: DataFrame, min_gain: float = MIN_GAIN, block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, hot: int | None = None) -> tuple[DataFrame, str, int]:
    """The manifest of the blocks of texts (key, copies, text) once all levels are done, their folder, and the number of
    training tokens."""
    spark = texts.sparkSession
    folder = new_path(spark, "blocks")
    held = blocks(texts, folder, block_tokens)
    size = held.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    buckets = max(1, -(-size // bucket_tokens))
    answers = count_words(held, folder, buckets)
    parts = [answers]
    sums = [np.frombuffer(r.sums, "<i8") for r in answers.filter("sums is not null").select("sums").collect()]  # two numbers a bucket
    distinct_words, total = (int(sum(x[i] for x in sums)) for i in (0, 1))
    hot_from = hot or max(HOT, total / MOST_HOT)

    def begin(block: Block, rows: list[dict]) -> None:
        counts = np.empty(len(block.words), np.int64)
        counts[np.argsort(block.words)] = _joined(rows, "n", "<i8")
        _begin(block, counts, total, distinct_words, min_gain)

    held = told(held, parts, folder, begin)
    depth = 0
    while held.filter("asks > 0").limit(1).count():
        depth += 1
        turns = max(1, -(-PASSES * held.agg(F.sum("asks")).first()[0] // size))
        parts = [count_contexts(held.filter("asks > 0"), folder, depth, buckets, hot_from, total, distinct_words, min_gain, turn, turns) for turn in range(turns)]
        answers = reduce(DataFrame.union, parts)
        shared = spark.sparkContext.broadcast(hot_weights(answers, min_gain))

        def go_on(block: Block, rows: list[dict], depth: int = depth, shared=shared) -> None:
            question = question_of(block, depth, buckets, hot_from, total, distinct_words)
            weight = _joined([r for r in rows if r["bucket"] < buckets], "weight", "<f4")
            keys, values = shared.value
            at = np.minimum(np.searchsorted(keys, question.contexts), max(0, len(keys) - 1))
            of_hot = np.where(keys[at] == question.contexts, values[at], np.nan) if len(keys) else np.nan
            step(block, question, _joined(rows, "n", "<i8"), np.where(question.is_hot, of_hot, weight), depth, min_gain)

        held = told(held, parts, folder, go_on)
        shared.unpersist()
    return held, folder, total


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Scores are log10 probabilities of the text with its end. A null or empty text is the end alone. A null id is
    held out; repeated ids are rows of their own. Without training rows every probability is 1. Other columns aren't
    read. No rows give no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("out"), F.md5(text.cast("binary")).alias("key"), text.alias("text"))
    texts = rows.groupBy("key").agg(F.sum(F.when(F.col("out"), 0).otherwise(1)).alias("copies"), F.first("text").alias("text"))
    held, folder, total = grown(texts, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block, keys = load(folder, row["block"], row["path"])
                made = [keys, *(pa.array(x) for x in (block.n_tokens, block.known, block.base, block.base + block.added / math.log(10)))]
                yield pa.RecordBatch.from_arrays(made, names=["key", "n_tokens", "n_known", "base_score", "score"])

    # written, so that its size is known where it is joined
    scored = materialize(spread(held).mapInArrow(run, "key string, n_tokens bigint, n_known bigint, base_score double, score double"), "scores")
    discard(held)
    delete(docs.sparkSession, folder)  # with what lost tasks have left there
    return rows.select("id", "out", "key").join(scored, "key").select(
        F.col("id").alias(id_col), F.col("out").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
