"""Token ids in binary files: blocks of ids transposed to planes, each compressed, with a chunk index.

A shard file holds the ids of a contiguous range of document ids, in ascending order:

    "WFBP1\\n"  chunk*  documents  index  footer
    chunk       the planes of at most `block` ids, each a zstandard frame: byte planes (all low bytes, then all
                next bytes ...) or bit planes (bit 0 of all ids, bit 1 ...)
    documents   an Arrow stream with id and number of ids of each document
    index       int64 rows: offset of the chunk, its ids, then the size of each plane
    footer      offset of documents, offset of index, chunks, planes, bits of a plane (1 or 8) as int64, "WFBP1\\n"

Every task writes its shard under a name of its own and reports it in a manifest row; a repeated or lost task
leaves at most a file that no manifest names. The manifest has one row for each shard, so the start of each shard
is a sum over few rows.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import in_blocks, text_length, word_level
from .shared import materialize, new_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
BLOCK = 1 << 20
SHARD_IDS = 1 << 26
MAGIC = b"WFBP1\n"


def to_planes(ids: np.ndarray, planes: int, bits: int) -> list[bytes]:
    """ids: uint32. planes: of 8 bits or of 1 bit each, lowest first."""
    if bits == 8:
        columns = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [np.ascontiguousarray(columns[:, i]).tobytes() for i in range(planes)]
    return [np.packbits((ids >> np.uint32(i) & 1).astype(np.uint8)).tobytes() for i in range(planes)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for i, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        ids |= (raw[:n] if bits == 8 else np.unpackbits(raw, count=n)).astype(np.uint32) << np.uint32(bits * i)
    return ids


class ShardWriter:
    def __init__(self, out, id_type: pa.DataType, planes: int, bits: int, block: int, level: int) -> None:
        self.out, self.id_type, self.planes, self.bits, self.block = out, id_type, planes, bits, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.at = 0
        self.index: list[list[int]] = []
        self.docs: list = []
        self.counts: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block:
            self._chunks(self.block)

    def _chunks(self, least: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        while len(ids) >= least and len(ids):
            part, ids = ids[: self.block], ids[self.block :]
            packed = [self.pack(p) for p in to_planes(part, self.planes, self.bits)]
            self.index.append([self.at, len(part), *map(len, packed)])
            for p in packed:
                self._put(p)
        self.held, self.n_held = [ids], len(ids)

    def close(self) -> None:
        self._chunks(1)
        docs_at, sink = self.at, io.BytesIO()
        batch = pa.record_batch([pa.array(self.docs, self.id_type), pa.array(self.counts, pa.int64())], names=["id", "n"])
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        self._put(sink.getvalue())
        index_at = self.at
        self._put(np.array(self.index, "<i8").tobytes())
        self._put(np.array([docs_at, index_at, len(self.index), self.planes, self.bits], "<i8").tobytes() + MAGIC)


def read_shard(source) -> tuple[pa.RecordBatch, Iterator[np.ndarray]]:
    """The documents (id, n) of a shard and its ids, chunk by chunk. source: seekable; raises ValueError if broken."""
    tail = 5 * 8 + len(MAGIC)
    end = source.seek(0, 2) or source.tell()
    source.seek(max(0, end - tail))
    footer = source.read(tail)
    if footer[-len(MAGIC) :] != MAGIC or len(footer) != tail:
        raise ValueError("not a whole shard")
    docs_at, index_at, n_chunks, planes, bits = np.frombuffer(footer[:-len(MAGIC)], "<i8").tolist()
    source.seek(docs_at)
    docs = pa.ipc.open_stream(source.read(index_at - docs_at)).read_next_batch()
    index = np.frombuffer(source.read(n_chunks * (2 + planes) * 8), "<i8").reshape(n_chunks, 2 + planes).tolist()

    def chunks() -> Iterator[np.ndarray]:
        unpack = zstandard.ZstdDecompressor().decompress
        for at, n, *sizes in index:
            source.seek(at)
            yield from_planes([unpack(source.read(s)) for s in sizes], n, bits)

    return docs, chunks()


def _largest(vocabulary: str, end_id: int | None) -> int:
    return max(word_level(vocabulary).library.get_vocab_size(with_added_tokens=True), end_id or 0)


def _width(largest: int) -> str:
    return "<u2" if largest < 1 << 16 else "<u4"


def encode(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int | None) -> DataFrame:
    """(id, place, n, ids): the ids of every text with end_id, compressed little-endian unsigned integers of two bytes,
    or four for a large vocabulary, their number, and a hash of the text that orders rows with equal ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, width = word_level(vocabulary), _width(_largest(vocabulary, end_id))
        end, squeeze = np.array([] if end_id is None else [end_id], np.uint32), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            at = 0
            for texts in in_blocks(batch.column(2).to_pylist(), text_length):
                ids = [np.concatenate((x, end)) for x in bpe.encode(texts)]
                made = [pa.array([len(x) for x in ids], pa.int64()), pa.array([squeeze(x.astype(width).tobytes()) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns[:2]), *made], names=["id", "place", "n", "ids"])
                at += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("place"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, place bigint, n bigint, ids binary")


def write(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    end_id: int | None = END_ID,
    plane_bits: int = 8,
    block: int = BLOCK,
    level: int = 3,
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Encode every text, append end_id, write shards into folder; the manifest (shard, part, file, n_docs, n_ids).

    Shards follow ascending ids, null ids first; of rows with equal ids the order is that of a hash of their
    texts. A null text is empty: only the end id. Texts are encoded once; their ids are what is written, sampled for
    ranges and sorted. Ranges take the id and the hash, so rows with one id are split, too, and a shard that has
    twice shard_ids ids goes on in another file. folder is one that executors reach through pyarrow's file systems."""
    spark = docs.sparkSession
    encoded = materialize(encode(docs, id_col, text_col, vocabulary, end_id), "encoded")
    total = encoded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_ids))
    id_type = encoded.select("id").limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        largest = _largest(vocabulary, end_id)
        planes, width = max(1, -(-largest.bit_length() // plane_bits)), _width(largest)
        where, base = fs.FileSystem.from_uri(folder)
        shard, made = TaskContext.get().partitionId(), []
        writer, out, name, expand = None, None, "", zstandard.ZstdDecompressor().decompress

        def close() -> None:
            writer.close()
            out.close()
            made.append({"shard": shard, "part": len(made), "file": name, "n_docs": len(writer.docs), "n_ids": writer.n_ids})

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    where.create_dir(base, recursive=True)
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.wfbp"
                    out = where.open_output_stream(f"{base}/{name}")
                    writer = ShardWriter(out, id_type, planes, plane_bits, block, level)
                writer.add(doc, np.frombuffer(expand(ids.as_buffer()), width).astype(np.uint32))
                if writer.n_ids >= 2 * shard_ids:
                    close()
                    writer = None
        if writer:
            close()
        if made:
            yield pa.RecordBatch.from_pylist(made)

    ranged = encoded.repartitionByRange(shards, "id", "place").sortWithinPartitions("id", "place").select("id", "ids")
    return materialize(ranged.mapInArrow(run, "shard bigint, part bigint, file string, n_docs bigint, n_ids bigint"), "manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame, id_col: str, id_type: str) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document in the shards that the manifest names.

    start: ids of all documents before it; ids_crc32: of its ids as little-endian unsigned 32-bit integers."""
    shards = sorted(manifest.collect(), key=lambda r: (r.shard, r.part))  # one row for each file
    starts = np.concatenate(([0], np.cumsum([r.n_ids for r in shards], dtype=np.int64))).tolist()
    rows = [(r.file, s) for r, s in zip(shards, starts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns)):
                with where.open_input_file(f"{base}/{name}") as source:
                    docs, chunks = read_shard(source)
                    counts = docs.column(1).to_numpy()
                    left, crcs = np.zeros(0, np.uint32), []
                    for n in counts.tolist():
                        crc = 0
                        while n:
                            if not len(left):
                                left = next(chunks)
                            part, left = left[:n], left[n:]
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                            n -= len(part)
                        crcs.append(crc)
                made = [docs.column(0), pa.array(start + np.cumsum(counts) - counts), docs.column(1), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names=[id_col, "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "file string, start bigint").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, f"`{id_col}` {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write the ids of docs into a new folder of the shared folder, and read the files back."""
    folder = new_path(docs.sparkSession, "ids")
    manifest = write(docs, folder, id_col, text_col, **options)
    return read(docs.sparkSession, folder, manifest, id_col, docs.schema[id_col].dataType.simpleString())
