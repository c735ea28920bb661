"""Token-ID output: sorted-string-table shards of documents, keyed by identifier.

A shard holds its documents in ascending key order:

    data blocks   zstd frames; each entry: varint shared key bytes, varint new key bytes, varint value bytes,
                  varint ordinal among equal keys, the new key bytes, the ids (unsigned 16 or 32 bits, little-endian)
    block index   per block: last key, offset, size, number of ids before it in the shard
    Bloom filter  ten bits a key, seven probes
    footer        56 bytes: places of index and filter, number of entries and ids, width of an id, magic

Lookup of a key asks the filter, finds the block by binary search in the index and reads that block alone.
Keys are integers as 8 big-endian bytes with the sign bit flipped (a missing key is empty and sorts first).
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.llm.common import Rows, filesystem, new_folder, shuffle_partitions, text_or_empty
from isopleth.llm.tokens import WordTokens, by_size

MAGIC = b"ISOSST01"
FOOTER = struct.Struct("<QIQIQQI4x8s")
BLOCK_BYTES = 64 << 10


def key_bytes(key: int | None) -> bytes:
    return b"" if key is None else struct.pack(">Q", (key + (1 << 63)) & ((1 << 64) - 1))


def key_value(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _probes(key: bytes, bits: int) -> Iterator[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return ((a + i * b) % bits for i in range(7))


class ShardWriter:
    """Writes one shard to an open binary sink; keys must come in ascending order."""

    def __init__(self, sink, wide: bool):
        self.sink, self.wide = sink, wide
        self.at = self.entries = self.ids = self.block_start = 0
        self.block, self.last, self.ordinal = bytearray(), None, 0
        self.index, self.keys = [], []
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        before = self.last if self.block else None
        self.ordinal = self.ordinal + 1 if key == self.last else 0
        if self.last is not None and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if before:
            most = min(len(before), len(key))
            while shared < most and before[shared] == key[shared]:
                shared += 1
        value = ids if self.wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        for n in (shared, len(key) - shared, len(value), self.ordinal):
            self.block += _varint(n)
        self.block += key[shared:]
        self.block += value
        self.last = key
        self.entries += 1
        self.ids += len(ids) // 4
        if not self.ordinal:
            self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        data = self.pack.compress(bytes(self.block))
        self.sink.write(data)
        self.index.append((self.last, self.at, len(data), self.block_start))
        self.at, self.block_start, self.block = self.at + len(data), self.ids, bytearray()

    def close(self) -> None:
        if self.block:
            self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QIQ", at, n, start) for k, at, n, start in self.index)
        bits = max(64, 10 * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom = struct.pack("<Q", bits) + bytes(bloom)
        self.sink.write(index)
        self.sink.write(bloom)
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.ids, 4 if self.wide else 2, MAGIC))


class ShardReader:
    """Reads one shard from a seekable binary file."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2) if not hasattr(source, "size") else source.size()
        at_index, n_index, at_bloom, n_bloom, self.entries, self.ids, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        data, at, self.index = self._read(at_index, n_index), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.index.append((bytes(data[at : at + n]), *struct.unpack_from("<QIQ", data, at + n)))
            at += n + 20
        bloom = self._read(at_bloom, n_bloom)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        self.unpack = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, number: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, number of ids before it in the shard, ids as 32-bit integers) of a block."""
        _, at, size, start = self.index[number]
        data, at, key = self.unpack.decompress(self._read(at, size)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            new, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            _, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + new]
            value = data[at + new : at + new + n]
            at += new + n
            yield key, start, value if self.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
            start += n // self.width

    def scan(self) -> Iterator[tuple[bytes, int, bytes]]:
        for number in range(len(self.index)):
            yield from self.block(number)

    def get(self, key: bytes) -> list[bytes]:
        """The ids of every document with this key."""
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        found = []
        for number in range(bisect.bisect_left(self.index, key, key=lambda x: x[0]), len(self.index)):
            rows = list(self.block(number))
            found += [ids for k, _, ids in rows if k == key]
            if rows[-1][0] > key:
                break
        return found


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list:
    """Encodes all documents and writes them to shards in ascending identifier order.

    Rows are dealt out by range of the identifier, so shard i holds smaller identifiers than shard i + 1; a
    missing text counts as empty and gets the end id alone; missing identifiers come first; documents with equal
    identifiers are ordered by their text. Other columns are ignored. An empty table gives no shards. A task
    writes to a name of its own and renames at the end, so a task that runs again leaves one whole shard.
    Returns one manifest row per shard: path, n_docs, n_ids, start (ids in all shards before it).
    """
    spark = docs.sparkSession
    rows = (
        docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
        .repartitionByRange(shards or shuffle_partitions(spark), "id")
        .sortWithinPartitions("id", "text")
    )

    def write(batches):
        context = TaskContext.get()
        encoder = WordTokens.load(tokenizer)
        wide, end = encoder.tokenizer.get_vocab_size() > 65536 or end_id > 65535, struct.pack("<I", end_id)
        writer = None
        for batch in batches:
            if writer is None and batch.num_rows:
                files, base = filesystem(folder)
                files.create_dir(base, recursive=True)
                name = f"{base}/shard-{context.partitionId():06d}.sst"
                draft = f"{base}/_draft-{context.partitionId()}-{context.taskAttemptId()}"
                sink = files.open_output_stream(draft)
                writer = ShardWriter(sink, wide)
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in by_size(texts):
                for key, ids in zip(keys[some], encoder.encode_all(texts[some])):
                    writer.add(key_bytes(key), ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            files.move(draft, name)
            yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "path": [name], "n_docs": [writer.entries], "n_ids": [writer.ids]})

    found = rows.mapInArrow(write, "shard long, path string, n_docs long, n_ids long").collect()
    start, manifest = 0, []
    for row in sorted(found):
        manifest.append((row.shard, row.path, row.n_docs, row.n_ids, start))
        start += row.n_ids
    return manifest


def read_shards(spark: SparkSession, manifest: list) -> DataFrame:
    """Per document of the shards: doc_id, start, ids (binary, 32-bit integers); one task per shard reads it block by block."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        rows = Rows(schema, 500)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                files, path = filesystem(path)
                with files.open_input_file(path) as source:
                    for key, start, ids in ShardReader(source).scan():
                        rows.add(key_value(key), first + start, ids)
                        if rows.full():
                            yield rows.take()
        yield rows.take()

    shards = spark.createDataFrame(manifest, "shard long, path string, n_docs long, n_ids long, start long")
    return shards.select("path", "start").repartition(max(1, len(manifest))).mapInArrow(read, "doc_id long, start long, ids binary")


def digest(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of all ids of each document read back."""
    return shards.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes all documents to shards in the shared folder, reads the shards back and digests what they hold."""
    spark = docs.sparkSession
    manifest = write_shards(docs, new_folder(spark, "sstable"), tokenizer, end_id)
    return digest(read_shards(spark, manifest))
