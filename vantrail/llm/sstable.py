"""Token ids in sorted-string-table shards.

File: data blocks, sparse index, Bloom filter, footer.

- A data block holds entries in key order: varint length of the prefix shared with the key before, varint length of the
  rest, varint length of the value, the rest of the key, the value. A block shares nothing with the one before.
- The index has an entry a block: its first key, offset, length, entries and the ids in all blocks before.
- The Bloom filter has ``BITS`` bits a key and ``PROBES`` probes.
- The footer has a fixed size: offsets and lengths of index and filter, entries, ids, bytes of an id, CRC-32 of the index
  and filter, magic.

Keys are bytes whose order is the documents' order: a null is 00; an integer 01 and its value plus 2^63, big-endian; a
string 02 and its UTF-8. A value is the ids in 2 bytes each, or 4 where an id needs it.

A lookup asks the filter, searches the index by bisection, and reads one block (more only where a key repeats). Shards
are ranges of keys; each is written by one task in one go under a name of its own attempt and then renamed, so a task that runs
again replaces its shard whole.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantrail.llm.common import checkpoint_dir, checkpointed, text_slices, workers_import
from vantrail.llm.tokens import library_encoder, vocabulary

#: Fixed values of the format.
MAGIC, FOOTER, BITS, PROBES = b"VTSST001", struct.Struct("<QQQQQQII8s"), 10, 7
BLOCK_BYTES, SHARD_BYTES = 1 << 16, 1 << 26


def encode_key(key: Any) -> bytes:
    if key is None:
        return b"\x00"
    if isinstance(key, str):
        return b"\x02" + key.encode()
    return b"\x01" + struct.pack(">Q", int(key) + (1 << 63))


def decode_key(raw: bytes) -> Any:
    if raw[:1] == b"\x00":
        return None
    return raw[1:].decode() if raw[:1] == b"\x02" else struct.unpack(">Q", raw[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Builds one table in memory; keys come in order."""

    def __init__(self, id_bytes: int = 2, block_bytes: int = BLOCK_BYTES):
        self.id_bytes, self.block_bytes = id_bytes, block_bytes
        self.out, self.size, self.index, self.keys = [], 0, [], []
        self.n_ids = self.last = None
        self.entries = 0
        self.n_ids = 0
        self._open()

    def _open(self) -> None:
        self.block, self.block_size, self.block_entries, self.block_first, self.before, self.last = [], 0, 0, b"", self.n_ids, b""

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian, unsigned, 32 bits each."""
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys out of order")
        n = len(ids) // 4
        if self.id_bytes == 2:
            wide = np.frombuffer(ids, dtype="<u4")
            if n and wide.max() > 0xFFFF:
                raise ValueError("an id does not fit 2 bytes")
            ids = wide.astype("<u2").tobytes()
        shared = len(os.path.commonprefix([self.last, key])) if self.block_entries else 0
        if not self.block_entries:
            self.block_first = key
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:]
        self.block += [entry, ids]
        self.block_size += len(entry) + len(ids)
        self.block_entries += 1
        self.entries += 1
        self.n_ids += n
        self.keys.append(key)
        self.last = key
        if self.block_size >= self.block_bytes:
            self._close()

    def _close(self) -> None:
        if self.block_entries:
            self.index.append(_varint(len(self.block_first)) + self.block_first + struct.pack("<QQQQ", self.size, self.block_size, self.block_entries, self.before))
            self.out += self.block
            self.size += self.block_size
        self._open()

    def finish(self) -> bytes:
        self._close()
        bits = max(64, BITS * self.entries)
        filter_ = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _probes(key, bits):
                filter_[p >> 3] |= 1 << (p & 7)
        index, bloom = b"".join(self.index), struct.pack("<Q", bits) + bytes(filter_)
        footer = FOOTER.pack(self.size, len(index), self.size + len(index), len(bloom), self.entries, self.n_ids, self.id_bytes, zlib.crc32(index + bloom), MAGIC)
        return b"".join([*self.out, index, bloom, footer])


class Table:
    """Reads a table through ``read(offset, length)``; only footer, index and filter are held."""

    def __init__(self, read, size: int):
        self.read = read
        foot = read(size - FOOTER.size, FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.entries, self.n_ids, self.id_bytes, crc, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a table")
        index, bloom = read(index_at, index_len), read(bloom_at, bloom_len)
        if zlib.crc32(index + bloom) != crc:
            raise ValueError("a damaged table")
        self.bits, self.filter = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        self.first, self.blocks, at = [], [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.first.append(index[at : at + n])
            self.blocks.append(struct.unpack_from("<QQQQ", index, at + n))
            at += n + 32

    def may_have(self, key: bytes) -> bool:
        return self.entries > 0 and all(self.filter[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def block(self, number: int) -> Iterator[tuple[bytes, bytes]]:
        at, length, entries, _ = self.blocks[number]
        data, at, key = self.read(at, length), 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            value = data[at : at + size]
            at += size
            yield key, value if self.id_bytes == 4 else np.frombuffer(value, dtype="<u2").astype("<u4").tobytes()

    def get(self, key: Any) -> list[bytes]:
        """The ids of every document under the key."""
        raw = encode_key(key)
        if not self.may_have(raw):
            return []
        lo, hi = max(0, bisect_left(self.first, raw) - 1), bisect_right(self.first, raw)
        return [ids for b in range(lo, hi) for k, ids in self.block(b) if k == raw]

    def scan(self) -> Iterator[tuple[Any, int, bytes]]:
        """(key, ids before it in this table, ids) in order."""
        before = 0
        for b in range(len(self.blocks)):
            for k, ids in self.block(b):
                yield decode_key(k), before, ids
                before += len(ids) // 4


def _filesystem(uri: str):
    """A pyarrow filesystem and the path in it: local for file: and plain paths, else what the scheme names."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def open_table(uri: str) -> Table:
    files, path = _filesystem(uri)
    source = files.open_input_file(path)

    def read(at: int, length: int) -> bytes:
        return source.read_at(length, at)

    return Table(read, source.size())


#: Shards from which on they get larger rather than more.
SHARDS = 1024


def write_tables(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 0, id_bytes: int | None = None, docs_per_shard: int | None = None) -> DataFrame:
    """Encode all documents and write them to ``folder`` in ascending key order; the manifest, one row a file, which is
    also the order of the files: (shard, part, uri, first, last, entries, n_ids).

    A null text is empty and holds ``end_id`` only; null keys come first. Rows of one key stay side by side and may
    fill several shards, so no key makes a shard large. No rows give no files. Without ``id_bytes`` ids take 2 bytes where
    the vocabulary's largest and ``end_id`` fit, else 4. Without ``docs_per_shard`` a shard has 4,096 to 65,536 documents, the
    more the more there are.
    """
    if id_bytes is None:
        known = vocabulary(tokenizer)
        id_bytes = 2 if max(end_id, *known.vocab.values(), *known.special.values()) <= 0xFFFF else 4
    spark = docs.sparkSession
    workers_import(spark)
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count = docs.count()
    n = max(1, -(-count // (docs_per_shard or min(65_536, max(4096, count // SHARDS)))))
    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)
    ordered = docs.withColumn("salt", F.rand(7)).repartitionByRange(n, F.asc_nulls_first("key"), F.asc("salt")).sortWithinPartitions(F.asc_nulls_first("key"), F.asc("salt")).select("key", "text")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, part = library_encoder(tokenizer), TaskContext.get().partitionId(), 0
        files, path = _filesystem(folder)
        table = Writer(id_bytes)

        def flush() -> pa.RecordBatch:
            nonlocal table, part
            name = f"{shard:06d}-{part:04d}.sst"
            own = f"{path}/.{name}-{uuid.uuid4().hex}"
            with files.open_output_stream(own) as f:
                f.write(table.finish())
            files.move(own, f"{path}/{name}")
            row = pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "uri": f"{folder}/{name}", "first": table.keys[0], "last": table.keys[-1], "entries": table.entries, "n_ids": table.n_ids}], schema=_MANIFEST_ARROW)
            table, part = Writer(id_bytes), part + 1
            return row

        for batch, _, _ in text_slices(batches, 1):
            for k, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                table.add(encode_key(k), ids + end)
                if table.size >= SHARD_BYTES:
                    yield flush()
        if table.entries:
            yield flush()

    return checkpointed(ordered.mapInArrow(run, _MANIFEST))


_MANIFEST = "shard int, part int, uri string, first binary, last binary, entries long, n_ids long"
_MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("uri", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("entries", pa.int64()), ("n_ids", pa.int64())])


def read_tables(manifest: DataFrame, key_type: T.DataType | None = None, key: str = "doc_id") -> DataFrame:
    """(key, start, ids) of every document from the files, start counting the ids of all documents before it. Only the
    manifest, a row a file, is summed in order; each file is read by one task."""
    workers_import(manifest.sparkSession)
    n = max(1, manifest.count())
    before = F.sum("n_ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1))
    listed = manifest.select("uri", F.coalesce(before, F.lit(0)).alias("before")).repartition(n)
    key_type = key_type or T.LongType()
    schema = T.StructType([T.StructField(key, key_type), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow_key = pa.string() if isinstance(key_type, T.StringType) else pa.int32() if isinstance(key_type, T.IntegerType) else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple[Any, int, bytes]] = []
                held = 0
                for row in open_table(uri).scan():
                    rows.append(row)
                    held += len(row[2])
                    if held > 1 << 22:
                        yield _batch(rows, offset)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, offset)

    def _batch(rows: Iterable[tuple[Any, int, bytes]], offset: int) -> pa.RecordBatch:
        keys, starts, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, arrow_key), pa.array([offset + s for s in starts], pa.int64()), pa.array(ids, pa.binary())], names=[key, "start", "ids"])

    return listed.mapInArrow(run, schema)


def lookup(spark: SparkSession, manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ids) of the asked keys, whole numbers or text: a range join with the manifest, a row a file, finds the files, then filter, index
    and one block each answer. A key on several rows gives each; one that no file holds gives none, a null key the rows without
    one. No keys or no files give no rows."""
    workers_import(spark)
    column, kind = F.col(key), keys.schema[key].dataType
    if isinstance(kind, T.StringType):
        own = F.concat(F.unhex(F.lit("02")), column.cast("binary"))
    else:
        own = F.concat(F.unhex(F.lit("01")), F.unhex(F.lpad(F.hex(column.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")))
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.int64()
    raw = F.when(column.isNull(), F.unhex(F.lit("00"))).otherwise(own)
    asked = keys.select(raw.alias("raw")).distinct().join(manifest.select("uri", "first", "last"), (F.col("raw") >= F.col("first")) & (F.col("raw") <= F.col("last"))).select("uri", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, table = None, None
        for batch in batches:
            found = []
            for uri, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if uri != last:
                    last, table = uri, open_table(uri)
                k = decode_key(raw)
                found += [(k, ids) for ids in table.get(k)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], arrow), pa.array([i for _, i in found], pa.binary())], names=[key, "ids"])

    return asked.mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("ids", T.BinaryType())]))


def scratch_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
