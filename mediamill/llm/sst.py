"""Sorted-string-table shards for token ids, and a lookup over them.

A shard holds entries in the order of their keys.  Blocks of about :data:`BLOCK` bytes
carry entries with prefix-compressed keys (shared length, own length, value length, own
bytes, value; every 16th key is whole, and the block ends with the places of those), each
followed by its CRC-32.  After the blocks come a Bloom filter over the keys, a sparse
index (the last key of each block, its place and size) and a footer of fixed length with
their places, the number of entries and a magic word.  A lookup tests the filter, finds
its block by binary search in the index, and its entry by binary search over the block's
whole keys.

Rows are range-partitioned by key, so shards follow one another.  A task writes block by
block and rolls on to a new shard at :data:`SHARD` bytes, so its memory follows neither the
partition nor the shard but a block and 16 bytes a key.  Each attempt of a task gives its
shards names of its own, and only those of the attempt that ended get into the manifest, so
a task that runs twice does no harm, and nothing is ever moved or written over.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import created, opened
from .shared import scratch, texts_of, worker_cache
from .wordbpe import ChunkEncoder, groups

BLOCK = 1 << 16
SHARD = 1 << 28
#: Runs of characters that a worker keeps: this operator keeps nothing else, and unseen words are what costs most.
CACHE = 1_200_000
RESTART = 16
BITS_A_KEY = 10
HASHES = 7
_MAGIC = b"SSTBL\0\1\n"
_FOOTER = struct.Struct("<QQQQQQI8s")


def key_of(value: int | None) -> bytes:
    """A key whose order as bytes is that of the integers, nulls first."""
    return b"\0" if value is None else b"\1" + struct.pack(">Q", (value + (1 << 63)) & ((1 << 64) - 1))


def value_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unvarint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key), xxhash.xxh64_intdigest(key, 1) | 1


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = _hashes(key)
    return [(a + i * b) % bits for i in range(HASHES)]


class Writer:
    """A shard that is written as it grows: entries are added in the order of their keys, blocks go to ``out`` when they are full."""

    def __init__(self, out) -> None:
        self.out, self.size, self.entries = out, 0, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes = array("Q")
        self.first = self.last = b""
        self._start()

    def _start(self) -> None:
        self.block, self.places, self.inside = bytearray(), [], 0

    def add(self, key: bytes, value: bytes) -> None:
        if not self.entries:
            self.first = key
        elif key < self.last:
            raise ValueError("keys must come in order")
        shared = 0
        if self.inside % RESTART == 0:
            self.places.append(len(self.block))
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += value
        self.last = key
        self.inside += 1
        self.entries += 1
        self.hashes.extend(_hashes(key))
        if len(self.block) >= BLOCK:
            self._close()

    def _write(self, body: bytes) -> None:
        self.out.write(body)
        self.size += len(body)

    def _close(self) -> None:
        if self.inside:
            self.block += struct.pack(f"<{len(self.places)}II", *self.places, len(self.places))
            self.index.append((self.last, self.size, len(self.block)))
            self._write(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))
        self._start()

    def finish(self) -> None:
        """Write the last block, the filter, the index and the footer."""
        self._close()
        bits = max(64, self.entries * BITS_A_KEY)
        filter_ = np.zeros((bits + 7) // 8, dtype=np.uint8)
        pairs = np.frombuffer(self.hashes, dtype=np.uint64).reshape(-1, 2) % np.uint64(bits)
        for i in range(HASHES):
            at = ((pairs[:, 0] + np.uint64(i) * pairs[:, 1]) % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(filter_, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        at_filter = self.size
        self._write(filter_.tobytes())
        at_index = self.size
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        self._write(index)
        self._write(_FOOTER.pack(at_filter, bits, at_index, len(index), len(self.index), self.entries, zlib.crc32(index), _MAGIC))


class Reader:
    """A shard for lookups and scans; only the footer, the index and the filter are held, blocks are read on demand."""

    def __init__(self, uri: str):
        store, path = opened(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()
        at_filter, self.bits, at_index, n_index, blocks, self.entries, crc, magic = _FOOTER.unpack(self._read(self.size - _FOOTER.size, _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is not a table")
        raw = self._read(at_index, n_index)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"{uri}: damaged index")
        self.last, self.where, at = [], [], 0
        for _ in range(blocks):
            n, at = _unvarint(raw, at)
            self.last.append(raw[at : at + n])
            self.where.append(struct.unpack_from("<QQ", raw, at + n))
            at += n + 16
        self.filter = self._read(at_filter, at_index - at_filter)

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def _block(self, i: int) -> tuple[bytes, int, list[int]]:
        at, n = self.where[i]
        raw = self._read(at, n + 4)
        body = raw[:n]
        if zlib.crc32(body) != struct.unpack("<I", raw[n:])[0]:
            raise ValueError("damaged block")
        count = struct.unpack_from("<I", body, n - 4)[0]
        end = n - 4 - 4 * count
        return body, end, list(struct.unpack_from(f"<{count}I", body, end))

    @staticmethod
    def _entries(body: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _unvarint(body, at)
            own, at = _unvarint(body, at)
            size, at = _unvarint(body, at)
            key = key[:shared] + body[at : at + own]
            at += own
            yield key, body[at : at + size]
            at += size

    def get(self, key: bytes) -> list[bytes]:
        """Values of a key, none if it isn't there, several if it was added several times."""
        if not all(self.filter[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        out: list[bytes] = []
        i = bisect.bisect_left(self.last, key)
        while i < len(self.last):
            body, end, places = self._block(i)
            whole = [next(self._entries(body, p, end))[0] for p in places]
            begin = places[max(0, bisect.bisect_left(whole, key) - 1)]
            for k, v in self._entries(body, begin, end):
                if k > key:
                    return out
                if k == key:
                    out.append(v)
            i += 1
        return out

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.where)):
            body, end, _ = self._block(i)
            yield from self._entries(body, 0, end)

    def close(self) -> None:
        self.file.close()


def _narrow(ids: bytes) -> bytes:
    """Ids as 16-bit integers after a byte 2, or as they are after a byte 4."""
    a = np.frombuffer(ids, dtype="<u4")
    return b"\2" + a.astype("<u2").tobytes() if not len(a) or int(a.max()) < 1 << 16 else b"\4" + ids


def _wide(value: bytes) -> bytes:
    return value[1:] if value[:1] == b"\4" else np.frombuffer(value, dtype="<u2", offset=1).astype("<u4").tobytes()


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", encoder: Callable[..., ChunkEncoder] = ChunkEncoder, most: int = SHARD) -> list[dict]:
    """Write shards of all texts' ids (with ``end_id`` after each) in the order of the identifiers; returns the manifest.

    The manifest has a row for each shard: its address, first and last identifier, entries,
    ids, and ids in all shards before it.  It grows with the number of shards alone, and a
    shard is full at ``most`` bytes.  Rows of one identifier come in the order of their texts'
    hashes, which is a part of the range that rows are dealt by, so one identifier (or none)
    in many rows is spread over tasks.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "sst")
    end = np.array([end_id], dtype="<u4").tobytes()
    rows = texts_of(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept = worker_cache("sst")
        if path not in kept:
            kept[path] = encoder(path, CACHE)
        coder, part, attempt = kept[path], TaskContext.get().partitionId(), uuid.uuid4().hex
        shard, done, n, at = None, [], 0, ""

        def close() -> None:
            shard.finish()
            shard.out.close()
            done.append({"part": part, "number": len(done), "path": at, "first": value_of(shard.first), "last": value_of(shard.last), "entries": shard.entries, "ids": n})

        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, texts in groups(b.column(1)):
                for key, tokens in zip(ids[lo : lo + len(texts)], coder.encode(texts), strict=True):
                    if shard is None:
                        at, out = created(folder, f"shard-{part:06d}-{len(done):06d}-{attempt}.sst")
                        shard, n = Writer(out), 0
                    tokens += end
                    n += len(tokens) // 4
                    shard.add(key_of(key), _narrow(tokens))
                    if shard.size >= most:
                        close()
                        shard = None
        if shard is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=_MANIFEST)

    manifest = [r.asDict() for r in rows.mapInArrow(run, "part int, number int, path string, first long, last long, entries long, ids long").collect()]
    manifest.sort(key=lambda r: (r["part"], r["number"]))
    start = 0
    for r in manifest:
        r["start"] = start
        start += r["ids"]
    return manifest


_MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("entries", pa.int64()), ("ids", pa.int64())])


def read_tokens(spark, manifest: list[dict], id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """``id_col, start, n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers), or ``ids_crc32`` with ``digest``, from the shards."""
    last = "ids_crc32 long" if digest else "ids binary"
    frame = spark.createDataFrame([(r["path"], r["start"]) for r in manifest], "path string, start long")
    frame = frame.repartition(max(1, len(manifest)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                table = Reader(path)
                out: list[tuple] = []
                held = 0
                for key, value in table.scan():
                    ids = _wide(value)
                    out.append((value_of(key), start, len(ids) // 4, zlib.crc32(ids) if digest else ids))
                    start += len(ids) // 4
                    held += 64 if digest else len(ids)
                    if held > 1 << 22:
                        yield _rows(out, digest)
                        out, held = [], 0
                table.close()
                if out:
                    yield _rows(out, digest)

    return frame.mapInArrow(run, f"id long, start long, n_tokens long, {last}").withColumnRenamed("id", id_col)


def _rows(out: list[tuple], digest: bool) -> pa.RecordBatch:
    a, b, c, d = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64() if digest else pa.binary())], ["id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def lookup(manifest: list[dict], key: int | None) -> list[bytes]:
    """Ids of one document, as little-endian unsigned 32-bit integers, by binary search over shards, blocks and entries."""
    wanted = key_of(key)
    lasts = [key_of(r["last"]) for r in manifest]
    out: list[bytes] = []
    for r in manifest[bisect.bisect_left(lasts, wanted) :]:
        if key_of(r["first"]) > wanted:
            break
        table = Reader(r["path"])
        out += [_wide(v) for v in table.get(wanted)]
        table.close()
    return out


def token_table(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", encoder: Callable[..., ChunkEncoder] = ChunkEncoder) -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` of every text, read back from the shards it was written to.

    A null or empty text has the end id alone; rows of one identifier follow one another in the
    order of their texts' hashes, a null identifier comes before all others, an empty
    table gives no shard and no row.  Other columns are not read.
    """
    return read_tokens(docs.sparkSession, write_tokens(docs, path, end_id, None, id_col, text_col, encoder), id_col, digest=True)


