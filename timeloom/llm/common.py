"""Helpers of the text operators: Arrow string buffers as numpy arrays, words and their hashes for a whole batch at once, tables written to cut lineage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.plans.ranges import numbered  # noqa: F401
from timeloom.plans.scratch import cut, scratch_dir  # noqa: F401

#: What separates words: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Three primes just below 2**32 and a base for each; a Rabin-Karp hash is taken modulo each of them.
PRIMES = (4294967291, 4294967279, 4294967231)
BASES = (2891336453, 1181783497, 3266489917)
#: Words of more bytes are hashed by BLAKE2b.
LONG_WORD = 64
BYTE_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def spread(df: DataFrame) -> DataFrame:
    """df, a table as read, with rows in as many partitions as the cluster has cores at least: a file of one row group would else be one task. Only few files are looked into."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.select(F.spark_partition_id()).distinct().count() >= cores:
        return df
    return df.repartition(cores)


def held_out(mod: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, divisible by mod; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(mod)) == 0, F.lit(False))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, at, data = col.buffers()
    if not len(col) or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(at, np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Parts of batches with about `most` bytes in a column and one row at least: numpy's temporaries stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(size, dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            stop = max(stop, at + 1)
            yield batch.slice(at, stop - at)
            at = stop


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of every text, and where each text's words begin among them. space: which bytes separate words."""
    inside = ~space[data]
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word. Eight bytes at a time pass through a mixing that isn't linear in them, so that no pattern of bytes cancels out; it keeps off chance, not an attacker who knows it."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64)))
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), np.dtype("<u8"), room, strides=(1,))
    todo, k = np.flatnonzero(size <= LONG_WORD), 0
    while len(todo):
        block = blocks[starts[todo] + k] & BYTE_MASKS[np.minimum(size[todo] - k, 8)]
        out[todo] = mix(out[todo] ^ block)
        k += 8
        todo = todo[size[todo] > k]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little"))
    return out


def modulo(x: np.ndarray, prime: int) -> np.ndarray:
    return x - x // np.uint64(prime) * np.uint64(prime)


def prime_powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASES[k]**i and BASES[k]**-i modulo PRIMES[k], for i up to n at least."""
    got = _powers.get(k)
    if got is None or len(got[0]) <= n:
        both = []
        for base in (BASES[k], pow(BASES[k], -1, PRIMES[k])):
            table = np.ones(1, np.uint64)
            while len(table) <= max(n, 1 << 16):
                table = np.concatenate([table, modulo(table * np.uint64(pow(base, len(table), PRIMES[k])), PRIMES[k])])
            both.append(table)
        _powers[k] = got = both[0], both[1]
    return got


def rabin_karp(values: np.ndarray, starts: np.ndarray, length: int, k: int) -> np.ndarray:
    """Of each range values[s : s + length]: sum of values[s + j] * BASES[k]**j modulo PRIMES[k], as one difference of prefix sums."""
    up, down = prime_powers(k, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(modulo(modulo(values, PRIMES[k]) * up[: len(values)], PRIMES[k]), out=sums[1:])
    return modulo(modulo(sums[starts + length] - sums[starts], PRIMES[k]) * down[starts], PRIMES[k])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1, one range after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte plane by byte plane, without planes that are all zero."""
    gaps = np.diff(values, prepend=np.uint64(0))
    planes = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([planes]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=1).reshape(planes, -1)
    gaps = np.zeros((body.shape[1], 8), np.uint8)
    gaps[:, :planes] = body.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    """Non-negative integers, byte plane by byte plane."""
    planes = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([planes]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpack_small(raw: bytes) -> np.ndarray:
    planes = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=1).reshape(planes, -1)
    out = np.zeros((body.shape[1], 8), np.uint8)
    out[:, :planes] = body.T
    return out.view("<u8").ravel().astype(np.int64)


def grown(each: int, total: int, most: int, since: int = 30 << 30) -> int:
    """each, more for an input over `since` bytes: it grows as the root of the input, `most` times at the utmost. With blocks and buckets that both grow so, what a block sends to a bucket stays well above a row's own size."""
    return int(each * min(most, max(1.0, (total / since) ** 0.5)))


def in_blocks(docs: DataFrame, total: int, block_bytes: int = 8 << 20) -> DataFrame:
    """docs with a column `block`: rows are dealt out to blocks of about block_bytes by a hash of id, text and the partition they are read in, so that a fully repeated row doesn't fill one block."""
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(max(1, -(-total // block_bytes)))))


def bucket_bits(total: int, each: int) -> int:
    """log2 of the number of buckets that get about `each` of `total` entries."""
    return max(0, int(np.ceil(np.log2(max(1, total / each)))))


def keep_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't among `dropped`; a null id only meets a null id."""
    ids = dropped.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__gone"]), "left_anti")


def packed_blocks(docs: DataFrame, total: int, block_bytes: int = 8 << 20, flush: int = 12 << 20) -> DataFrame:
    """(block, payload): the rows of docs, dealt out to blocks by a hash of id and text, as compressed Arrow streams; one row for each task and block.

    Compressed on the way, whole texts cross the shuffle at about a third of their size.
    """
    kind = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
    names = docs.columns

    def flushed(parts):
        table = pa.Table.from_batches(parts)
        block = np.asarray(table.column("block"))
        order = np.argsort(block, kind="stable")
        table, block = table.take(pa.array(order)).select(names), block[order]
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        rows = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.slice(a, b - a).combine_chunks())
            rows.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(rows, pa.binary())], schema=kind)

    def run(batches):
        parts, size = [], 0
        for part in slices(batches, most=4 << 20):
            parts.append(part)
            size += int(pc.sum(pc.binary_length(part.column("text"))).as_py() or 0)
            if size >= flush:
                yield flushed(parts)
                parts, size = [], 0
        if parts:
            yield flushed(parts)

    return in_blocks(docs, total, block_bytes).mapInArrow(run, "block long, payload binary")


def unpacked(table: pa.Table) -> pa.Table:
    """The rows of one block. Their order depends on the tasks; nothing may depend on it."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table.column("payload").to_pylist()])
