"""Removal of word windows that occur more than once in the corpus, by Rabin-Karp hashes counted across all documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import bucket_bits, grown, in_blocks, mix, pack, rabin_karp, ragged, slices, text_bytes, unpack, utf8, word_hashes, words

WINDOW = 35
BITS_KIND = "bucket long, block long, repeats binary"


def window_hashes(h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window that lies in one text (at: where each text's words begin), its Rabin-Karp hash modulo two primes as 64 bits, and modulo a third as 32."""
    count = np.maximum(0, np.diff(at) - window + 1)
    starts = ragged(at[:-1], count)
    both = rabin_karp(h, starts, window, 0) << np.uint64(32) | rabin_karp(h, starts, window, 1)
    return starts, mix(both), rabin_karp(h, starts, window, 2).astype("<u4")


def _block_hashes(table: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    values, checks = [np.zeros(0, np.uint64)], [np.zeros(0, "<u4")]
    for part in slices([table]):
        data, off = utf8(part.column("text"))
        starts, ends, at = words(data, off)
        _, value, check = window_hashes(word_hashes(data, starts, ends), at, window)
        values.append(value), checks.append(check)
    return np.concatenate(values), np.concatenate(checks)


def distinct(values: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (value, check) as two arrays, the place of each row among them, and how many rows each has."""
    order = np.argsort(values, kind="stable")
    v, c = values[order], checks[order]
    if ((v[1:] == v[:-1]) & (c[1:] != c[:-1])).any():  # one value with two checks
        order = np.lexsort((checks, values))
        v, c = values[order], checks[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
    first = np.flatnonzero(new)
    inverse = np.empty(len(v), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return v[first], c[first], inverse, np.diff(np.append(first, len(v)))


def _buckets(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)


def _send(window: int, bits: int):
    """Of one block: its distinct hashes, sorted, cut by their leading bits into one row for each bucket, with a mark at those that the block has twice."""
    kind = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("checks", pa.binary()), ("twice", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        values, checks, _, count = distinct(*_block_hashes(table, window))
        names, first = np.unique(_buckets(values, bits), return_index=True)
        block, rows = table.column("block")[0].as_py(), []
        for b, i, j in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(values)], strict=True):
            rows.append((b, block, pack(values[i:j]), checks[i:j].tobytes(), np.packbits(count[i:j] > 1).tobytes()))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kind.types, strict=True)], schema=kind)

    return run


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block's row, which of its hashes occur more than once over all blocks."""
    lists = [unpack(x) for x in table.column("hashes").to_pylist()]
    checks = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("checks").to_pylist()])
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)) for x, v in zip(table.column("twice").to_pylist(), lists, strict=True)])
    ends = np.cumsum([len(v) for v in lists])[:-1]
    _, _, inverse, count = distinct(np.concatenate(lists), checks)
    often = (count > 1) | (np.bincount(inverse, twice, len(count)) > 0)
    parts = np.split(often[inverse], ends)
    return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "repeats": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})


def covered_words(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Windows from starts, merged: which of the words they cover."""
    step = np.zeros(n_words + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return np.cumsum(step[:-1]) > 0


def kept_bytes(data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, gone: np.ndarray) -> list[bytes]:
    """Each text's kept words joined by one space."""
    kept = np.flatnonzero(~gone)
    s, e = starts[kept], ends[kept]
    last = np.zeros(len(data) + 1, bool)
    last[off] = True
    inner = ~last[e]  # after these, a separator of the same text follows: it becomes the space
    take = np.zeros(len(data) + 1, np.int8)
    take[s] += 1
    np.add.at(take, e + inner, -1)
    copy = data.copy()
    copy[e[inner]] = 32
    picked = np.cumsum(take[:-1], dtype=np.int8) > 0
    edges = np.concatenate([[0], np.cumsum(picked)])[off]
    out = copy[picked].tobytes()
    return [out[a:b].removesuffix(b" ") for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _finish(window: int, with_text: bool):
    names = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32())])))]
    kind = pa.schema(names + [("kept_text", pa.string())] * with_text)

    def run(table: pa.Table, bits: pa.Table) -> pa.Table:
        if not table.num_rows:
            return kind.empty_table()
        values, _, inverse, _ = distinct(*_block_hashes(table, window))
        order = np.argsort(np.asarray(bits.column("bucket")))
        packed = bits.column("repeats").to_pylist()
        flags, used = np.zeros(len(values), bool), 0
        shift = bits.column("bits")[0].as_py() if bits.num_rows else 0
        _, sizes = np.unique(_buckets(values, shift), return_counts=True)
        for i, n in zip(order, sizes.tolist(), strict=True):
            if len(packed[i]) != -(-n // 8):
                raise RuntimeError("rows were dealt out otherwise when they were read again")
            flags[used : used + n] = np.unpackbits(np.frombuffer(packed[i], np.uint8), count=n)
            used += n
        repeated, seen = flags[inverse], 0
        cols = [[] for _ in kind]
        for part in slices([table]):
            data, off = utf8(part.column("text"))
            starts, ends, at = words(data, off)
            count = np.maximum(0, np.diff(at) - window + 1)
            first = ragged(at[:-1], count)
            gone = covered_words(len(starts), first[repeated[seen : seen + len(first)]], window)
            seen += len(first)
            sums = np.concatenate([[0], np.cumsum(gone)])
            texts = kept_bytes(data, off, starts, ends, at, gone)
            cols[0] += part.column("doc_id").to_pylist()
            cols[1] += np.diff(at).tolist()
            cols[2] += (sums[at[1:]] - sums[at[:-1]]).tolist()
            cols[3] += [hashlib.sha256(x).hexdigest() for x in texts]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if sums[b] == sums[a]:
                    cols[4].append([])
                    continue
                own = np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)
                cols[4].append([{"first_word": int(x), "last_word": int(y)} for x, y in zip(np.flatnonzero(own == 1), np.flatnonzero(own == -1) - 1, strict=True)])
            if with_text:
                cols[5] += [x.decode() for x in texts]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kind.types, strict=True)], schema=kind)

    return run


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, with_text: bool = False, block_bytes: int = 8 << 20, bucket_entries: int = 1_000_000) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_removed, kept_sha256, removed (maximal intervals of words, both ends included), kept_text if asked for.

    A window is `window` consecutive words of one text; each word covered by a window whose words also start anywhere else goes. Blocks of documents send every distinct
    hash once to the bucket of its leading bits; a bucket answers with one bit for each hash, and the block applies the answers. A window that stands in a third of all
    texts is one hash of each block. Windows count as equal if their hashes agree modulo three primes of 32 bits: over n windows the chance of any false match is about
    n**2 / 2**97 (0.002 for 100 TB), besides that of two words of one 64-bit hash, about w**2 / 2**65 over w different words.

    Null is an empty text: no words, nothing removed, the digest of nothing. A row that stands twice is two texts, whose windows repeat each other. A text of fewer words
    than the window keeps all. A text of any length lies in one block as a whole. An empty table gives no rows; other columns of docs, whatever their names, are ignored.
    """
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = text_bytes(small)
    bits = bucket_bits(total // 6, grown(bucket_entries, total, 8))
    blocks = in_blocks(small, total, grown(block_bytes, total, 16))
    sent = blocks.groupBy("block").applyInArrow(_send(window, bits), "bucket long, block long, hashes binary, checks binary, twice binary")
    back = sent.groupBy("bucket").applyInArrow(_count, BITS_KIND).withColumn("bits", F.lit(bits))
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first_word:int,last_word:int>>" + ", kept_text string" * with_text
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_finish(window, with_text), kind)
