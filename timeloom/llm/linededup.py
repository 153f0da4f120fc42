"""Reversible line dedup: sharded cuckoo filters of repeated line keys, backed by exact tables of how many documents hold each key and which is the largest."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import LOWER, SPACE, bucket_bits, cut, grown, mix, pack, pack_small, slices, text_bytes, unpack, unpack_small, utf8

#: Keys of fewer code points are never dropped; keys in at least so many documents are.
MIN_POINTS, MIN_DOCS = 20, 3
#: Slots of a bucket, and the share of slots that may be taken.
SLOTS, LOAD = 4, 0.85
NO_ID = np.iinfo(np.int64).min


class CuckooFilter:
    """16-bit fingerprints of 64-bit keys in buckets of four, each in one of two buckets; whole arrays of keys go in and out at once. A key that finds no place waits in a stash."""

    def __init__(self, table: np.ndarray, stash: np.ndarray):
        self.table, self.stash = table, stash

    @classmethod
    def of(cls, keys: np.ndarray, room: int = 0) -> CuckooFilter:
        """A filter of distinct keys with room for as many as `room` at least."""
        out = cls(np.zeros((1 << max(0, int(np.ceil(np.log2(max(1, len(keys), room) / (SLOTS * LOAD))))), SLOTS), np.uint16), np.zeros(0, np.uint64))
        out.insert(keys)
        return out

    @property
    def full(self) -> bool:
        return np.count_nonzero(self.table) + len(self.stash) > self.table.size * LOAD

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        return (keys % np.uint64(65535) + np.uint64(1)).astype(np.uint16), (keys >> np.uint64(16) & mask).astype(np.int64)

    def _other(self, prints: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        return buckets ^ (mix(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _fill(self, prints: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of their buckets; true where there was none."""
        order = np.argsort(buckets, kind="stable")
        b = buckets[order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        rank = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
        taken = self.table[b] != 0
        free = SLOTS - taken.sum(1)
        slot = np.argsort(taken, axis=1, kind="stable")
        ok = rank < free
        self.table[b[ok], slot[ok, rank[ok]]] = prints[order][ok]
        left = np.zeros(len(b), bool)
        left[order[~ok]] = True
        return left

    def insert(self, keys: np.ndarray, rounds: int = 200) -> None:
        """Keys that aren't in yet. What finds both buckets full pushes out a fingerprint, which then tries its other bucket."""
        prints, buckets = self._place(keys)
        whose = np.arange(len(keys))
        left = self._fill(prints, buckets)
        prints, buckets, whose = prints[left], self._other(prints, buckets)[left], whose[left]
        for k in range(rounds):
            left = self._fill(prints, buckets)
            prints, buckets = prints[left], buckets[left]
            if not len(prints):
                return
            _, one = np.unique(buckets, return_index=True)  # of a bucket, one fingerprint is pushed out a round
            b, slot = buckets[one], (one + k) % SLOTS
            out = self.table[b, slot].copy()
            self.table[b, slot] = prints[one]
            prints[one] = out
            buckets[one] = self._other(out, b)
        self.stash = np.concatenate([self.stash, self._stashed(prints, buckets)])

    def _stashed(self, prints: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        return prints.astype(np.uint64) << np.uint64(48) | np.minimum(buckets, self._other(prints, buckets)).astype(np.uint64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that is in, and for about 8 of 65,536 others."""
        prints, buckets = self._place(keys)
        found = (self.table[buckets] == prints[:, None]).any(1) | (self.table[self._other(prints, buckets)] == prints[:, None]).any(1)
        return found | np.isin(self._stashed(prints, buckets), self.stash) if len(self.stash) else found

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one fingerprint of each key; only keys that are in may be given."""
        prints, buckets = self._place(keys)
        while len(prints):
            where = np.where((self.table[buckets] == prints[:, None]).any(1), buckets, self._other(prints, buckets))
            hit = self.table[where] == prints[:, None]
            slot = np.argmax(hit, axis=1)
            inside = hit.any(1)
            _, one = np.unique(np.where(inside, where * SLOTS + slot, -1 - np.arange(len(where))), return_index=True)  # of equal fingerprints, one slot a round
            done = np.zeros(len(prints), bool)
            done[one] = True
            now = done & inside
            self.table[where[now], slot[now]] = 0
            for s in self._stashed(prints[done & ~inside], buckets[done & ~inside]):
                at = np.flatnonzero(self.stash == s)
                if not len(at):
                    raise ValueError("a key that isn't in the filter can't be deleted")
                self.stash = np.delete(self.stash, at[0])
            prints, buckets = prints[~done], buckets[~done]


# Lines and their keys


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line of every text, in order; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    owner = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, "right") - 1])
    starts = np.concatenate([off[:-1], breaks + 1])
    order = np.lexsort((starts, owner))
    owner, starts = owner[order], starts[order]
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    return starts, np.where(last, off[owner + 1], np.append(starts[1:], 0) - 1), owner


def line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lines have a key of `least` code points or more (blanks at both ends stripped, A-Z lowered), and 128 bits of BLAKE2b of each of these keys."""
    solid = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = np.flatnonzero(b > a)
    first, last = solid[a[full]], solid[b[full] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = points[last] - points[first] >= least
    low = LOWER[data].tobytes()
    raw = b"".join(hashlib.blake2b(low[i:j], digest_size=16).digest() for i, j in zip(first[long].tolist(), last[long].tolist(), strict=True))
    return full[long], np.frombuffer(raw, "<u8").reshape(-1, 2)


# Tables of keys: parallel arrays sorted by both halves of the key


def combine(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row a key: its counts summed, the largest top."""
    order = np.lexsort((lo, hi))
    hi, lo, n, top = hi[order], lo[order], n[order], top[order]
    new = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))) if len(hi) else np.zeros(0, np.int64)
    return (hi[new], lo[new], np.add.reduceat(n, new), np.maximum.reduceat(top, new)) if len(new) else (hi, lo, n, top)


def find(hi: np.ndarray, lo: np.ndarray, in_hi: np.ndarray, in_lo: np.ndarray) -> np.ndarray:
    """Place of each key in a table, or -1."""
    if not len(in_hi) or not len(hi):
        return np.full(len(hi), -1, np.int64)
    at = np.minimum(np.searchsorted(in_hi, hi), len(in_hi) - 1)
    for _ in range(64):  # keys that share the first half stand side by side
        on = (in_hi[at] == hi) & (in_lo[at] < lo)
        if not on.any():
            break
        at = np.minimum(at + on, len(in_hi) - 1)
    return np.where((in_hi[at] == hi) & (in_lo[at] == lo), at, -1)


def pack_ids(ids: np.ndarray) -> bytes:
    base = ids.min() if len(ids) else np.int64(0)
    return np.int64(base).tobytes() + pack_small(ids.view(np.uint64) - np.int64(base).view(np.uint64))


def unpack_ids(raw: bytes) -> np.ndarray:
    return unpack_small(raw[8:]) + np.frombuffer(raw, "<i8", 1)[0]


TABLE = [("hi", pa.binary()), ("lo", pa.binary()), ("n", pa.binary()), ("top", pa.binary())]
REFS = pa.schema([("shard", pa.int64()), ("slab", pa.int64()), *TABLE])
REFS_SQL = "shard long, slab long, hi binary, lo binary, n binary, top binary"
SHARD = pa.schema([("shard", pa.int64()), *TABLE, ("filter", pa.binary()), ("stash", pa.binary())])
SHARD_SQL = "shard long, hi binary, lo binary, n binary, top binary, filter binary, stash binary"


def packed(hi, lo, n, top) -> tuple[bytes, bytes, bytes, bytes]:
    return pack(hi), lo.astype("<u8").tobytes(), pack_small(n), pack_ids(top)


def unpacked_table(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return unpack(row["hi"]), np.frombuffer(row["lo"], "<u8"), unpack_small(row["n"]), unpack_ids(row["top"])


def joined(tables: list) -> tuple:
    empty = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return combine(*[np.concatenate(c) for c in zip(*tables, strict=True)]) if tables else empty


def _ids(table) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)


# Slabs: runs of whole documents as they are read, written once


def _slabs(most: int):
    kind = pa.schema([("payload", pa.binary())])

    def run(batches):
        def flushed(parts):
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(parts).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=kind)

        parts, size = [], 0
        for part in slices(batches, most=1 << 20):
            parts.append(part)
            size += part.nbytes
            if size >= most:
                yield flushed(parts)
                parts, size = [], 0
        if parts:
            yield flushed(parts)

    return run


def opened(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def _single(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _references(bits: int, least: int):
    """A slab's row for each shard: its keys, in how many of its documents they are, and the largest of these."""

    def run(batches):
        for row in _single(batches):
            parts = []
            for part in slices(opened(row["payload"]).to_batches()):
                data, off = utf8(part.column("text"))
                starts, ends, owner = lines(data, off)
                at, key = line_keys(data, starts, ends, least)
                doc = owner[at]
                order = np.lexsort((doc, key[:, 1], key[:, 0]))
                key, doc = key[order], doc[order]
                once = np.append(True, (key[1:] != key[:-1]).any(1) | (doc[1:] != doc[:-1]))[: len(doc)]
                parts.append((key[once, 0], key[once, 1], np.ones(once.sum(), np.int64), _ids(part)[doc[once]]))
            hi, lo, n, top = joined(parts)
            if not len(hi):
                continue
            shards = (hi >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hi), np.int64)
            names, first = np.unique(shards, return_index=True)
            rows = [(s, row["slab"], *packed(hi[i:j], lo[i:j], n[i:j], top[i:j])) for s, i, j in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(hi)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), REFS.types, strict=True)], schema=REFS)

    return run


def _update(min_docs: int):
    """A shard after added and removed rows of references. Counts go up and down exactly; where the largest document of a key may have gone, it is found again among what remains."""

    def run(old: pa.Table, delta: pa.Table) -> pa.Table:
        state = [unpacked_table(r) for r in old.to_pylist()]
        hi, lo, n, top = joined(state)
        some = (old if old.num_rows else delta).column("shard")[0].as_py()
        sketch = [CuckooFilter(np.frombuffer(r["filter"], np.uint16).reshape(-1, SLOTS).copy(), np.frombuffer(r["stash"], np.uint64).copy()) for r in old.to_pylist()]
        was = n >= min_docs
        parts = {s: joined([unpacked_table(r) for r in delta.to_pylist() if r["sign"] == s]) for s in (1, -1, 0)}
        gone, rest = parts[-1], parts[0]
        new = joined([(hi, lo, n, top), parts[1]])
        at = find(gone[0], gone[1], new[0], new[1])
        if (at < 0).any():
            raise RuntimeError("references are removed that were never added")
        new[2][at] -= gone[2]
        if len(at):
            back = find(new[0][at], new[1][at], rest[0], rest[1])
            new[3][at] = np.where(back < 0, NO_ID, rest[3][np.maximum(back, 0)] if len(rest[3]) else NO_ID)
        new = tuple(c[new[2] > 0] for c in new)
        now = new[2] >= min_docs
        before, after = (hi[was], lo[was]), (new[0][now], new[1][now])
        more, less = find(*after, *before) < 0, find(*before, *after) < 0
        if sketch:
            cuckoo = sketch[0]
            cuckoo.delete(before[1][less])
            cuckoo.insert(after[1][more])
        if not sketch or cuckoo.full:
            cuckoo = CuckooFilter.of(after[1], 2 * len(after[1]) if sketch else 0)
        row = some, *packed(*new), cuckoo.table.tobytes(), cuckoo.stash.tobytes()
        return pa.table([pa.array([x], t) for x, t in zip(row, SHARD.types, strict=True)], schema=SHARD)

    return run


ANSWERS = pa.schema([("slab", pa.int64()), *TABLE])
ANSWERS_SQL = "slab long, hi binary, lo binary, n binary, top binary"


def _answer(min_docs: int):
    """For each slab's row of references, the keys that are repeated, with the largest document of all. The filter is asked first, the exact table about its hits."""

    def run(state: pa.Table, refs: pa.Table) -> pa.Table:
        rows = []
        for s in state.to_pylist():
            hi, lo, n, top = unpacked_table(s)
            often = n >= min_docs
            hi, lo, n, top = hi[often], lo[often], n[often], top[often]
            cuckoo = CuckooFilter(np.frombuffer(s["filter"], np.uint16).reshape(-1, SLOTS), np.frombuffer(s["stash"], np.uint64))
            for i in range(refs.num_rows):
                r = refs.slice(i, 1).to_pylist()[0]
                own_hi, own_lo = unpack(r["hi"]), np.frombuffer(r["lo"], "<u8")
                maybe = np.flatnonzero(cuckoo.contains(own_lo))
                at = find(own_hi[maybe], own_lo[maybe], hi, lo)
                at = at[at >= 0]
                if len(at):
                    rows.append((r["slab"], *packed(hi[at], lo[at], n[at], top[at])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, ANSWERS.types, strict=True)], schema=ANSWERS)

    return run


def _finish(least: int, with_text: bool):
    kind = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text)

    def run(slab: pa.Table, answers: pa.Table) -> pa.Table:
        hi, lo, _, top = joined([unpacked_table(r) for r in answers.to_pylist()])
        cols = [[] for _ in kind]
        for payload in slab.column("payload").to_pylist():
            for part in slices(opened(payload).to_batches()):
                data, off = utf8(part.column("text"))
                starts, ends, owner = lines(data, off)
                gone = np.zeros(len(starts), bool)
                if len(hi):
                    at, key = line_keys(data, starts, ends, least)
                    place = find(key[:, 0].copy(), key[:, 1].copy(), hi, lo)
                    gone[at] = (place >= 0) & (_ids(part)[owner[at]] < top[np.maximum(place, 0)])
                lost = np.bincount(owner, gone, len(off) - 1).astype(np.int64)
                first = np.searchsorted(owner, np.arange(len(off)))
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                for i in np.flatnonzero(lost).tolist():
                    kept = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
                    texts[i] = b"\n".join(raw[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True))
                for c, x in zip(cols, (part.column("doc_id").to_pylist(), np.diff(first).tolist(), lost.tolist(), [hashlib.sha256(t).hexdigest() for t in texts], [t.decode() for t in texts] if with_text else []), strict=False):
                    c += x
        return pa.table([pa.array(c, t) for c, t in zip(cols, kind.types, strict=True)], schema=kind)

    return run


def _without(batches):
    """Slabs without the documents that go."""
    for row in _single(batches):
        table = opened(row["payload"])
        gone = set(row["gone"])
        keep = [i for i, x in enumerate(table.column("doc_id").to_pylist()) if x not in gone]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table.take(pa.array(keep, pa.int64())))
        yield pa.RecordBatch.from_pydict({"slab": [row["slab"]], "payload": [sink.getvalue().to_pybytes()]}, schema=pa.schema([("slab", pa.int64()), ("payload", pa.binary())]))


def _slab_ids(batches):
    for row in _single(batches):
        ids = opened(row["payload"]).column("doc_id").combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array([row["slab"]] * len(ids), pa.int64()), ids], schema=pa.schema([("slab", pa.int64()), ("doc_id", pa.int64())]))


@dataclass
class LineIndex:
    """slabs: the documents, in runs; refs: each slab's keys, counts and largest documents by shard; shards: the sums of refs, with the cuckoo filter of the keys in
    min_docs documents or more. All are written tables; insert() and delete() give a new index and leave this one as it is."""

    slabs: DataFrame
    refs: DataFrame
    shards: DataFrame
    bits: int
    next_slab: int
    min_docs: int
    least: int
    slab_bytes: int

    @classmethod
    def of(cls, docs: DataFrame, min_docs: int = MIN_DOCS, least: int = MIN_POINTS, slab_bytes: int = 8 << 20, shard_bytes: int = 64 << 20) -> LineIndex:
        """An index of docs (doc_id, text). The number of shards is set here: one for about shard_bytes of text, or more for an input over 30 GB."""
        total = text_bytes(docs)
        spark = docs.sparkSession
        empty = lambda kind: spark.createDataFrame([], kind)
        bits = bucket_bits(total, grown(shard_bytes, total, 8))
        start = cls(empty("slab long, payload binary"), empty(REFS_SQL), empty(SHARD_SQL), bits, 0, min_docs, least, grown(slab_bytes, total, 16))
        return start.insert(docs)

    def _references(self, slabs: DataFrame) -> DataFrame:
        return slabs.mapInArrow(_references(self.bits, self.least), REFS_SQL)

    def _moved(self, slabs: DataFrame, refs: DataFrame, delta: DataFrame, next_slab: int) -> LineIndex:
        touched = delta.select("shard").distinct()
        changed = self.shards.groupBy("shard").cogroup(delta.groupBy("shard")).applyInArrow(_update(self.min_docs), SHARD_SQL) if self.next_slab == 0 else (
            self.shards.join(touched, "shard", "left_semi").groupBy("shard").cogroup(delta.groupBy("shard")).applyInArrow(_update(self.min_docs), SHARD_SQL).unionByName(self.shards.join(touched, "shard", "left_anti"))
        )
        return LineIndex(slabs, refs, cut(changed), self.bits, next_slab, self.min_docs, self.least, self.slab_bytes)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with more documents; a doc_id that is in already is one more document."""
        small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        new = cut(small.mapInArrow(_slabs(self.slab_bytes), "payload binary").withColumn("slab", F.monotonically_increasing_id() + self.next_slab).select("slab", "payload"))
        refs = cut(self._references(new))
        last = new.agg(F.max("slab")).first()[0]
        first = self.next_slab == 0
        return self._moved(new if first else self.slabs.unionByName(new), refs if first else self.refs.unionByName(refs), refs.withColumn("sign", F.lit(1)), self.next_slab if last is None else last + 1)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without all documents of the given doc_id (null ones stay). Slabs that hold none of them aren't touched."""
        ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        hit = cut(self.slabs.mapInArrow(_slab_ids, "slab long, doc_id long").join(ids, "doc_id").groupBy("slab").agg(F.collect_set("doc_id").alias("gone")))
        left = cut(self.slabs.join(hit, "slab").select("slab", "payload", "gone").mapInArrow(_without, "slab long, payload binary"))
        again = cut(self._references(left))
        dead = self.refs.join(hit.select("slab"), "slab", "left_semi").select(self.refs.columns)
        stay = self.refs.join(hit.select("slab"), "slab", "left_anti").select(self.refs.columns)
        refs = cut(stay.unionByName(again))
        shards = dead.select("shard").distinct()
        delta = dead.withColumn("sign", F.lit(-1)).unionByName(again.withColumn("sign", F.lit(1))).unionByName(refs.join(shards, "shard", "left_semi").select(refs.columns).withColumn("sign", F.lit(0)))
        slabs = cut(self.slabs.join(hit.select("slab"), "slab", "left_anti").select("slab", "payload").unionByName(left))
        return self._moved(slabs, refs, delta, self.next_slab)

    def result(self, with_text: bool = False) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_sha256, kept_text if asked for, of every document that is in."""
        answers = self.shards.groupBy("shard").cogroup(self.refs.groupBy("shard")).applyInArrow(_answer(self.min_docs), ANSWERS_SQL)
        kind = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
        return self.slabs.groupBy("slab").cogroup(answers.groupBy("slab")).applyInArrow(_finish(self.least, with_text), kind)


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, least: int = MIN_POINTS, with_text: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_lines, n_dropped, kept_sha256, kept_text if asked for.

    A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lowered. Keys of at least `least` code points that stand in at least min_docs documents lose all
    their lines except in the largest doc_id that holds them. Keys are told apart by 128 bits of BLAKE2b.

    Null and empty texts are one empty line. A row is a document: one that stands twice counts twice, and rows that share the largest doc_id all keep the line. A null
    doc_id is less than any other. A line or text of any length is taken whole. An empty table gives no rows; other columns are ignored. A line that stands in a third
    of all documents is one entry of each slab of documents.
    """
    return LineIndex.of(docs, min_docs, least).result(with_text)
