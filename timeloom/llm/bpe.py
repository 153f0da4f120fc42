"""Byte-level BPE: texts to token ids and back, by rank files, on padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import ragged, slices

#: Rows of up to so many symbols share a matrix; wider ones are merged by themselves.
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256)
#: Distinct pieces that a Python worker keeps between batches.
CACHE_PIECES = 400_000
NONE = np.int32(2**31 - 1)


class Ranks:
    """A rank file as arrays: the pair table (open addressing, looked up for whole matrices) and the bytes and decimal digits of every token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_id < 0).any():
            raise ValueError("every byte must be a token")
        self.bytes, self.byte_start, self.byte_len = self._table(tokens)
        self.digits, self.digit_start, self.digit_len = self._table([b"%d " % i for i in range(self.size)])
        # Any two tokens whose bytes make a token are a pair, whichever merge made it first.
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
        keys = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        self.shift = np.uint64(64 - int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.made = np.full(len(self.keys), NONE, np.int32)
        self.probes = 0
        pending = np.arange(len(keys))
        while len(pending):
            slot = (self._slot(keys[pending]) + self.probes) & (len(self.keys) - 1)
            free = self.keys[slot] == -1
            first = np.unique(slot[free], return_index=True)[1]
            win = pending[free][first]
            self.keys[slot[free][first]], self.made[slot[free][first]] = keys[win], np.array(made, np.int32)[win]
            pending = np.setdiff1d(pending, win, assume_unique=True)
            self.probes += 1

    @staticmethod
    def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to; NONE if it doesn't or a side is -1."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.made[slot], NONE)
        todo = np.flatnonzero(((self.keys[slot] != keys) & (self.keys[slot] != -1) & (keys != -2)).ravel())
        flat, key, at = out.ravel(), keys.ravel()[todo], slot.ravel()[todo]
        for _ in range(self.probes):
            if not len(todo):
                break
            at = (at + 1) & (len(self.keys) - 1)
            hit = self.keys[at] == key
            flat[todo[hit]] = self.made[at[hit]]
            on = ~hit & (self.keys[at] != -1)
            todo, key, at = todo[on], key[on], at[on]
        return flat.reshape(keys.shape)

    def merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """ids: a row for each piece, -1 behind its end. In each round every row merges its leftmost pair of least rank; the rest moves up; done rows leave."""
        done = np.full_like(ids, -1)
        rows = np.arange(len(ids))
        while len(rows) and ids.shape[1] > 1:
            rank = self.pairs(ids[:, :-1], ids[:, 1:])
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(ids)), at]
            over = least == NONE
            if over.any():
                done[rows[over], : ids.shape[1]] = ids[over]
                ids, rows, at, least = ids[~over], rows[~over], at[~over], least[~over]
            place = np.arange(ids.shape[1] - 1)[None, :]
            moved = np.where(place > at[:, None], ids[:, 1:], ids[:, :-1])
            moved[np.arange(len(ids)), at] = least
            ids = moved
            if len(ids):
                ids = ids[:, : max(1, int((ids >= 0).sum(axis=1).max()))]
        done[rows, : ids.shape[1]] = ids
        return done

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece. As merge_rows, but all places of the least pair merge at once where that can't change the result: no pair with the new token ranks lower."""
        while len(ids) > 1:
            rank = self.pairs(ids[:-1], ids[1:])
            least = rank.min()
            if least == NONE:
                break
            at = np.flatnonzero(rank == least)
            near = np.flatnonzero(np.diff(at) == 1)
            if len(near):  # overlapping places: every second one of each run, from its left end
                run = np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
                begin = np.concatenate([[0], np.flatnonzero(np.diff(at) > 1) + 1])
                at = at[(np.arange(len(at)) - begin[run]) % 2 == 0]
            if len(at) > 1:
                new = np.full(len(at), least, np.int32)
                sides = [ids[at[at > 0] - 1], new[at > 0]], [new[at + 2 < len(ids)], ids[at[at + 2 < len(ids)] + 2]], [new[:1], new[:1]]
                if any(len(a) and self.pairs(a, b).min() <= least for a, b in sides):
                    at = at[:1]
            ids = ids.copy()
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
        return ids

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has."""
        size = np.array([len(p) for p in pieces], np.int64)
        flat = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        begin = np.cumsum(size) - size
        count, found = np.zeros(len(pieces), np.int64), {}
        low = 0
        for width in (1, *WIDTHS):
            own = np.flatnonzero((size > low) & (size <= width))
            low = width
            for part in np.array_split(own, max(1, -(-len(own) * width // (1 << 18)))) if len(own) else []:
                ids = np.full((len(part), width), -1, np.int32)
                ids[np.repeat(np.arange(len(part)), size[part]), ragged(np.zeros(len(part), np.int64), size[part])] = flat[ragged(begin[part], size[part])]
                ids = self.merge_rows(ids)
                count[part] = (ids >= 0).sum(axis=1)
                found[int(part[0])] = part, ids[ids >= 0]
        for i in np.flatnonzero(size > low).tolist():
            ids = self.merge_long(flat[begin[i] : begin[i] + size[i]])
            count[i] = len(ids)
            found[i] = np.array([i]), ids
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for part, ids in found.values():
            out[ragged(start[part], count[part])] = ids
        return out, count


class Encoder:
    """Splits texts by the pattern and encodes each distinct piece once; the pieces are kept for later batches, within a bound."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = Ranks(path), regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        if len(self.index) > CACHE_PIECES:
            self.forget()
        split = [self.pattern.findall(t) for t in texts]
        n = list(map(len, split))
        flat = list(chain.from_iterable(split))
        piece = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        unknown = np.flatnonzero(piece < 0).tolist()
        if unknown:
            new = list({flat[i] for i in unknown})
            ids, count = self.ranks.encode([p.encode() for p in new])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.flat, self.count = np.concatenate([self.flat, ids]), np.concatenate([self.count, count])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            piece[unknown] = [self.index[flat[i]] for i in unknown]
        count = self.count[piece]
        ids = self.flat[ragged(self.start[piece], count)]
        sums = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(sums[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        return self._join(ids, count, self.ranks.bytes, self.ranks.byte_start, self.ranks.byte_len)

    def digits(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The ids as decimal numbers joined by one space."""
        return [x[:-1] for x in self._join(ids, count, self.ranks.digits, self.ranks.digit_start, self.ranks.digit_len)]

    @staticmethod
    def _join(ids, count, table, start, size) -> list[bytes]:
        raw = table[ragged(start[ids], size[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(count)])].tolist()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and if asked for ids and decoded_text (from the ids; invalid UTF-8 is replaced).

    path: a rank file that every executor can read. Null is an empty text: no ids, and the digests of nothing. A row that repeats is encoded as often as it stands, a null
    doc_id stays null. Texts may have any length. Of equal pairs the leftmost merges first. An empty table gives no rows; other columns of docs, whatever their names,
    are ignored. Rows stay in their partitions; nothing is shuffled.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids + [("decoded_text", pa.string())] * with_text)

    def run(batches):
        own = encoder(path, pattern)
        for part in slices(batches):
            ids, count = own.encode(part.column("text").to_pylist())
            back = own.decode(ids, count)
            cols = [part.column("doc_id"), pa.array(count, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in own.digits(ids, count)]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(ids)))
            if with_text:
                cols.append(pa.array([x.decode("utf-8", "replace") for x in back]))
            yield pa.RecordBatch.from_arrays(cols, schema=kind)

    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return small.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded_text string" * with_text)


def decode_ids(encoded: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """encoded with a column decoded_text made from token ids; a null or empty list is an empty text, an empty table stays empty, a column of that name is replaced; all others stay."""
    @F.pandas_udf("string")
    def text(lists):
        own, lists = encoder(path, pattern), [np.asarray([] if x is None else x, np.int64) for x in lists]
        back = own.decode(np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64), np.array([len(x) for x in lists], np.int64))
        return pd.Series([x.decode("utf-8", "replace") for x in back])

    return encoded.withColumn("decoded_text", text(F.col(column)))
