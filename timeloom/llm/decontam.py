"""Benchmark decontamination: item-sized word windows meet the items by bit-sampling LSH over CGK embeddings; exact edit distance decides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm.common import LOWER, cut, mix, ragged, slices, utf8, word_hashes

#: A window is a leak if its edit distance to an item, in words, is at most RATE of the item's words. RUN: words in a run, see Index.screen.
RATE, RUN = 0.2, 3
#: Coordinates that one repetition samples, and the recall that repetitions are added for, at the largest distance.
COORDINATES, RECALL = 3, 0.995
#: A walk of 2n steps passes n words on average; coordinates are sampled from the first 1.8n, where few walks have ended.
STEPS = 1.8
#: Items go to the executors in parts of about so many words, one at a time, each with a pass of its own over the documents.
PART_WORDS = 1_000_000
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
PAD = np.uint64(0)
OUT = pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int64())])


def word_ids(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (letters, digits and bytes of longer UTF-8 sequences, A-Z lowered), and where each text's begin."""
    data, off = utf8(text)
    data = LOWER[data]
    inside = np.concatenate([WORD[data], [False]])
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(before & (~inside | first))
    return word_hashes(data, starts, ends), np.searchsorted(starts, off)


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` consecutive words."""
    out = np.zeros(max(0, len(h) - length + 1), np.uint64)
    for j in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return mix(out)


def edit_distances(windows: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Edit distance in words of each row of windows to the item, one for all or a row for each; all rows at once, a column of the table at a time."""
    items = np.atleast_2d(items)
    size, length = (windows != PAD).sum(axis=1), items.shape[1]
    steps = np.arange(length + 1, dtype=np.int32)
    last = np.broadcast_to(steps, (len(windows), length + 1)).copy()
    result = np.where(size == 0, length, 0)
    for i in range(windows.shape[1]):
        new = np.empty_like(last)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(last[:, 1:] + 1, last[:, :-1] + (windows[:, i : i + 1] != items))
        last = np.minimum.accumulate(new - steps, axis=1) + steps
        result = np.where(size == i + 1, last[:, -1], result)
    return result


def shared_words(windows: np.ndarray, items: np.ndarray) -> np.ndarray:
    """How many words of each row of items stand anywhere in the same row of windows."""
    both = np.concatenate([windows & ~np.uint64(1), items | np.uint64(1)], axis=1)  # a word's window places sort before its item places
    both.sort(axis=1)
    new = np.ones(both.shape, bool)
    new[:, 1:] = both[:, 1:] >> np.uint64(1) != both[:, :-1] >> np.uint64(1)
    first = np.maximum.accumulate(np.where(new, np.arange(both.shape[1]), 0), axis=1)
    of_window = np.take_along_axis(both, first, axis=1) & np.uint64(1) == 0
    return (of_window & (both & np.uint64(1) == 1)).sum(axis=1)


def walks(windows: np.ndarray, size: int, seeds: np.ndarray) -> np.ndarray:
    """CGK embedding: of each window (rows of `windows`, word hashes, PAD behind the end) and each seed, the place of its pointer at every step, as (step, window, seed).

    A pointer writes the word it stands at and goes on to the next one if a coin says so, which is a hash of seed, step and word: equal words at equal steps move alike,
    so that two walks that once stand at the same word of an alignment stay together until the next edit. Places behind the last word are that of the first PAD.
    """
    steps = int(STEPS * size)
    wide = np.concatenate([windows, np.full((len(windows), 1), PAD)], axis=1)
    row = (np.arange(len(wide)) * wide.shape[1])[:, None]
    flat, last = wide.ravel(), wide.shape[1] - 1
    out = np.empty((steps, len(windows), len(seeds)), np.int16 if last < 1 << 15 else np.int32)
    place = np.zeros((len(windows), len(seeds)), np.int64)
    for t in range(steps):
        out[t] = place
        coin = flat[row + place] * (mix(seeds + np.uint64(t)) | np.uint64(1)) >> np.uint64(63)
        place = np.minimum(place + coin.astype(np.int64), last)
    return out


def sampled(size: int, seeds: np.ndarray) -> np.ndarray:
    """The steps that each seed samples: COORDINATES of them."""
    draw = mix(seeds[:, None] ^ np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort((draw % np.uint64(max(1, int(STEPS * size)))).astype(np.int64), axis=1)


def bucket_keys(windows: np.ndarray, size: int, seeds: np.ndarray) -> np.ndarray:
    """LSH keys of windows (rows) for each seed (columns): the words at the sampled coordinates of the embedding. 0, which meets nothing, if one lies behind the end."""
    path = walks(windows, size, seeds)
    wide = np.concatenate([windows, np.full((len(windows), 1), PAD)], axis=1)
    at = sampled(size, seeds)
    key = np.broadcast_to(mix(seeds ^ np.uint64(size)), (len(windows), len(seeds))).copy()
    ended = np.zeros(key.shape, bool)
    for j in range(COORDINATES):
        word = np.take_along_axis(wide, path[at[:, j], :, np.arange(len(seeds))].T.astype(np.int64), axis=1)
        ended |= word == PAD
        key = mix(key ^ word) + np.uint64(j + 1)
    key[ended] = 0
    return key


def seeds_of(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) << np.uint64(32))


def length_class(size: int) -> int:
    """Repetitions are measured once for all lengths of a class: a power of 1.2, rounded up."""
    n = 1
    while n < size:
        n = max(n + 1, int(n * 1.2))
    return n


_repetitions: dict[tuple[int, float], int] = {}


def repetitions(size: int, rate: float, scripts: int = 200, tries: int = 96) -> int:
    """How many repetitions find an item of `size` different words with expected probability RECALL when as much is edited as the limit lets.

    Measured on random edit scripts (substitutions, and insertions and deletions in equal number) of the class's largest length, each with its own chance p of meeting in
    one repetition: the least R at which the mean of 1 - (1 - p)**R is RECALL. There is no upper bound on R. Repeated words can only make walks meet oftener.
    """
    size = length_class(size)
    if (size, rate) in _repetitions:
        return _repetitions[size, rate]
    rng = np.random.default_rng(size)
    edits = int(rate * size)
    item = mix(np.arange(1, size + 1, dtype=np.uint64))
    made = np.full((scripts, size), PAD)
    for i in range(scripts):
        x = item.tolist()
        swaps = int(rng.integers(0, edits // 2 + 1)) if edits > 1 else 0
        for j in range(edits - 2 * swaps):
            x[rng.integers(len(x))] = int(rng.integers(1, 1 << 63))
        for j in range(swaps):
            del x[rng.integers(len(x))]
            x.insert(rng.integers(len(x) + 1), int(rng.integers(1, 1 << 63)))
        made[i] = np.array(x, np.uint64)
    seeds = mix(np.arange(1, tries + 1, dtype=np.uint64) << np.uint64(20))
    own, hits = bucket_keys(item[None, :], size, seeds), np.zeros(scripts)
    for part in np.array_split(np.arange(scripts), max(1, int(scripts * tries * size * STEPS) >> 22)):
        keys = bucket_keys(made[part], size, seeds)
        hits[part] = ((keys == own) & (keys != 0)).sum(axis=1)
    p, n = (hits + 0.5) / (tries + 1), 1
    while np.mean(1 - (1 - p) ** n) < RECALL:
        n += max(1, n // 16)
    _repetitions[size, rate] = n
    return n


@dataclass
class Index:
    """Items as word hashes, the runs that stand in items, and the LSH tables of all items of one length."""

    ids: np.ndarray
    items: list[np.ndarray]
    rate: float = RATE

    def __post_init__(self):
        self.size = np.array([len(x) for x in self.items], np.int64)
        self.most = (self.rate * self.size).astype(np.int64)
        self.runs, self.tables = {}, {}
        for size in np.unique(self.size[self.size > 0]).tolist():
            own = np.flatnonzero(self.size == size)
            length = self.run_length(size)
            self.runs.setdefault(length, []).append((np.unique(np.concatenate([runs(self.items[k], length) for k in own])), size))
            seeds = seeds_of(repetitions(size, self.rate))
            keys = bucket_keys(np.stack([self.items[k] for k in own]), size, seeds)
            item = np.repeat(own, len(seeds))
            key, item = keys.ravel()[keys.ravel() != 0], item[keys.ravel() != 0]
            order = np.argsort(key, kind="stable")
            self.tables[size] = seeds, key[order], item[order]
        for length, found in self.runs.items():
            key, size = np.concatenate([x for x, _ in found]), np.concatenate([np.full(len(x), n) for x, n in found])
            order = np.argsort(key, kind="stable")
            sieve = np.zeros(1 << 22, bool)
            sieve[(key >> np.uint64(42)).astype(np.int64)] = True
            self.runs[length] = key[order], size[order], sieve

    def run_length(self, size: int) -> int:
        most = int(self.rate * size)
        return min(RUN, size, -(-(size - most) // (most + 1)))

    def screen(self, h: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
        """For each item length, the first words of all windows of that length that hold enough runs of items of that length; others can't be within the limit of one.

        An edit breaks at most `length` of an item's runs, so a window within the limit holds at least runs - length * limit of them, one at least by the choice of
        `length`. Which item a run is from isn't asked, so a run that very many items share costs once for each of their lengths.
        """
        out, hits = {}, {}
        for length, (key, sizes, sieve) in self.runs.items():
            g = runs(h, length)
            where = np.flatnonzero(sieve[(g >> np.uint64(42)).astype(np.int64)])
            low, high = np.searchsorted(key, g[where], "left"), np.searchsorted(key, g[where], "right")
            text = np.searchsorted(at, where, "right") - 1
            count = np.where(where + length <= at[text + 1], high - low, 0)  # a run lies in one text
            size, where = sizes[ragged(low, count)], np.repeat(where, count)
            for n in np.unique(size).tolist():
                hits[n] = where[size == n]
        for size, where in hits.items():
            length = self.run_length(size)
            need = max(1, size - length + 1 - length * int(self.rate * size))
            if len(where) < need:
                continue
            first, last = where[: len(where) - need + 1], where[need - 1 :]  # `need` hits in a row: windows from last + length - size to first hold them
            text = np.searchsorted(at, first, "right") - 1
            low = np.maximum(last + length - size, at[text])
            good = (low <= first) & (last < at[text + 1])
            low, first = low[good], first[good]
            low[1:] = np.maximum(low[1:], first[:-1] + 1)  # both rise: each start once
            out[size] = ragged(low, np.maximum(0, first - low + 1))
        return out

    def windows(self, h: np.ndarray, at: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Words of the windows from starts, PAD where the text ends before."""
        place = starts[:, None] + np.arange(size)[None, :]
        end = at[np.searchsorted(at, starts, "right")][:, None]
        return np.where(place < end, h[np.minimum(place, len(h) - 1)], PAD)

    def meet(self, h: np.ndarray, at: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of all windows that share an LSH bucket with an item of their length."""
        seeds, key, item = self.tables[size]
        found = [np.zeros(0, np.int64)]
        for part in np.array_split(starts, max(1, int(len(starts) * len(seeds) * size * STEPS) >> 22)):
            keys = bucket_keys(self.windows(h, at, part, size), size, seeds)
            spot = np.minimum(np.searchsorted(key, keys), len(key) - 1) if len(key) else np.zeros(keys.shape, np.int64)
            w, r = np.nonzero((key[spot] == keys) & (keys != 0)) if len(key) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            spot = spot[w, r]
            n = np.searchsorted(key, key[spot], "right") - spot
            found.append(np.unique(np.repeat(part[w], n) * len(self.items) + item[ragged(spot, n)]))
        both = np.concatenate(found)
        return both // len(self.items), both % len(self.items)

    def distances(self, h: np.ndarray, at: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Edit distance to item k and number of words of the windows from starts."""
        far, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in np.array_split(starts, max(1, -(-len(starts) // 1000))):
            window = self.windows(h, at, part, len(self.items[k]))
            far.append(edit_distances(window, self.items[k])), words.append((window != PAD).sum(axis=1))
        return np.concatenate(far), np.concatenate(words)

    def near(self, h: np.ndarray, at: np.ndarray, start: np.ndarray, item: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of a window's first word and an item of that length, those within the item's limit: all pairs in one table of distances, those first left out that share
        fewer words than any pair within the limit does (each edit takes one of the item's words at most)."""
        every = np.stack([self.items[k] for k in np.flatnonzero(self.size == size)])
        place = np.searchsorted(np.flatnonzero(self.size == size), item)
        kept = []
        for part in np.array_split(np.arange(len(start)), max(1, -(-len(start) * size // (1 << 19)))):
            windows, items, most = self.windows(h, at, start[part], size), every[place[part]], self.most[item[part]]
            enough = np.flatnonzero(shared_words(windows, items) >= size - most)
            far = edit_distances(windows[enough], items[enough])
            kept.append(part[enough[far <= most[enough]]])
        good = np.concatenate(kept)
        return start[good], item[good]

    def search(self, text: pa.Array) -> list[list[dict]]:
        """For each text: its leaks, the nearest window of each item, then the first."""
        h, at = word_ids(text)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for size, starts in self.screen(h, at).items():
            start, item = self.near(h, at, *self.meet(h, at, starts, size), size)
            if not len(item):
                continue
            order = np.lexsort((start, item))
            start, item = start[order], item[order]
            names, first_of = np.unique(item, return_index=True)
            for k, i, j in zip(names.tolist(), first_of.tolist(), [*first_of[1:].tolist(), len(item)], strict=True):
                # around each leak, every window that overlaps it: the nearest may share no bucket
                good, most = start[i:j], int(self.most[k])
                near = np.searchsorted(good, starts, "right")
                gap = np.minimum(np.where(near > 0, starts - good[near - 1], size), np.where(near < len(good), good[np.minimum(near, len(good) - 1)] - starts, size))
                around = starts[gap <= most]
                far, words = self.distances(h, at, around, k)
                doc = np.searchsorted(at, around, "right") - 1
                for x in np.flatnonzero(far <= most).tolist():
                    found = (int(far[x]), int(around[x] - at[doc[x]]), int(words[x]))
                    best[int(doc[x]), k] = min(best.get((int(doc[x]), k), found), found)
        out = [[] for _ in range(len(at) - 1)]
        for (doc, k), (d, first, n) in sorted(best.items()):
            out[doc].append({"item_id": int(self.ids[k]), "first_word": first, "n_words": n, "distance": d})
        return out


def item_rows(benchmark: DataFrame) -> DataFrame:
    return benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")


def part_count(benchmark: DataFrame, part_words: int) -> int:
    words = item_rows(benchmark).agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    return max(1, -(-words // part_words))


def part_index(benchmark: DataFrame, rate: float, part: int, parts: int) -> Index:
    """One of `parts` about equal parts of the benchmark. Items without words match nothing."""
    rows = item_rows(benchmark).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").toArrow()
    h, at = word_ids(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()))
    return Index(np.asarray(rows.column("item_id")), [h[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], rate)


def leak_column(shared: Broadcast) -> Callable[[Column], Column]:
    """Of a broadcast index a column function: text to an array of leaks."""

    @F.arrow_udf("array<struct<item_id:long,first_word:long,n_words:long,distance:long>>")
    def leaks(text: pa.Array) -> pa.Array:
        found = [x for part in slices([pa.RecordBatch.from_arrays([text], ["text"])], most=1 << 21) for x in shared.value.search(part.column("text"))]
        return pa.array(found, pa.list_(OUT))

    return leaks


def over_parts(spark: SparkSession, benchmark: DataFrame, rate: float, parts: int, search: Callable[[Callable[[Column], Column]], DataFrame]) -> DataFrame:
    """The rows that search(leaks) gives for each part of the benchmark. Of several parts, one is built, broadcast, searched for with its rows written, and released before the
    next one is built: driver and executors hold one part at a time, however large the benchmark."""
    out = []
    for part in range(parts):
        shared = spark.sparkContext.broadcast(part_index(benchmark, rate, part, parts))
        rows = search(leak_column(shared))
        if parts > 1:
            rows = cut(rows)
            shared.destroy()
        out.append(rows)
    return reduce(DataFrame.unionByName, out)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, part_words: int = PART_WORDS) -> DataFrame:
    """A row for each (row of docs, item) with a leak: doc_id, item_id, first_word, n_words, distance; of an item's windows the nearest, then the first.

    Windows have the item's length in words, less where the text ends; a leak is one within an edit distance of `rate` of the item's words. Every window that can be
    that near is embedded (Index.screen passes over those that can't), searches the items' LSH tables in as many repetitions as RECALL asks for at the largest
    distance, and is compared in full with each item it meets. So all rows are true, and a leak edited to the limit is missed with a chance of about 1 - RECALL.

    Null and empty texts and items have no leaks; a row or item that stands twice gives its leaks twice; items of equal text are found alike; texts may have any length;
    an empty table gives no rows; other columns, whatever their names, are ignored. Rows of docs stay in their partitions; a benchmark of more than part_words words goes
    in parts of about so many, one at a time.
    """
    text = F.coalesce("text", F.lit(""))
    parts = part_count(benchmark, part_words)
    return over_parts(docs.sparkSession, benchmark, rate, parts, lambda leaks: docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(leaks(text)).alias("leak")).select("doc_id", "leak.*"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, part_words: int = PART_WORDS) -> DataFrame:
    """docs without the rows that hold a leak, all columns and repeated rows as they are. Rows with null or empty text stay; with an empty benchmark all rows stay.

    A benchmark of one part is one filter. Of several parts, each writes the digests of the texts that it leaks into, and all rows of such texts go by one join.
    """
    text, parts = F.coalesce("text", F.lit("")), part_count(benchmark, part_words)
    if parts == 1:
        return over_parts(docs.sparkSession, benchmark, rate, parts, lambda leaks: docs.where(F.size(leaks(text)) == 0))
    found = over_parts(docs.sparkSession, benchmark, rate, parts, lambda leaks: docs.where(F.size(leaks(text)) > 0).select(F.sha2(text, 256).alias("__leaks_into")))
    return docs.join(found.distinct(), F.sha2(text, 256) == F.col("__leaks_into"), "left_anti")
