"""Near-duplicates by circulant MinHash, banding and an exact check on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import LOWER, cut, keep_rows, mix, slices, utf8, word_hashes, words
from timeloom.llm.components import connected_components

WIDTH, PERCENT = 5, 75
#: 32 bands of 4 rows: a pair of similarity 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6.
BANDS, ROWS = 32, 4
#: Shingles are counted in so many slots, by leading bits of their hashes.
SLOT_BITS = 20


def shingle_sets(text: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    data, off = utf8(text)
    data = LOWER[data]
    starts, ends, at = words(data, off)
    h = word_hashes(data, starts, ends)
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(rolled)]
    rolled = mix(rolled)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for v in h[a:b]:
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + v)
            yield x
        else:
            yield np.zeros(0, np.uint64)


def _permuted(x: np.ndarray) -> np.ndarray:
    """The circulated permutation of [0, 2**32), in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: one permutation places the shingles in [0, 2**32), the other, shifted by k around the circle, gives coordinate k."""
    place = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(place), 2048):
        np.minimum(least, _permuted(place[None, a : a + 2048] + shift).min(axis=1), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, the band's number mixed in."""
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + sig.reshape(bands, rows)[:, j].astype(np.uint64))
    return key.view(np.int64)


def _describe(width: int, bands: int, rows: int):
    kind = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for part in slices(batches):
            sizes, keys, bits = [], [], []
            for s in shingle_sets(part.column("text"), width):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bits.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else np.zeros(0, np.int64))
            off = np.concatenate([[0], np.cumsum([len(b) for b in bits])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], schema=kind)

    return run


def _sets(width: int):
    kind = pa.schema([("member", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), width)], pa.binary())], schema=kind)

    return run


def common_counts(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of all intersections, from products of 0/1 matrices over the values that two sets at least have."""
    n = len(sets)
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    column = (np.cumsum(count > 1) - 1)[inverse]
    row, column = row[(count > 1)[inverse]], column[(count > 1)[inverse]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
        a, b = np.searchsorted(column, [low, low + chunk])
        m = np.zeros((n, chunk), np.float32)
        m[row[a:b], column[a:b] - low] = 1
        out += m @ m.T
    return out.astype(np.int64)


def linked_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix: 100 * intersection >= percent * union, in integers."""
    common = common_counts(sets)
    size = np.array([len(s) for s in sets])
    return 100 * common >= percent * (size[:, None] + size[None, :] - common)


def _verify(percent: int):
    """Of one group: an edge from each member to the least member it is connected with. Never more rows than members."""
    kind = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("member"))
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        raw = table.column("hashes").to_pylist()
        sets = [np.frombuffer(raw[i], np.uint64) for i in order]
        if len(ids) == 2:
            common = len(np.intersect1d(*sets, assume_unique=True))
            link = np.eye(2, dtype=bool)
            link[0, 1] = link[1, 0] = 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common)
        else:
            link = linked_pairs(sets, percent)
        link |= ids[:, None] == ids[None, :]
        label = np.arange(len(ids))
        while True:
            least = np.where(link, label[None, :], len(ids)).min(axis=1)
            if (least == label).all():
                break
            label = least
        far = label != np.arange(len(ids))
        return pa.table([pa.array(ids[far]), pa.array(ids[label[far]])], schema=kind)

    return run


def _checked(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) of a spanning forest of each check's links; dealt: (check columns.., member), sets: (member, hashes)."""
    names = [c for c in dealt.columns if c != "member"]
    return dealt.join(sets, "member").select(*names, "member", "hashes").groupBy(*names).applyInArrow(_verify(percent), "u long, v long")


def _apart(members: DataFrame) -> DataFrame:
    """The rows (leader, member, part) of groups that hold several components."""
    several = members.groupBy("leader").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("leader")
    return members.join(several, "leader", "left_semi")


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _shingle_counts(batches):
    n = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        n += np.bincount(_slot(np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64)), minlength=len(n))
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["slot", "n"])


def rarest(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """So many of the rarest shingles that two sets within `percent` have one of them in common: a set that shares none of these has too few others to share.

    counts: how often each slot's shingles stand anywhere; any counts give right results, good ones small answers, and equal ones are settled by value.
    """
    enough = len(shingles) - -(-percent * len(shingles) // 100) + 1
    return shingles[np.lexsort((shingles, counts[_slot(shingles)]))[:enough]]


def _may_link(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """member: those of `apart` that have one of their rarest shingles in common with a member of another component. All others can link with nothing that they aren't joined
    with, so members of a template that differ in more than a quarter of their shingles need no check among themselves.

    What goes to the driver and back is a table of 2**SLOT_BITS counters, whatever the input.
    """
    spark = apart.sparkSession
    open_sets = sets.join(apart.select("member", "part").distinct(), "member")
    total = open_sets.select("hashes").mapInArrow(_shingle_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    counts[np.asarray(total.column("slot"))] = np.asarray(total.column("n"))
    shared = spark.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            found = [rarest(np.frombuffer(raw, np.uint64), shared.value, percent).view(np.int64) for raw in batch.column("hashes").to_pylist()]
            times = [len(f) for f in found]
            part, member = (np.repeat(np.asarray(batch.column(n)), times) for n in ("part", "member"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), pa.array(part), pa.array(member)], names=["shingle", "part", "member"])

    rare = cut(open_sets.select("part", "member", "hashes").mapInArrow(run, "shingle long, part long, member long"))
    shared.destroy()
    meet = rare.groupBy("shingle").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("shingle")
    return rare.join(meet, "shingle", "left_semi").select("member").distinct()


def _open_checks(large: DataFrame, block: int) -> DataFrame:
    """(leader, i, j, member): what is still to be checked in the groups of more than `block` members; large: (leader, member, part), part being the component so far.

    In a group, members of one component need no check among themselves. Components of `block` members or more fill blocks of their own, numbered on; smaller ones share
    blocks. Two blocks are checked together unless both are of one component. So a group with a few outsiders needs as many checks as it has blocks.
    """
    parts = large.groupBy("leader", "part").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") >= block
    own = cut(parts.where(share).select("leader", "part", F.ceil(F.col("n") / block).cast("long").alias("blocks")))
    rest = parts.where(~share).groupBy("leader").agg(F.ceil(F.sum("n") / block).cast("long").alias("rest"))
    sizes = own.groupBy("leader").agg(F.count(F.lit(1)).alias("parts"))
    open_groups = cut(rest.join(sizes, "leader", "full_outer").select("leader", F.coalesce("rest", F.lit(0)).alias("rest"), F.coalesce("parts", F.lit(0)).alias("parts")).where("rest > 0 or parts > 1"))
    # A block's name: the component's or "-" for shared ones, and its number.
    block_name = lambda part, k: F.concat_ws(":", part.cast("string"), k.cast("string"))
    placed = large.join(open_groups, "leader").join(own, ["leader", "part"], "left")
    name = F.when(F.col("blocks").isNull(), block_name(F.lit("-"), F.pmod(F.xxhash64("part", F.lit(5)), F.col("rest")))).otherwise(block_name(F.col("part"), F.pmod(F.xxhash64("member", F.lit(3)), F.col("blocks"))))
    mine = placed.select("leader", "member", name.alias("own"))
    # Pairs of blocks, from numbers of blocks: shared with shared, shared with each component's, and those of two components.
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    shared = open_groups.where("rest > 0")
    among = shared.select("leader", "rest", numbers("rest").alias("a")).select("leader", "a", numbers("rest").alias("b")).where("a <= b")
    among = among.select("leader", block_name(F.lit("-"), F.col("a")).alias("i"), block_name(F.lit("-"), F.col("b")).alias("j"))
    beside = own.join(shared, "leader").select("leader", "part", "rest", numbers("blocks").alias("b")).select("leader", "part", "b", numbers("rest").alias("a"))
    beside = beside.select("leader", block_name(F.lit("-"), F.col("a")).alias("i"), block_name(F.col("part"), F.col("b")).alias("j"))
    several = own.join(open_groups.where("parts > 1").select("leader"), "leader")
    across = several.join(several.select("leader", F.col("part").alias("part2"), F.col("blocks").alias("blocks2")), "leader").where("part < part2")
    across = across.select("leader", "part", "part2", "blocks2", numbers("blocks").alias("a")).select("leader", "part", "part2", "a", numbers("blocks2").alias("b"))
    across = across.select("leader", block_name(F.col("part"), F.col("a")).alias("i"), block_name(F.col("part2"), F.col("b")).alias("j"))
    meets = among.unionByName(beside).unionByName(across)
    meets = meets.select("leader", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    return mine.join(meets, ["leader", "own"]).select("leader", "i", "j", "member")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = 256) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept.

    Texts of equal sets stand for each other as one representative. In each bucket of a band, the least representative leads; all that meet under one leader form a
    group, which holds every pair of its buckets. A group is cut into blocks of about `block` members, and each block is checked together with the leader, all pairs
    exactly; only edges of a spanning forest leave a check. In groups of several blocks, whatever these checks haven't joined and can still link by its rarest shingles is
    then checked across blocks.

    Null and empty texts have no shingles and stand alone. Rows that share a doc_id are one node, rows without one stand alone. Texts may have any length. An empty table
    gives no rows; other columns, whatever their names, are ignored.
    """
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sig = cut(small.mapInArrow(_describe(width, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>"))
    reps = sig.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"))
    reps = cut(reps)
    entries = reps.select(F.explode("bands").alias("key"), F.col("rep").alias("member"))
    leaders = entries.groupBy("key").agg(F.min("member").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "leader")
    groups = cut(entries.join(leaders, "key").select("leader", "member").distinct())
    sizes = cut(groups.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))  # cut, so that the join can split a large group
    groups = cut(groups.join(sizes, "leader"))
    own = F.when(F.col("member") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")))
    first = groups.select("leader", F.explode(own).alias("i"), "member")
    wanted = groups.select(F.col("member").alias("doc_id")).distinct().hint("merge")  # grows with the corpus: never broadcast
    sets = cut(small.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(width), "member long, hashes binary"))  # whole texts move once
    edges = cut(_checked(first.hint("merge"), sets, percent))  # both sides grow with the corpus: never broadcast
    found = connected_components(edges)
    if groups.where("blocks > 1").limit(1).count():
        found = cut(found)
        large = groups.where("blocks > 1").join(found, F.col("member") == F.col("node"), "left").select("leader", "member", F.coalesce("component", "member").alias("part"))
        apart = cut(_apart(large))
        live = cut(_apart(apart.join(_may_link(apart, sets, percent), "member", "left_semi")))
        rest = cut(_open_checks(live, block))
        again = cut(rest.select("member").distinct())  # what is still apart in large groups: Spark broadcasts these numbers if they are few, else the sets move
        later = _checked(rest, sets.join(again, "member", "left_semi"), percent)
        found = connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(later))
    named = reps.select("set_key", "rep").join(found, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the smallest doc_id; all columns as they are, whatever their names.

    Rows that share a doc_id are one node, so one of them stays at most: that of the longest text, then the largest hash of the text; rows equal in that too may differ in other
    columns, and which stays then isn't defined. Rows without a doc_id stand alone and stay, as do rows with null or empty text under ids of their own.
    """
    found = cut(near_duplicates(docs, **options).select("doc_id", "kept"))
    kept = keep_rows(docs, cut(found.where("not kept").select("doc_id").distinct()))  # a table of known size: texts only move if it is large
    twice = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("twice"))
    if not twice.limit(1).count():
        return kept
    single = kept.join(twice, kept["doc_id"] == twice["twice"], "left_anti")
    several = kept.join(twice, kept["doc_id"] == twice["twice"], "left_semi")
    best = F.max(F.struct(F.length(F.coalesce("text", F.lit(""))).alias("n"), F.xxhash64("text").alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    return single.unionByName(several.groupBy("doc_id").agg(best.alias("best")).select(*[F.col("best.row").getField(c).alias(c) for c in docs.columns]))
