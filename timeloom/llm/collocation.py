"""Phrase collocations: pairs of frequency-ranked ids counted in tiles, frequent pairs ranked anew as the ids of the next length."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timeloom.llm.common import LOWER, cut, grown, numbered, pack_small, slices, text_bytes, unpack_small, utf8, words

#: What ends a piece, and what separates words.
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?\n\x0b\x0c\r"]] = True
GAP = PIECE_END.copy()
GAP[[9, 32]] = True
#: Ranks below this form the first tile; the tiles after it are one octave of ranks wide each, or one of so many pieces of an octave. Ids are ranks.
HEAD = 1024
#: A tile is counted by direct addresses if it has at most so many cells and at least one in SPARSE of them comes in.
CELLS, SPARSE = 1 << 22, 32
#: Rows of a tile that are summed at once, when there are more than one.
FAN_IN = 32


def squeeze(values: np.ndarray) -> bytes:
    """Non-negative integers, byte plane by byte plane, compressed."""
    raw = pack_small(values)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def loosen(raw: bytes) -> np.ndarray:
    return unpack_small(pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True))


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=0))


def loosen_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(loosen(raw))


def _single(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def one_row(kind: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kind.types, strict=True)], schema=kind)


def rows_of(kind: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kind), kind.types, strict=True)], schema=kind)


# Slabs: the words of a few megabytes of one lang, by places in a dictionary of their own


SLAB = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int64())), ("seq", pa.binary())])


def piece_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of texts, A-Z lowered, and the texts as places in them, from 1; 0 between pieces."""
    data, off = utf8(text)
    starts, ends, at = words(data, off, GAP)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    ended = np.concatenate([[0], np.cumsum(PIECE_END[data])])[starts]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    new = np.concatenate([[False], (ended[1:] != ended[:-1]) | (doc[1:] != doc[:-1])])
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(LOWER[data][~GAP[data]].tobytes())]).dictionary_encode()
    seq = np.zeros(len(starts) + int(new.sum()), np.int64)
    seq[np.arange(len(starts)) + np.cumsum(new)] = np.asarray(flat.indices) + 1
    return flat.dictionary.cast(pa.string()), seq


def _slabs(most: int):
    def run(batches):
        for part in slices(batches, most=most):
            lang = part.column("lang").to_pylist()
            for name in dict.fromkeys(lang):
                own, seq = piece_words(part.column("text").filter(pa.array([x == name for x in lang])))
                yield one_row(SLAB, name, own, np.bincount(seq, minlength=len(own) + 1)[1:], squeeze(seq))

    return run


# Tiles


def tiles(ids: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id, the tile's number, first id and width."""
    octave = np.where(ids < HEAD, 0, np.log2(np.maximum(ids >> 10, 1)).astype(np.int64) + 1)
    start = np.where(octave == 0, 0, HEAD << np.maximum(octave - 1, 0))
    width = np.where(octave == 0, HEAD, start // pieces)
    piece = np.where(octave == 0, 0, (ids - start) // np.maximum(width, 1))
    return octave * pieces + piece, start + piece * width, width


def tile_bounds(tile: int, pieces: int) -> tuple[int, int]:
    octave, piece = divmod(tile, pieces)
    if not octave:
        return 0, HEAD
    start = HEAD << (octave - 1)
    return start + piece * (start // pieces), start // pieces


TILE = pa.schema([("lang", pa.string()), ("t1", pa.int64()), ("t2", pa.int64()), ("salt", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])
TILE_SQL = "lang string, t1 long, t2 long, salt long, codes binary, counts binary"
MESSAGE = pa.schema([("slab", pa.int64()), *TILE])
MESSAGE_SQL = f"slab long, {TILE_SQL}"


def pairs(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a sequence (from 1; 0 is none), and of each place where two ids meet: the place, and the places of both among the ids."""
    at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0)) if len(seq) else np.zeros(0, np.int64)
    ids, own = np.unique(np.concatenate([seq[at], seq[at + 1]]), return_inverse=True)
    return ids - 1, at, own[: len(at)], own[len(at) :]


def _messages(pieces: int, salts: int):
    """A slab's row for each tile: codes of the pairs in it, and how often the slab has each."""

    def run(batches):
        for row in _single(batches):
            ids, _, left, right = pairs(loosen(row["seq"]))
            if not len(left):
                continue
            code, times = np.unique(left * len(ids) + right, return_counts=True)
            (t1, a, _), (t2, b, w) = tiles(ids[code // len(ids)], pieces), tiles(ids[code % len(ids)], pieces)
            code = (ids[code // len(ids)] - a) * w + ids[code % len(ids)] - b
            order = np.lexsort((code, t2, t1))
            code, times, t1, t2 = code[order], times[order], t1[order], t2[order]
            first = np.flatnonzero(np.concatenate([[True], (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])]))
            salt = row["salt"] % salts
            out = [(row["slab"], row["lang"], int(t1[i]), int(t2[i]), salt, squeeze_sorted(code[i:j]), squeeze(times[i:j])) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(code)], strict=True)]
            yield from rows_of(MESSAGE, out).to_batches()

    return run


def sum_tile(parts: list[tuple[bytes, bytes]], cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a tile with their counts summed: by direct addresses where the tile is small and well filled, else sorted."""
    each = [loosen_sorted(c) for c, _ in parts]
    total = sum(map(len, each))
    if cells <= CELLS and total * SPARSE >= cells:
        sums = np.zeros(cells, np.int64)
        for code, (_, times) in zip(each, parts, strict=True):
            sums += np.bincount(code, loosen(times), cells).astype(np.int64)
        code = np.flatnonzero(sums)
        return code, sums[code]
    code, times = np.concatenate(each), np.concatenate([loosen(t) for _, t in parts])
    order = np.argsort(code, kind="stable")
    code, times = code[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(times, first)


def _sum(pieces: int):
    def run(key, table):
        lang, t1, t2, salt = (k.as_py() for k in key)
        cells = tile_bounds(t1, pieces)[1] * tile_bounds(t2, pieces)[1]
        code, times = sum_tile(list(zip(table.column("codes").to_pylist(), table.column("counts").to_pylist(), strict=True)), cells)
        return rows_of(TILE, [(lang, t1, t2, salt, squeeze_sorted(code), squeeze(times))])

    return run


FREQUENT = pa.schema([(n, pa.string() if n == "lang" else pa.int64()) for n in ("lang", "t1", "t2", "code", "left", "right", "f")])
FREQUENT_SQL = "lang string, t1 long, t2 long, code long, left long, right long, f long"


def _frequent(pieces: int, least: int):
    def run(batches):
        for row in _single(batches):
            code, f = loosen_sorted(row["codes"]), loosen(row["counts"])
            code, f = code[f >= least], f[f >= least]
            (a, _), (b, w) = tile_bounds(row["t1"], pieces), tile_bounds(row["t2"], pieces)
            n = len(code)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([row["lang"]] * n, [row["t1"]] * n, [row["t2"]] * n, code, a + code // w, b + code % w, f), FREQUENT.types, strict=True)], schema=FREQUENT)

    return run


REPLY = pa.schema([("lang", pa.string()), ("t1", pa.int64()), ("t2", pa.int64()), ("salt", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary())])
REPLY_SQL = "lang string, t1 long, t2 long, salt long, codes binary, ids binary"
ANSWER = pa.schema([("slab", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary())])
ANSWER_SQL = "slab long, t1 long, t2 long, codes binary, ids binary"


def _pack(key, table):
    lang, t1, t2 = (k.as_py() for k in key)
    code, ids = np.asarray(table.column("code")), np.asarray(table.column("index"))
    order = np.argsort(code)
    return rows_of(REPLY, [(lang, t1, t2, 0, squeeze_sorted(code[order]), squeeze(ids[order]))])


def _restrict(kind: pa.Schema):
    """Of a tile's codes with ids, those that each of its rows has."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        rows = []
        if known.num_rows:
            code, ids = loosen_sorted(known.column("codes")[0].as_py()), loosen(known.column("ids")[0].as_py())
            for i in range(asked.num_rows):
                r = asked.slice(i, 1).to_pylist()[0]
                own = loosen_sorted(r["codes"])
                at = np.minimum(np.searchsorted(code, own), len(code) - 1)
                hit = at[code[at] == own]
                if len(hit):
                    rows.append((*[r[n] for n in kind.names[:-2]], squeeze_sorted(code[hit]), squeeze(ids[hit])))
        return rows_of(kind, rows)

    return run


SEQ = pa.schema([("slab", pa.int64()), ("lang", pa.string()), ("salt", pa.int64()), ("seq", pa.binary())])
SEQ_SQL = "slab long, lang string, salt long, seq binary"


def _by_words(slab: pa.Table, known: pa.Table) -> pa.Table:
    """A slab by the ids of its frequent words."""
    rows = []
    for r in slab.to_pylist():
        ids = np.zeros(r["size"] + 1, np.int64)
        ids[np.asarray(known.column("place")) + 1] = np.asarray(known.column("index")) + 1
        rows.append((r["slab"], r["lang"], r["salt"], squeeze(ids[loosen(r["seq"])])))
    return rows_of(SEQ, rows)


def _by_pairs(pieces: int):
    """A slab by the ids of its frequent pairs: where one begins stands its id."""

    def run(slab: pa.Table, known: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64),) * 3]
        for r in known.to_pylist():
            (a, _), (b, w), code = tile_bounds(r["t1"], pieces), tile_bounds(r["t2"], pieces), loosen_sorted(r["codes"])
            parts.append((a + code // w, b + code % w, loosen(r["ids"])))
        first, second, new = (np.concatenate(x) for x in zip(*parts, strict=True))
        rows = []
        for r in slab.to_pylist():
            seq = loosen(r["seq"])
            ids, at, left, right = pairs(seq)
            code = np.searchsorted(ids, first) * len(ids) + np.searchsorted(ids, second)
            order = np.argsort(code)
            code, named = code[order], new[order]
            own, out = left * len(ids) + right, np.zeros(len(seq), np.int64)
            if len(code):
                place = np.minimum(np.searchsorted(code, own), len(code) - 1)
                out[at] = np.where(code[place] == own, named[place] + 1, 0)
            rows.append((r["slab"], r["lang"], r["salt"], squeeze(out)))
        return rows_of(SEQ, rows)

    return run


TILE_KEY = ("lang", "t1", "t2")


def count_pairs(seqs: DataFrame, least: int, pieces: int, salts: int, with_answers: bool) -> tuple[DataFrame, DataFrame | None]:
    """Frequent pairs (lang, index, left, right, f) of neighbouring ids, and the sequences by them if asked for.

    Slabs send their pairs to tiles. A tile of very many slabs is summed part by part (salt), then parts by FAN_IN until one is left; ids go back the same way, so no task
    holds more than a part or FAN_IN sums of one tile.
    """
    sent = seqs.mapInArrow(_messages(pieces, salts), MESSAGE_SQL)
    sent = cut(sent) if with_answers else sent
    sums, parents = [cut(sent.groupBy(*TILE_KEY, "salt").applyInArrow(_sum(pieces), TILE_SQL))], []
    while salts > 1:
        salts = -(-salts // FAN_IN)
        parent = F.floor(F.col("salt") / FAN_IN).cast("long")
        parents.append(parent)
        sums.append(cut(sums[-1].withColumn("salt", parent).groupBy(*TILE_KEY, "salt").applyInArrow(_sum(pieces), TILE_SQL)))
    frequent = numbered(sums[-1].mapInArrow(_frequent(pieces, least), FREQUENT_SQL).withColumn("less", -F.col("f")), ["lang"], ["less", "left", "right"])
    frequent = cut(frequent.select(*TILE_KEY, "code", "left", "right", "f", "index"))
    if not with_answers:
        return frequent, None
    known = frequent.groupBy(*TILE_KEY).applyInArrow(_pack, REPLY_SQL)
    for below, parent in zip(sums[-2::-1], parents[::-1], strict=True):
        known = cut(below.groupBy(*TILE_KEY, parent.alias("parent")).cogroup(known.groupBy(*TILE_KEY, "salt")).applyInArrow(_restrict(REPLY), REPLY_SQL))
    answers = sent.groupBy(*TILE_KEY, "salt").cogroup(known.groupBy(*TILE_KEY, "salt")).applyInArrow(_restrict(ANSWER), ANSWER_SQL)
    return frequent, cut(seqs.groupBy("slab").cogroup(answers.groupBy("slab")).applyInArrow(_by_pairs(pieces), SEQ_SQL))


def phrase_table(pairs_: DataFrame, shorter: DataFrame) -> DataFrame:
    """lang, id, f, words, before, after of phrases that begin with one shorter phrase and end with another. before[k]: how often the first k + 1 words stand; after[k]: the words after them."""
    side = lambda name: shorter.select("lang", F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("f", "words", "before", "after")])
    both = pairs_.join(side("left"), ["lang", "left"]).join(side("right"), ["lang", "right"])
    return both.select(
        "lang", F.col("index").alias("id"), "f", F.concat("left_words", F.slice("right_words", -1, 1)).alias("words"),
        F.concat("left_before", F.array("left_f")).alias("before"), F.concat(F.array("right_f"), "right_after").alias("after"), "left", "right",
    )


def _score(scale: int, a: Column, both: Column) -> Column:
    """floor(scale * a / both), exact beyond 64 bits."""
    return F.floor((F.lit(scale).cast("decimal(10,0)") * a.cast("decimal(19,0)") - (F.lit(scale).cast("decimal(10,0)") * a.cast("decimal(19,0)")) % both.cast("decimal(19,0)")) / both.cast("decimal(19,0)")).cast("long")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, scale: int = 2_000_000, inside: int = 80, slab_bytes: int = 4 << 20, part_bytes: int = 2 << 30, octave_bytes: int = 64 << 30) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's best `top` phrases of 2 to `longest` words.

    Texts are cut into pieces at [.,;:!?\\x0A-\\x0D] and these into words at blanks and tabs, A-Z lowered; a phrase lies within a piece. a: its occurrences, `least` or
    more; l and r: those of its two parts at the cut with the least score floor(scale * a / (l + r)), the first of equal ones; n: the words of the lang. Phrases that lie
    in a longer one with at least `inside` percent of their occurrences are left out; as a part of a longer phrase is at least as frequent, the next length decides that.
    Order: score and a descending, phrase by UTF-8 bytes.

    Null lang is `und`, together with a lang of that name; null text is empty. Rows that stand twice count twice; texts of any length are read whole. A table without
    frequent phrases gives no rows; other columns are ignored. A word or phrase of any frequency is one entry of each slab; what is sent to a tile, and the ids that
    come back, are summed and handed on in parts. No table of words or phrases is broadcast or held by one task.
    """
    small = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total = text_bytes(small)
    pieces, salts = 1 << max(0, math.ceil(math.log(max(1, total) / octave_bytes, 4))), -(-max(1, total) // grown(part_bytes, total, 16))
    slabs = small.mapInArrow(_slabs(grown(slab_bytes, total, 16)), "lang string, words array<string>, times array<long>, seq binary").withColumn("slab", F.monotonically_increasing_id())
    slabs = cut(slabs.withColumns({"salt": F.pmod(F.xxhash64("slab"), F.lit(1 << 40)), "size": F.size("words")}))
    each = slabs.select("slab", "lang", F.posexplode(F.arrays_zip("words", "times")).alias("place", "w")).select("slab", "lang", "place", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    counts = cut(each.groupBy("lang", "word").agg(F.sum("times").alias("f")))
    sizes = counts.groupBy("lang").agg(F.sum("f").alias("n_words"))
    frequent = cut(numbered(counts.where(F.col("f") >= least).withColumn("less", -F.col("f")), ["lang"], ["less", "word"]).select("lang", "word", "f", "index"))
    known = each.join(frequent.select("lang", "word", "index"), ["lang", "word"]).select(F.col("slab").alias("slab"), F.col("place").alias("place"), F.col("index").alias("index"))
    seqs = cut(slabs.select("slab", "lang", "salt", "size", "seq").groupBy("slab").cogroup(known.groupBy("slab")).applyInArrow(_by_words, SEQ_SQL))
    none = F.array().cast("array<long>")
    phrases = frequent.select("lang", F.col("index").alias("id"), "f", F.array("word").alias("words"), none.alias("before"), none.alias("after"))
    levels = []
    for size in range(2, longest + 1):
        found, seqs = count_pairs(seqs, least, pieces, salts, size < longest)
        phrases = cut(phrase_table(found, phrases))
        levels.append(phrases)
    out = None
    for k, level in enumerate(levels):
        kept = level
        if k + 1 < len(levels):
            longer = levels[k + 1].select("lang", F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), "f").groupBy("lang", "id").agg(F.max("f").alias("longer"))
            kept = level.join(longer, ["lang", "id"], "left").where(F.coalesce(F.col("longer").cast("decimal(20,0)") * 100 < F.col("f").cast("decimal(20,0)") * inside, F.lit(True)))
        cuts = F.zip_with("before", "after", lambda x, y: F.struct(x.alias("l"), y.alias("r")))
        scored = F.transform(cuts, lambda c, i: F.struct(_score(scale, F.col("f"), c["l"] + c["r"]).alias("score"), i.alias("i"), c["l"].alias("l"), c["r"].alias("r")))
        kept = kept.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.array_min(scored).alias("best"))
        kept = kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
        out = kept if out is None else out.unionByName(kept)
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    some = out.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(sizes.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")
