"""Language-model scores: Katz backoff of any order over Good-Turing discounted n-gram counts.

Counts live in tables, one for each order, dealt out to buckets by a hash of the context. Blocks of documents send their distinct n-grams once, order by order; a bucket
adds up, stores what it has and answers in the order it was asked; blocks go on to the next order with the answers, and score at last. A context that makes up more than
1 / HOT of all tokens is spread over all buckets by (context, word); of these there are at most HOT an order, and their parts are summed and broadcast.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm.common import LOWER, bucket_bits, cut, grown, held_out, mix, pack, pack_small, packed_blocks, scratch_dir, slices, text_bytes, unpack, unpack_small, unpacked, utf8, word_hashes, words

ORDER = 2
END, START = np.uint64(1), np.uint64(1 << 63)
ADD = 0.1
#: Counts above LAST aren't discounted.
LAST, HOT = 5, 1000
#: Of a context: how many words follow it 1 .. LAST times; how many oftener, and how often together. Beside these, the lower order's probability of all that follow it.
STATS = LAST + 2
#: Word numbers take WORD_BITS under a context's; an unknown word has the largest.
WORD_BITS = 40
UNKNOWN = (1 << WORD_BITS) - 1


def block_tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then END) and where each text's begin."""
    parts, counts = [], []
    for part in slices([table]):
        data, off = utf8(part.column("text"))
        data = LOWER[data]
        starts, ends, at = words(data, off)
        parts.append(np.insert(word_hashes(data, starts, ends), at[1:], END))
        counts.append(np.diff(at) + 1)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


_zstd = pa.Codec("zstd", compression_level=1)


def squeeze(raw: bytes) -> bytes:
    """Compressed by an entropy coder, which what Spark compresses its shuffles with has not."""
    return len(raw).to_bytes(8, "little") + _zstd.compress(raw, asbytes=True)


def unsqueeze(raw: bytes) -> bytes:
    return _zstd.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def put(values: np.ndarray) -> bytes:
    return squeeze(pack(values))


def get(raw: bytes) -> np.ndarray:
    return unpack(unsqueeze(raw))


def put_small(values: np.ndarray) -> bytes:
    return squeeze(pack_small(values))


def get_small(raw: bytes) -> np.ndarray:
    return unpack_small(unsqueeze(raw))


def _leading(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _cuts(key: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Of a sorted key: its distinct values, and where each begins and ends."""
    names, first = np.unique(key, return_index=True)
    return names, first.tolist(), [*first[1:].tolist(), len(key)]


def _rows(rows: list[tuple], kind: pa.Schema) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kind), kind.types, strict=True)], schema=kind)


def good_turing(seen: list[int]) -> np.ndarray:
    """Factor for counts 0 .. LAST + 1 (the last for all above): Katz's discounts from counts of counts; where these are too few for them, (r - 0.5) / r."""
    out = np.ones(LAST + 2)
    tail = (LAST + 1) * seen[LAST] / seen[0] if seen[0] else 1.0
    for r in range(1, LAST + 1):
        d = (((r + 1) * seen[r] / (r * seen[r - 1])) - tail) / (1 - tail) if seen[r - 1] and tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass
class Level:
    """What every task needs of one order beside its table; of bounded size."""

    discount: np.ndarray
    hot: np.ndarray
    hot_stats: np.ndarray
    hot_lower: np.ndarray

    def katz(self, total: np.ndarray, lower: np.ndarray, stats: np.ndarray, lower_sum: np.ndarray) -> np.ndarray:
        """Probability of n-grams: discounted if seen, else the lower order's probability times the context's backoff weight, which makes the whole sum to 1.

        At least half a count of each context is left for unseen words; a context that was never seen backs off wholly.
        """
        r = np.arange(1, LAST + 1)[:, None]
        n = (stats[:LAST] * r).sum(axis=0) + stats[LAST + 1]
        known = np.maximum(n, 1)
        mass = ((self.discount[1 : LAST + 1, None] * r * stats[:LAST]).sum(axis=0) + stats[LAST + 1]) / known
        scale = np.minimum(1.0, (1 - 0.5 / (n + 1)) / np.maximum(mass, 1e-300))
        weight = np.where(n > 0, (1 - scale * mass) / np.maximum(1 - lower_sum, 1e-300), 1.0)
        seen = scale * self.discount[np.minimum(total, LAST + 1)] * total / known
        return np.where((total > 0) & (n > 0), seen, weight * lower)


@dataclass
class Model:
    """Tokens and distinct words of the training text, and a Level for each order from 2."""

    tokens: int
    words: int
    bits: int
    levels: list[Level]

    @property
    def limit(self) -> float:
        return self.tokens / HOT

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + ADD) / (self.tokens + ADD * (self.words + 1))


# Words: the first order.


def _send_words(bits: int):
    kind = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        docs = unpacked(table)
        tokens, at = block_tokens(docs)
        train = np.repeat(np.asarray(docs.column("train")).astype(bool), np.diff(at))
        values, inverse = np.unique(tokens, return_inverse=True)
        count = np.bincount(inverse, train, len(values)).astype(np.int64)
        block = table.column("block")[0].as_py()
        return _rows([(b, block, put(values[i:j]), put_small(count[i:j])) for b, i, j in zip(*_cuts(_leading(values, bits)), strict=True)], kind)

    return run


WORD_ANSWERS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("totals", pa.binary()), ("numbers", pa.binary()), ("hashes", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
WORD_ANSWERS_SQL = "bucket long, block long, totals binary, numbers binary, hashes binary, n long, v long"


def _answer_words(bits: int):
    """Of one bucket: each word's total and number; the row of block -1 is the bucket's part of the table.

    A word's number is its rank in the bucket by count, times the number of buckets, plus the bucket's: about its rank of all, so that common words have short numbers.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket, lists = table.column("bucket")[0].as_py(), [get(x) for x in table.column("hashes").to_pylist()]
        values, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([get_small(x) for x in table.column("counts").to_pylist()])).astype(np.int64)
        number = np.empty(len(values), np.int64)
        number[np.lexsort((values, -total))] = (np.arange(len(values)) << bits) + bucket + 1
        ends = np.cumsum([len(x) for x in lists])[:-1]
        rows = [(bucket, block, put_small(t), put_small(k), None, 0, 0) for block, t, k in zip(table.column("block").to_pylist(), np.split(total[inverse], ends), np.split(number[inverse], ends), strict=True)]
        known = total > 0
        rows.append((bucket, -1, put_small(total[known]), put_small(number[known]), put(values[known]), int(total.sum()), int(known.sum())))
        return _rows(rows, WORD_ANSWERS)

    return run


def _look_up_words(asked: pa.Table, table: pa.Table) -> pa.Table:
    """As _answer_words, from the stored table."""
    if not asked.num_rows:
        return WORD_ANSWERS.empty_table()
    values, total, number = (f(table.column(c)[0].as_py()) for f, c in ((get, "hashes"), (get_small, "totals"), (get_small, "numbers"))) if table.num_rows else (np.zeros(0, d) for d in (np.uint64, np.int64, np.int64))
    values, total, number = np.append(values, np.uint64(0)), np.append(total, 0), np.append(number, UNKNOWN)
    rows = []
    for bucket, block, packed in zip(*(asked.column(c).to_pylist() for c in ("bucket", "block", "hashes")), strict=True):
        own = get(packed)
        at = np.searchsorted(values[:-1], own)
        at = np.where(values[at] == own, at, len(values) - 1)
        rows.append((bucket, block, put_small(total[at]), put_small(number[at]), None, 0, 0))
    return _rows(rows, WORD_ANSWERS)


# Orders above the first, in blocks.


@dataclass
class Grams:
    """A block's distinct n-grams of one order, in the order in which buckets get them."""

    token: np.ndarray  # each token's place among them
    key: np.ndarray  # what names each as a context of the next order
    total: np.ndarray | None  # of each, in training text; known with the bucket's answer
    p: np.ndarray | None  # probability of the last word after the others
    bucket: np.ndarray | None = None
    context: np.ndarray | None = None
    word: np.ndarray | None = None
    lower: np.ndarray | None = None
    times: np.ndarray | None = None
    hot: np.ndarray | None = None
    starts: np.ndarray | None = None  # first n-gram of each (bucket, context)


def _first(values: np.ndarray, token: np.ndarray, answers: pa.Table, model: Model) -> tuple[Grams, np.ndarray]:
    """The block's words as n-grams of order 1, and their numbers."""
    order = np.argsort(np.asarray(answers.column("bucket")))
    join = lambda name: np.concatenate([get_small(x) for x in answers.column(name).take(pa.array(order)).to_pylist()])
    total, number = join("totals"), join("numbers")
    if len(total) != len(values):
        raise RuntimeError("rows were dealt out otherwise when they were read again")
    return Grams(token, number.astype(np.uint64), total, model.base(total)), number


def _next(below: Grams, number: np.ndarray, word: np.ndarray, at: np.ndarray, train: np.ndarray, model: Model) -> Grams:
    """The n-grams one word longer. A text's first tokens follow as many START as the order asks for."""
    before = np.concatenate([[0], below.token[:-1]])
    before[at[:-1]] = len(below.key)
    key, inverse = np.unique(before * np.int64(len(number) + 1) + word, return_inverse=True)
    del before
    times = np.bincount(inverse, train, len(key)).astype(np.int64)
    left, right = key // (len(number) + 1), key % (len(number) + 1)
    hot = np.append(below.total > model.limit, True)[left]
    context, last = np.append(below.key, START)[left], number[right]
    bucket = _leading(mix(np.where(hot, mix(context) ^ last.astype(np.uint64), mix(context))), model.bits)
    order = np.lexsort((last, context, bucket))
    place = np.empty(len(key), np.int64)
    place[order] = np.arange(len(key))
    del key, left, right
    token, bucket, context, last = place[inverse], bucket[order], context[order], last[order]
    lower = np.empty(len(order), np.float32)
    lower[token] = below.p[below.token]
    starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (context[1:] != context[:-1])]))
    return Grams(token, mix(mix(context + END) + last.astype(np.uint64)), None, None, bucket, context, last, lower, times[order], hot[order], starts)


def _answered(grams: Grams, answers: pa.Table, level: Level) -> Grams:
    """grams with totals and probabilities."""
    answers = answers.take(pa.array(np.argsort(np.asarray(answers.column("bucket")))))
    join = lambda lists: np.concatenate([get_small(x) for x in lists])
    packed = answers.column("stats").to_pylist()
    stats = np.stack([join([x[s] for x in packed]) for s in range(STATS)])
    lower = np.concatenate([_unplanes(x, np.float64) for x in answers.column("lower").to_pylist()])
    hot = grams.hot[grams.starts]
    at = np.minimum(np.searchsorted(level.hot, grams.context[grams.starts][hot]), max(0, len(level.hot) - 1))
    if len(level.hot):
        found = level.hot[at] == grams.context[grams.starts][hot]
        stats[:, hot], lower = np.where(found, level.hot_stats[:, at], 0), lower.copy()
        lower[hot] = np.where(found, level.hot_lower[at], 0.0)
    size = np.diff(np.append(grams.starts, len(grams.context)))
    grams.total = join(answers.column("totals").to_pylist())
    grams.p = level.katz(grams.total, grams.lower.astype(np.float64), np.repeat(stats, size, axis=1), np.repeat(lower, size))
    return grams


def _grams(docs: pa.Table, answers: pa.Table, order: int, model: Model) -> tuple[Grams, Grams, np.ndarray]:
    """(order 1, the given order, where texts begin); answered if the answers reach so far."""
    tokens, at = block_tokens(docs)
    train = np.repeat(np.asarray(docs.column("train")).astype(bool), np.diff(at))
    values, word = np.unique(tokens, return_inverse=True)
    del tokens
    of = np.asarray(answers.column("order"))
    first, number = _first(values, word, answers.filter(pa.array(of == 1)), model)
    grams = first
    for m in range(2, order + 1):
        grams = _next(grams, number, word, at, train, model)
        own = answers.filter(pa.array(of == m))
        if own.num_rows:
            grams = _answered(grams, own, model.levels[m - 2])
    return first, grams, at


MESSAGE = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("contexts", pa.binary()), ("hot", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("times", pa.binary()), ("lower", pa.binary())])
MESSAGE_SQL = "bucket long, block long, contexts binary, hot binary, sizes binary, words binary, times binary, lower binary"


def _planes(values: np.ndarray) -> bytes:
    """Byte plane by byte plane: leading bytes are alike, and compress."""
    return squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _unplanes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(unsqueeze(raw), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _send(order: int, shared):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return MESSAGE.empty_table()
        _, g, _ = _grams(unpacked(table), answers, order, shared.value)
        block, rows = table.column("block")[0].as_py(), []
        size = np.diff(np.append(g.starts, len(g.context)))
        for b, i, j in zip(*_cuts(g.bucket), strict=True):
            x, y = np.searchsorted(g.starts, [i, j])
            own = g.starts[x:y]
            lower = g.lower[i:j]
            if order == 2:  # of each distinct word once
                lower = lower[np.unique(g.word[i:j], return_index=True)[1]]
            rows.append((b, block, put(g.context[own]), np.packbits(g.hot[own]).tobytes(), put_small(size[x:y]), put_small(g.word[i:j]), put_small(g.times[i:j]), _planes(lower)))
        return _rows(rows, MESSAGE)

    return run


# Orders above the first, in buckets.

ANSWERS = pa.schema([
    ("bucket", pa.int64()), ("block", pa.int64()), ("totals", pa.binary()), ("stats", pa.list_(pa.binary())), ("lower", pa.binary()),
    ("contexts", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()),
    ("hot", pa.list_(pa.int64())), ("hot_stats", pa.list_(pa.int64())), ("hot_lower", pa.list_(pa.float64())), ("seen", pa.list_(pa.int64())),
])
ANSWERS_SQL = "bucket long, block long, totals binary, stats array<binary>, lower binary, contexts binary, sizes binary, words binary, hot array<long>, hot_stats array<long>, hot_lower array<double>, seen array<long>"


def _asked(table: pa.Table, names: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each message: places of its contexts among names (len(names) if not there), and a key for each n-gram."""
    spots, keys = [], []
    for contexts, sizes, own in zip(*(table.column(c).to_pylist() for c in ("contexts", "sizes", "words")), strict=True):
        context = get(contexts)
        at = np.searchsorted(names, context)
        at[at < len(names)] = np.where(names[at[at < len(names)]] == context[at < len(names)], at[at < len(names)], len(names))
        spots.append(at)
        keys.append(np.repeat(at, get_small(sizes)) << WORD_BITS | get_small(own))
    return spots, keys


def _answer(order: int):
    """Of one bucket: to each block the totals of its n-grams and the stats of their contexts; the row of block -1 is the bucket's part of the table."""

    def run(table: pa.Table) -> pa.Table:
        names = np.unique(np.concatenate([get(x) for x in table.column("contexts").to_pylist()]))
        spots, keys = _asked(table, names)
        values, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(inverse, np.concatenate([get_small(x) for x in table.column("times").to_pylist()])).astype(np.int64)
        lowers = [_unplanes(x, np.float32) for x in table.column("lower").to_pylist()]
        if order == 2:
            lowers = [x[np.unique(k & UNKNOWN, return_inverse=True)[1]] for x, k in zip(lowers, keys, strict=True)]
        lower = np.concatenate(lowers)[first].astype(np.float64)
        owner = values >> WORD_BITS
        stats = np.zeros((STATS, len(names)), np.int64)
        for r in range(1, LAST + 1):
            stats[r - 1] = np.bincount(owner[total == r], minlength=len(names))
        over = total > LAST
        stats[LAST], stats[LAST + 1] = np.bincount(owner[over], minlength=len(names)), np.bincount(owner[over], total[over], len(names))
        lower_sum = np.bincount(owner[total > 0], lower[total > 0], len(names))
        each = np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1])
        bucket, blank = table.column("bucket")[0].as_py(), [None] * 3 + [[]] * 4
        rows = [(bucket, block, put_small(t), [put_small(x[s]) for x in stats], _planes(lower_sum[s]), *blank) for block, t, s in zip(table.column("block").to_pylist(), each, spots, strict=True)]
        hot = np.unique(np.concatenate([s[np.unpackbits(np.frombuffer(h, np.uint8), count=len(s)).astype(bool)] for s, h in zip(spots, table.column("hot").to_pylist(), strict=True)]))
        known = total > 0
        size = np.bincount(owner[known], minlength=len(names))
        own = size > 0
        rows.append((
            bucket, -1, put_small(total[known]), [put_small(x[own]) for x in stats], _planes(lower_sum[own]), put(names[own]), put_small(size[own]), put_small(values[known] & UNKNOWN),
            names[hot].view(np.int64).tolist(), stats[:, hot].T.ravel().tolist(), lower_sum[hot].tolist(), [int((total == r).sum()) for r in range(1, LAST + 2)],
        ))
        return _rows(rows, ANSWERS)

    return run


def _look_up(asked: pa.Table, table: pa.Table) -> pa.Table:
    """As _answer, from the stored table."""
    if not asked.num_rows:
        return ANSWERS.empty_table()
    if table.num_rows:
        row = table.to_pylist()[0]
        names, size, own, total = get(row["contexts"]), get_small(row["sizes"]), get_small(row["words"]), get_small(row["totals"])
        stats, lower = np.stack([get_small(x) for x in row["stats"]]), _unplanes(row["lower"], np.float64)
    else:
        names, size, own, total, stats, lower = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros((STATS, 0), np.int64), np.zeros(0)
    keys = np.append(np.repeat(np.arange(len(size)), size) << WORD_BITS | own, -1)
    total, stats, lower = np.append(total, 0), np.append(stats, np.zeros((STATS, 1), np.int64), axis=1), np.append(lower, 0.0)
    rows = []
    for bucket, block, spots, want in zip(asked.column("bucket").to_pylist(), asked.column("block").to_pylist(), *_asked(asked, names), strict=True):
        at = np.searchsorted(keys[:-1], want)
        rows.append((bucket, block, put_small(np.where(keys[at] == want, total[at], 0)), [put_small(x[spots]) for x in stats], _planes(lower[spots]), *[None] * 3, *[[]] * 4))
    return _rows(rows, ANSWERS)


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, shared):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return SCORES.empty_table()
        model, docs = shared.value, unpacked(table)
        words_, g, at = _grams(docs, answers, order, model)
        count, first = words_.total[words_.token], at[:-1]
        return pa.table([
            docs.column("doc_id"), docs.column("held_out"), pa.array(np.diff(at)), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)), pa.array(np.full(docs.num_rows, model.tokens, np.int64)),
            pa.array(np.add.reduceat(np.log10(model.base(count)), first)), pa.array(np.add.reduceat(np.log10(g.p)[g.token], first)),
        ], schema=SCORES)

    return run


# Jobs.


def _blocks(docs: DataFrame, mod: int, block_bytes: int, train: bool) -> tuple[DataFrame, int]:
    """Packed texts by block, kept on executors' disks until unpersist(); and the bytes of all texts."""
    held = held_out(mod)
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), (~held if train else F.lit(False)).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    total = text_bytes(small)
    each, session = grown(block_bytes, total, 8), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-total // each), max(session, total >> 26)))  # fixed, so that what meets the blocks later is dealt out likewise and they needn't move
    return packed_blocks(small, total, each).repartition(parts, "block").persist(StorageLevel.DISK_ONLY), total


def _with_order(answers: DataFrame, order: int) -> DataFrame:
    """Answers to blocks, in the columns that all orders share."""
    none = {"numbers": "binary", "stats": "array<binary>", "lower": "binary"}
    own = [F.col(c) if c in answers.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()]
    return answers.where("block >= 0").select("bucket", "block", F.lit(order).alias("order"), "totals", *own)


def _level(table: DataFrame) -> Level:
    """Counts of counts and hot contexts of one order, at most HOT of these and the texts' beginnings."""
    whole = table.where("block = -1")
    seen = whole.select(*[F.sum(F.col("seen")[r]).alias(f"r{r}") for r in range(LAST + 1)]).first()
    each = whole.select(F.posexplode("hot").alias("k", "context"), "hot_stats", "hot_lower")
    each = each.select("context", F.col("hot_lower")[F.col("k")].alias("lower"), *[F.col("hot_stats")[F.col("k") * STATS + s].alias(f"s{s}") for s in range(STATS)])
    hot = each.groupBy("context").agg(F.sum("lower").alias("lower"), *[F.sum(f"s{s}").alias(f"s{s}") for s in range(STATS)]).toArrow()
    names = np.asarray(hot.column("context")).astype(np.int64).view(np.uint64)
    order = np.argsort(names)
    stats = np.stack([np.asarray(hot.column(f"s{s}")).astype(np.int64) for s in range(STATS)])[:, order] if len(names) else np.zeros((STATS, 0), np.int64)
    return Level(good_turing([x or 0 for x in seen]), names[order], stats, np.asarray(hot.column("lower")).astype(float)[order])


def _answers(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(kind).parquet(path)


def _run(blocks: DataFrame, order: int, bits: int, path: str, stored: str | None) -> tuple[Model, DataFrame]:
    """The model and all answers to blocks, order by order, written below path. From `stored`, what a former run has left there, or else from the blocks' own training text."""
    spark = blocks.sparkSession
    sent = blocks.groupBy("block").applyInArrow(_send_words(bits), "bucket long, block long, hashes binary, counts binary")
    if stored:
        table = _answers(spark, f"{stored}/order=1", WORD_ANSWERS_SQL).where("block = -1")
        done = sent.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(_look_up_words, WORD_ANSWERS_SQL)
    else:
        done = sent.groupBy("bucket").applyInArrow(_answer_words(bits), WORD_ANSWERS_SQL)
    done.write.parquet(f"{path}/order=1")
    words_ = _answers(spark, f"{path}/order=1", WORD_ANSWERS_SQL)
    size = _answers(spark, f"{stored or path}/order=1", WORD_ANSWERS_SQL).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    model, answers = Model(size["n"] or 0, size["v"] or 0, bits, []), _with_order(words_, 1)
    for m in range(2, order + 1):
        shared = spark.sparkContext.broadcast(model)
        asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_send(m, shared), MESSAGE_SQL)
        if stored:
            table = _answers(spark, f"{stored}/order={m}", ANSWERS_SQL).where("block = -1")
            done = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(_look_up, ANSWERS_SQL)
        else:
            done = asked.groupBy("bucket").applyInArrow(_answer(m), ANSWERS_SQL)
        done.write.parquet(f"{path}/order={m}")
        level = _level(_answers(spark, f"{stored or path}/order={m}", ANSWERS_SQL))
        model = Model(model.tokens, model.words, bits, [*model.levels, level])
        answers = answers.unionByName(_with_order(_answers(spark, f"{path}/order={m}", ANSWERS_SQL), m))
    return model, answers


def _scores(blocks: DataFrame, model: Model, answers: DataFrame) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    out = cut(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(len(model.levels) + 1, shared), SCORES_SQL))
    blocks.unpersist()
    return out


def score_documents(docs: DataFrame, order: int = ORDER, mod: int = 10, path: str | None = None, block_bytes: int = 6 << 20, bucket_entries: int = 1_000_000) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    Tokens are lower-cased words and one end; a text's first ones follow its beginning. Counts are those of all documents outside the held-out fold (a null id is outside).
    The first order gives a word (c + 0.1) / (N + 0.1 * (V + 1)), an unknown one the rest; each further order, up to `order`, discounts and backs off to the one below.
    Probabilities of lower orders are handed on in 32 bits, so scores are good to 7 digits. Contexts of two words or more are told apart by 64-bit hashes.

    path: a folder where the model's tables stay, one for each order, for score_with; the shared scratch folder if none is given. Null and empty texts are one end; rows
    that stand twice count twice and are scored twice; texts may have any length, each in one block as a whole; an empty table gives no rows; other columns are ignored.
    """
    blocks, total = _blocks(docs, mod, block_bytes, True)
    bits = bucket_bits(total // 8, grown(bucket_entries, total, 8))
    spark, path = docs.sparkSession, path or f"{scratch_dir(docs.sparkSession)}/lm-{uuid.uuid4().hex}"
    model, answers = _run(blocks, order, bits, path, None)
    spark.createDataFrame([(order, bits, mod)], "orders int, bits int, mod int").write.parquet(f"{path}/shape")
    return _scores(blocks, model, answers)


def score_with(docs: DataFrame, path: str, block_bytes: int = 6 << 20) -> DataFrame:
    """Scores as of score_documents for documents that the stored model at path hasn't seen; held_out is as in training."""
    spark = docs.sparkSession
    shape = spark.read.parquet(f"{path}/shape").first()
    blocks, _ = _blocks(docs, shape["mod"], block_bytes, False)
    model, answers = _run(blocks, shape["orders"], shape["bits"], f"{scratch_dir(spark)}/lm-{uuid.uuid4().hex}", path)
    return _scores(blocks, model, answers)
