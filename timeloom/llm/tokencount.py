"""Token counts without token ids: pieces of each distinct pre-token once, joined to the pre-token frequencies of each document."""

from __future__ import annotations

import json
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import cut, pack, pack_small, slices, unpack, unpack_small, utf8
from timeloom.llm.lm import squeeze, unsqueeze

#: Broadcast: at most so many of the commonest pre-tokens, of at most so many bytes each. All others go through the join.
COMMON, COMMON_BYTES = 1 << 18, 48
#: Texts go through the first pass in slabs of about so many bytes, each with a dictionary of its own.
SLAB_BYTES = 2 << 20
#: Row groups of their table: a slab is half a megabyte in one row, and a reader takes a row group as a whole.
SLAB_FILES = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 8}
#: Texts of these characters alone are already in NFC, and both regular expression engines class them alike.
PLAIN = regex.compile("[\t-\r -~ -¬®-ſ]*")
#: The rules, beside the pattern of the split, for which plain texts are cut without the library.
PLAIN_RULES = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [{"type": "Split", "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
)


class PreTokenizer:
    """A tokenizer file's own normalizer and pre-tokenizer. Where the file has the very rules of PLAIN_RULES, plain texts take them by a compiled pattern; all else goes through the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation(), self.whole.no_padding()
        with open(path) as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.special = [t["content"] for t in added]
        self.odd = any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        rules = (spec.get("normalizer") or {}).get("normalizers", []), [{k: v for k, v in s.items() if k != "pattern"} for s in steps]
        self.pattern = None
        if rules == PLAIN_RULES and set(steps[0]["pattern"]) == {"Regex"} and not self.odd:
            self.pattern = regex.compile(steps[0]["pattern"]["Regex"])

    def normal(self, text: str) -> str:
        return self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special) or self.odd and any(s in self.normal(text) or self.normal(s) in self.normal(text) for s in self.special)

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, in the library's byte letters (after a 0) or for plain texts as they stand, and how many tokens it has beside them.

        A special string is one token and cuts the text; by rules other than the plain ones, a text that holds one is left to the library as a whole.
        """
        parts, special = [text], 0
        if self.special and self.has_special(text):
            if not self.pattern:
                return [], len(self.whole.encode(text, add_special_tokens=False).ids)
            parts = self.cut.split(text)
            special = len(parts) - 1
        out: list[str] = []
        for part in parts:
            if self.pattern and PLAIN.fullmatch(part):
                out += self.pattern.findall(part.lower())
            elif part:
                normal = self.normal(part)
                out += ["\0" + p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal)] if self.whole.pre_tokenizer else ["\0" + normal] * bool(normal)
        return out, special

    def count(self, pieces: list[str]) -> list[int]:
        """Model tokens of pre-tokens as pieces() gives them."""
        from tokenizers.pre_tokenizers import ByteLevel

        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        model = self.whole.model
        return [len(model.tokenize(p[1:] if p[:1] == "\0" else letters.pre_tokenize_str(p)[0][0])) for p in pieces]


_own: dict[str, PreTokenizer] = {}


def pre_tokenizer(path: str) -> PreTokenizer:
    if path not in _own:
        _own[path] = PreTokenizer(path)
    return _own[path]


SLAB = pa.schema([
    ("doc_id", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())),
    ("pairs", pa.binary()), ("times", pa.binary()), ("lengths", pa.binary()), ("letters", pa.binary()),
])
SLAB_SQL = "doc_id array<long>, n_bytes array<long>, known array<long>, pairs binary, times binary, lengths binary, letters binary"


def _slabs(path: str):
    """A row for each slab of documents: its dictionary of pre-tokens, and for each document the places there of its pre-tokens with their frequencies.

    Both are compressed here, not by the file alone: all slabs of a task cross to Python in one Arrow batch, which is then no larger than the task's part of the file.
    """

    def run(batches):
        own = pre_tokenizer(path)
        for part in slices(batches, most=SLAB_BYTES):
            both = [own.pieces(t) for t in part.column("text").to_pylist()]
            n = np.array([len(p) for p, _ in both], np.int64)
            flat = list(chain.from_iterable(p for p, _ in both))
            index = dict(zip(dict.fromkeys(flat), range(len(flat)), strict=False))
            place = np.fromiter(map(index.get, flat, repeat(-1)), np.int64, len(flat))
            pair, times = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(index)) + place, return_counts=True)
            letters, off = utf8(pa.array(list(index), pa.string()))
            packed = pack(pair.astype(np.uint64)), pack_small(times), pack_small(np.diff(off)), letters.tobytes()
            columns = part.column("doc_id").to_pylist(), part.column("n_bytes").to_pylist(), [s for _, s in both], *map(squeeze, packed)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(columns, SLAB, strict=True)], schema=SLAB)

    return run


def _dictionary(batch: pa.RecordBatch, i: int) -> pa.Array:
    """The pre-tokens of a slab."""
    lengths, letters = (unsqueeze(batch.column(c)[i].as_py()) for c in ("lengths", "letters"))
    off = np.concatenate([[0], np.cumsum(unpack_small(lengths))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off), pa.py_buffer(letters))


def _dictionaries(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays([_dictionary(batch, i)], ["piece"])


def _pieces_of(path: str):
    kind = pa.schema([("piece", pa.string()), ("n", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array(pre_tokenizer(path).count(batch.column("piece").to_pylist()), pa.int64())], schema=kind)

    return run


def _frequencies(common):
    """Of each document: tokens of special strings and common pre-tokens, and the frequencies of its other pre-tokens."""
    entry = pa.struct([("piece", pa.string()), ("n", pa.int32())])
    kind = pa.schema([("slab", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("rest", pa.list_(entry))])

    def run(batches):
        get = common.value.get
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, n_bytes, known = (batch.column(c).slice(i, 1).flatten() for c in ("doc_id", "n_bytes", "known"))
                pieces, n = _dictionary(batch, i), len(known)
                tokens = np.fromiter(map(get, pieces.to_pylist(), repeat(-1)), np.int64, len(pieces))
                owner, place = np.divmod(unpack(unsqueeze(batch.column("pairs")[i].as_py())).astype(np.int64), max(1, len(pieces)))
                times, found = unpack_small(unsqueeze(batch.column("times")[i].as_py())), tokens[place]
                total = np.asarray(known) + np.bincount(owner, np.where(found < 0, 0, found) * times, n).astype(np.int64)
                other = np.flatnonzero(found < 0)
                off = np.searchsorted(owner[other], np.arange(n + 1)).astype(np.int32)
                rest = pa.StructArray.from_arrays([pieces.take(pa.array(place[other])), pa.array(times[other].astype(np.int32))], fields=list(entry))
                rows = pa.array(np.arange(n, dtype=np.int32))
                slab = pa.array(np.full(n, batch.column("slab")[i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([slab, rows, doc_id, n_bytes, pa.array(total), pa.ListArray.from_arrays(pa.array(off), rest)], schema=kind)

    return run


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of counts (piece, n, tokens), those of the largest n; of the n at the bound, none. A histogram of n finds the bound, so nothing is sorted."""
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("step")).collect()  # 8 a power of two at most
    room, least = most, None
    for r in steps:
        if r["rows"] > room:
            break
        room, least = room - r["rows"], r["step"]
    return counts.where(F.lit(False) if least is None else F.floor(F.log2("n") * 8) >= least)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, common: int = COMMON) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    path: a tokenizers file that every executor can read. Texts are cut into pre-tokens once: a written table holds the frequencies of every document, by places in the
    dictionary of its slab. The model counts each distinct pre-token of the corpus once, and the frequencies meet these counts: the commonest pre-tokens (bounded in
    number and length) by broadcast, all others by a shuffled join.

    Null is an empty text, without tokens. A special string inside a text is one token, as the library's default has it. A text of any length is cut as a whole; a row
    that stands twice is counted twice. An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    slabs = cut(small.mapInArrow(_slabs(path), SLAB_SQL).withColumn("slab", F.monotonically_increasing_id()), **SLAB_FILES)
    found = slabs.select("lengths", "letters").mapInArrow(_dictionaries, "piece string").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))  # n: in how many slabs
    counts = cut(found.mapInArrow(_pieces_of(path), "piece string, n long, tokens long"))
    rows = commonest(counts.where(F.octet_length("piece") <= COMMON_BYTES), common).select("piece", "tokens").toArrow()
    table = dict(zip(rows.column("piece").to_pylist(), rows.column("tokens").to_pylist(), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    each = slabs.mapInArrow(_frequencies(shared), "slab long, row int, doc_id long, n_bytes long, known long, rest array<struct<piece:string,n:int>>")
    each = each.select("slab", "row", "doc_id", "n_bytes", "known", F.explode_outer("rest").alias("e"))
    joined = each.select("slab", "row", "doc_id", "n_bytes", "known", F.col("e.piece").alias("piece"), F.col("e.n").alias("times")).join(counts.select("piece", "tokens"), "piece", "left")
    total = joined.groupBy("slab", "row", "doc_id", "n_bytes", "known").agg(F.sum(F.coalesce(F.col("times") * F.col("tokens"), F.lit(0))).alias("more"))
    n = F.col("known") + F.col("more")
    return total.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
