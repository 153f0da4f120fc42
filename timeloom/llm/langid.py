"""Language identification by bit-sliced Bloom filters of byte n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timeloom.llm.common import LOWER, held_out, mix, slices, utf8

#: The classifier is fitted on about so many documents of each language, chosen by a hash of their ids.
SAMPLE_PER_LANGUAGE = 4000
#: Commonest n-grams of each language that go into its filter; n-gram length in bytes; hash functions; filter positions for each n-gram.
GRAMS, LENGTH, HASHES, ROOM = 6000, 4, 3, 24
LETTER = regex.compile(r"\p{L}")
#: a-z and bytes of longer UTF-8 sequences stay, all else is a blank.
FOLD = LOWER.copy()
FOLD[[b for b in range(128) if not 97 <= LOWER[b] <= 122]] = 32


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of all texts as integers, one after another, and how many each text has; those of blanks only are left out."""
    data, off = utf8(text)
    data = FOLD[data].astype(np.uint32)
    n = max(0, len(data) - LENGTH + 1)
    g = np.zeros(n, np.uint32)
    for j in range(LENGTH):
        g = (g << np.uint32(8)) | data[j : j + n]
    good = g != np.uint32(0x20202020)
    for j in range(1, LENGTH):  # n-grams that run into the next text
        at = off[1:] - j
        good[at[(at >= 0) & (at < n)]] = False
    sums = np.concatenate([[0], np.cumsum(good)])
    return g[good], np.diff(sums[np.minimum(off, n)])


@dataclass
class Filters:
    """Row r of `bits` holds bit l where language l has an n-gram that hashes there: one lookup answers for up to 64 languages; more take further words."""

    languages: list[str]
    bits: np.ndarray
    common: int = 0

    @classmethod
    def build(cls, found: dict[str, np.ndarray], common: str | None = None) -> Filters:
        names = sorted(found)
        size = 1 << int(np.ceil(np.log2(max(64, ROOM * max([1, *map(len, found.values())])))))
        bits = np.zeros((-(-max(1, len(names)) // 64), size), np.uint64)
        for k, name in enumerate(names):
            for at in cls.places(found[name], size):
                bits[k // 64, at] |= np.uint64(1 << (k % 64))
        return cls(names, bits, names.index(common) if common in names else 0)

    @staticmethod
    def places(g: np.ndarray, size: int) -> list[np.ndarray]:
        h = mix(g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        return [((h >> np.uint64(21 * i)) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]

    def false_rates(self) -> np.ndarray:
        """Of each language: the chance that an n-gram it doesn't have seems to be there."""
        return np.array([float((self.bits[k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean()) ** HASHES for k in range(len(self.languages))])

    def hits(self, g: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Languages by texts: how many of a text's n-grams each language's filter holds."""
        places = self.places(g, self.bits.shape[1])
        edges = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros((len(self.languages), len(count)))
        for w in range(len(self.bits)):
            mask = self.bits[w, places[0]]
            for at in places[1:]:
                mask &= self.bits[w, at]
            for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                sums = np.concatenate([[0], np.cumsum((mask >> np.uint64(k % 64)) & np.uint64(1), dtype=np.int64)])
                out[k] = sums[edges[1:]] - sums[edges[:-1]]
        return out

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: hits less the expected false ones, as a share; ties go to the first name, texts that hit nothing to the commonest language."""
        g, count = grams(text)
        lettered = np.array([bool(t and LETTER.search(t)) for t in text.to_pylist()], bool)
        if not self.languages:
            return ["und"] * len(count), np.zeros(len(count))
        rate = self.false_rates()[:, None]
        share = np.clip((self.hits(g, count) - rate * count) / (1 - rate + 1e-12), 0, None)
        best, total = share.argmax(axis=0), share.sum(axis=0)
        score = np.where(lettered & (total > 0), share[best, np.arange(len(count))] / np.maximum(total, 1e-12), 0.0)
        best = np.where(total > 0, best, self.common)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.clip(score, 0, 1)


def learn_filters(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, top: int = GRAMS, mod: int = 5) -> Filters:
    """Filters from text and lang of documents outside the held-out fold; a bounded sample of each language, whole texts. Without such documents, filters of no language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(mod)).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Filters.build({})
    share = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))]), F.col("lang"))
    taken = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    kind = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for part in slices(batches, most=1 << 22):
            lang = np.array(part.column("lang").to_pylist(), object)
            g, n = grams(part.column("text"))
            owner = np.repeat(np.arange(len(n)), n)
            for name in sorted(set(lang)):
                values, times = np.unique(g[(lang == name)[owner]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values, pa.int64()), pa.array(times, pa.int64())], schema=kind)

    counted = taken.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= top)
    rows = best.select("lang", "gram").toArrow()
    lang, gram = np.array(rows.column("lang").to_pylist(), object), np.asarray(rows.column("gram")).astype(np.uint32)
    return Filters.build({name: gram[lang == name] for name in sorted(set(lang))}, max(sorted(sizes), key=sizes.get))


def predict_languages(docs: DataFrame, filters: Filters | None = None, mod: int = 5) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, lang_pred, score.

    `und` with score 0 if text is null, empty or without a letter, and everywhere if there is nothing to learn from. Every n-gram of the whole text counts, however long
    it is; lang, source and doc_id don't. Ties go to the first name; a text that no filter knows gets the commonest language and score 0. A row that repeats is predicted
    as often as it stands; a null doc_id stays null and isn't held out. An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    filters = learn_filters(docs, mod=mod) if filters is None else filters
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for part in slices(batches):
            names, score = shared.value.predict(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)], schema=kind)

    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(mod).alias("held_out"), "text")
    return small.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
