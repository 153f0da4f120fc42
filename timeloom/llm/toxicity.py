"""Toxicity by non-negative positive-unlabelled learning: a numpy classifier over words and word beginnings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import LOWER, cut, held_out, slices, utf8, word_hashes

#: Bounds of the training sample (documents, chosen by a hash of their ids) and of the features kept.
POSITIVES, UNLABELLED, FEATURES = 6000, 12000, 20000
#: Beginnings of words, in bytes, that are features beside the words.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
LEAST_DOCS, LEAST_LIFT, LEAST_GAIN = 3, 3.0, 15.0
#: a-z and bytes of longer UTF-8 sequences make words.
WORD = np.zeros(256, bool)
WORD[97:123] = WORD[128:] = True


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature) for every occurrence of every word and word beginning, as 64-bit hashes; then the texts' word counts."""
    data, off = utf8(text)
    data = LOWER[data]
    inside = np.concatenate([WORD[data], [False]])
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before = np.concatenate([[False], inside[:-1]]) & ~first
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(np.concatenate([[False], inside[:-1]]) & (~inside | first))
    owner = np.searchsorted(off, starts, "right") - 1
    out, who = [word_hashes(data, starts, ends)], [owner]
    for n in BEGINNINGS:
        long = ends - starts > n
        out.append(word_hashes(data, starts[long], starts[long] + n, seed=1))
        who.append(owner[long])
    return np.concatenate(who), np.concatenate(out), np.bincount(owner, minlength=len(text))


def length_value(n_words: np.ndarray) -> np.ndarray:
    return np.log1p(n_words) / 5


@dataclass
class Classifier:
    """Logistic over log2(1 + count) of the `known` features (sorted hashes) and, as last weight, the text's length."""

    known: np.ndarray
    weight: np.ndarray
    bias: float

    def __post_init__(self):
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.known >> np.uint64(42)).astype(np.int64)] = True

    def present(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text number, place among the known features) with their counts; word counts."""
        who, h, n_words = features(text)
        may = self.sieve[(h >> np.uint64(42)).astype(np.int64)]
        who, h = who[may], h[may]
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        hit = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        width = max(1, len(self.known))
        pair, count = np.unique(who[hit] * np.int64(width) + at[hit], return_counts=True)
        return pair // width, pair % width, count, n_words

    def score(self, text: pa.Array) -> np.ndarray:
        who, at, count, n_words = self.present(text)
        return sigmoid(self.bias + np.bincount(who, self.weight[at] * np.log2(1 + count), len(text)) + self.weight[-1] * length_value(n_words))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def nnpu_fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, positive: np.ndarray, width: int, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that lessen the non-negative risk  prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])  with the sigmoid loss l(+) = s(-z), l(-) = s(z), by Adam on all rows.

    rows, cols, values: the features' matrix; positive: which rows are confirmed, the others are unlabelled. Where the second term falls below 0, which no
    true risk can, it counts as 0 and gives no gradient. The iterate of least risk is returned.
    """
    n = len(positive)
    share_p, share_u = positive / max(1, positive.sum()), ~positive / max(1, (~positive).sum())
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    least, best = np.inf, theta
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(rows, theta[cols] * values, n)
        p = sigmoid(z)
        rest = (share_u - prior * share_p) @ p
        d_rest = (share_u - prior * share_p) * p * (1 - p)
        risk = prior * (share_p @ (1 - p)) + max(0.0, rest) + decay / 2 * (theta[:-1] @ theta[:-1])
        if risk < least:
            least, best = risk, theta.copy()
        d = -prior * share_p * p * (1 - p) + d_rest * (rest >= 0)
        g = np.append(np.bincount(cols, d[rows] * values, width), d.sum())
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return best[:-1], float(best[-1])


def train_classifier(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, most: int = FEATURES, mod: int = 5) -> Classifier:
    """A classifier from confirmed toxic documents and unlabelled text, both outside the held-out fold.

    A document whose id stands twice counts as often as it stands; of labels that contradict each other, toxic counts. Labels of clean documents only set the class prior (the toxic share of labelled rows); their texts count as unlabelled. The sample is bounded; a feature is kept if it
    stands in LEAST_DOCS positives, LEAST_LIFT times as often there as in unlabelled text, and its log-likelihood gain is more than chance gives among millions.
    """
    marks = labels.where(~held_out(mod) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = marks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("p")).first()
    n, p = count["n"], count["p"] or 0
    if not p:
        return Classifier(np.zeros(0, np.uint64), np.zeros(1), -3.0)
    prior = min(0.5, max(1e-3, p / n))
    total = docs.count()
    share = lambda k, of: F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < int(min(1.0, k / max(1, of)) * (1 << 24))
    rank = F.xxhash64("doc_id")
    chosen = marks.where("toxic = 1").orderBy(rank, "doc_id").limit(positives).select("doc_id").withColumn("positive", F.lit(True))  # at most `positives` rows
    pool = docs.where(F.col("text").isNotNull() & ~held_out(mod)).select("doc_id", "text")
    plain = pool.where(share(unlabelled, total)).withColumn("positive", F.lit(False))  # from all texts, so that the prior is theirs
    sample = pool.join(F.broadcast(chosen), "doc_id").select("text", "positive").unionByName(plain.select("text", "positive"))
    kind = pa.schema([("positive", pa.bool_()), ("f", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("words", pa.int64())])

    def describe(batches):
        for part in slices(batches, most=1 << 18):
            who, h, n_words = features(part.column("text"))
            order = np.lexsort((h, who))
            who, h = who[order], h[order]
            first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
            off = pa.array(np.searchsorted(who[first], np.arange(part.num_rows + 1)).astype(np.int32))
            count = np.diff(np.append(first, len(h))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("positive"), pa.ListArray.from_arrays(off, pa.array(h[first].view(np.int64))), pa.ListArray.from_arrays(off, pa.array(count)), pa.array(n_words, pa.int64())], schema=kind)

    table = cut(sample.mapInArrow(describe, "positive boolean, f array<long>, n array<int>, words long"))
    sizes = {r["positive"]: r["n"] for r in table.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return Classifier(np.zeros(0, np.uint64), np.zeros(1), -3.0)
    seen = table.select("positive", F.explode("f").alias("f")).groupBy("f").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    gain = F.col("p") * F.log((F.col("p") / n_p) / ((F.col("p") + F.col("u")) / (n_p + n_u)))
    lift = (F.col("p") / n_p) / ((F.col("u") + 1) / n_u)
    rows = seen.where((F.col("p") >= LEAST_DOCS) & (lift >= LEAST_LIFT) & (gain >= LEAST_GAIN)).orderBy(gain.desc(), "f").limit(most).select("f").toArrow()
    known = np.sort(np.asarray(rows.column("f")).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def places(batches):
        own = shared.value
        for batch in batches:
            flat = batch.column("f").flatten()
            off = np.concatenate([[0], np.cumsum(np.asarray(batch.column("f").value_lengths()))])
            h = np.asarray(flat).view(np.uint64)
            at = np.minimum(np.searchsorted(own, h), max(0, len(own) - 1))
            hit = own[at] == h if len(own) else np.zeros(len(h), bool)
            sums = pa.array(np.concatenate([[0], np.cumsum(hit)])[off].astype(np.int32))
            count = np.asarray(batch.column("n").flatten())[hit]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("words"), pa.ListArray.from_arrays(sums, pa.array(at[hit].astype(np.int32))), pa.ListArray.from_arrays(sums, pa.array(count))], schema=found)

    found = pa.schema([("positive", pa.bool_()), ("words", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
    got = table.mapInArrow(places, "positive boolean, words long, at array<int>, n array<int>").toArrow()
    lists, n = got.column("at").combine_chunks(), got.num_rows
    rows_at = np.concatenate([np.repeat(np.arange(n), np.asarray(lists.value_lengths()).astype(np.int64)), np.arange(n)])
    cols = np.concatenate([np.asarray(lists.flatten()).astype(np.int64), np.full(n, len(known))])
    values = np.concatenate([np.log2(1 + np.asarray(got.column("n").combine_chunks().flatten())), length_value(np.asarray(got.column("words")))])
    weight, bias = nnpu_fit(rows_at, cols, values, np.asarray(got.column("positive")).astype(bool), len(known) + 1, prior)
    return Classifier(known, weight, bias)


def toxicity_score(classifier: Classifier, spark) -> Column:
    """A column function: score of a text column, 0 to 1; null counts as empty."""
    shared = spark.sparkContext.broadcast(classifier)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        parts = [shared.value.score(part.column("text")) for part in slices([pa.RecordBatch.from_arrays([text], ["text"])], most=1 << 19)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, classifier: Classifier | None = None, mod: int = 5) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score, predicted (score >= 0.5).

    Null and empty texts get the score of a text without features; whole texts of any length are scored; rows that stand twice get the same score twice; an empty table
    of documents gives no rows; without toxic labels nothing is predicted toxic; other columns, whatever their names, are ignored.
    """
    classifier = train_classifier(docs, labels, mod=mod) if classifier is None else classifier
    score = toxicity_score(classifier, docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(mod).alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, mod: int = 5) -> DataFrame:
    """docs without the rows that a classifier trained on them and their labels rejects, all columns as they are.

    Rows with null or empty text are scored as texts without features; rows that stand twice go or stay together; an empty table stays empty.
    """
    score = toxicity_score(train_classifier(docs, labels, mod=mod), docs.sparkSession)
    return docs.where(score(F.coalesce("text", F.lit(""))) < 0.5)
