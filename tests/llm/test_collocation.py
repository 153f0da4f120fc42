"""Collocations against brute force over all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.llm import collocation

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, least=30, longest=4, top=2000, scale=2_000_000, inside=80):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, p), a in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * a >= inside * f[lang, p[i : i + m]]:
                    covered.add((lang, p[i : i + m]))
    rows = {}
    for (lang, p), a in found.items():
        if (lang, p) not in covered:
            score, k = min((scale * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(rng, n, vocabulary=40, size=60):
    marks = ["", "", "", "", ".", ",", "\n", " ; ", "\r\n", "!", "\t"]
    words = [f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(n * size)]
    texts = []
    for i in range(n):
        part = words[i * size : (i + 1) * size]
        if rng.random() < 0.7:
            part[5:9] = ["New", "york", "stock", "Exchange"][: rng.randrange(2, 5)]
        texts.append((None if i % 11 == 3 else "  ".join(w + rng.choice(marks) for w in part).upper() if i % 5 == 0 else " ".join(w + rng.choice(marks) for w in part), [None, "en", "de", "und"][i % 7 % 4]))
    return texts


def frame(spark, docs):
    return spark.createDataFrame(docs, "text string, lang string").withColumn("slab", F.lit("x")).withColumn("f", F.lit(1))


@pytest.mark.parametrize("parts", [{}, {"slab_bytes": 500, "part_bytes": 1500, "octave_bytes": 300}])
def test_against_brute_force(spark, parts):
    docs = corpus(random.Random(4), 60) + [("a a a a a a b. a a", "aa")] * 8 + [("é ß é ß, É", "de")] * 9 + [("", "en"), (" .,; ", "en")]
    assert got(collocation.collocations(frame(spark, docs).repartition(5), least=4, top=25, **parts)) == brute(docs, 4, top=25)


def test_ids_beyond_the_first_tile(spark):
    docs = corpus(random.Random(9), 300, vocabulary=5000, size=80)
    want = brute(docs, 2)
    assert got(collocation.collocations(frame(spark, docs), least=2, slab_bytes=20_000, part_bytes=60_000, octave_bytes=9000)) == want
    words = Counter((lang, w) for text, lang in docs for w in re.findall(r"w\d+", (text or "").lower()))
    assert sum(n >= 2 for (lang, _), n in words.items() if lang == "en") > 1100


def test_other_lengths_and_one_long_text(spark):
    docs = [("one two three one two three, " * 4000, "en"), (None, None)]
    assert got(collocation.collocations(frame(spark, docs), longest=3)) == brute(docs, longest=3)
    assert got(collocation.collocations(frame(spark, docs), longest=2)) == brute(docs, longest=2)


def test_nothing_frequent(spark):
    assert got(collocation.collocations(frame(spark, []))) == []
    assert got(collocation.collocations(frame(spark, [("a b c", "en"), (None, None)]))) == []


def test_scores_beyond_64_bits(spark):
    a, both = 9 * 10**18, 9 * 10**18 + 7
    row = spark.createDataFrame([(a, both)], "a long, b long").select(collocation._score(2_000_000, F.col("a"), F.col("b"))).first()
    assert row[0] == 2_000_000 * a // both


@pytest.mark.parametrize("pieces", [1, 4, 64])
def test_tiles_part_the_ids(pieces):
    ids = np.unique(np.concatenate([np.arange(5000), 2 ** np.arange(38), 2 ** np.arange(1, 38) - 1]))
    tile, start, width = collocation.tiles(ids, pieces)
    assert ((start <= ids) & (ids < start + width)).all() and (np.diff(tile) >= 0).all()
    assert all(collocation.tile_bounds(int(t), pieces) == (s, w) for t, s, w in zip(tile, start, width, strict=True))


def test_dense_and_sorted_sums_agree():
    rng = np.random.default_rng(2)
    parts = []
    for _ in range(5):
        code, times = np.unique(rng.integers(0, 5000, 3000), return_counts=True)
        parts.append((collocation.squeeze_sorted(code), collocation.squeeze(times)))
    dense, by_sort = collocation.sum_tile(parts, 5000), collocation.sum_tile(parts, 1 << 40)
    assert all((x == y).all() for x, y in zip(dense, by_sort, strict=True))
