"""Exact, near and substring dedup against brute force, and the cases of nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.llm import exact, neardup, substring
from timeloom.llm.common import pack, pack_small, unpack, unpack_small, word_hashes
from timeloom.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, digest string, n long, member long, block long"


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(40, 120))) for _ in range(12)]
    docs = []
    for i in range(60):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs.append((i, " ".join(words) + rng.choice(["", " ", "\n"])))
    shared = " ".join(rng.choice(vocab) for _ in range(50))
    docs += [(60 + i, " ".join(rng.choice(vocab) for _ in range(20)) + " " + shared + " " + " ".join(rng.choice(vocab) for _ in range(20))) for i in range(6)]
    docs += [(100, None), (101, ""), (102, " \n\t"), (103, "one two"), (104, "ONE two"), (105, "x" * 200_000), (106, "in " * 3000), (107, None), (103, "one two"), (None, "lonely words here"), (108, "é Ü ß é")]
    return docs


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "d", 1, 2, 3) for i, t in rows], KIND)


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def test_exact_groups(spark):
    rows = corpus()
    got = exact.exact_duplicates(frame(spark, rows), fan_in=2).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = collections.Counter()
    for k, v in groups.items():
        best = min(v)
        for x in v:
            want[x[3], best[3], len(v), x[:2] == best[:2] and x[3] == best[3], hashlib.sha256(k.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_filter_keeps_one_row_of_each_group_with_its_columns(spark):
    rows = corpus()
    kept = exact.drop_exact_duplicates(frame(spark, rows))
    assert kept.columns == [c.split()[0] for c in KIND.split(", ")]
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows}


def test_exact_ties_and_many_runs(spark):
    rows = [(1, "a b"), (1, "ab "), (1, " ab"), (1, "a b"), (2, "a  b"), (None, "zz"), (None, "zz"), (3, "zz")] * 3 + [(9, f"t{i % 7}") for i in range(100)]
    df = frame(spark, rows).repartition(27)
    for fan_in in (2, 3, 8):
        kept = exact.drop_exact_duplicates(df.withColumn("row", F.lit("r")).withColumn("run", F.lit(0)), fan_in).collect()
        assert sorted((r.doc_id, r.text, r.row) for r in kept if r.doc_id != 9) == [(2, "a  b", "r"), (3, "zz", "r")] and sorted(r.text for r in kept if r.doc_id == 9) == [f"t{i}" for i in range(7)]
        assert {(r.keep_id, r.group_size) for r in exact.exact_duplicates(df, fan_in).collect() if r.doc_id != 9} == {(2, 15), (3, 9)}
    same = [(1, "b a"), (1, "ba "), (1, " ba")]
    first = {exact.drop_exact_duplicates(frame(spark, order)).first().text for order in (same, same[::-1], same[1:] + same[:1])}
    assert len(first) == 1


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize("block", [4, 256])
def test_near_components(spark, block):
    rows = corpus(1)
    want = components(rows)
    got = neardup.near_duplicates(frame(spark, rows), block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
    sizes = {(i, len(shingles(t))) for i, t in rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_a_large_group_is_checked_in_parts(spark):
    """Copies with edits of one text, some of them too far from all others: every check stays small, links are those of brute force."""
    rng = random.Random(8)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2]) if i % 10 else 4):
            words[rng.randrange(60)] = f"u{rng.randrange(10_000)}"
        rows.append((1000 - i, " ".join(words)))
    want = components(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), block=8).collect()}
    assert got == want and len(set(want.values())) > 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sets_within_the_limit_share_a_rare_shingle(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 3, 1 << neardup.SLOT_BITS)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64) * np.uint64(2))
        a, b = (np.sort(rng.permutation(pool)[: rng.integers(1, 60)]) for _ in range(2))
        common = len(np.intersect1d(a, b))
        for percent in (30, 75, 100):
            if 100 * common >= percent * (len(a) + len(b) - common):
                assert len(np.intersect1d(neardup.rarest(a, counts, percent), neardup.rarest(b, counts, percent)))
    assert len(neardup.rarest(np.zeros(0, np.uint64), counts, 75)) == 0


def template_rows(n, links=0, seed=5):
    """n texts of one template, each with as much of its own (similarity about 0.5); the first `links` of them have a near copy besides."""
    rng = random.Random(seed)
    same, rows = " ".join(f"t{i}" for i in range(60)), []
    for i in range(n):
        own = [f"o{rng.randrange(1 << 40)}" for _ in range(30)]
        rows.append((2 * i, same + " " + " ".join(own)))
        if i < links:
            rows.append((2 * i + 1, same + " " + " ".join([*own[:-1], "edited"])))
    return rows


def test_members_that_link_with_nothing_are_not_checked_across_blocks(spark, monkeypatch):
    dealt = []
    checked = neardup._checked
    monkeypatch.setattr(neardup, "_checked", lambda rows, *more: dealt.append(rows.count()) or checked(rows, *more))
    work = {}
    for n in (1000, 4000):
        dealt.clear()
        out = neardup.near_duplicates(frame(spark, template_rows(n)), block=32)
        assert out.where("kept").count() == n
        work[n] = sum(dealt)
        assert dealt[1] == 0
    assert work[4000] < 5 * work[1000]


def test_links_inside_a_group_of_strangers_are_found(spark):
    rows = template_rows(150, 40)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), block=8).collect()}
    assert got == components(rows) and len(set(got.values())) == 150


def test_near_filter_keeps_one_row_of_a_repeated_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (1, text + " more"), (2, text), (3, "alone here"), (3, "alone here"), (None, "x"), (None, "x"), (4, None), (5, "")]
    kept = neardup.drop_near_duplicates(frame(spark, rows))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "x"), (0, "x"), (1, text + " more"), (3, "alone here"), (4, ""), (5, "")]
    assert kept.columns == [c.split()[0] for c in KIND.split(", ")] and neardup.drop_near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_hub_and_its_rims(spark):
    import timeloom.llm.components as module

    old, module.HEAVY = module.HEAVY, 4
    try:
        edges = [(0, i) for i in range(1, 300)] + [(i, 1000 + i) for i in range(1, 50)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7)]
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    finally:
        module.HEAVY = old
    assert all(got[i] == 0 for i in [*range(300), *range(1001, 1050)]) and {got[i] for i in (5000, 5001, 5002)} == {5000} and len(got) == 300 + 49 + 3


def test_near_filter(spark):
    rows = [r for r in corpus(2) if r[0] is not None]
    want = components(rows)
    kept = neardup.drop_near_duplicates(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}


def test_signature_coordinates_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 800).astype(np.uint64))
    b = np.unique(np.concatenate([a[:600], rng.integers(0, 1 << 63, 200).astype(np.uint64)]))
    same = (neardup.signature(a, 512) == neardup.signature(b, 512)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.08


def test_substring_windows(spark):
    rows = corpus(3)
    words = [WORD.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = collections.Counter()
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i, len(w), sum(gone), kept] += 1
    assert sum(k[2] for k in want) > 0
    got = substring.remove_repeated_windows(frame(spark, rows), with_text=True, block_bytes=60_000, bucket_entries=200).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got)
    assert all(sum(x.last_word - x.first_word + 1 for x in r.removed) == r.n_removed for r in got)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact.exact_duplicates(none).count() == exact.drop_exact_duplicates(none).count() == neardup.near_duplicates(none).count() == substring.remove_repeated_windows(none).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500


def test_packing():
    rng = np.random.default_rng(1)
    v = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (unpack(pack(v)) == v).all() and (unpack_small(pack_small(v.astype(np.int64) % 70000)) == v.astype(np.int64) % 70000).all()


def test_words_made_to_cancel_out_have_different_hashes(spark):
    """Thue-Morse words and their complements, on which polynomials modulo 2**64 agree."""
    signs = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = "".join("ab"[x] for x in signs), "".join("ba"[x] for x in signs)
    rows = [(1, " ".join([one] * 40)), (2, " ".join([two] * 40))]
    pattern = [(one, two)[x] for x in signs[:32]]
    rows += [(3, " ".join(["x", *pattern, "y", "z", "u"])), (4, " ".join(["x", *((two, one)[x] for x in signs[:32]), "y", "z", "u"]))]
    got = {r.doc_id: r.n_removed for r in substring.remove_repeated_windows(frame(spark, rows)).collect()}
    assert got == {1: 40, 2: 40, 3: 0, 4: 0}  # 1 and 2 repeat themselves
    alone = [(1, " ".join(f"{one}{i}" for i in range(40))), (2, " ".join(f"{two}{i}" for i in range(40)))]
    assert [r.n_removed for r in substring.remove_repeated_windows(frame(spark, alone)).collect()] == [0, 0]


def test_hashes_with_one_value_and_two_checks_stay_apart():
    values = np.array([7, 5, 7, 5, 7], np.uint64)
    v, c, inverse, count = substring.distinct(values, np.array([1, 1, 2, 1, 1], "<u4"))
    assert v.tolist() == [5, 7, 7] and c.tolist() == [1, 1, 2] and inverse.tolist() == [1, 0, 2, 0, 1] and count.tolist() == [2, 2, 1]


def test_word_hashes_tell_lengths_and_contents_apart():
    words = [b"", b"a", b"a\0", b"\0", b"\0\0", b"abcdefgh", b"abcdefghi", b"abcdefgh\0", b"x" * 64, b"x" * 65, b"x" * 66, b"x" * 64 + b"y"]
    ends = np.cumsum([len(w) for w in words])
    h = word_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert len(set(h.tolist())) == len(words)
