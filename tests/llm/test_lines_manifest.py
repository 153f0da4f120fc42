"""Line dedup and the Merkle manifest against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timeloom.llm import linededup, merkle

LOWER = {c: c + 32 for c in range(65, 91)}
BLANK = " \t\n\x0b\x0c\r"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


# Cuckoo filter


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 3000), st.integers(0, 100))
def test_cuckoo_filter_holds_what_is_in_and_forgets_what_goes(seed, n, share):
    rng = np.random.default_rng(seed)
    keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    f = linededup.CuckooFilter.of(keys)
    assert f.contains(keys).all()
    gone = rng.random(len(keys)) * 100 < share
    f.delete(keys[gone])
    assert f.contains(keys[~gone]).all()
    f.delete(keys[~gone])
    assert not f.table.any() and not len(f.stash)


def test_cuckoo_filter_false_hits_are_rare():
    rng = np.random.default_rng(1)
    f = linededup.CuckooFilter.of(rng.integers(0, 2**63, 100_000, dtype=np.uint64))
    assert f.contains(rng.integers(0, 2**63, 100_000, dtype=np.uint64)).mean() < 0.001


def test_cuckoo_filter_stashes_keys_of_one_fingerprint():
    same = np.full(20, 7, np.uint64) + np.arange(20, dtype=np.uint64) * np.uint64(65535 << 40)
    f = linededup.CuckooFilter.of(same)
    assert len(f.stash) and f.contains(same).all()
    f.delete(same)
    assert not f.table.any() and not len(f.stash)


# Line dedup


def brute_lines(docs, min_docs=3, least=20):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    holders = {}
    for r, (doc, text) in enumerate(docs):
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), {})[r] = -1 if doc is None else doc
    top = {k: max(v.values()) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in docs:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if key(x) not in top or (-1 if doc is None else doc) == top[key(x)]]
        out.append((doc, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_docs(rng, n):
    pool = [f"  Line number {i} of a Common pool é {'x' * (i % 30)}" for i in range(12)] + ["short", "", "\t \r", "exactly twenty chars", "nineteen characters"]
    return [(i, None if i % 17 == 5 else "\n".join(rng.choice(pool).upper() if rng.random() < 0.2 else rng.choice(pool) + "\r" * (rng.random() < 0.2) for _ in range(rng.randrange(0, 9)))) for i in range(n)]


def got_lines(df):
    rows = df.collect()
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in rows)
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in rows], key=str)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_line_dedup_against_brute_force(spark):
    docs = line_docs(random.Random(3), 120) + [(None, "\n".join(["exactly twenty chars", "a line of the document without id"])), (7, "exactly twenty chars"), (7, "exactly twenty chars"), (500, "only line\n" * 4000 + "y" * 200_000)]
    df = frame(spark, docs).repartition(5).withColumn("slab", F.lit(1)).withColumn("top", F.lit("x"))
    assert got_lines(linededup.drop_repeated_lines(df, with_text=True)) == brute_lines(docs)


def test_line_dedup_of_nothing(spark):
    assert linededup.drop_repeated_lines(frame(spark, [])).collect() == []
    assert got_lines(linededup.drop_repeated_lines(frame(spark, [(1, None), (2, "")]), with_text=True)) == [(1, 1, 0, ""), (2, 1, 0, "")]


def test_inserts_and_deletions_are_as_if_built_at_once(spark):
    rng = random.Random(5)
    docs = line_docs(rng, 90)
    first, second = docs[:50], docs[50:]
    index = linededup.LineIndex.of(frame(spark, first).repartition(3), slab_bytes=600, shard_bytes=1000)
    both = index.insert(frame(spark, second).repartition(2))
    assert got_lines(both.result(True)) == brute_lines(docs)
    gone = {i for i, _ in docs if i % 3 == 0} | {89, 88}
    less = both.delete(frame(spark, [(i, None) for i in [*gone, 1000]]))
    rest = [d for d in docs if d[0] not in gone]
    assert got_lines(less.result(True)) == brute_lines(rest)
    back = less.insert(frame(spark, [d for d in docs if d[0] in gone]))
    assert got_lines(back.result(True)) == brute_lines(docs)
    assert got_lines(index.result(True)) == brute_lines(first)  # the first index stays as it was
    none = back.delete(frame(spark, [(i, None) for i, _ in docs]))
    assert none.result().collect() == []
    assert all(not any(r["filter"]) and not any(r["stash"]) for r in none.shards.collect())


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(doc_id, text, lang, source, n_chars):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(part(v) for v in (doc_id, source, lang, n_chars, text)))


def brute_tree(leaves):
    """Root, and each leaf's siblings level by level."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, p in zip(at, paths, strict=True):
            run = level[i - i % 8 : i - i % 8 + 8]
            p.append((run[: i % 8], run[i % 8 + 1 :]))
        level, at = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)], [i // 8 for i in at]
    return level[0], paths


def brute_manifest(docs):
    trees = {}
    for row in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(*r))):
        trees.setdefault(b"\0" if row[2] is None else b"\1" + row[2].encode(), []).append(row)
    names = sorted(trees)
    if not names:
        return []
    own = {t: brute_tree([brute_leaf(*r) for r in trees[t]]) for t in names}
    root, top = brute_tree([own[t][0] for t in names])
    out = []
    for t, above in zip(names, top, strict=True):
        for row, path in zip(trees[t], own[t][1], strict=True):
            doc, text = row[0], row[1]
            changed = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
            cur = brute_leaf(doc, text.translate(LOWER) if changed and text is not None else text, *row[2:])
            for before, after in path + above:
                cur = sha("".join([*before, cur, *after]))
            out.append((doc, brute_leaf(*row), own[t][0], root, sha("".join("".join(b + a) for b, a in path + above)), cur, cur == root))
    return sorted(out, key=str)


def checked(df):
    return sorted([tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


def manifest(spark, docs, height):
    from timeloom.llm.common import held_out

    df = spark.createDataFrame(docs, KIND).repartition(4).withColumn("block", F.lit(3)).withColumn("tree", F.lit("t"))
    return merkle.dataset_manifest(df, {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}, held_out(3), height)


def some_docs(n, langs):
    return [(i, None if i % 13 == 4 else f"Text {i} é\n" * (i % 4), langs[i % len(langs)], None if i % 5 == 0 else "web", i) for i in range(n)]


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest_against_brute_force(spark, height):
    docs = some_docs(180, ["en", "de", None, "é", "en", "en", ""]) + [(900, "alone", "xx", "s", 5), (3, "same id", "en", "s", 1), (3, "same id", "en", "s", 1), (None, "no id", "en", None, None), (901, "long " * 60_000, "en", "s", 1)]
    assert checked(manifest(spark, docs, height)) == brute_manifest(docs)


@pytest.mark.parametrize("docs", [[], [(1, "A", None, None, None)], some_docs(8, ["en"]), some_docs(9, ["en"]), some_docs(65, ["en"])])
def test_small_manifests(spark, docs):
    assert checked(manifest(spark, docs, 1)) == brute_manifest(docs)


def test_many_trees(spark):
    docs = some_docs(90, [f"l{i:02}" for i in range(75)])
    assert checked(manifest(spark, docs, 1)) == brute_manifest(docs)


def postorder(n):
    """Nodes (height, index) in order of completion when leaves come one by one and the rest is closed at the end."""
    top = merkle.tree_height(n)

    def visit(h, j):
        if h:
            for c in range(8 * j, 8 * j + 8):
                if c << 3 * (h - 1) < n:
                    yield from visit(h - 1, c)
        yield h, j

    return list(visit(top, 0))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 72, 73, 512, 513, 700])
def test_positions_are_the_order_of_completion(n):
    order = postorder(n)
    assert [int(merkle.position(h, np.int64(j), n, merkle.tree_height(n))) for h, j in order] == list(range(len(order)))


def test_the_tiers_make_one_log_a_tree(spark):
    docs = some_docs(150, ["en", "en", "de"])
    built = merkle.build(merkle.leaf_table(spark.createDataFrame(docs, KIND)), 1)
    rows = merkle.append_log(built).collect()
    for lang in ("en", "de"):
        own = sorted((r.position, r.height, bytes(r.digest).hex()) for r in rows if bytes(r.tree) == b"\1" + lang.encode())
        leaves = [brute_leaf(*r) for r in docs if r[2] == lang]
        assert [(p, h) for p, h, _ in own] == [(i, h) for i, (h, _) in enumerate(postorder(len(leaves)))]
        assert own[-1][2] == brute_tree(leaves)[0] and [d for _, h, d in own if h == 0] == leaves


def test_a_claim_that_differs_is_found_and_proofs_can_be_had(spark):
    docs = some_docs(40, ["en", "de"])
    df = spark.createDataFrame(docs, KIND)
    out = merkle.dataset_manifest(df, {"source": F.lit("other")}, F.col("doc_id") == 7, height=1, with_proof=True).collect()
    assert [r.doc_id for r in out if not r.verified] == [7]
    assert all(sha("".join(r.proof)) == r.proof_sha256 for r in out)
