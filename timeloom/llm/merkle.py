"""Merkle manifest of a dataset: aligned builders append each subtree's nodes in order of completion, and proofs address them by closed-form positions."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import cut, numbered

#: Children of a node, and its logarithm.
FAN, SHIFT = 8, 3
#: Columns that make a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def subtree_size(leaves, height: int):
    """Nodes of a subtree of that height over so many leaves."""
    return leaves + sum((leaves + (1 << SHIFT * k) - 1) >> SHIFT * k for k in range(1, height + 1))


def position(height: int, index, leaves: int, top: int):
    """Where the node `index` of a height stands in the log of a tree of that many leaves, whose root has height `top`.

    Before the first leaf of its subtree stand that many leaves and all inner nodes that are complete by then; its own subtree follows and it comes last.
    """
    first = index << SHIFT * height
    last = np.minimum((index + 1) << SHIFT * height, leaves)
    before = first + sum(first >> SHIFT * k for k in range(1, top + 1))
    return before + subtree_size(last - first, height) - 1


def tree_height(leaves: int) -> int:
    h = 0
    while leaves > 1:
        leaves, h = -(-leaves // FAN), h + 1
    return h


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def build_log(leaves: list[bytes], height: int) -> bytes:
    """The nodes over the leaves up to that height, 32 bytes each, in postorder."""
    log = np.zeros((int(subtree_size(len(leaves), height)), 32), np.uint8)
    level = b"".join(leaves).hex()
    for h in range(height + 1):
        n = len(level) // 64
        log[position(h, np.arange(n), len(leaves), height)] = np.frombuffer(bytes.fromhex(level), np.uint8).reshape(n, 32)
        level = "".join(_hash(level[i : i + 64 * FAN]) for i in range(0, len(level), 64 * FAN))
    return log.tobytes()


def siblings(log: bytes, leaves: int, height: int) -> list[list[tuple[str, str]]]:
    """For each leaf of a log, level by level, the digests (hex) that stand before and after it in its run."""
    nodes = np.frombuffer(log, np.uint8).reshape(-1, 32)
    levels = []
    for h in range(height):
        n = (leaves + (1 << SHIFT * h) - 1) >> SHIFT * h
        level = nodes[position(h, np.arange(n), leaves, height)].tobytes().hex()
        runs = [(level[64 * (j - j % FAN) : 64 * j], level[64 * (j + 1) : 64 * min(j - j % FAN + FAN, n)]) for j in range(n)]
        levels.append(runs)
    return [[level[i >> SHIFT * h] for h, level in enumerate(levels)] for i in range(leaves)]


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        digest = _hash(before + digest + after)
    return digest


def field(name: str, value: Column | None = None) -> Column:
    """A column as a part of the leaf: `-` for null, else its length in UTF-8 bytes, `:` and itself."""
    s = (F.col(name) if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(changed: dict[str, Column] | None = None) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(n, (changed or {}).get(n)) for n in FIELDS]), 256))


def leaf_table(docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """doc_id, tree, leaf, claimed: texts are hashed where they are read and don't move. claimed: the digest of the row as somebody else has it, with the columns of `changed` where `where` is true."""
    tree = F.when(F.col("lang").isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), F.col("lang").cast("string").cast("binary")))
    leaf = leaf_digest()
    claimed = leaf if not changed else F.when(where, leaf_digest(changed)).otherwise(leaf)
    return docs.select(*[F.col(n) for n in FIELDS]).select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf.alias("leaf"), claimed.alias("claimed"))


SEGMENT = pa.schema([
    ("tree", pa.binary()), ("block", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), ("height", pa.int32()), ("root", pa.binary()), ("log", pa.binary()),
    ("doc_id", pa.list_(pa.int64())), ("claimed", pa.list_(pa.binary())),
])
SEGMENT_SQL = "tree binary, block long, n long, size int, height int, root binary, log binary, doc_id array<long>, claimed array<binary>"


def _segment(span: int):
    """The log of one aligned block of at most span nodes: up to the whole span's height where its tree goes on above, else up to the tree's root."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        n, leaves = table.column("n")[0].as_py(), table.column("digest").to_pylist()
        height = tree_height(min(n, span))
        log = build_log(leaves, height)
        row = table.column("tree")[0].as_py(), table.column("block")[0].as_py(), n, len(leaves), height, log[-32:], log, table.column("doc_id").to_pylist(), table.column("claimed").to_pylist()
        return pa.table([pa.array([x], f.type) for x, f in zip(row, SEGMENT, strict=True)], schema=SEGMENT)

    return run


def tower(nodes: DataFrame, span: int) -> list[DataFrame]:
    """Tiers of segments over nodes (tree, index, n, digest, doc_id, claimed): the roots of a tier's segments are the nodes of the next, for trees of more than one segment."""
    tiers = []
    while True:
        blocks = nodes.withColumn("block", F.floor(F.col("index") / span).cast("long"))
        tiers.append(cut(blocks.groupBy("tree", "block").applyInArrow(_segment(span), SEGMENT_SQL)))
        open_ = tiers[-1].where(F.col("n") > span)
        if open_.isEmpty():
            return tiers
        nodes = open_.select("tree", F.col("block").alias("index"), F.ceil(F.col("n") / span).cast("long").alias("n"), F.col("root").alias("digest"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("claimed"))


def roots(tiers: list[DataFrame], span: int) -> DataFrame:
    """tree, root of every tree."""
    each = [t.where(F.col("n") <= span).select("tree", "root") for t in tiers]
    out = each[0]
    for t in each[1:]:
        out = out.union(t)
    return out


def _rows(batches):
    """Rows one by one: a segment is large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


@dataclass
class Manifest:
    """trees: tiers of segments over the rows, a tree for each lang; top: tiers over the trees' roots. All are written tables."""

    trees: list[DataFrame]
    top: list[DataFrame]
    span: int


def build(leaves: DataFrame, height: int = 4) -> Manifest:
    """The manifest of a leaf table. A builder's block is 8**height consecutive rows of a tree, numbered by doc_id (null first), then digest."""
    span = FAN**height
    rows = numbered(cut(leaves), ["tree"], ["doc_id", "leaf"]).withColumnRenamed("leaf", "digest")
    trees = tower(rows, span)
    subroots = numbered(roots(trees, span).select(F.lit(b"").alias("all"), "tree", "root"), ["all"], ["tree"])
    top = tower(subroots.select(F.col("all").alias("tree"), "index", "n", F.col("root").alias("digest"), F.lit(None).cast("long").alias("doc_id"), F.col("tree").alias("claimed")), span)
    return Manifest(trees, top, span)


def append_log(manifest: Manifest) -> DataFrame:
    """tree, position, height, digest of every node of the trees: the logs as one postorder log a tree."""
    span, up, kind = manifest.span, tree_height(manifest.span), pa.schema([("tree", pa.binary()), ("position", pa.int64()), ("height", pa.int32()), ("digest", pa.binary())])

    def rows(tier: int):
        def run(batches):
            for r in _rows(batches):
                nodes = np.frombuffer(r["log"], np.uint8).reshape(-1, 32)
                for h in range(1 if tier else 0, r["height"] + 1):
                    n = (r["size"] + (1 << SHIFT * h) - 1) >> SHIFT * h
                    own = nodes[position(h, np.arange(n), r["size"], r["height"])]
                    at = position(tier * up + h, r["block"] * (span >> SHIFT * h) + np.arange(n), r["leaves"], tree_height(r["leaves"]))
                    yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * n, pa.binary()), pa.array(at), pa.array([tier * up + h] * n, pa.int32()), pa.array([x.tobytes() for x in own], pa.binary())], schema=kind)

        return run

    sizes = manifest.trees[0].groupBy("tree").agg(F.first("n").alias("leaves"))
    out = None
    for tier, t in enumerate(manifest.trees):
        part = t.join(sizes, "tree").select("tree", "block", "leaves", "size", "height", "log").mapInArrow(rows(tier), "tree binary, position long, height int, digest binary")
        out = part if out is None else out.union(part)
    return out


PATH_SQL = "tree binary, block long, path array<string>, subroot binary, root binary"


def _descend(named: bool):
    """From segments with the path above them to a path for each node: of the segment in the tier below or, if named, of the tree whose root it is."""
    kind = pa.schema([("tree", pa.binary()), ("block", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.binary()), ("root", pa.binary())])

    def run(batches):
        for r in _rows(batches):
            paths = siblings(r["log"], r["size"], r["height"])
            own = [[x for pair in p for x in pair] + r["path"] for p in paths]
            first = r["block"] * r["span"]
            trees = r["claimed"] if named else [r["tree"]] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((trees, list(range(first, first + len(own))), own, [r["subroot"]] * len(own), [r["above"]] * len(own)), kind, strict=True)], schema=kind)

    return run


def _with_path(tier: DataFrame, span: int, whole: DataFrame, below: DataFrame | None) -> DataFrame:
    """A tier's segments with path, subroot and the root above: of whole trees by tree, of others by the place in the tier above."""
    ends = tier.where(F.col("n") <= span).join(whole.select("tree", "path", "subroot", F.col("root").alias("above")), "tree")
    if below is None:
        return ends
    return ends.unionByName(tier.where(F.col("n") > span).join(below.select("tree", "block", "path", "subroot", F.col("root").alias("above")), ["tree", "block"]))


def paths(tiers: list[DataFrame], span: int, whole: DataFrame, named: bool = False) -> DataFrame:
    """The first tier's segments with their path, found tier by tier from the roots down; or, if named, the path of each of its nodes."""
    below = None
    for k in range(len(tiers) - 1, -1, -1):
        ready = _with_path(tiers[k], span, whole, below)
        if k or named:
            below = ready.withColumn("span", F.lit(span)).mapInArrow(_descend(named and not k), PATH_SQL)
    return below if named else ready


CHECKED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _check(with_proof: bool):
    kind = pa.schema([("doc_id", pa.int64()), *((n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())] + [("proof", pa.list_(pa.string()))] * with_proof)

    def run(batches):
        for r in _rows(batches):
            root, above = r["above"].hex(), list(zip(r["path"][::2], r["path"][1::2], strict=True))
            own, cols = siblings(r["log"], r["size"], r["height"]), [[] for _ in kind]
            at = position(0, np.arange(r["size"]), r["size"], r["height"])
            leaves = np.frombuffer(r["log"], np.uint8).reshape(-1, 32)[at].tobytes().hex()
            for i, (doc, claimed) in enumerate(zip(r["doc_id"], r["claimed"], strict=True)):
                path = own[i] + above
                end = fold(claimed.hex(), path)
                row = [doc, leaves[64 * i : 64 * i + 64], r["subroot"].hex(), root, _hash("".join(b + a for b, a in path)), end, end == root]
                for c, x in zip(cols, [*row, [b + a for b, a in path]], strict=False):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], schema=kind)

    return run


def verify(manifest: Manifest, with_proof: bool = False) -> DataFrame:
    """A row for each row of the leaf table: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and proof if asked for (a text of siblings a level).

    The claimed digest is folded with the siblings on its way up; verified: it ends at the root.
    """
    span = manifest.span
    heads = roots(manifest.top, span).select("tree", F.array().cast("array<string>").alias("path"), F.col("root").alias("subroot"), "root")
    whole = paths(manifest.top, span, heads, named=True).drop("subroot", "block")
    whole = cut(whole.join(roots(manifest.trees, span).withColumnRenamed("root", "subroot"), "tree"))
    return paths(manifest.trees, span, whole).select("size", "height", "log", "doc_id", "claimed", "path", "subroot", "above").mapInArrow(_check(with_proof), CHECKED + ", proof array<string>" * with_proof)


def dataset_manifest(docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None, height: int = 4, with_proof: bool = False) -> DataFrame:
    """The manifest of docs and a check of every row against it; see verify() for the columns.

    A leaf is a digest of doc_id, source, lang, n_chars and text; each lang (null is one) is a tree of fan 8 over its rows by doc_id, null first; the trees' roots, null
    lang first, then by UTF-8 bytes, form the tree of the root. A lone node is its own root. Rows of equal doc_id stand by their digests; a row that stands twice is two
    leaves. Null and empty columns differ. Texts of any length are hashed whole where they are read. An empty table gives no rows; other columns are ignored.

    Rows are numbered by a sort over ranges, so a lang of any share is dealt over all tasks; a builder holds 8**height leaves, a proof goes down from tier to tier with the
    few siblings above it.
    """
    return verify(build(leaf_table(docs, changed, where), height), with_proof)
