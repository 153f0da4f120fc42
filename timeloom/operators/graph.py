"""Connected components of many small graphs at once (a mesh side of a frame, a mask of a frame). A graph, or a tile of a large one, is settled by union-find in one Arrow pass; rounds of
joins are left for what spans tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.plans.ranges import join_same
from timeloom.plans.scratch import cut

#: Edges of a graph, and pixels along a side of a tile, that one task settles at once.
EDGES, TILE = 1 << 20, 1024


def union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node each of n nodes reaches along edges (a, b): roots are hooked to lesser roots, paths are halved until nothing moves."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def by_groups(batches, made):
    """made() of rows that come in order of __group: always whole groups, many at once."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.asarray(batch.column("__group"))
        last = int(np.searchsorted(group, group[-1]))  # the last group may go on
        if waiting and (last or waiting[-1].column("__group")[-1].as_py() != group[0]) or last:
            yield made(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield made(pa.Table.from_batches(waiting))


def _settle(batches):
    """(group, a, b) edges, in order of group: each node of a group with the least node it reaches there. Whole groups go together, many at once."""

    def made(table: pa.Table) -> pa.RecordBatch:
        group, a, b = (np.asarray(table.column(c)) for c in ("__group", "a", "b"))
        names = np.unique(np.rec.fromarrays([np.concatenate([group, group]), np.concatenate([a, b])], names="g,n"))
        place = lambda x: np.searchsorted(names, np.rec.fromarrays([group, x], names="g,n"))
        root = union(len(names), place(a), place(b))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(names["g"])), pa.array(np.ascontiguousarray(names["n"])), pa.array(np.ascontiguousarray(names["n"][root]))], names=["__group", "node", "root"])

    yield from by_groups(batches, made)


def settled(edges: DataFrame, keys: list[str], part: Column) -> DataFrame:
    """keys, node, root: each node with the least one it reaches along edges (keys, a, b as longs) of its key and part."""
    split = edges.withColumn("__part", part)
    groups = split.select(*keys, "__part").distinct().withColumn("__group", F.monotonically_increasing_id())
    groups = cut(groups)  # numbers must be the same each time they are read
    ready = join_same(split, groups, [*keys, "__part"]).select("__group", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    roots = ready.repartition("__group").sortWithinPartitions("__group").mapInArrow(_settle, "__group long, node long, root long")
    return roots.join(groups, "__group").select(*keys, "node", "root")


def spread_components(edges: DataFrame, nodes: DataFrame, keys: list[str], most_rounds: int = 60) -> DataFrame:
    """keys, node, component by rounds of least-label propagation with pointer jumps, for graphs of any size."""
    links = cut(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(nodes.select(*keys, "node").distinct().withColumn("component", F.col("node")))
    for _ in range(most_rounds):
        near = join_same(links, label.select(*keys, F.col("node").alias("b"), F.col("component").alias("c")), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = join_same(label, near, [*keys, "node"], "left").withColumn("next", F.least("component", "c"))
        jump = step.select(*keys, F.col("node").alias("next"), F.col("next").alias("far"))
        new = cut(join_same(step, jump, [*keys, "next"], "left").select(*keys, "node", F.least("next", "far").alias("component"), F.col("component").alias("was")))
        if new.where("component <> was").isEmpty():
            return new.drop("was")
        label = new.drop("was")
    raise RuntimeError("components didn't settle")


def components(edges: DataFrame, nodes: DataFrame, keys: list[str], most_edges: int = EDGES) -> DataFrame:
    """keys, node, component: the least node reachable along edges (keys, a, b) between given nodes (keys, node).

    Keys of at most most_edges edges are settled by union-find, whole. The edges of larger ones are dealt out, each part leaves one edge a node, and rounds of joins settle
    these. A null key is a graph of its own; a table without nodes gives no rows.
    """
    given = nodes.select(*keys, "node").distinct()
    inside = join_same(edges.select(*keys, "a", "b"), given.withColumnRenamed("node", "a"), [*keys, "a"])
    inside = cut(join_same(inside, given.withColumnRenamed("node", "b"), [*keys, "b"]).where("a <> b"))
    large = cut(inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most_edges).select(*keys, F.ceil(F.col("__n") / most_edges).cast("long").alias("__parts")))
    dealt = join_same(inside, large, keys, "left") if keys else inside.crossJoin(large) if not large.isEmpty() else inside.withColumn("__parts", F.lit(None).cast("long"))
    first = settled(dealt, keys, F.pmod(F.xxhash64("a", "b"), F.coalesce("__parts", F.lit(1))))
    if not large.isEmpty():
        first = cut(first)
        star = join_same(first, large, keys) if keys else first.withColumn("__parts", F.lit(1))
        star = star.select(*keys, F.col("node").alias("a"), F.col("root").alias("b"))
        again = spread_components(star, star.select(*keys, F.col("a").alias("node")).unionByName(star.select(*keys, F.col("b").alias("node"))), keys)
        small = join_same(first, large.withColumn("__is", F.lit(1)), keys, "left").where("__is IS NULL").select(*keys, "node", F.col("root").alias("component")) if keys else None
        found = again if small is None else small.unionByName(again)
    else:
        found = first.withColumnRenamed("root", "component")
    kind = given.schema["node"].dataType
    return join_same(given, found.withColumn("node", F.col("node").cast(kind)), [*keys, "node"], "left").select(*keys, "node", F.coalesce(F.col("component").cast(kind), F.col("node")).alias("component"))


def small_component_filter(flags: DataFrame, edges: DataFrame, keys: list[str], min_size: int = 20) -> DataFrame:
    """keys, node, component, size of flagged vertices (keys, node) in components of min_size or more. edges: keys, a, b (sides of faces)."""
    c = components(edges, flags, keys)
    size = c.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return c.join(size, [*keys, "component"])


def face_edges(faces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b for the three sides of each face (keys, v1, v2, v3)."""
    sides = F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("v1", "v2"), ("v2", "v3"), ("v3", "v1"))])).alias("e")
    return faces.select(*keys, sides).select(*keys, "e.a", "e.b").distinct()


def _pixels(width: int):
    """(group, node) pixels, in order of group: each pixel's first pixel of its component within its group."""

    def made(table: pa.Table) -> pa.RecordBatch:
        group, node = np.asarray(table.column("__group")), np.asarray(table.column("node"))
        pixels = np.unique(np.rec.fromarrays([group, node], names="g,n"))
        a, b = [], []
        for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
            from_ = np.flatnonzero((pixels["n"] % width + dx >= 0) & (pixels["n"] % width + dx < width))
            want = np.rec.fromarrays([pixels["g"][from_], pixels["n"][from_] + dy * width + dx], names="g,n")
            at = np.minimum(np.searchsorted(pixels, want), len(pixels) - 1)
            hit = pixels[at] == want
            a.append(from_[hit]), b.append(at[hit])
        root = union(len(pixels), np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pixels["g"])), pa.array(np.ascontiguousarray(pixels["n"])), pa.array(np.ascontiguousarray(pixels["n"][root]))], names=["__group", "node", "root"])

    return lambda batches: by_groups(batches, made)


def pixel_components(mask: DataFrame, keys: list[str], width: int, tile: int = TILE) -> DataFrame:
    """keys, y, x, component: 8-neighbour components of a sparse mask; the component is named by its first pixel y * width + x.

    A tile of a frame, tile by tile pixels, is settled in one Arrow pass; a frame of one tile is then done. In larger ones, neighbours across tile borders link the tiles'
    components, and only these links go through components().
    """
    node = (F.col("y").cast("long") * width + F.col("x")).alias("node")
    pixels = mask.select(*keys, node, F.floor(F.col("y") / tile).alias("__ty"), F.floor(F.col("x") / tile).alias("__tx"), F.col("y").cast(mask.schema["y"].dataType).alias("y"), F.col("x").alias("x")).distinct()
    groups = cut(pixels.select(*keys, "__ty", "__tx").distinct().withColumn("__group", F.monotonically_increasing_id()))
    ready = join_same(pixels, groups, [*keys, "__ty", "__tx"]).select("__group", "node").repartition("__group").sortWithinPartitions("__group")
    first = ready.mapInArrow(_pixels(width), "__group long, node long, root long").join(groups, "__group").select(*keys, "node", "root")
    if not groups.where("__ty <> 0 OR __tx <> 0").isEmpty():
        first = cut(first)
        y, x = F.floor(F.col("node") / width), F.col("node") % width
        edge = first.where((y % tile == tile - 1) | (x % tile == tile - 1) | (x % tile == 0))
        moves = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("m")
        ahead = edge.select(*keys, "root", y.alias("y"), x.alias("x"), moves).where((F.col("x") + F.col("m.dx") >= 0) & (F.col("x") + F.col("m.dx") < width))
        ahead = ahead.where((F.floor((F.col("y") + F.col("m.dy")) / tile) != F.floor(F.col("y") / tile)) | (F.floor((F.col("x") + F.col("m.dx")) / tile) != F.floor(F.col("x") / tile)))
        ahead = ahead.select(*keys, F.col("root").alias("a"), ((F.col("y") + F.col("m.dy")) * width + F.col("x") + F.col("m.dx")).cast("long").alias("node"))
        links = join_same(ahead, first.withColumnRenamed("root", "b"), [*keys, "node"]).select(*keys, "a", "b").distinct()
        ends = links.select(*keys, F.col("a").alias("node")).unionByName(links.select(*keys, F.col("b").alias("node"))).distinct()
        joined = components(links, ends, keys).select(*keys, F.col("node").alias("root"), "component")
        first = join_same(first, joined, [*keys, "root"], "left").select(*keys, "node", F.coalesce("component", "root").alias("root"))
    kinds = mask.schema["y"].dataType, mask.schema["x"].dataType
    return first.select(*keys, F.floor(F.col("node") / width).cast(kinds[0]).alias("y"), (F.col("node") % width).cast(kinds[1]).alias("x"), F.col("root").alias("component"))


def seeded_components(mask: DataFrame, seeds: DataFrame, keys: list[str], width: int, min_area: int = 1) -> DataFrame:
    """Pixels of components that hold a seed pixel (keys, y, x) and have min_area pixels at least."""
    c = pixel_components(mask, keys, width)
    hit = c.join(seeds, [*keys, "y", "x"], "left_semi").select(*keys, "component").distinct()
    size = c.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("area")).where(F.col("area") >= min_area)
    return c.join(hit, [*keys, "component"], "left_semi").join(size, [*keys, "component"])
