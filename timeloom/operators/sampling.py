"""Sorts, top-k and sampling that give the same rows on every run: order comes from columns or hashes, never from rand()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timeloom.functions.scalars import natural_key
from timeloom.plans.ranges import join_same, numbered


def natural_sort(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(natural_key(F.col(name)), name)


def top_k(df: DataFrame, keys: list[str], group: str, score: str, limits: DataFrame | int, tie: str) -> DataFrame:
    """Best rows of each (keys, group): `limits` rows, a number or a dimension (group, max_instances)."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, group).orderBy(F.desc(score), tie)))
    if isinstance(limits, int):
        return ranked.where(F.col("rank") <= limits)
    return ranked.join(F.broadcast(limits.select(group, "max_instances")), group).where("rank <= max_instances").drop("max_instances")


def spaced_top_k(df: DataFrame, keys: list[str], frame: str, score: str, gap: int, most: int) -> DataFrame:
    """keys, frame (whole numbers), score: best first (the later frame of two), each at least `gap` frames from those taken, `most` in all.

    A taken frame bars 2 * gap - 1 frames at most, its own included, so the best (most - 1) * (2 * gap - 1) + 1 frames of a key hold all that can be taken.
    """
    enough = max(most, (most - 1) * (2 * gap - 1) + 1)
    frames = df.where(F.col(score).isNotNull()).groupBy(*keys, frame).agg(F.max(score).alias(score)) if gap > 0 else df
    best = frames.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(frame)))).where(F.col("__k") <= enough)
    row = F.struct((-F.col(score)).alias("less"), (-F.col(frame)).alias("f"))
    got = best.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.slice("rows", 1, 0)

    def step(kept: Column, x: Column) -> Column:
        return F.when((F.size(kept) < most) & ~F.exists(kept, lambda k: F.abs(k["f"] - x["f"]) < gap), F.concat(kept, F.array(x))).otherwise(kept)

    return got.select(*keys, F.explode(F.aggregate("rows", none, step)).alias("x")).select(*keys, (-F.col("x.f")).alias(frame), (-F.col("x.less")).alias(score))


def balanced_cap(df: DataFrame, label: str, key: str, epoch: int, cap: str | int = "mean") -> DataFrame:
    """At most `cap` rows of each class (mean or median of the class counts, or a number), drawn by a hash of epoch and key, in hashed order `position`."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    limit = F.lit(cap) if isinstance(cap, int) else None
    if limit is None:
        limits = n.agg((F.floor(F.avg("n")) if cap == "mean" else F.floor(F.percentile("n", 0.5))).alias("__cap"))
        df = df.join(F.broadcast(limits))
        limit = F.col("__cap")
    h = F.md5(F.concat_ws(":", F.lit(str(epoch)), F.col(key).cast("string")))
    kept = df.withColumn("__h", h).withColumn("__k", F.row_number().over(Window.partitionBy(label).orderBy("__h", key))).where(F.col("__k") <= limit)
    return kept.drop("__k", "__cap").withColumnRenamed("__h", "position")


def stratified_allocation(counts: DataFrame, stratum: str, most: int, least: int = 1) -> DataFrame:
    """counts (stratum, n) with take: `least` rows of each stratum (or all), the rest of `most` in proportion to what is left, by floor and largest remainder (then by name).

    Whole numbers throughout. Strata are ranked over ranges, so they may be many; only their sums, one row, are broadcast.
    """
    base = counts.select(stratum, "n", F.least(F.col("n"), F.lit(least)).alias("__own")).withColumn("__room", F.col("n") - F.col("__own"))
    sums = base.agg(F.sum("__own").alias("__taken"), F.sum("__room").alias("__total"))
    rest = F.greatest(F.lit(most) - F.col("__taken"), F.lit(0)).cast("decimal(19,0)")
    product = rest * F.col("__room").cast("decimal(19,0)")
    total = F.greatest(F.col("__total"), F.lit(1)).cast("decimal(19,0)")
    left = product % total
    part = base.join(F.broadcast(sums)).withColumns({"__whole": ((product - left) / total).cast("long"), "__left": left.cast("decimal(38,0)"), "__all": F.col("__total") <= rest, "__less": -left.cast("decimal(38,0)")})
    ranked = numbered(part.withColumn("__one", F.lit(0)), ["__one"], ["__less", stratum], "__rank", "__n")
    given = ranked.agg(F.sum(F.col("__own") + F.col("__whole")).alias("__given"))
    more = (F.col("__rank") < most - F.col("__given")) & (F.col("__left") > 0)
    return ranked.join(F.broadcast(given)).select(stratum, "n", F.when(F.col("__all"), F.col("n")).otherwise(F.col("__own") + F.col("__whole") + more.cast("long")).alias("take"))


def evenly_spaced(df: DataFrame, keys: list[str], order: str, most: int | Column) -> DataFrame:
    """At most `most` rows of each key, first and last included, evenly spread in order."""
    w = Window.partitionBy(*keys)
    m = F.lit(most) if isinstance(most, int) else most
    ranked = df.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    spot = lambda i: F.floor(i * (m - 1) / F.greatest(F.col("__n") - 1, F.lit(1)) + 1e-9)
    keep = (F.col("__n") <= m) | (F.col("__i") == 0) | (spot(F.col("__i")) > spot(F.col("__i") - 1))
    return ranked.where(keep).drop("__i", "__n")


def stratified_cap(df: DataFrame, stratum: str, order: str, most: int, least: int = 1) -> DataFrame:
    """`most` rows over all strata by stratified_allocation(), evenly spread within each; a null stratum is one of them."""
    take = stratified_allocation(df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")), stratum, most, least)
    asked = join_same(df, take.select(stratum, F.col("take").alias("__take")), [stratum])
    return evenly_spaced(asked, [stratum], order, F.col("__take")).drop("__take")


def ordered_split(df: DataFrame, name: str, last: int) -> DataFrame:
    """df with split: the last `last` names in natural order are validation."""
    names = df.select(name).distinct().withColumn("__k", natural_key(F.col(name)))
    tail = names.orderBy(F.desc("__k"), F.desc(name)).limit(last).select(F.col(name), F.lit("validation").alias("split"))
    return df.join(F.broadcast(tail), name, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def fold_ids(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """df with the number from 0 of each row's group, in order of the groups; null is a group of its own, the first. Every row stays once, however many groups there are:
    fold_role() of the column gives the roles when a group is held out. Groups are numbered over ranges and joined, not collected."""
    names = df.select(group).distinct().withColumns({"__one": F.lit(0), "__known": F.col(group).isNotNull()})
    ids = numbered(names, ["__one"], ["__known", group], "__fold", "__folds").select(group, F.col("__fold").alias(fold))
    return join_same(df, ids, [group])


def fold_role(held: int | Column, fold: str = "fold") -> Column:
    """validation for the rows of the fold that is held out, train for all others."""
    return F.when(F.col(fold) == held, "validation").otherwise("train")


def fold_sizes(df: DataFrame, group: str) -> DataFrame:
    """holdout, role, n: how many rows train and validate when a group is held out, from the groups' counts; a role without rows has no row. Null is a group of its own."""
    sizes = df.groupBy(F.col(group).alias("holdout")).agg(F.count(F.lit(1)).alias("own"))
    both = sizes.join(F.broadcast(sizes.agg(F.sum("own").alias("every"))))  # one row
    roles = F.array(F.struct(F.lit("validation").alias("role"), F.col("own").alias("n")), F.struct(F.lit("train").alias("role"), (F.col("every") - F.col("own")).alias("n")))
    return both.select("holdout", F.explode(roles).alias("r")).select("holdout", "r.role", "r.n").where("n > 0")


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """Every row once for each group, with holdout and role (validation if it is of that group, null being one). The rows grow with the groups by definition: fold_ids() and
    fold_sizes() tell the same without copies."""
    held = df.select(F.col(group).alias("holdout")).distinct()
    return df.join(held, how="inner").withColumn("role", F.when(F.col(group).eqNullSafe(F.col("holdout")), "validation").otherwise("train"))


def next_free_id(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """next_id: one more than the largest of both, 1 at least."""
    top = a.select(column).unionByName(b.select(column)).agg(F.max(column).alias("m"))
    return top.select((F.greatest(F.coalesce("m", F.lit(0)), F.lit(0)) + 1).alias("next_id"))
