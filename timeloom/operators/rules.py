"""Data-quality rules. Each returns its violations as a DataFrame with a `reason`; no rows means that the data are clean. enforce() turns violations into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timeloom.operators.sequence import over


class RuleViolation(ValueError):
    """The data break a rule."""


def enforce(violations: DataFrame, rule: str, shown: int = 5) -> None:
    rows = violations.limit(shown).collect()
    if rows:
        raise RuleViolation(f"{rule}: " + "; ".join(str(r.asDict()) for r in rows))


def reasons(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    """keep columns and reason: a row for each rule whose condition isn't true. Unknown counts as broken."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("reason", F.explode(bad)).select(*keep, "reason")


def check_segments(segments: DataFrame, recordings: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds within the recording, known labels, no overlap. segments: keys, start_frame, end_frame (included), label; recordings: keys, num_frames; labels: label."""
    rows = segments.join(recordings, keys, "left").join(F.broadcast(labels.select("label", F.lit(True).alias("__known"))), "label", "left")
    reach = F.max("end_frame").over(Window.partitionBy(*keys).orderBy("start_frame", "end_frame").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__reach", reach)
    rules = {
        "start_before_0": F.col("start_frame") >= 0, "end_before_start": F.col("end_frame") >= F.col("start_frame"), "end_beyond_recording": F.col("end_frame") < F.col("num_frames"),
        "unknown_label": F.col("__known"), "overlap": F.col("__reach").isNull() | (F.col("start_frame") > F.col("__reach")),
    }
    return reasons(rows, rules, [*keys, "start_frame", "end_frame", "label"])


def check_increasing(df: DataFrame, keys: list[str], order: str, time: str) -> DataFrame:
    """Rows whose time isn't after the previous row's (in the order of `order`)."""
    last = F.lag(time).over(over(keys, order))
    rows = df.withColumn("previous", last)
    return rows.where(F.col(time).isNull() | (F.col(time) <= F.col("previous"))).select(*keys, order, time, "previous", F.lit("not_increasing").alias("reason"))


def check_coverage(segments: DataFrame, recordings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, from_frame, to_frame, reason (missing or duplicate): every frame of a recording must lie in exactly one segment. Interval form: no row per frame."""
    ends = segments.select(*keys, F.col("start_frame").alias("at"), F.lit(1).alias("d")).unionByName(segments.select(*keys, (F.col("end_frame") + 1).alias("at"), F.lit(-1).alias("d")))
    ends = ends.unionByName(recordings.select(*keys, F.lit(0).cast("long").alias("at"), F.lit(0).alias("d"))).unionByName(recordings.select(*keys, F.col("num_frames").cast("long").alias("at"), F.lit(0).alias("d")))
    step = ends.groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("at")
    depth = step.withColumns({"depth": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "to_frame": F.lead("at").over(w) - 1}).join(recordings, keys)
    bad = depth.where((F.col("depth") != 1) & (F.col("to_frame") >= F.col("at")) & (F.col("at") < F.col("num_frames")))
    return bad.select(*keys, F.col("at").alias("from_frame"), "to_frame", F.when(F.col("depth") < 1, "missing").otherwise("duplicate").alias("reason"))


def check_bundle(rows: DataFrame, header: DataFrame, key: str, vector: str, size: int, label: str, n_labels: int, version: int) -> DataFrame:
    """key and reason: row count as in the header, vectors of the right size, labels in range, schema version. header: key, num_tokens, schema_version."""
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.size(vector) == size).alias("sized"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    both = header.join(found, key, "full_outer")
    rules = {
        "row_count": F.col("n") == F.col("num_tokens"), "vector_size": F.col("sized"), "label_range": (F.col("lo") >= -1) & (F.col("hi") < n_labels),
        "schema_version": F.col("schema_version") == version,
    }
    return reasons(both, rules, [key])


def check_subset(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the inner mask that the outer one lacks."""
    return inner.select(*keys).distinct().join(outer, keys, "left_anti").withColumn("reason", F.lit("not_in_outer"))


def check_nested(df: DataFrame, chain: list[str], keep: list[str]) -> DataFrame:
    """Rows where a flag is true though the next one of the chain isn't."""
    return reasons(df, {f"{a}_without_{b}": ~F.coalesce(F.col(a), F.lit(False)) | F.coalesce(F.col(b), F.lit(False)) for a, b in zip(chain, chain[1:], strict=False)}, keep)


def check_partition(df: DataFrame, parts: list[str], whole: str, keep: list[str]) -> DataFrame:
    """Rows where not exactly one part holds though the whole does, or a part without the whole."""
    n = sum((F.coalesce(F.col(p).cast("int"), F.lit(0)) for p in parts[1:]), F.coalesce(F.col(parts[0]).cast("int"), F.lit(0)))
    return reasons(df, {"not_a_partition": n == F.coalesce(F.col(whole).cast("int"), F.lit(0))}, keep)


#: Domains by name: what must be true of a column.
DOMAINS = {
    "probability": lambda c: c.between(0, 1) & ~F.isnan(c.cast("double")), "positive_integer": lambda c: (c > 0) & (c == F.floor(c)),
    "optional_non_negative_integer": lambda c: c.isNull() | ((c >= 0) & (c == F.floor(c))), "finite": lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < float("inf")),
    "non_empty": lambda c: F.length(F.trim(c)) > 0,
}


def check_domains(df: DataFrame, domains: dict[str, str], keep: list[str]) -> DataFrame:
    """keep columns and reason `<column>:<domain>` for each value outside its domain."""
    return reasons(df, {f"{c}:{d}": DOMAINS[d](F.col(c)) for c, d in domains.items()}, keep)


def check_same(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of a contract (signature, vocabulary, shape) with their counts, if there is more than one."""
    values = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
    n = values.agg(F.count(F.lit(1)).alias("__n"))
    return values.join(F.broadcast(n), F.col("__n") > 1).drop("__n").withColumn("reason", F.lit("contract_differs"))


def check_equal_fields(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys and reason for each field that two runs don't share exactly (null equals null), and for keys of one run only."""
    x, y = a.select(*keys, F.struct(*fields).alias("__a")), b.select(*keys, F.struct(*fields).alias("__b"))
    both = x.join(y, keys, "full_outer")
    return reasons(both, {"in_both_runs": F.col("__a").isNotNull() & F.col("__b").isNotNull()} | {f: F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")) for f in fields}, keys)


def check_limits(df: DataFrame, limits: DataFrame, keys: list[str], joint: str, frame: str, q: str, fps: float, margin: float = 0.0, slack: float = 1e-6) -> DataFrame:
    """Rows that are not finite, outside [lo + margin, hi - margin], or faster than vmax. limits: joint, lo, hi, vmax."""
    rows = df.join(F.broadcast(limits), joint).withColumn("__v", F.abs(F.col(q) - F.lag(q).over(over([*keys, joint], frame))) * fps)
    rules = {
        "finite": DOMAINS["finite"](F.col(q)), "position": F.col(q).between(F.col("lo") + margin - slack, F.col("hi") - margin + slack),
        "velocity": F.col("__v").isNull() | (F.col("__v") <= F.col("vmax") + slack),
    }
    return reasons(rows, rules, [*keys, joint, frame, q])


def check_units(found: DataFrame, expected: DataFrame, key: str, count: str | None = None, allow_incomplete: bool = False) -> DataFrame:
    """key, reason, fatal: units missing or not expected, found twice, or of another count than expected."""
    n = found.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *([F.first(count).alias("__c")] if count else []))
    both = expected.join(n, key, "full_outer")
    here = F.col("__n").isNotNull()
    rules = {"missing": here, "duplicate": ~here | (F.col("__n") == 1)}
    if count:
        rules["count"] = ~here | (F.col("__c") == F.col(f"expected_{count}"))
    return reasons(both, rules, [key]).withColumn("fatal", F.lit(not allow_incomplete))


def check_count_is_integer(df: DataFrame, accuracy: str, support: str, keep: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Accuracies that no whole number of hits gives."""
    hits = F.col(accuracy) * F.col(support)
    return reasons(df, {"hits_not_whole": F.abs(hits - F.rint(hits)) <= tolerance}, keep)
