"""Exact dedup by a tree-merge of sorted digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import cut, text_column

#: Deleted before texts are compared: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
KEY = ("digest", "n_bytes", "proof")


def normalised(text: Column) -> Column:
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def with_digests(docs: DataFrame) -> DataFrame:
    """docs with run (the partition it was read in), row (a number of its own), n_points, digest (SHA-256), n_bytes and proof of the normalised text, and raw, a hash of the text as it is.

    n_bytes and proof (an independent 64-bit hash) belong to the key of every merge, so rows meet only if both digests and the lengths agree.
    """
    norm, text = normalised(text_column()), text_column()
    return docs.withColumns({
        "run": F.spark_partition_id(), "row": F.monotonically_increasing_id(), "n_points": F.length(text).cast("long"), "digest": F.unhex(F.sha2(norm, 256)),
        "n_bytes": F.octet_length(norm).cast("long"), "proof": F.xxhash64(norm), "raw": F.xxhash64(text, F.lit(1)),
    })


def merge_runs(runs: DataFrame, fan_in: int = 8) -> DataFrame:
    """The winner and the size of every group, from rows as with_digests makes them.

    Every run is first sorted by key and made one row a key: its best row (most code points, then smallest doc_id, null last, then raw and row) and its count. Then runs
    are exchanged in rounds, as many as fan_in needs powers to reach the number of runs: in round k the nodes that differ in digit k of their number form a group, and
    each node gets from the others of its group the keys whose hash has the node's digit there, and merges up to fan_in sorted runs by key. So each round halves (for
    fan_in 2) how many nodes hold a key, at the end one does, and no node ever holds more than its share of the keys; a key that very many rows have is one row a node.
    """
    order = F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "raw", "row")
    merged = runs.groupBy("run", *KEY).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("best"))
    nodes, step = (runs.agg(F.max("run")).first()[0] or 0) + 1, 1
    size = 1
    while size < nodes:
        size *= fan_in
    home = F.pmod(F.xxhash64("digest", F.lit(7)), F.lit(size))
    while step < nodes:
        digit = lambda x, step=step: F.pmod(F.floor(x / F.lit(step)), F.lit(fan_in))
        goes_to = F.col("run") + (digit(home) - digit(F.col("run"))) * step
        sorted_runs = merged.withColumn("run", goes_to).repartition("run").sortWithinPartitions("run", *KEY)
        merged = sorted_runs.groupBy("run", *KEY).agg(F.sum("n").alias("n"), F.min("best").alias("best"))
        step *= fan_in
    return merged.select(*KEY, F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), (-F.col("best.less")).alias("keep_points"), F.col("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical without [\\x20\\x09-\\x0D]; null counts as empty, and all empty texts are one group. The row with the most code points stays, then the
    smallest doc_id (null last). Rows that repeat the winner's doc_id and length are marked kept too. Texts may have any length. An empty table gives no rows; other
    columns of docs, whatever their names, are ignored.
    """
    runs = cut(with_digests(docs.select("doc_id", "text")).drop("text"))
    root = merge_runs(runs, fan_in)
    return runs.join(root, list(KEY)).select(
        "doc_id", "keep_id", F.col("group_size").cast("long"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """docs, one row of each group of equal texts (see exact_duplicates), all columns as they are, whatever their names.

    Rows of one group with equal doc_id and length are told apart by a hash of the text; of rows that agree in that too, one stays, and which isn't defined if their
    other columns differ. A doc_id that stands at two texts loses only the row that is a copy. Texts are hashed once, where they are written, and shuffled once.
    """
    whole = cut(with_digests(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("one more")).alias("others"))))
    winners = merge_runs(whole.drop("text", "others"), fan_in).select(F.col("keep_row").alias("row"))
    kept = whole.join(winners.hint("merge"), "row", "left_semi")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in docs.columns])
