"""What the queries share: the given tables read as recordings, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timeloom.operators.sequence import frame_index

CLASSES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def class_of(c: Column) -> Column:
    return F.coalesce(*[F.when(c == n, i) for i, n in enumerate(CLASSES)])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recordings: a user is a recording, an event a frame. cls its class, gt the same with every 11th event unlabelled (-1), pred the class before."""
    f = frame_index(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])
    f = f.withColumn("cls", class_of(F.col("event_type")))
    last = F.lag("cls").over(Window.partitionBy("user_id").orderBy("frame"))
    return f.withColumns({"gt": F.when(F.col("event_id") % 11 == 0, -1).otherwise(F.col("cls")), "pred": F.coalesce(last, F.col("cls"))})


FRAMES = """f0 AS (SELECT user_id, ts, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS cls FROM events),
f AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN -1 ELSE cls END AS gt, coalesce(lag(cls) OVER (PARTITION BY user_id ORDER BY frame), cls) AS pred FROM f0)"""


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Columns rounded as the SQL rounds them; -0.0 becomes 0.0."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) + F.lit(0.0) for n in names})


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as tokens: 50 to a recording."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 50).alias("recording"), (F.col("vec_id") % 50).alias("token_index"), F.col("embedding").alias("vec"), "label", "vec_id")


TOKENS = "t AS (SELECT vec_id // 50 AS recording, vec_id % 50 AS token_index, embedding AS vec, label, vec_id FROM embeddings)"
