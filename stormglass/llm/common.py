"""Shared pieces of the corpus operators: scratch tables and the word rule."""

from __future__ import annotations

import re
import tempfile
import uuid
from hashlib import md5

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of anything but ASCII white space (space and 0x09-0x0D).
WORD = "[^\\x20\\x09-\\x0D]+"


def scratch_database(spark: SparkSession) -> tuple[str, str]:
    """(name, folder) of the database of scratch tables; it lies under spark.checkpoint.dir.

    That folder is shared by the driver and all executors. Where the setting is missing, a
    session on one machine (tests) gets a folder of its own; a cluster raises, as a local folder
    would scatter its tables over the executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    name = f"scratch_{md5(root.encode()).hexdigest()[:12]}"
    folder = f"{root.rstrip('/')}/{name}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{folder}'")
    return name, folder


def cut(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there.

    Unlike a cache, the copy survives lost executors, and both readers of it see the same rows
    even where a plan samples (range partitioning). The table's name is added to keep, with
    which drop() deletes it after its last reader.
    """
    spark = df.sparkSession
    database, folder = scratch_database(spark)
    table = f"t{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").saveAsTable(f"{database}.{table}")
    if keep is not None:
        keep.append(f"{database}.{table}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{table}")


def drop(spark: SparkSession, tables: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    while tables:
        spark.sql(f"DROP TABLE IF EXISTS {tables.pop()}")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def counted(df: DataFrame, what: Column | None = None, keep: list[str] | None = None) -> tuple[DataFrame, int]:
    """cut(), and how many rows it wrote (or the sum of what), observed by the same job."""
    seen = Observation()
    out = cut(df.observe(seen, F.coalesce(F.sum(F.lit(1) if what is None else what.cast("long")), F.lit(0)).alias("n")), keep)
    return out, seen.get["n"]


def small(df: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """df with the hint to broadcast it if a count finds at most so many rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def placed(rows: DataFrame, by: list[str], order: list[str], keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with place, from 0 within each key of by (never null), and n, the key's rows; the keys with n).

    No key is sorted in one task: rows are dealt by ranges of (by, order) and numbered where
    they lie; what each range holds of each key is counted, and the sums before it are added.
    """
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("mono_", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumns({"part_": F.shiftright("mono_", 33), "local_": F.col("mono_").bitwiseAND(F.lit((1 << 33) - 1))}).drop("mono_"), keep)
    parts = dealt.groupBy(*by, "part_").agg(F.count(F.lit(1)).alias("n_"), F.min("local_").alias("first_"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("n_").over(whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(parts.select(*by, "part_", (before - F.col("first_")).alias("shift_"), F.sum("n_").over(whole).alias("n")), keep)
    out = dealt.join(small(offsets), [*by, "part_"]).withColumn("place", F.col("local_") + F.col("shift_"))
    return out.drop("part_", "local_", "shift_"), offsets.select(*by, "n").distinct()


def components(edges: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Each round a node takes the smallest label among its neighbours and then, twice, its
    label's own label, so paths shrink fourfold; rounds end when no label changes. Labels are
    cut every round, and the same job tells whether any changed; older labels are deleted.
    """
    spark, old = edges.sparkSession, []
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), old)
    last: list[str] = []
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), last)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        after = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        for k in (1, 2):
            of = labels.select(F.col("node").alias("via"), F.col("label").alias(f"jump{k}"))
            after = after.join(of, F.col("label") == F.col("via"), "left").select("node", "old", F.least("label", F.coalesce(f"jump{k}", "label")).alias("label"))
        fresh: list[str] = []
        after, changed = counted(after, F.col("label") != F.col("old"), fresh)
        drop(spark, last)
        labels, last = after.select("node", "label"), fresh
        if not changed:
            drop(spark, old)
            if keep is not None:
                keep += last
            return labels.select("node", F.col("label").alias("component"))
