"""Sharding by extendible hashing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormglass.llm.common import cut, drop, text_or_empty

#: Bits of the key's hash that the directory can use.
HASH_BITS = 60
#: Directory bits that are added at a time.
STEP_BITS = 10


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\u0000"))), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column | int) -> Column:
    """The leading bits of h, as a number."""
    return F.call_function("shiftright", F.col("h"), (F.lit(HASH_BITS) - depth).cast("int"))


def assign_shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, depth, bucket, page, shard_bytes, oversized.

    A bucket is a prefix of `depth` bits of the id's hash. Only buckets above limit_bytes are
    split on another bit, so depth differs from bucket to bucket. Bytes are summed once for
    prefixes of STEP_BITS bits (map-side combined) and rolled up from there; only the keys of
    prefixes that are still too large look at STEP_BITS more. Rows that share all 60 bits
    (an id that repeats) can't be split by bits: they are dealt to numbered pages of one
    bucket, by running sum. A single text above the limit has a page to itself and is marked
    oversized. The directory grows with the data, so it is joined by shuffles, not broadcast. Null texts have 0 bytes; null ids hash alike; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"))
    units = cut(rows.groupBy("id", "n_bytes").agg(F.count(F.lit(1)).alias("n")).withColumn("h", key_hash(F.col("id"))))
    settled, open_units, low = None, units, 0
    while True:
        high = min(low + STEP_BITS, HASH_BITS)
        fine = cut(open_units.groupBy(_prefix(high).alias("p")).agg(F.sum(F.col("n_bytes") * F.col("n")).alias("bytes")))
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("bucket", F.call_function("shiftright", F.col("p"), F.lit(high) - F.col("depth")))
        sums = levels.groupBy("depth", "bucket").agg(F.sum("bytes").alias("shard_bytes"))
        placed = levels.select("p", "depth", "bucket").join(sums.where(F.col("shard_bytes") <= limit_bytes).hint("shuffle_merge"), ["depth", "bucket"])
        best = placed.groupBy("p").agg(F.min(F.struct("depth", "bucket", "shard_bytes")).alias("b"))
        found = cut(fine.select("p").join(best.hint("shuffle_merge"), "p", "left").select("p", "b.*"))
        here = open_units.withColumn("p", _prefix(high)).join(found.hint("shuffle_merge"), "p").drop("p")
        fits = here.where("depth is not null")
        settled = fits if settled is None else settled.unionByName(fits)
        if found.where("depth is null").isEmpty():
            break
        open_units = cut(here.where("depth is null").drop("depth", "bucket", "shard_bytes"))
        low = high
        if low >= HASH_BITS:
            settled = settled.withColumn("page", F.lit(0).cast("long")).unionByName(_pages(open_units, limit_bytes))
            break
    if "page" not in settled.columns:
        settled = settled.withColumn("page", F.lit(0).cast("long"))
    out = settled.select(
        F.col("id").alias(id_col), "n_bytes", "depth", F.lpad(F.conv(F.col("bucket").cast("string"), 10, 2), 60, "0").alias("b"), "page", "shard_bytes",
        (F.col("n_bytes") > limit_bytes).alias("oversized"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"),
    )
    return out.select(
        id_col, "n_bytes", "depth", F.expr("substring(b, 61 - depth, depth)").alias("bucket"), "page", "shard_bytes", "oversized"
    )


def _pages(units: DataFrame, limit_bytes: int) -> DataFrame:
    """Pages of buckets whose rows share every bit, filled in order; each page within the limit."""
    each = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest(F.col("n_bytes"), F.lit(1))))
    split = (
        units.withColumn("each", each.cast("long"))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("each")))))
        .withColumn("n", F.least(F.col("each"), F.col("n") - F.col("part") * F.col("each")))
        .drop("each")
    )
    by = Window.partitionBy("h").orderBy("n_bytes", "id", "part")
    return (
        split.withColumn("page", F.row_number().over(by).cast("long") - 1)
        .withColumn("shard_bytes", F.col("n_bytes") * F.col("n"))
        .withColumns({"depth": F.lit(HASH_BITS), "bucket": F.col("h")})
        .drop("part")
    )


def write_shards(docs: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs to one folder a shard, `shard=<depth>-<bucket>-<page>`; columns as they were, in column `row`.

    Rows that share id and size fill their pages in turn: they are numbered inside the parts
    of a written table, whose counts give each part its offset, so a hot id is not gathered in
    one task. Null ids are rows like any other; an empty table writes no shard.
    """
    old: list[str] = []
    shards = assign_shards(docs, limit_bytes, id_col, text_col)
    pages = shards.groupBy(F.col(id_col).alias("id"), "n_bytes", "depth", "bucket", "page").agg(F.count(F.lit(1)).alias("rows"))
    units = pages.groupBy("id", "n_bytes").agg(F.min("depth").alias("depth"), F.min("bucket").alias("bucket"), F.min("page").alias("page"), F.max("rows").alias("each"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(id_col).alias("own_id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("size"), F.monotonically_increasing_id().alias("m"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("size") == F.col("n_bytes"))
    placed = cut(keyed.join(units, same).drop("own_id", "size").withColumn("part", F.call_function("shiftright", F.col("m"), F.lit(33))), old)
    unit = [F.coalesce(F.col("id").cast("string"), F.lit("\0")), F.col("n_bytes")]
    counts = placed.groupBy("id", "n_bytes", "part").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(*unit).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before", before).select(F.col("id").alias("i"), F.col("n_bytes").alias("b"), F.col("part").alias("p"), "before")
    local = placed.withColumn("at", F.row_number().over(Window.partitionBy(*unit, "part").orderBy("m")) - 1)
    numbered = local.join(offsets, F.col("id").eqNullSafe(F.col("i")) & (F.col("n_bytes") == F.col("b")) & (F.col("part") == F.col("p")))
    page = F.col("page") + F.floor((F.col("at") + F.col("before")) / F.col("each"))
    out = numbered.select("row", F.concat_ws("-", "depth", "bucket", page.cast("long")).alias("shard"))
    out.repartition("shard").write.partitionBy("shard").parquet(path)
    drop(docs.sparkSession, old)


def expected_depth(total_bytes: int, limit_bytes: int) -> int:
    """Bits that evenly hashed rows need."""
    return max(0, math.ceil(math.log2(max(1, total_bytes) / limit_bytes)))
