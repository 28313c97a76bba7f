"""Exact quantiles of keys and of windows along time; no key has to fit into a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stormglass.functions.scratch import cut
from stormglass.operators import scans
from stormglass.operators.scans import Scan, deal


def column_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], keep: list[str] | None = None) -> DataFrame:
    """keys and, by name, quantiles (name -> (column, share)) linear between neighbours; null for a column without values.

    Values of all columns are counted first; ranks are sums of counts over ranges of (key,
    column, value), so neither a key with most of the rows nor a value with most of a key's
    meets in one task. Keys without any value have no row; without keys there is one row.
    """
    columns = {c: k for k, c in enumerate(dict.fromkeys(c for c, _ in wanted.values()))}
    cells = F.array(*[F.struct(F.lit(k).alias("c_"), F.col(f"`{c}`").cast("double").alias("x_")) for c, k in columns.items()])
    values = df.select(*keys, F.explode(cells).alias("e_")).select(*keys, "e_.*").where("x_ is not null")
    counts = values.groupBy(*keys, "c_", "x_").agg(F.count(F.lit(1)).alias("n_"))
    scanned = deal(counts, [*keys, "c_"], ["x_"], keep).scan({"upto_": Scan("sum", F.col("n_")), "over_": Scan("sum", F.col("n_"), back=True, own=False)}).rows
    last = F.col("upto_") + F.coalesce("over_", F.lit(0)) - 1

    def ends(k: int, column: str, q: float) -> list[Column]:
        own = F.col("c_") == columns[column]
        at = lambda place: F.min(F.when(own & (F.col("upto_") > place), F.col("x_")))
        return [at(F.floor(last * q)).alias(f"a{k}"), at(F.ceil(last * q)).alias(f"b{k}"), F.max(F.when(own, last * q - F.floor(last * q))).alias(f"s{k}")]

    found = scanned.groupBy(*keys).agg(*[c for k, (column, q) in enumerate(wanted.values()) for c in ends(k, column, q)])
    value = lambda k: F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * F.col(f"s{k}")
    return found.select(*keys, *[value(k).alias(n) for k, n in enumerate(wanted)])


def key_quantiles(df: DataFrame, keys: list[str], x: str, wanted: dict[str, float]) -> DataFrame:
    """column_quantiles() of one column; keys without values have no row."""
    return column_quantiles(df, keys, {n: (x, q) for n, q in wanted.items()})


def with_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """df with column_quantiles() of each row's key; null keys are a key like any other."""
    if not wanted:
        return df
    cuts = column_quantiles(df, keys, wanted).withColumnsRenamed({k: f"of_{i}_" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"of_{i}_")) for i, k in enumerate(keys)]
    joined = df.join(cuts, same, "left") if keys else df.join(F.broadcast(cuts))
    return joined.drop(*[f"of_{i}_" for i in range(len(keys))])


def smallest(values: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each query the place-th smallest (from 0) of values[begin:end].

    Values are told by the bits of their rank, from the highest: at each bit the values are
    parted stably by it, and a count of zeros up to the query's ends says on which side its
    answer lies. All queries go through a bit at once, so a query costs the number of bits
    whatever its window holds.
    """
    order, rank = np.unique(values, return_inverse=True)
    row, low, high, place = rank, begin.astype(np.int64), end.astype(np.int64), place.astype(np.int64)
    answer = np.zeros(len(place), np.int64)
    for bit in range(max(len(order) - 1, 0).bit_length() - 1, -1, -1):
        one = (row >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        a, b = zeros[low], zeros[high]
        up = place >= b - a
        answer |= up.astype(np.int64) << bit
        place = np.where(up, place - (b - a), place)
        low, high = np.where(up, zeros[-1] + low - a, a), np.where(up, zeros[-1] + high - b, b)
        row = np.concatenate([row[one == 0], row[one == 1]])
    return order[answer]


def window_quantile(values: np.ndarray, begin: np.ndarray, end: np.ndarray, q: float, below: int = 0, size: np.ndarray | None = None) -> np.ndarray:
    """The q-quantile, linear between neighbours, of values[begin:end] for each window, none of them empty.

    With below and size, each is part of a window of `size` values: `below` of the missing ones
    are smaller than where the quantile lies, the others larger.
    """
    place = ((end - begin if size is None else size) - 1) * q
    low = np.floor(place).astype(np.int64)
    one = smallest(values, begin, end, low - below)
    other = smallest(values, begin, end, np.ceil(place).astype(np.int64) - below)
    return one + (other - one) * (place - low)


def _with(table: pa.Table, name: str, values: np.ndarray, known: np.ndarray, fields: list[str]) -> pa.Table:
    return table.select(fields).append_column(name, pa.array(values, pa.float64(), mask=~known))


def _value(x: str) -> Column:
    """A number; NaN counts as missing."""
    v = F.col(x).cast("double")
    return F.when(~F.isnan(v), v)


def rolling_quantile(df: DataFrame, x: str, keys: list[str], time: str, width: int, q: float, least: int, name: str) -> DataFrame:
    """df with the quantile of the `width` rows before; null where fewer than `least` of them have a value.

    Chunks of rows, each with the rows that its first windows need, go through smallest(): a
    row costs the same for any width, and a long key runs in many tasks.
    """
    rows = deal(df.withColumn("x_", _value(x)), keys, [time]).numbered().chunked(width, 0).rows
    fields = df.columns

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place_")
        numbers = group.column("x_").to_numpy(zero_copy_only=False).astype(float)
        known, row = ~np.isnan(numbers), np.arange(len(numbers))
        upto = np.concatenate([[0], np.cumsum(known)])
        begin, end = upto[np.maximum(row - width, 0)], upto[row]
        ready, out = end - begin >= max(least, 1), np.zeros(len(row))
        out[ready] = window_quantile(numbers[known], begin[ready], end[ready], q)
        own = np.flatnonzero(~group.column("halo_").to_numpy(zero_copy_only=False))
        return _with(group.take(own), name, out[own], ready[own], fields)

    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
    return rows.drop("at_", "last_").groupBy("part_", "key_").applyInArrow(run, schema)


def expanding_quantile(df: DataFrame, x: str, keys: list[str], time: str, name: str, q: float = 0.85, least: int = 756, keep: list[str] | None = None) -> DataFrame:
    """df with the quantile of all earlier values of the key, linear between neighbours; null before `least` of them.

    Time falls into chunks. The values of a chunk move the quantile of what is before it by no
    more than their number in ranks, so of all earlier values a chunk needs only those whose
    rank lies that near to the quantile, and how many are smaller. Counts of values by (chunk,
    bucket of ranks), added up along chunks and then along buckets, tell which buckets these
    are; a chunk gets their values from earlier chunks, a few times its own length, and
    finishes on its own with smallest(). Chunks have CHUNK rows, or the root of their key's
    number if that is more, so that the counts stay below the rows.
    """
    known = F.col("x_").isNotNull().cast("long")
    first = deal(df.withColumn("x_", _value(x)), keys, [time], keep).numbered()
    rows = first.scan({"seen_": Scan("sum", known, own=False)}).rows
    size = F.greatest(F.lit(scans.CHUNK).cast("long"), F.ceil(F.sqrt(F.col("last_") + 1)))
    rows = rows.withColumn("size_", size).withColumn("chunk_", F.floor(F.col("place_") / F.col("size_")))
    rows = cut(rows.withColumn("seen_", F.coalesce("seen_", F.lit(0).cast("long"))).drop("part_", "at_"), keep)
    base = _earlier(rows.where("last_ >= size_").select("key_", "chunk_", "x_", "seen_", "place_", "size_", "last_"), q, keep)
    fields = df.columns
    stacked = rows.withColumn("below_", F.lit(None).cast("long")).unionByName(base, allowMissingColumns=True)

    def run(group: pa.Table) -> pa.Table:
        earlier = group.column("below_").is_valid().to_numpy(zero_copy_only=False)
        own = group.take(np.flatnonzero(~earlier)).sort_by("place_")
        some = group.take(np.flatnonzero(earlier))
        below = some.column("below_")[0].as_py() if len(some) else 0
        numbers, seen = own.column("x_").to_numpy(zero_copy_only=False).astype(float), own.column("seen_").to_numpy()
        has = ~np.isnan(numbers)
        upto = len(some) + np.concatenate([[0], np.cumsum(has)])[:-1]
        ready, out = seen >= max(least, 1), np.zeros(len(own))
        values = np.concatenate([some.column("x_").to_numpy(zero_copy_only=False).astype(float), numbers[has]])
        out[ready] = window_quantile(values, np.zeros(int(ready.sum()), np.int64), upto[ready], q, below, seen[ready])
        return _with(own, name, out, ready, fields)

    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
    return stacked.groupBy("key_", "chunk_").applyInArrow(run, schema)


def _earlier(rows: DataFrame, q: float, keep: list[str] | None) -> DataFrame:
    """(key_, chunk_, x_, below_): the earlier values that a chunk needs, and how many are below all of them."""
    ranked = deal(rows.where("x_ is not null").withColumnsRenamed({"place_": "time_", "last_": "total_"}), ["key_"], ["x_", "time_"], keep).numbered().rows
    points = ranked.select(F.col("key_.key_").alias("key_"), "chunk_", "x_", F.floor(F.col("total_") / F.col("size_")).alias("chunks_"), F.floor(F.col("place_") / F.col("size_")).alias("bucket_"))
    # what each chunk begins with, how many values it has, and how many chunks there are
    begun = rows.groupBy("key_", "chunk_").agg(F.min("seen_").alias("n_"), F.count("x_").alias("m_"), F.max(F.floor(F.col("last_") / F.col("size_"))).alias("chunks_"))
    grid = begun.withColumn("bucket_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks_"))))
    cells = points.groupBy("key_", "chunk_", "bucket_").agg(F.count(F.lit(1)).alias("c_"))
    grid = grid.join(cells, ["key_", "chunk_", "bucket_"], "left")
    before = Window.partitionBy("key_", "bucket_").orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("before_", F.coalesce(F.sum("c_").over(before), F.lit(0)))
    upto = Window.partitionBy("key_", "chunk_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("upto_", F.sum("before_").over(upto))
    low = F.greatest(F.floor((F.col("n_") - 1) * q) - F.col("m_"), F.lit(0))
    high = F.least(F.ceil((F.col("n_") + F.col("m_") - 1) * q), F.col("n_") - 1)
    reached = (F.col("upto_") > low) & (F.col("upto_") - F.col("before_") <= high)
    needs = grid.where(F.col("n_") > 0).where(reached & (F.col("before_") > 0))
    needs = needs.withColumn("below_", F.min(F.col("upto_") - F.col("before_")).over(Window.partitionBy("key_", "chunk_")))
    # a steady series asks for the same few buckets in every chunk: their values are dealt by salt, 64 chunks each
    salts = F.floor(F.col("chunks_") / 64)
    needs = needs.select("key_", "bucket_", F.col("chunk_").alias("for_"), "below_", F.explode(F.sequence(F.lit(0).cast("long"), salts)).alias("salt_"))
    own = F.pmod(F.xxhash64("x_", "chunk_"), F.floor(F.col("chunks_") / 64) + 1)
    return points.withColumn("salt_", own).join(needs, ["key_", "bucket_", "salt_"]).where("chunk_ < for_").select("key_", F.col("for_").alias("chunk_"), "x_", "below_")
