"""Scans and windows along time that split a key over many tasks.

Rows are dealt by ranges of (keys, order), so a key lies in as many ranges as its rows need.
A scan runs within each range, and what a range hands to the next ones of its key is one row
a range. Bounded windows run in chunks of row numbers that carry copies of their neighbours.
Null keys are a key like any other.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormglass.functions.scratch import cut

#: Rows of a chunk, without the copies of its neighbours.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Scan:
    """What rows up to here (or, with back, from here on) come to: "last" (not null), "sum", "min", "max" or "product" of value.

    Without own, the row itself is left out.
    """

    kind: str
    value: Column
    back: bool = False
    own: bool = True


_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}


def _both(kind: str, one: Column, other: Column) -> Column:
    if kind == "last":
        return F.coalesce(one, other)
    if kind in ("min", "max"):
        return (F.least if kind == "min" else F.greatest)(one, other)
    # where one side has nothing, the other stands
    return F.coalesce(one + other if kind == "sum" else one * other, one, other)


@dataclass(frozen=True)
class Dealt:
    """rows with key_ (the keys as a struct), part_ and at_: parts of a key follow each other, at_ orders the rows of a part."""

    rows: DataFrame
    keys: list[str]

    def _along(self, back: bool) -> Window:
        at = F.col("at_").desc() if back else F.col("at_")
        return Window.partitionBy("part_", "key_").orderBy(at)

    def scan(self, cells: dict[str, Scan]) -> Dealt:
        """rows with one column a scan. The rows are read twice, so they should be cheap to read.

        Parts come to one row each by an aggregation; a window over these rows, one a part of a
        key, gives what stands before; then it meets the part's rows, dealt as their own window is.
        """
        rows, ahead, upto = self.rows, Window.partitionBy("key_").orderBy("part_"), Window.unboundedPreceding
        sums = []
        for name, s in cells.items():
            at = F.when(s.value.isNotNull(), F.col("at_"))
            sums.append(((F.min_by if s.back else F.max_by)(s.value, at) if s.kind == "last" else _FOLDS[s.kind](s.value)).alias(f"{name}_sum"))
        parts = rows.groupBy("key_", "part_").agg(*sums)
        carries = []
        for name, s in cells.items():
            before = (Window.partitionBy("key_").orderBy(F.col("part_").desc()) if s.back else ahead).rowsBetween(upto, -1)
            c = F.col(f"{name}_sum")
            carries.append((F.last(c, ignorenulls=True) if s.kind == "last" else _FOLDS[s.kind](c)).over(before).alias(f"{name}_carry"))
        joined = rows.join(parts.select("key_", "part_", *carries), ["part_", "key_"])
        for name, s in cells.items():
            frame = self._along(s.back).rowsBetween(upto, 0 if s.own else -1)
            local = (F.last(s.value, ignorenulls=True) if s.kind == "last" else _FOLDS[s.kind](s.value)).over(frame)
            joined = joined.withColumn(name, _both(s.kind, local, F.col(f"{name}_carry")))
        return replace(self, rows=joined.drop(*[f"{n}_carry" for n in cells]))

    def settled(self, keep: list[str] | None = None) -> Dealt:
        """The same rows, written: later scans read them and not what made them."""
        return replace(self, rows=cut(self.rows, keep))

    def numbered(self) -> Dealt:
        """rows with place_, from 0 within the key, and last_, the place of its last row."""
        parts = self.rows.groupBy("key_", "part_").agg(F.count(F.lit(1)).alias("n_"), F.min("at_").alias("first_"))
        whole = Window.partitionBy("key_")
        before = F.coalesce(F.sum("n_").over(whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = parts.select("key_", "part_", (before - F.col("first_")).alias("shift_"), (F.sum("n_").over(whole) - 1).alias("last_"))
        out = self.rows.join(offsets, ["part_", "key_"]).withColumn("place_", F.col("at_") + F.col("shift_"))
        return replace(self, rows=out.drop("shift_"))

    def chunked(self, before: int, after: int, length: int | None = None) -> Dealt:
        """numbered() rows in chunks of `length` (CHUNK) places, each with copies (halo_) of so many rows on both sides.

        Windows over chunks then see what they need; whole() drops the copies again. A chunk is
        never shorter than its halo, so a row is copied once or twice at most.
        """
        size = max(length or CHUNK, before, after)
        own = F.floor(F.col("place_") / size)
        low, high = F.floor((F.col("place_") - after) / size), F.floor((F.col("place_") + before) / size)
        first, last = F.greatest(low, F.lit(0).cast("long")), F.least(high, F.floor(F.col("last_") / size))
        out = self.rows.withColumn("chunk_", F.explode(F.sequence(first, last))).withColumn("halo_", F.col("chunk_") != own)
        out = out.withColumn("part_", F.col("chunk_")).withColumn("at_", F.col("place_")).drop("chunk_")
        return replace(self, rows=out.repartition("part_", "key_"))

    def shifted(self, name: str, value: Column, by: int) -> Dealt:
        """rows of chunks with the value `by` rows later (earlier, if negative)."""
        along = self._along(False)
        return replace(self, rows=self.rows.withColumn(name, F.lead(value, by).over(along) if by >= 0 else F.lag(value, -by).over(along)))

    def extremes(self, cells: dict[str, tuple[str, Column, int, int]]) -> Dealt:
        """rows of chunks with the min or max of a value over the rows `start` to `end` after each; at the ends, of those there are.

        The places fall into blocks as long as the window. A window reaches from one block into
        the next at most, so it is the rest of the first from its start and the head of the
        second to its end: two running extremes a row, whatever the window's length.
        """
        rows, along, place = self.rows, self._along(False), F.col("place_")
        shift = lambda c, by: F.lead(c, by).over(along) if by >= 0 else F.lag(c, -by).over(along)
        for width in dict.fromkeys(end - start + 1 for _, _, start, end in cells.values()):
            of = {n: c for n, c in cells.items() if c[3] - c[2] + 1 == width}
            block = lambda x: F.floor(x / width)  # noqa: B023, E731
            running = Window.partitionBy("part_", "key_", "block_").rowsBetween(Window.unboundedPreceding, 0)
            rows = rows.withColumn("block_", block(place))
            for side, order in (("head", F.col("at_")), ("rest", F.col("at_").desc())):
                rows = rows.withColumns({f"{n}_{side}": _FOLDS[kind](value).over(running.orderBy(order)) for n, (kind, value, _, _) in of.items()})
            every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            shifted = {}
            for n, (_, _, start, end) in of.items():
                reaches = (place + start <= F.col("last_")) & (block(F.col("last_")) > block(place + start))
                shifted[f"{n}_first"] = shift(f"{n}_rest", start)
                shifted[f"{n}_second"] = F.when(place + end <= F.col("last_"), shift(f"{n}_head", end)).when(reaches, F.last(f"{n}_head").over(every))
            rows = rows.withColumns(shifted)
            rows = rows.withColumns({n: (F.least if c[0] == "min" else F.greatest)(f"{n}_first", f"{n}_second") for n, c in of.items()})
            rows = rows.drop("block_", *[f"{n}_{x}" for n in of for x in ("head", "rest", "first", "second")])
        return replace(self, rows=rows)

    def counts(self, cells: dict[str, tuple[Column, int, int]]) -> Dealt:
        """rows of chunks with how many values the rows `start` to `end` after each have, as differences of a running count."""
        rows, along, place = self.rows, self._along(False), F.col("place_")
        shift = lambda c, by: F.lead(c, by).over(along) if by >= 0 else F.lag(c, -by).over(along)
        upto = along.rowsBetween(Window.unboundedPreceding, 0)
        every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        for name, (value, start, end) in cells.items():
            rows = rows.withColumn("upto_", F.count(value).over(upto))
            high = F.when(place + end <= F.col("last_"), F.coalesce(shift("upto_", end), F.lit(0))).otherwise(F.last("upto_").over(every))
            low = F.when(place + start <= F.col("last_"), F.coalesce(shift("upto_", start - 1), F.lit(0))).otherwise(F.last("upto_").over(every))
            rows = rows.withColumn(name, high - low).drop("upto_")
        return replace(self, rows=rows)

    def whole(self) -> Dealt:
        """The rows of chunks without the copies."""
        return replace(self, rows=self.rows.where("not halo_").drop("halo_"))

    def plain(self) -> DataFrame:
        """The rows as they came, with the columns that were added."""
        return self.rows.drop("key_", "part_", "at_", "place_", "last_")


def deal(df: DataFrame, keys: list[str], order: list[str], keep: list[str] | None = None) -> Dealt:
    """df dealt by ranges of (keys, order), sorted and numbered within them, and written.

    Range bounds come from a sample, so the table is written once, lest two readers see other
    ranges. A key without many rows lies in one range, or in two.
    """
    by = [*keys, *order]
    rows = df.withColumn("key_", F.struct(*keys)).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id_", F.monotonically_increasing_id())
    rows = rows.withColumns({"part_": F.shiftright("id_", 33), "at_": F.col("id_").bitwiseAND(F.lit((1 << 33) - 1))}).drop("id_")
    return Dealt(cut(rows, keep), keys)
