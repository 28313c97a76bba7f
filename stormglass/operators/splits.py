"""Temporal splits as tables: folds are intervals of row numbers, and rows meet them by a join only where wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormglass.operators.scans import Scan, deal
from stormglass.operators.windows import running_sum


def indexed(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """row_idx from 0 and n_rows within each key, by ranges of (key, time): no key is sorted in one task."""
    rows = deal(df, keys, [time]).numbered().rows
    return rows.withColumns({"row_idx": F.col("place_"), "n_rows": F.col("last_") + 1}).drop("key_", "part_", "at_", "place_", "last_")


def chronological(df: DataFrame, fraction: float) -> DataFrame:
    """role: the first int(n x fraction) rows train, the rest test. A key that is left without train or test rows is an error when rows are read."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    begin = F.floor(F.col("n_rows") * fraction)
    short = F.raise_error(F.lit("not enough rows for the chronological split")).cast("string")
    return df.withColumn("role", F.when((begin < 1) | (begin >= F.col("n_rows")), short).when(F.col("row_idx") < begin, "train").otherwise("test"))


def purge_mask(idx: Column, start: Column, horizon: int) -> Column:
    """Rows whose label ends before the interval."""
    return idx + horizon < start


def embargo_mask(idx: Column, end: Column, embargo: int) -> Column:
    """Rows that lie after the interval and its embargo."""
    return idx > end + embargo


def _codes(folds: DataFrame, horizon: int, later: Column) -> DataFrame:
    """Folds (keys, n_rows, fold, test_start, test_end) with the rows that train: up to train_to and from later_from on."""
    coded = folds.withColumns({"train_to": F.col("test_start") - horizon - 1, "later_from": F.least(later, F.col("n_rows"))})
    n_train = F.greatest(F.col("train_to") + 1, F.lit(0)) + F.col("n_rows") - F.col("later_from")
    return coded.withColumns({"n_train": n_train, "n_test": F.col("test_end") - F.col("test_start") + 1})


def purged_intervals(sizes: DataFrame, keys: list[str], n_splits: int, horizon: int, embargo: int, least_train: int = 1) -> DataFrame:
    """Contiguous test folds as intervals of row numbers, train rows purged before and embargoed after; sizes: keys and n_rows.

    A fold is one row whatever it holds: its rows follow by assigned(), what it says about them
    by fold_summary() and fold_sums(), whose cost does not grow with rows x folds.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold")
    folds = sizes.select(*keys, "n_rows", k).withColumn("base_", F.floor(F.col("n_rows") / n_splits)).withColumn("extra_", F.col("n_rows") % n_splits)
    start = F.col("fold") * F.col("base_") + F.least("fold", "extra_")
    folds = folds.withColumn("test_start", start).withColumn("test_end", start + F.col("base_") + (F.col("fold") < F.col("extra_")).cast("int") - 1).drop("base_", "extra_")
    return _codes(folds, horizon, F.col("test_end") + embargo + 1).where(F.col("n_train") >= least_train)


def expanding_intervals(sizes: DataFrame, keys: list[str], least_train: int, step: int, horizon: int, embargo: int, include_future: bool = True) -> DataFrame:
    """Test windows of `step` rows from least_train on as intervals; train rows before start - horizon.

    With include_future, rows from one past the embargo on train as well. Folds grow with the
    rows, but each is one row (see purged_intervals).
    """
    long = sizes.where(F.col("n_rows") > least_train)
    last = F.floor((F.col("n_rows") - 1 - least_train) / step)
    folds = long.select(*keys, "n_rows", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("step_"))
    folds = folds.withColumns({"fold": F.col("step_").cast("int"), "test_start": least_train + F.col("step_") * step}).drop("step_")
    folds = folds.withColumn("test_end", F.least(F.col("test_start") + step, F.col("n_rows")) - 1)
    return _codes(folds, horizon, F.col("test_end") + embargo + 2 if include_future else F.col("n_rows"))


def assigned(df: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with fold and role, for those who want each fold's rows: one row a row and fold it has a role in."""
    rows = df.drop("n_rows").join(folds.drop("n_rows", "n_train", "n_test"), keys)
    i = F.col("row_idx")
    role = F.when(i.between(F.col("test_start"), F.col("test_end")), "test").when((i <= F.col("train_to")) | (i >= F.col("later_from")), "train")
    return rows.withColumn("role", role).drop("train_to", "later_from").where("role is not null")


def sizes_of(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"))


def purged_folds(df: DataFrame, keys: list[str], n_splits: int, horizon: int, embargo: int, least_train: int = 1) -> DataFrame:
    """assigned() rows of purged_intervals()."""
    return assigned(df, purged_intervals(sizes_of(df, keys), keys, n_splits, horizon, embargo, least_train), keys)


def expanding_folds(df: DataFrame, keys: list[str], least_train: int, step: int, horizon: int, embargo: int, include_future: bool = True) -> DataFrame:
    """assigned() rows of expanding_intervals()."""
    return assigned(df, expanding_intervals(sizes_of(df, keys), keys, least_train, step, horizon, embargo, include_future), keys)


def fold_bounds(folds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fold, role, n, first_idx, last_idx) of the folds' roles that have rows, from the intervals alone."""
    before, after = F.col("train_to") >= 0, F.col("later_from") < F.col("n_rows")
    train = F.struct(F.lit("train").alias("role"), F.col("n_train").alias("n"), F.when(before, F.lit(0).cast("long")).otherwise(F.col("later_from")).alias("first_idx"), F.when(after, F.col("n_rows") - 1).otherwise(F.col("train_to")).alias("last_idx"))
    test = F.struct(F.lit("test").alias("role"), F.col("n_test").alias("n"), F.col("test_start").alias("first_idx"), F.col("test_end").alias("last_idx"))
    return folds.select(*keys, "fold", F.explode(F.array(train, test)).alias("r")).select(*keys, "fold", "r.*").where("n > 0")


def fold_summary(df: DataFrame, folds: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Per fold the range and size of both roles: the four rows at the ends of each fold's roles are looked up by number."""
    ends = fold_bounds(folds, keys).select(*keys, "fold", "role", "n", F.explode(F.array(F.struct(F.lit("first").alias("end"), F.col("first_idx").alias("row_idx")), F.struct(F.lit("last").alias("end"), F.col("last_idx").alias("row_idx")))).alias("e"))
    found = ends.select(*keys, "fold", "role", "n", "e.*").join(df.select(*keys, "row_idx", time), [*keys, "row_idx"])
    at = lambda role, end: F.max(F.when((F.col("role") == role) & (F.col("end") == end), F.col(time)))
    n = lambda role: F.coalesce(F.max(F.when(F.col("role") == role, F.col("n"))), F.lit(0).cast("long"))
    return found.groupBy(*keys, "fold").agg(
        at("train", "first").alias("train_start"), at("train", "last").alias("train_end"), at("test", "first").alias("test_start_time"), at("test", "last").alias("test_end_time"),
        n("train").alias("n_train"), n("test").alias("n_test"),
    )


def fold_sums(df: DataFrame, folds: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, fold, role, n, and the sum of each value) of every fold, as differences of running sums at the ends of its intervals.

    df: indexed() rows. Running sums come from scans over ranges of rows; a fold asks for six of
    them at most, so expanding folds, whose rows grow with the square of the series, cost as
    many lookups as there are folds.
    """
    upto = deal(df, keys, ["row_idx"]).scan({f"sum_{v}": Scan("sum", F.coalesce(F.col(v).cast("double"), F.lit(0.0))) for v in values}).rows
    sums = upto.select(*keys, "row_idx", *[f"sum_{v}" for v in values])
    last = F.col("n_rows") - 1
    # a role's rows are those up to some numbers, added, less those up to others; number -1 has no rows
    parts = [("train", F.col("train_to"), 1), ("train", last, 1), ("train", F.col("later_from") - 1, -1), ("test", F.col("test_end"), 1), ("test", F.col("test_start") - 1, -1)]
    asked = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), at.cast("long").alias("row_idx"), F.lit(sign).alias("sign")) for role, at, sign in parts])).alias("e")
    found = folds.select(*keys, "fold", "n_train", "n_test", asked).select(*keys, "fold", "n_train", "n_test", "e.*").join(sums, [*keys, "row_idx"], "left")
    n = F.when(F.col("role") == "train", F.col("n_train")).otherwise(F.col("n_test"))
    return found.groupBy(*keys, "fold", "role").agg(F.max(n).alias("n"), *[F.sum(F.col("sign") * F.coalesce(F.col(f"sum_{v}"), F.lit(0.0))).alias(v) for v in values]).where("n > 0")


def holdout(df: DataFrame, keys: list[str], time: str, cutoff: str, purge: int = 20) -> DataFrame:
    """role: before the cutoff train, but for its last `purge` rows; from the cutoff on test."""
    early = F.col(time) < F.lit(cutoff).cast("date")
    back = F.row_number().over(Window.partitionBy(*keys, early).orderBy(F.col(time).desc()))
    role = F.when(~early, "test").when(F.col("back_") > purge, "train")
    return df.withColumn("back_", back).withColumn("role", role).drop("back_").where("role is not null")


def stratified_random(df: DataFrame, label: str, unique: list[str], train_share: float = 0.7, seed: int = 42) -> DataFrame:
    """role: a shuffled share of every class trains (the control that ignores time); the order is a hash of the unique columns."""
    place = F.xxhash64(*unique, F.lit(seed))
    ranked = running_sum(df.withColumn("place_", place), [label, "place_", *unique], {"rank_": F.lit(1)}, [label])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("all_"))
    role = F.when(F.col("rank_") <= F.round(F.col("all_") * train_share), "train").otherwise("test")
    return ranked.join(sizes, label).withColumn("role", role).drop("place_", "rank_", "all_")


def three_way(df: DataFrame, time: str, validation: str, test: str) -> DataFrame:
    """role by date: train before `validation`, validation before `test`, test from there on."""
    day = lambda x: F.lit(x).cast("date")
    return df.withColumn("role", F.when(F.col(time) < day(validation), "train").when(F.col(time) < day(test), "validation").otherwise("test"))
