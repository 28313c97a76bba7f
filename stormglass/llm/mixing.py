"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from stormglass.llm.common import cut, drop, text_or_empty, word_count

#: Newton steps at most; the log of the constraint is smooth, so some ten steps suffice.
MAX_STEPS = 60
#: Relative error of a source's expected words at which the dual counts as solved.
TOLERANCE = 1e-9
#: Documents that one rounding group holds on average.
GROUP_DOCS = 256


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: source_size, n_docs, target.

    Sources in code point order, null last, get the weights in turn. They split share x all
    words by weight, none above cap x its own words; what is cut is shared again by weight
    until none is above. That fixed point is a water level L with target = min(cap x size,
    L x weight): in the order of cap x size / weight the cut sources come first, so running
    sums over the (small) table of sources find L without a loop.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n_docs"))
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", turn[((F.col("rank") - 1) % len(weights)).cast("int")])
    everyone = Window.partitionBy(F.lit(1))
    level = Window.partitionBy(F.lit(1)).orderBy(F.col("most") / F.col("weight"), "rank")
    filled = (
        ranked.withColumn("most", F.lit(cap) * F.col("source_size"))
        .withColumn("words", F.lit(share) * F.sum("source_size").over(everyone))
        .withColumn("before", F.coalesce(F.sum("most").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level_here", (F.col("words") - F.col("before")) / F.col("weight_left"))
        .withColumn("cut", F.col("level_here") * F.col("weight") >= F.col("most"))
    )
    first_free = F.min(F.when(~F.col("cut"), F.struct(F.col("most") / F.col("weight"), "rank", "level_here"))).over(everyone)["level_here"]
    return filled.withColumn("level", first_free).select(
        "source", "source_size", "n_docs", "cut", F.when(F.col("cut"), F.col("most")).otherwise(F.col("level") * F.col("weight")).alias("target")
    )


def _rate(cap: float) -> Column:
    """min(cap, exp(lam x z)) for z = size / mean size of the source."""
    return F.when(F.col("cut"), F.lit(cap)).otherwise(F.exp(F.least(F.col("lam") * F.col("z"), F.log(F.lit(cap)))))


def tilt(units: DataFrame, targets: DataFrame, cap: float = 2.0) -> DataFrame:
    """targets with lam: the dual solution of entropy balancing for each source.

    Among rates r >= 0, r <= cap, those that lie nearest to 1 in relative entropy and meet
    sum(r x size) = target are r = min(cap, exp(lam x size)). Each Newton step on the log of
    that constraint is one aggregation over the histogram of sizes; the state is one row a
    source and is cut each time. Terms are summed as decimals, whose sum does not depend on
    the order of tasks, and a step that leaves the known bracket is replaced by a bisection.
    """
    hist = cut(units.where("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n")))
    mean = hist.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = (
        targets.join(mean, targets["source"].eqNullSafe(mean["source"]), "left")
        .drop(mean["source"])
        .withColumns({"lam": F.lit(0.0), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
    )
    old: list[str] = []
    state = cut(state.coalesce(1), old)
    exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")
    for _ in range(MAX_STEPS):
        seen = hist.join(state.where("not cut and target > 0").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        seen = seen.withColumn("z", F.col("size") / F.col("mean")).withColumn("rate", _rate(cap))
        got = seen.groupBy("source").agg(
            exact(F.col("n") * F.col("size") * F.col("rate")).alias("sum_rate"),
            exact(F.when(F.col("rate") < cap, F.col("n") * F.col("size") * F.col("z") * F.col("rate")).otherwise(0.0)).alias("slope"),
        )
        step = state.join(got.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        gap = F.log(F.col("sum_rate") / F.col("target"))
        step = (
            step.withColumn("gap", F.coalesce(gap, F.when(F.col("sum_rate") == 0, F.lit(-1e9)), F.lit(0.0)))
            .withColumn("lo", F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("hi")))
            .withColumn("newton", F.col("lam") - F.try_divide(F.col("gap") * F.col("sum_rate"), F.col("slope")))
        )
        inside = F.coalesce((F.col("newton") > F.coalesce("lo", F.lit(-1e18))) & (F.col("newton") < F.coalesce("hi", F.lit(1e18))), F.lit(False))
        halfway = F.coalesce(
            (F.col("lo") + F.col("hi")) / 2,
            F.when(F.col("gap") < 0, F.col("lam") + F.abs(F.col("lam")) + 1).otherwise(F.col("lam") - F.abs(F.col("lam")) - 1),
        )
        step = step.withColumn("next", F.when(inside, F.col("newton")).otherwise(halfway))
        done = F.abs(F.col("gap")) <= TOLERANCE
        seen_gap = Observation()
        step = step.withColumn("lam", F.when(done, F.col("lam")).otherwise(F.col("next"))).coalesce(1)
        step = cut(step.observe(seen_gap, F.max(F.abs("gap")).alias("worst")), old)
        worst = seen_gap.get["worst"]
        drop(units.sparkSession, old[:-1])
        state, old = step.select(*state.columns), old[-1:]
        if worst is None or worst <= TOLERANCE:
            break
    return state.withColumn("lam", F.round("lam", 10)).select("source", "source_size", "n_docs", "cut", "target", "mean", "lam")


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per distinct (id, source, size): n rows of it, source_size, target, rate, copies.

    Rates become whole copies by carrying the rounding error in words from one document to
    the next, longest first, inside groups of about GROUP_DOCS documents that a hash of the id
    deals out; a document gets floor(rate) or ceil(rate) copies, so never more than cap. The
    groups of a hot source are many, none of them grows, and reruns give the same copies.

    Null or empty texts have size 0, rate 1 and so one copy without words. Null sources form
    one source, which comes last. Rows that repeat id, source and size share one decision.
    """
    units = cut(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"))
        .groupBy("id", "source", "size")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    weighed = units.select("source", (F.col("size") * F.col("n")).alias("size"), "n")
    targets = cut(source_targets(weighed, weights, share, cap))
    solved = tilt(units, targets, cap).withColumnRenamed("source", "s")
    rated = (
        units.join(solved, F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("z", F.coalesce(F.col("size") / F.col("mean"), F.lit(0.0)))
        .withColumn("rate", F.when(F.col("size") > 0, _rate(cap)).otherwise(F.lit(1.0)))
    )
    groups = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / GROUP_DOCS))
    dealt = rated.withColumn("group", F.pmod(F.xxhash64("id", "size"), groups))
    entry = F.struct((-F.col("size") * F.col("n")).alias("order"), F.xxhash64("size", "id").alias("tie"), "id", "size", "n", "rate")
    gathered = dealt.groupBy("source", "group").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sort_array(F.collect_list(entry)).alias("docs")
    )

    def carry(acc: Column, doc: Column) -> Column:
        words = doc["size"] * doc["n"]
        due = doc["rate"] * words + acc["err"]
        copies = F.when(words == 0, F.lit(1)).otherwise(
            F.least(F.greatest(F.floor(F.try_divide(due, words) + 0.5), F.floor(doc["rate"])), F.least(F.ceil(doc["rate"]), F.lit(int(cap))))
        ).cast("long")
        return F.struct((due - copies * words).cast("double").alias("err"), F.concat(acc["copies"], F.array(copies)).alias("copies"))

    start = F.struct(F.lit(0.0).alias("err"), F.array().cast("array<bigint>").alias("copies"))
    counted = gathered.withColumn("copies", F.aggregate("docs", start, carry)["copies"])
    return counted.select("source", "source_size", "target", F.explode(F.arrays_zip("docs", "copies")).alias("d")).select(
        F.col("d.docs.id").alias("id"), "source", F.col("d.docs.size").alias("size"), F.col("d.docs.n").alias("n"), "source_size", "target", F.col("d.docs.rate").alias("rate"), F.col("d.copies").alias("copies")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; columns as they were, whatever their names.

    Null and empty texts stay once. Rows that repeat id, source and size are repeated alike;
    null ids and sources are matched like any other. An empty table gives no rows.
    """
    id_col, source_col, text_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text")))
    names = docs.columns
    taken = mix_copies(docs, **options).where("copies > 0").select("id", "source", "size", "copies")
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    packed = docs.select(row, F.col(id_col).alias("own_id"), F.col(source_col).alias("own_source"), word_count(text_or_empty(text_col)).alias("own_size"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_size") == F.col("size"))
    joined = packed.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return joined.select(*[F.col(f"row.`{c}`") for c in names])
