"""Correlation structure: Gram matrices gathered per partition, eigenvalues of small matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormglass.functions.scratch import cut, drop
from stormglass.operators.impulse import SAMPLES, sample_flags
from stormglass.operators.windows import row_index


def corr_matrix(long: DataFrame, date: str, name: str, value: str) -> DataFrame:
    """Pairwise complete correlations a <= b with n; null where a pair has no two rows or no spread.

    Dates become rows of a matrix with a column a name; each partition multiplies its rows and
    their masks, so p x p moments travel and not every pair of every date. Values are taken
    from their mean first, so that nothing cancels out.
    """
    rows = long.where(F.col(value).isNotNull())
    means = {r["name"]: r["mean"] for r in rows.groupBy(F.col(name).alias("name")).agg(F.avg(value).alias("mean")).collect()}
    names = sorted(means)
    wide = rows.groupBy(date).pivot(name, names).agg(F.max(value)).select(*[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    centre = np.array([means[n] for n in names])
    one, two = np.triu_indices(len(names))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, len(names), len(names)))
        for batch in batches:
            x = batch.to_numpy(float) - centre
            here = np.isfinite(x).astype(float)
            x = np.where(here > 0, x, 0.0)
            total += np.stack([here.T @ here, x.T @ here, here.T @ x, (x * x).T @ here, here.T @ (x * x), x.T @ x])
        cells = total[:, one, two]
        some = cells[0] > 0
        yield pd.DataFrame({"a": np.array(names, object)[one[some]], "b": np.array(names, object)[two[some]], **{c: cells[k, some] for k, c in enumerate(("n", "sa", "sb", "saa", "sbb", "sab"))}})

    parts = wide.mapInPandas(part, "a string, b string, n double, sa double, sb double, saa double, sbb double, sab double")
    sums = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    real = lambda s, ss: spread(s, ss) > 1e-12 * F.col(ss)
    corr = (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(spread("sa", "saa") * spread("sb", "sbb"))
    return sums.select("a", "b", F.col("n").cast("long").alias("n"), F.when((F.col("n") > 1) & real("sa", "saa") & real("sb", "sbb"), corr).alias("corr"))


def gram(wide: DataFrame, columns: dict[str, list[str]], by: str) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Per group its rows that are complete in its own columns: (n, sums, cross products); groups that are not named are left out.

    One pass for all groups; one matrix a partition and group travels.
    """
    every = sorted({c for own in columns.values() for c in own})

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = {g: [0, np.zeros(len(own)), np.zeros((len(own), len(own)))] for g, own in columns.items()}
        for batch in batches:
            for g, rows in batch.groupby(by):
                x = rows[columns[g]].to_numpy(float)
                x = x[np.isfinite(x).all(axis=1)]
                have = kept[g]
                have[0] += len(x)
                have[1] += x.sum(axis=0)
                have[2] += x.T @ x
        for g, (n, s, m) in kept.items():
            if n:
                yield pd.DataFrame({"g": [g], "n": [n], "v": [np.concatenate([s, m.reshape(-1)])]})

    named = wide.where(F.col(by).isin(list(columns))).select(by, *[F.col(f"`{c}`") for c in every])
    parts = named.mapInPandas(part, "g string, n long, v array<double>")
    sums = parts.select("g", "n", F.posexplode("v").alias("k", "x")).groupBy("g", "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    flat = {g: np.zeros(len(own) + len(own) ** 2) for g, own in columns.items()}
    n = dict.fromkeys(columns, 0)
    for r in sums:
        flat[r["g"]][r["k"]], n[r["g"]] = r["x"], r["n"]
    return {g: (n[g], flat[g][: len(own)], flat[g][len(own) :].reshape(len(own), len(own))) for g, own in columns.items()}


def correlation_of(n: int, sums: np.ndarray, cross: np.ndarray) -> np.ndarray:
    mean = sums / n
    cov = cross / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return cov / np.outer(std, std)


def conditional_pca(aligned: DataFrame, time: str = "ts", key: str = "ticker", reference: str = "", least: int = 30, components: int = 5) -> tuple[DataFrame, DataFrame]:
    """(summary, loadings) per sample and component.

    summary: status, rows, drivers, explained and cumulative ratio, correlation with the
    reference, and the three strongest drivers of either sign; a sample without enough
    complete rows has one row that says so. loadings: one row a driver, turned so that the
    component moves with the reference.

    Drivers that are too sparse or constant go, then the sparsest, until enough complete rows
    are left. That order depends on the counts alone, so one histogram of how many of the
    ordered drivers a row has before its first gap answers every step, for all samples at once.
    One pass then gathers the Gram matrices of all samples, reference included, and scores are
    never made: corr(score, ref) = v . c / sqrt(lambda).
    """
    spark, written = aligned.sparkSession, []
    flagged = aligned.withColumn("sample", F.explode(sample_flags()))
    names = sorted(r[0] for r in aligned.where(F.col(key) != reference).select(key).distinct().collect())
    ref = flagged.groupBy("sample", time).agg(F.max("ref_ret").alias("ref_"))
    wide = cut(flagged.groupBy("sample", time).pivot(key, names).agg(F.max("ret")).join(ref, ["sample", time]), written)
    cells = [F.count(f"`{n}`").alias(f"n_{k}") for k, n in enumerate(names)] + [F.stddev_samp(f"`{n}`").alias(f"s_{k}") for k, n in enumerate(names)]
    orders = {}
    for seen in wide.where(F.col("sample").isin(SAMPLES[1:])).groupBy("sample").agg(*cells).collect():
        fit = [k for k in range(len(names)) if seen[f"n_{k}"] >= least and (seen[f"s_{k}"] or 0) > 0]
        # the earliest of equally sparse drivers goes first, so it stands last
        orders[seen["sample"]] = [names[k] for k in sorted(fit, key=lambda k: (-seen[f"n_{k}"], -k))]  # noqa: B023
    used = {s: [n for n in names if n in use] for s, use in _complete_drivers(wide, orders, least).items()}
    moments = gram(wide, {s: [*use, "ref_"] for s, use in used.items()}, "sample") if used else {}
    drop(spark, written)
    summary, loadings = [], []
    for sample in SAMPLES[1:]:
        if sample not in moments:
            summary.append((sample, None, "insufficient_complete_rows", 0, 0, None, None, None, None, None))
            continue
        use, (n, sums, cross) = used[sample], moments[sample]
        corr = correlation_of(n, sums, cross)
        values, vectors = np.linalg.eigh(corr[:-1, :-1])
        total = 0.0
        for k, i in enumerate(np.argsort(values)[::-1][: min(components, len(use), n - 1)], 1):
            v, share = vectors[:, i], float(max(values[i], 0.0) / len(use))
            total += share
            # a component without variance has no scores to correlate
            with_ref = float(v @ corr[:-1, -1] / np.sqrt(values[i])) if values[i] > 1e-9 else float("nan")
            known = np.isfinite(with_ref)
            turned = v * (np.sign(with_ref) if known and with_ref else np.sign(v[np.argmax(np.abs(v))]))
            strongest = sorted(zip(use, turned.tolist(), strict=True), key=lambda t: -abs(t[1]))
            up, down = (", ".join([d for d, x in strongest if x * side > 0][:3]) for side in (1, -1))
            strength = abs(with_ref) if known else None
            summary.append((sample, k, "fit", int(n), len(use), share, total, strength, up, down))
            loadings += [(sample, k, d, x, abs(x), share, strength) for d, x in zip(use, turned.tolist(), strict=True)]
    first = spark.createDataFrame(summary, "sample string, component int, status string, n_rows long, n_drivers int, explained double, cumulative double, abs_corr_reference double, top_positive string, top_negative string")
    return first, spark.createDataFrame(loadings, "sample string, component int, driver string, loading double, abs_loading double, explained double, abs_corr_reference double")


def _complete_drivers(wide: DataFrame, orders: dict[str, list[str]], least: int) -> dict[str, list[str]]:
    """Per sample the longest head of its ordered drivers, two at least, that enough rows have complete; samples without one are left out.

    One histogram for all samples: how many of its sample's drivers a row has before its first gap.
    """
    orders = {s: order for s, order in orders.items() if len(order) > 1}
    if not orders:
        return {}
    gap = F.coalesce(*[F.when(F.col("sample") == s, F.coalesce(*[F.when(F.col(f"`{n}`").isNull(), F.lit(k)) for k, n in enumerate(order)], F.lit(len(order)))) for s, order in orders.items()])
    found = wide.where(F.col("ref_").isNotNull()).groupBy("sample", gap.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("k is not null").collect()
    heads = {}
    for s, order in orders.items():
        full = lambda size: sum(r["n"] for r in found if r["sample"] == s and r["k"] >= size)  # noqa: B023, E731
        size = next((size for size in range(len(order), 1, -1) if full(size) >= least), 0)
        if size:
            heads[s] = order[:size]
    return heads


def absorption(x: np.ndarray, least_rows: int, least_columns: int = 2, top: int = 3, share: float | None = None) -> tuple[int, int, float | None]:
    """(complete rows, columns, share of variance in the first components) of one window.

    With share, columns that are present in that share of rows stay. Without, columns with
    least_rows values and a spread stay, and the sparsest go until least_rows rows are complete.
    """
    have = np.isfinite(x)
    count = have.sum(axis=0)
    if share is not None:
        columns = np.flatnonzero(count >= share * max(1, len(x))).tolist()
        full = x[:, columns][have[:, columns].all(axis=1)]
    else:
        spread = [len(x) > 1 and count[k] > 1 and x[have[:, k], k].std(ddof=1) > 0 for k in range(x.shape[1])]
        columns = sorted((k for k in range(x.shape[1]) if count[k] >= least_rows and spread[k]), key=lambda k: (-count[k], -k))
        full = x[:0]
        while len(columns) >= 2 and len(full := x[:, columns][have[:, columns].all(axis=1)]) < least_rows:
            columns.pop()
        if len(columns) < 2:
            return 0, len(columns), None
    if len(full) < max(least_rows, 2) or len(columns) < least_columns:
        return len(full), len(columns), None
    varied = full[:, full.std(axis=0) > 0]
    if varied.shape[1] < 2:
        return len(full), len(columns), 1.0 if varied.shape[1] else None
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(varied, rowvar=False)))[::-1]
    return len(full), len(columns), float(values[: min(top, len(full) - 1)].sum() / values.sum())


class GramBlocks:
    """Rows of numbers cut at some places, each piece summed up by the pattern of what is missing.

    A window from one cut to another is a difference of two prefix sums of row counts, sums and
    Gram matrices, one for each pattern; what a choice of columns leaves complete is the sum
    over the patterns that have them. Values are taken from their column's mean, so that
    differences keep their digits; lowest and highest values tell constant columns apart.
    """

    #: Numbers that the sums may have; rows with too many patterns are worked on window by window instead.
    CELLS = 1 << 23

    def __init__(self, x: np.ndarray, marked: np.ndarray, cuts: np.ndarray):
        have = np.isfinite(x)
        self.bits, which = np.unique(np.column_stack([have, marked]), axis=0, return_inverse=True)
        self.bits, self.marked = self.bits[:, :-1], self.bits[:, -1]
        self.shape, p = (len(cuts), len(self.bits)), x.shape[1]
        self.fits = len(cuts) * len(self.bits) * p * p <= self.CELLS
        if not self.fits:
            return
        center = np.where(have, x, 0).sum(axis=0) / np.maximum(have.sum(axis=0), 1)
        flat = np.where(have, x - center, 0)
        self.n, self.sums, self.gram = np.zeros(self.shape), np.zeros((*self.shape, p)), np.zeros((*self.shape, p, p))
        self.low, self.high = np.full((*self.shape, p), np.inf), np.full((*self.shape, p), -np.inf)
        piece = np.searchsorted(cuts, np.arange(len(x)), side="right")
        inside = np.flatnonzero((piece > 0) & (piece < len(cuts)))
        cell = piece[inside] * len(self.bits) + which[inside]
        order = inside[np.argsort(cell, kind="stable")]
        cells, starts = np.unique(np.sort(cell), return_index=True)
        for c, rows in zip(cells.tolist(), np.split(order, starts[1:]) if len(cells) else [], strict=True):
            at, own = divmod(c, len(self.bits)), flat[rows]
            self.n[at], self.sums[at], self.gram[at] = len(rows), own.sum(axis=0), own.T @ own
            self.low[at], self.high[at] = own.min(axis=0), own.max(axis=0)
        for total in (self.n, self.sums, self.gram):
            np.cumsum(total, axis=0, out=total)

    def absorption(self, begin: int, end: int, of: np.ndarray, least_rows: int, least_columns: int, top: int, share: float | None) -> tuple[int, int, float | None]:
        """absorption() of the rows between two cuts, of the patterns marked in `of`."""
        n = np.where(of, self.n[end] - self.n[begin], 0)
        size, count = int(n.sum()), n @ self.bits
        low, high = self.low[begin + 1 : end + 1].min(axis=0), self.high[begin + 1 : end + 1].max(axis=0)
        complete = lambda columns: n * self.bits[:, columns].all(axis=1)
        if share is not None:
            columns = np.flatnonzero(count >= share * max(1, size)).tolist()
            rows = complete(columns)
        else:
            seen = of[:, None] & self.bits
            spread = np.where(seen, high, -np.inf).max(axis=0, initial=-np.inf) > np.where(seen, low, np.inf).min(axis=0, initial=np.inf)
            columns = sorted((k for k in range(len(count)) if count[k] >= least_rows and count[k] > 1 and spread[k]), key=lambda k: (-count[k], -k))
            rows = np.zeros(len(n))
            while len(columns) >= 2 and (rows := complete(columns)).sum() < least_rows:
                columns.pop()
            if len(columns) < 2:
                return 0, len(columns), None
        full = int(rows.sum())
        if full < max(least_rows, 2) or len(columns) < least_columns:
            return full, len(columns), None
        used = rows > 0
        varied = [c for c in columns if high[used, c].max() > low[used, c].min()]
        if len(varied) < 2:
            return full, len(columns), 1.0 if varied else None
        mean = (self.sums[end] - self.sums[begin])[used][:, varied].sum(axis=0) / full
        cov = (self.gram[end] - self.gram[begin])[used][:, varied][:, :, varied].sum(axis=0) / full - np.outer(mean, mean)
        std = np.sqrt(np.diag(cov))
        values = np.sort(np.linalg.eigvalsh(cov / np.outer(std, std)))[::-1]
        return full, len(columns), float(values[: min(top, full - 1)].sum() / values.sum())


def rolling_absorption(
    wide: DataFrame, columns: list[str], time: str, width: int, step: int, least_rows: int, least_columns: int = 2, share: float | None = 0.8, top: int = 3, flag: str | None = None, chunk_ends: int = 64
) -> DataFrame:
    """Share of variance in the first components over windows of `width` rows, one every `step` rows.

    A window has the time of its last row. Per window: n_rows (complete ones), n_columns,
    absorption; with flag, a boolean column, also flagged_rows and flagged_absorption over its
    flagged rows alone, of which a quarter of least_rows (8 at least) must be complete.

    Rows are dealt to chunks of windows with the rows before them as halo, so each task
    computes its windows alone and a row is copied about width / (step x chunk_ends) times.
    Within a task a row goes into one piece's sums, whatever the number of windows over it.
    """
    span = step * chunk_ends
    rows = row_index(wide.select(time, *[F.col(f"`{c}`") for c in columns], *([flag] if flag else [])), [time], "i")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("i").alias("last")))).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("i") / span), F.floor((F.col("i") + width - 1) / span))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        i, x = pdf["i"].to_numpy(), pdf[columns].to_numpy(float)
        marked = pdf[flag].fillna(False).to_numpy(bool) if flag else np.zeros(len(pdf), bool)
        chunk, last, first = int(pdf["chunk"].iloc[0]), int(pdf["last"].iloc[0]), int(i[0])
        # end is one past the window's last row; the reference's last end is the last row's index
        ends = [e for e in range(max(width, chunk * span + 1), min((chunk + 1) * span, last) + 1) if (e - width) % step == 0]
        places = np.unique([p - first for e in ends for p in (e - width, e)]).astype(np.int64)
        blocks, out = GramBlocks(x, marked, places), []
        for end in ends:
            a, b = end - width - first, end - first
            own = np.flatnonzero(marked[a:b]) + a
            least = max(8, least_rows // 4)
            if blocks.fits:
                at = np.searchsorted(places, [a, b]).tolist()
                found = blocks.absorption(*at, np.ones(blocks.shape[1], bool), least_rows, least_columns, top, share)
                chosen = blocks.absorption(*at, blocks.marked, least, least_columns, top, share)[2] if flag else None
            else:
                found = absorption(x[a:b], least_rows, least_columns, top, share)
                chosen = absorption(x[own], least, least_columns, top, share)[2] if flag else None
            out.append([pdf[time].iloc[b - 1], *found, *([len(own), chosen] if flag else [])])
        return pd.DataFrame(out, columns=[time, "n_rows", "n_columns", "absorption", *(["flagged_rows", "flagged_absorption"] if flag else [])])

    kind = wide.schema[time].dataType.simpleString()
    extra = ", flagged_rows long, flagged_absorption double" if flag else ""
    return rows.groupBy("chunk").applyInPandas(run, f"{time} {kind}, n_rows long, n_columns long, absorption double{extra}")
