"""Baselines and logistic models of rare events, fitted by aggregations."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormglass.functions.scratch import cut, drop
from stormglass.operators.windows import exact_quantiles


#: Sums of one aggregation.
SUMS = 200


def historical_frequency(train: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """rows with the constant probability of the train labels."""
    rate = train.agg(F.avg(F.col(label).cast("double")).alias("p"))
    if rate.first()[0] is None:
        raise ValueError("no labels to learn from")
    return rows.crossJoin(F.broadcast(rate))


@dataclass
class Logistic:
    """A fitted model in plain numbers; with one class in the train rows, only their rate."""

    fill: dict[str, float]
    mean: dict[str, float]
    scale: dict[str, float]
    weights: dict[str, float]
    intercept: float
    rate: float | None = None

    def probability(self) -> Column:
        """The probability of a row, in built-in expressions."""
        if self.rate is not None:
            return F.lit(self.rate)
        terms = (w * scaled(f, self) for f, w in self.weights.items())
        return 1 / (1 + F.exp(-sum(terms, F.lit(self.intercept))))


def scaled(feature: str, model: Logistic) -> Column:
    value = F.coalesce(F.col(f"`{feature}`").cast("double"), F.lit(model.fill[feature]))
    return (value - model.mean[feature]) / model.scale[feature]


@dataclass(frozen=True)
class Spec:
    """A model to fit: its features (none: the mean of the label), label, train rows, inverse penalty and class weights."""

    features: list[str]
    label: str
    train: Column | None = None
    c: float = 1.0
    balanced: bool = True

    def known(self) -> Column:
        """Whether a row is one to learn from."""
        labelled = F.col(f"`{self.label}`").isNotNull()
        return labelled if self.train is None else labelled & F.coalesce(self.train, F.lit(False))


@dataclass
class _Newton:
    """Where a model stands: accepted parameters with their loss, gradient and curvature, and the step that is tried."""

    theta: np.ndarray
    step: np.ndarray
    loss: float = math.inf
    gradient: np.ndarray | None = None
    curvature: np.ndarray | None = None
    taken: int = 0
    done: bool = False

    def told(self, loss: float, gradient: np.ndarray, curvature: np.ndarray, steps: int) -> None:
        """The sums at theta - step; a step that does not help is halved."""
        if loss > self.loss + 1e-12 * abs(self.loss) and np.abs(self.step).max() >= 1e-9:
            self.step = self.step / 2
            return
        first = self.gradient is None
        self.done = not first and (np.abs(self.step).max() < 1e-8 or self.taken >= steps)
        self.theta, self.loss, self.gradient, self.curvature = self.theta - self.step, loss, gradient, curvature
        self.taken += 1
        self.step = np.linalg.lstsq(curvature, gradient, rcond=None)[0]


def fit_many(rows: DataFrame, specs: dict[str, Spec], steps: int = 50) -> dict[str, Logistic]:
    """Every model of the specs: median imputation, population scaling, L2 logistic regression by Newton steps.

    Each minimises the (weighted) log losses plus w'w / (2c), the intercept unpenalised. All
    models take their steps together: one aggregation over the rows, which are written once and
    not copied for any model, gives the gradient and the upper half of the curvature of all
    that have not ended. For p features these are (p + 1)(p + 4) / 2 sums a model, and only they
    reach the driver; SUMS of them go into one aggregation. So the number of jobs is that of the
    steps of the slowest model, not of all models.
    """
    old: list[str] = []
    names = list(specs)
    columns = sorted({f for s in specs.values() for f in s.features})
    place = {f: f"x{k}" for k, f in enumerate(columns)}
    labels = {label: f"y{k}" for k, label in enumerate(dict.fromkeys(s.label for s in specs.values()))}
    data = cut(rows.select(
        *[F.col(f"`{f}`").cast("double").alias(c) for f, c in place.items()], *[F.col(f"`{f}`").cast("double").alias(c) for f, c in labels.items()],
        *[s.known().alias(f"in{k}") for k, s in enumerate(specs.values())],
    ), old)
    inside = lambda k, c: F.when(F.col(f"in{k}"), c)
    y = {k: F.col(labels[s.label]) for k, s in enumerate(specs.values())}
    counts = data.agg(*[f.alias(f"{n}{k}") for k in y for n, f in (("n", F.count(inside(k, y[k]))), ("pos", F.count(inside(k, F.when(y[k] == 1, 1)))), ("mean", F.avg(inside(k, y[k]))))]).first()
    out: dict[str, Logistic] = {}
    fitted: dict[int, Spec] = {}
    for k, (name, s) in enumerate(specs.items()):
        if not counts[f"n{k}"]:
            raise ValueError("no labels to learn from")
        if not s.features or counts[f"pos{k}"] in (0, counts[f"n{k}"]):
            out[name] = Logistic({}, {}, {}, {}, 0.0, counts[f"mean{k}"])
        else:
            fitted[k] = s
    cells = {f"c{k}_{f}": inside(k, F.col(place[f])) for k, s in fitted.items() for f in s.features}
    short = {c: f"m{i}" for i, c in enumerate(cells)}
    middle = exact_quantiles(data.select(*[x.alias(short[c]) for c, x in cells.items()]), {c: (short[c], 0.5) for c in cells}) if cells else {}
    fill = {c: 0.0 if m is None else m for c, m in middle.items()}
    filled = {c: inside(int(c[1:].split("_")[0]), F.coalesce(F.col(place[c.split("_", 1)[1]]), F.lit(fill[c]))) for c in cells}
    moments = data.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(filled.values()) for n, f in (("avg", F.avg), ("std", F.stddev_pop))]).first() if cells else None
    where = {c: i for i, c in enumerate(filled)}
    for k, s in fitted.items():
        of = {f: where[f"c{k}_{f}"] for f in s.features}
        out[names[k]] = Logistic({f: fill[f"c{k}_{f}"] for f in s.features}, {f: moments[f"avg{i}"] for f, i in of.items()}, {f: moments[f"std{i}"] or 1.0 for f, i in of.items()}, {}, 0.0)

    # what every step reads: scaled features, labels and weights of each model, null outside its train rows
    ready = []
    for k, s in fitted.items():
        model, n, pos, hit = out[names[k]], counts[f"n{k}"], counts[f"pos{k}"], y[k] == 1
        ready += [inside(k, (F.coalesce(F.col(place[f]), F.lit(model.fill[f])) - model.mean[f]) / model.scale[f]).alias(f"z{k}_{i}") for i, f in enumerate(s.features, 1)]
        ready += [inside(k, hit.cast("double")).alias(f"hit{k}"), inside(k, F.when(hit, n / (2 * pos)).otherwise(n / (2 * (n - pos))) if s.balanced else F.lit(1.0)).alias(f"w{k}")]
    scaled_rows = cut(data.select(*ready), old) if ready else data

    def stepped(thetas: dict[int, np.ndarray]) -> list[float]:
        """Loss, gradient and half of the curvature of some models at some parameters, by one aggregation."""
        score = {f"s{k}": sum((float(t) * F.col(f"z{k}_{i}") for i, t in enumerate(theta[1:], 1)), F.lit(float(theta[0]))) for k, theta in thetas.items()}
        rows_ = scaled_rows.withColumns(score).withColumns({f"p{k}": 1 / (1 + F.exp(-F.col(f"s{k}"))) for k in thetas})
        rows_ = rows_.withColumns({f"g{k}": F.col(f"w{k}") * (F.col(f"p{k}") - F.col(f"hit{k}")) for k in thetas} | {f"h{k}": F.col(f"w{k}") * F.col(f"p{k}") * (1 - F.col(f"p{k}")) for k in thetas})
        wanted = []
        for k, theta in thetas.items():
            s, z = F.col(f"s{k}"), [F.lit(1.0), *(F.col(f"z{k}_{i}") for i in range(1, len(theta)))]
            # log(1 + exp(s)) without overflow
            wanted.append(F.col(f"w{k}") * (F.greatest(s, F.lit(0.0)) + F.log1p(F.exp(-F.abs(s))) - F.col(f"hit{k}") * s))
            wanted += [F.col(f"g{k}") * x for x in z]
            wanted += [F.col(f"h{k}") * z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))]
        return list(rows_.agg(*[F.sum(v).alias(f"v{i}") for i, v in enumerate(wanted)]).first())

    states = {k: _Newton(np.zeros(len(s.features) + 1), np.zeros(len(s.features) + 1)) for k, s in fitted.items()}
    while active := [k for k, n in states.items() if not n.done]:
        for some in _batches({k: len(states[k].theta) for k in active}):
            got = iter(stepped({k: states[k].theta - states[k].step for k in some}))
            for k in some:
                size, penalty = len(states[k].theta), np.diag([0.0, *[1 / fitted[k].c] * (len(states[k].theta) - 1)])
                at = states[k].theta - states[k].step
                loss, gradient = next(got), np.array([next(got) for _ in range(size)])
                half = np.zeros((size, size))
                for i in range(size):
                    for j in range(i, size):
                        half[i, j] = half[j, i] = next(got)
                states[k].told(loss + at @ penalty @ at / 2, gradient + penalty @ at, half + penalty, steps)
    for k, n in states.items():
        out[names[k]].intercept, out[names[k]].weights = float(n.theta[0]), dict(zip(fitted[k].features, n.theta[1:].tolist(), strict=True))
    drop(rows.sparkSession, old)
    return {n: out[n] for n in names}


def _batches(sizes: dict[int, int]) -> list[list[int]]:
    """The models in groups of at most SUMS sums, a larger one alone."""
    out, room = [], 0
    for k, size in sizes.items():
        own = 1 + size + size * (size + 1) // 2
        if own > room:
            out.append([])
            room = SUMS
        out[-1].append(k)
        room -= own
    return out


def fit_logistic(train: DataFrame, features: list[str], label: str, c: float = 1.0, balanced: bool = True, steps: int = 50) -> Logistic:
    """One model of fit_many()."""
    return fit_many(train, {"own": Spec(features, label, None, c, balanced)}, steps)["own"]


def fit_predict_logistic(train: DataFrame, rows: DataFrame, features: list[str], label: str, c: float = 1.0, balanced: bool = True) -> DataFrame:
    """rows with p and fallback; where the train labels have one class, p is their mean and fallback is true."""
    model = fit_logistic(train, features, label, c, balanced)
    return rows.withColumns({"p": model.probability(), "fallback": F.lit(model.rate is not None)})


def _scored(rows: DataFrame, models: dict[str, tuple[str, Column]]) -> DataFrame:
    """(model, y, p) of the rows for every model (label, probability) whose label they have, in one pass."""
    cells = [F.struct(F.lit(name).alias("model"), F.col(f"`{label}`").cast("double").alias("y"), p.alias("p")) for name, (label, p) in models.items()]
    return rows.select(F.explode(F.array(*cells)).alias("m")).select("m.*").where("y is not null")


def feature_group_holdout(panel: DataFrame, groups: dict[str, list[str]], targets: list[str], c: float = 1.0) -> DataFrame:
    """Long scores (model, y, p) of every target and group: fitted on rows with role train, scored on test."""
    train = F.col("role") == "train"
    specs = {f"{t}/{name}": Spec(features, t, train, c) for t in targets for name, features in groups.items()}
    fitted = fit_many(panel, specs)
    return _scored(panel.where("role = 'test'"), {n: (specs[n].label, m.probability()) for n, m in fitted.items()})


def predictive_screen(panel: DataFrame, groups: dict[str, list[str]], targets: list[str], least_train: int = 100, least_test: int = 30, c: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(scores, coefficients): a base rate and a logit for each group of features, for every target.

    scores is as in feature_group_holdout, with a guard row (p null) where rows, features or
    classes do not suffice; coefficients (model, feature, coefficient, rank) come with the
    largest first.
    """
    spark = panel.sparkSession
    role = lambda r, t: F.when(F.col("role") == r, F.col(f"`{t}`"))
    seen = panel.agg(*[f.alias(f"{n}{k}") for k, t in enumerate(targets) for n, f in (("train", F.count(role("train", t))), ("test", F.count(role("test", t))), ("low", F.min(role("train", t))), ("high", F.max(role("train", t))))]).first()
    few = any(len(f) < 2 for f in groups.values())
    guarded = [t for k, t in enumerate(targets) if few or seen[f"train{k}"] < least_train or seen[f"test{k}"] < least_test or seen[f"low{k}"] == seen[f"high{k}"]]
    train = F.col("role") == "train"
    specs = {f"{t}/{name}": Spec(features, t, train, c) for t in targets if t not in guarded for name, features in {"base_rate": [], **groups}.items()}
    out, told = spark.createDataFrame([(f"{t}/insufficient_class_balance", None, None) for t in guarded], "model string, y double, p double"), []
    if specs:
        fitted = fit_many(panel, specs)
        out = out.unionByName(_scored(panel.where("role = 'test'"), {n: (specs[n].label, m.probability()) for n, m in fitted.items()}))
        for name, model in fitted.items():
            order = sorted(model.weights.items(), key=lambda t: (-abs(t[1]), t[0]))
            told += [(name, f, w, k) for k, (f, w) in enumerate(order, 1)]
    return out, spark.createDataFrame(told, "model string, feature string, coefficient double, rank int")
