"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.llm.bpe import restore_id, select_text
from stormglass.llm.common import cut, drop
from stormglass.llm.words import Words, gathered, mixed

#: Labelled documents that the classifier is fitted on at most; those with the smallest hashes.
FIT_ROWS = 6000
#: Rows of the word-vector table, its width, and the non-zero entries of an index vector.
ROWS, WIDTH, NONZERO = 1 << 14, 48, 6
#: Neighbours on each side that make a word's context.
REACH = 2
#: Tasks that read the sample.
FIT_TASKS = 8
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 48, 60, 128, 3e-3, 1e-4


#: Bytes by kind: lower-case letters (and all of UTF-8's longer characters), upper-case letters, digits; others stand for themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1] = _KIND[0x80:] = ord("a")
_KIND[ord("A") : ord("Z") + 1] = ord("A")
_KIND[ord("0") : ord("9") + 1] = ord("9")


def shapes(words: Words) -> Words:
    """The shapes of words: each run of bytes of one kind counts once."""
    kind = _KIND[words.data[:-8]]
    keep = np.diff(kind, prepend=kind[:1] ^ 1) != 0
    place = np.cumsum(keep) - 1
    return Words(np.append(kind[keep], np.full(8, 0x20, np.uint8)), place[words.starts], place[words.ends - 1] + 1, words.n)


def index_vectors() -> np.ndarray:
    """A sparse vector of small whole numbers for each table row, from a fixed seed."""
    rng = np.random.default_rng(20)
    out = np.zeros((ROWS, WIDTH), np.int32)
    for k in range(NONZERO):
        out[np.arange(ROWS), rng.integers(0, WIDTH, ROWS)] += rng.choice(np.array([-1, 1], np.int32), ROWS)
    return out


def _rows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words and of their shapes."""
    half = np.uint64(ROWS // 2)
    return (mixed(words.hashes) % half).astype(np.int64), (mixed(shapes(words).hashes) % half + half).astype(np.int64)


def context_sums(words: Words, index: np.ndarray) -> np.ndarray:
    """For each table row the sum of the index vectors (whole numbers) that stand around its words."""
    out = np.zeros(index.shape, np.int32)
    w, s = _rows(words)
    own = index[w] + index[s]
    doc = np.repeat(np.arange(len(words.n)), words.n)
    around = np.zeros_like(own)
    for reach in range(1, REACH + 1):
        same = (doc[reach:] == doc[:-reach])[:, None]
        around[reach:] += own[:-reach] * same
        around[:-reach] += own[reach:] * same
    for rows in (w, s):
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.diff(rows[order], prepend=-1))
        if len(first):
            out[rows[order][first]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int32)
    return out


def unit_vectors(sums: np.ndarray) -> np.ndarray:
    """Word vectors of length one; a word that the sample lacks keeps its index vector."""
    out = (sums + index_vectors()).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pool(words: Words, vectors: np.ndarray) -> np.ndarray:
    """Per document: mean word vector, spread, the same for shapes, their lengths, and the share of distinct words."""
    out = np.zeros((len(words.n), 4 * WIDTH + 6), np.float32)
    full = np.flatnonzero(words.n)
    out[words.n == 0, -1] = 1.0
    if not len(full):
        return out
    doc, n = np.repeat(np.arange(len(words.n)), words.n), words.n[full].astype(np.float32)[:, None]
    for k, rows in enumerate(_rows(words)):
        key, count = np.unique(doc * ROWS + rows, return_counts=True)
        of, first = key // ROWS, np.searchsorted(key, full * ROWS)
        v, times = vectors[key % ROWS], count.astype(np.float32)[:, None]
        mean = np.add.reduceat(v * times, first, axis=0) / n
        square = np.add.reduceat(v * v * times, first, axis=0) / n
        at = 2 * WIDTH * k
        out[full, at : at + WIDTH] = mean
        out[full, at + WIDTH : at + 2 * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[full, 4 * WIDTH + k] = np.linalg.norm(mean, axis=1)
        out[full, 4 * WIDTH + 2 + k] = np.sqrt(np.add.reduceat(times * times, first, axis=0) / (n * n))[:, 0]
        if not k:
            out[full, -2] = np.bincount(of, minlength=len(words.n))[full] / n[:, 0]
    return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer with ReLU, one logit, divided by a temperature."""

    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.centre) / self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))


def fit(vectors: np.ndarray, x: np.ndarray, labels: np.ndarray) -> Network:
    """Fit on four fifths of the sample, find the temperature on the rest; fixed seeds, so reruns agree.

    x: pooled documents, one a row.
    """
    y = labels.astype(np.float32)
    rng = np.random.default_rng(7)
    w1 = rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)).astype(np.float32)
    net = Network(vectors, np.zeros(x.shape[1], np.float32), np.ones(x.shape[1], np.float32), w1, np.zeros(HIDDEN, np.float32), rng.normal(0, 0.1, HIDDEN).astype(np.float32), 0.0)
    if len(np.unique(y)) < 2:  # nothing to learn: the base rate
        net.w2[:] = 0
        net.b2 = 0.0 if not len(y) else (3.0 if y[0] else -3.0)
        return net
    net.centre, net.scale = x.mean(0), x.std(0) + 1e-3
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - net.centre) / net.scale
    moments = [np.zeros_like(p) for p in (net.w1, net.b1, net.w2, np.zeros(1, np.float32)) for _ in (0, 1)]
    b2, step = np.zeros(1, np.float32), 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            h = z[part] @ net.w1 + net.b1
            a = np.maximum(h, 0)
            g = 1 / (1 + np.exp(-(a @ net.w2 + b2))) - y[part]
            g /= len(part)
            back = np.outer(g, net.w2) * (h > 0)
            step += 1
            for k, (p, d) in enumerate(((net.w1, z[part].T @ back + DECAY * net.w1), (net.b1, back.sum(0)), (net.w2, a.T @ g + DECAY * net.w2), (b2, g.sum(keepdims=True)))):
                m, v = moments[2 * k], moments[2 * k + 1]
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(b2[0])
    check = held if len(np.unique(y[held])) > 1 else train
    logit = net.logits(x[check])
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.mean(np.logaddexp(0, -np.where(y[check] > 0, 1, -1) * logit / t)) for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int, label: str, id_col: str, text_col: str, mod: int) -> DataFrame:
    """(key, text, y) of at most fit_rows labelled documents outside the held-out fold, those with the smallest hash of the id."""
    key = F.col(id_col).cast("string")
    chosen = (
        labels.where(F.col(label).isNotNull() & (F.crc32(key.cast("binary")) % mod != 0))
        .groupBy(F.col(id_col).alias("key"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(fit_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("id") == F.col("key"))
    return joined.groupBy("key").agg(F.min("text").alias("text"), F.max("y").alias("y")).select(F.col("key").cast("string"), "text", "y")


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int, label: str, id_col: str, text_col: str, mod: int) -> Broadcast:
    """The network fitted on the sample, broadcast (3 MB whatever the corpus).

    Texts stay on the workers: their context sums come to the driver as FIT_TASKS tables of
    3 MB at most, then their pooled vectors, 0.8 kB a document. Sums are of whole numbers and
    vectors are sorted by id, so reruns agree.
    """
    spark, old = docs.sparkSession, []
    # few rows, so few files
    dealt = cut(labelled_sample(docs, labels, fit_rows, label, id_col, text_col, mod).coalesce(FIT_TASKS), old).coalesce(FIT_TASKS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        total = np.zeros_like(index)
        for _, words in gathered(batches):
            total += context_sums(words, index)
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]}, pa.schema([("sums", pa.binary())]))

    total = np.zeros((ROWS, WIDTH), np.int64)
    for row in dealt.mapInArrow(sums, "sums binary").collect():
        total += np.frombuffer(row["sums"], np.int32).reshape(ROWS, WIDTH)
    known = spark.sparkContext.broadcast(unit_vectors(total))
    schema = pa.schema([("key", pa.string()), ("y", pa.int32()), ("x", pa.binary())])

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, words in gathered(batches):
            x = [row.tobytes() for row in pool(words, known.value)]
            yield pa.RecordBatch.from_arrays([table.column("key").combine_chunks(), table.column("y").combine_chunks(), pa.array(x, pa.binary())], schema=schema)

    rows = sorted(dealt.mapInArrow(pooled, "key string, y int, x binary").collect(), key=lambda r: r["key"])
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(len(rows), 4 * WIDTH + 6)
    net = fit(known.value, x, np.array([r["y"] for r in rows], np.int64))
    known.unpersist()
    drop(spark, old)
    return spark.sparkContext.broadcast(net)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", mod: int = 5) -> Network:
    """The network that score_quality() fits, to be saved or to score other tables with score_with()."""
    return fitted(docs, labels, fit_rows, label, id_col, text_col, mod).value


def save_model(spark: SparkSession, model: Network, path: str) -> None:
    """Write a network as a Parquet table, one row a parameter (3 MB whatever the corpus)."""
    rows = [(f.name, list(np.shape(v)), str(np.asarray(v).dtype), np.asarray(v).tobytes()) for f in fields(model) for v in [getattr(model, f.name)]]
    spark.createDataFrame(rows, "name string, shape array<int>, kind string, data binary").coalesce(1).write.parquet(path)


def load_model(spark: SparkSession, path: str) -> Network:
    """The network that save_model() has written; its scores are the same to the bit."""
    values = {r["name"]: np.frombuffer(r["data"], r["kind"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
    return Network(**{n: v if v.ndim else float(v) for n, v in values.items()})


def score_with(docs: DataFrame, model: Network | Broadcast, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", mod: int = 5) -> DataFrame:
    """score_quality() by a network that is there already: no labels are read and nothing is fitted."""
    kind = docs.schema[id_col].dataType.simpleString()
    net = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for table, words in gathered(batches):
            scores = model.scores(pool(words, model.vectors)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), pa.array(scores)], schema=schema)

    texts = select_text(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    scored = texts.mapInArrow(run, "id string, score double")
    held = F.coalesce(F.crc32(F.col("id").cast("binary")) % mod == 0, F.lit(False))
    return restore_id(scored.select("id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")), id_col, kind)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", mod: int = 5) -> DataFrame:
    """Per row of docs: id, held_out, score, predicted.

    The vectors and the network are fitted on at most fit_rows labelled rows (the documented
    bound), none with crc32(id) mod 5 = 0; the network is broadcast (3 MB). Every whole text is
    then scored in one pass without a shuffle, from its words alone. Empty and null texts get a
    score too; null ids are not held out; rows that repeat id and text get equal results.
    Without labels of both kinds the score is constant. An empty table gives no rows.
    """
    return score_with(docs, fitted(docs, labels, fit_rows, label, id_col, text_col, mod), threshold, id_col, text_col, mod)


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", mod: int = 5) -> DataFrame:
    """The rows of docs that the classifier does not reject; columns as they were, texts never shuffled.

    Null and empty texts are judged like any other, repeated rows alike; an empty table gives
    no rows.
    """
    net, names = fitted(docs, labels, fit_rows, label, id_col, text_col, mod), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, words in gathered(batches):
            good = table.filter(pa.array(net.value.scores(pool(words, net.value.vectors)) >= threshold))
            yield from good.drop_columns("text").combine_chunks().to_batches()

    # the whole row travels as a struct, so its names can't clash with the text that is read
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kept = packed.mapInArrow(run, packed.select("row").schema)
    return kept.select(*[F.col(f"row.`{c}`") for c in names])
