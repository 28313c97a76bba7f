"""Document fingerprints by winnowing."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from stormglass.llm.bpe import TOGETHER, restore_id, select_text

#: Code points of a k-gram and k-grams of a window: a shared run of GRAM + WINDOW - 1 code
#: points always shares a selected hash, and no run under GRAM code points is seen.
GRAM, WINDOW = 16, 32
#: Code points of a text that help to cut ranges where an id repeats.
RANGE_HEAD = 64
_RESULT = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("positions", pa.list_(pa.int32()))])
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """Rolling polynomial hashes (32 bits) of all k-grams, from prefix sums; a shorter text is one gram."""
    n, gram = len(points), min(gram, len(points))
    if not n:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << (n + 1).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * down[:n], out=sums[1:])
    h = (sums[gram:] - sums[: n + 1 - gram]) * up[: n + 1 - gram]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that winnowing selects: the minimum of every window, the rightmost on ties.

    A text of fewer than `window` grams is one window; the empty text selects nothing.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = gram_hashes(points, gram)
    if not len(h):
        return h, np.zeros(0, np.int64)
    top = np.uint64(0xFFFFFFFF)
    key = (h << np.uint64(32)) | (top - np.arange(len(h), dtype=np.uint64))  # ties: the larger position is the smaller key
    span, width = 1, min(window, len(key))
    while span < width:
        step = min(span, width - span)
        key = np.minimum(key[:-step], key[step:])
        span += step
    # minima move right only, so equal selections are neighbours
    key = key[np.flatnonzero(np.diff(key, prepend=~key[:1]))]
    return key >> np.uint64(32), (top - (key & top)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def as_text(hashes: np.ndarray) -> str:
    """The selected hashes in text order, eight hex digits each."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per row of docs: id, hashes and positions (code points) that winnowing selects.

    Null texts count as empty and select nothing. One pass without a shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [winnow(t, gram, window) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "hashes": [h.astype(np.int64) for h, _ in got], "positions": [p for _, p in got]})

    schema = "id string, hashes array<long>, positions array<long>"
    return restore_id(select_text(docs, id_col, text_col).mapInPandas(run, schema), id_col, kind)


def _prints(text: str, gram: int, window: int) -> dict:
    hashes, positions = winnow(text, gram, window)
    return {"hashes": hashes, "positions": positions, "distinct": np.unique(hashes)}


def compared(text: str, own: dict, following: str, other: dict, gram: int, window: int) -> dict:
    """The result of a document and the next: own and other are their prints."""
    n = len(text)
    swapped = n // 3
    edited = text[: n - swapped] + following[:swapped]
    changed = _prints(edited, gram, window)
    return {
        "n_chars": n,
        "edited_sha256": sha256(edited.encode()).hexdigest(),
        "fingerprint": as_text(own["hashes"]),
        "edited_fingerprint": as_text(changed["hashes"]),
        "near_edited": likeness(own["distinct"], changed["distinct"]),
        "near_next": likeness(own["distinct"], other["distinct"]),
        "positions": own["positions"],
    }


def _first_rows(rows: DataFrame, n: int) -> list[tuple]:
    """(id, head) of the first row of each of n ranges of the rows (id, head), in the order of documents.

    Only ids and heads are shuffled, and one row a range comes to the driver.
    """
    order = [F.col("id").desc_nulls_last(), F.col("head").asc()]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return [tuple(r["f"]) for r in sorted(dealt.groupBy("part").agg(F.first(F.struct("id", "head")).alias("f")).collect(), key=lambda r: r["part"])]


def _range_of(firsts: list[tuple], kind: str) -> Column:
    """The number of the range of a row (id, head): how many first rows besides the first of all stand at or before it.

    They are looked up in two steps, so a row meets some twice the square root of their number.
    """
    step = max(1, math.isqrt(len(firsts)))
    groups = [firsts[k : k + step] for k in range(0, len(firsts), step)]
    told = json.dumps([[{"id": i, "head": h} for i, h in group] for group in groups], default=str)
    listed = F.from_json(F.lit(told), f"array<array<struct<id:{kind},head:string>>>")
    ahead = lambda b: F.coalesce((b["id"] > F.col("id")) | (b["id"].isNotNull() & F.col("id").isNull()) | (b["id"].eqNullSafe(F.col("id")) & (b["head"] <= F.col("head"))), F.lit(False))
    coarse = F.greatest(F.size(F.filter(listed, lambda g: ahead(g[0]))) - 1, F.lit(0))
    fine = F.greatest(F.size(F.filter(F.element_at(listed, coarse + 1), ahead)) - 1, F.lit(0))
    return (coarse * step + fine).cast("int")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every document, of an edited copy, and their likeness with it and the next document.

    Next is by descending id, then by ascending text where ids repeat; a null id comes last;
    after the last document comes the first. The edited text has its last n_chars / 3 code
    points replaced by as many from the head of the next document. Null texts are empty; two
    empty fingerprints have likeness 1; rows that repeat id and text follow one another. An
    empty table gives no rows; other columns are not read. positions are those of the
    fingerprint's hashes in code points.

    Ranges of ids, one a shuffle partition, are laid down first from ids and heads of texts.
    Each range then gets its documents and, as an end mark, the first document of the range
    after it; its task walks through them in order with one document in hand. Texts travel
    once and nothing is stored on the way.
    """
    spark, field = docs.sparkSession, docs.schema[id_col]
    kind = field.dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("head", F.substring("text", 1, RANGE_HEAD))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = _first_rows(rows.select("id", "head"), n) or [(None, "")]
    marks = spark.createDataFrame([(k, *f) for k, f in enumerate(firsts)], StructType([StructField("mark", IntegerType()), StructField("i_", field.dataType), StructField("h_", StringType())]))
    same = F.col("id").eqNullSafe(F.col("i_")) & (F.col("head") == F.col("h_"))
    # one row a range, so as small as the number of partitions
    ends = rows.join(F.broadcast(marks), same).groupBy("mark").agg(F.min("text").alias("text"))
    before = F.pmod(F.col("mark") - 1, F.lit(len(firsts))).cast("int")
    inside = rows.select("id", "text", _range_of(firsts, kind).alias("part"), F.lit(False).alias("end"))
    marked = ends.select(F.lit(None).cast(kind).alias("id"), "text", before.alias("part"), F.lit(True).alias("end"))
    dealt = inside.unionByName(marked).repartitionById(n, "part").sortWithinPartitions("part", "end", F.col("id").desc_nulls_last(), F.col("text").asc())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = own = None
        for batch in batches:
            key = batch.schema.field("id").type
            for k in range(0, batch.num_rows, TOGETHER):
                ids, out = [], []
                for row in batch.slice(k, TOGETHER).to_pylist():
                    prints = _prints(row["text"], gram, window)
                    if held is not None:
                        ids.append(held["id"])
                        out.append(compared(held["text"], own, row["text"], prints, gram, window))
                    held, own = (None, None) if row["end"] else (row, prints)
                values = [pa.array([o[f.name] for o in out], f.type) for f in _RESULT]
                yield pa.RecordBatch.from_arrays([pa.array(ids, key), *values], names=["id", *_RESULT.names])

    columns = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>"
    walked = dealt.mapInArrow(walk, f"id {kind}, {columns}")
    return walked.withColumnRenamed("id", id_col)
