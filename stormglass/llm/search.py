"""Ranked lexical search over bit-sliced Bloom signatures: upper bounds rule documents out, the rest are scored exactly."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormglass.llm.common import counted, cut, drop
from stormglass.llm.words import PUNCTUATION, Words, gathered, mixed, words_of

#: Bits of a signature for each (term, level) of its document, at least, and bits that each sets.
BITS_PER_ITEM, PROBES = 10, 3
#: Level j says that a term occurs 2^j times or more; from the last level on a bound is that of infinitely many.
LEVELS = 12
#: Signatures have 2^LEAST_LOG to 2^MOST_LOG bits, and a block so many bits in all.
LEAST_LOG, MOST_LOG, BLOCK_BITS = 6, 22, 1 << 23
#: Distinct terms after which a task writes down what it has counted.
COUNTED_TERMS = 1 << 20
#: Items that are searched together, and bytes of their texts; a longer one goes alone. The driver and every task hold these.
TOGETHER_ITEMS, TOGETHER_BYTES = 1024, 1 << 22
#: Cells (terms x rows) of a block that are worked on at once.
CELLS = 1 << 23
#: Pairs of item and document up to which they are sent to every task; more meet the documents in a shuffle.
BROADCAST_PAIRS = 1 << 17

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_INDEX = pa.schema([
    ("log", pa.int32()), ("ids", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("slices", pa.binary()),
    ("terms", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64())), ("documents", pa.int64()), ("total", pa.int64()),
])
_COLUMNS = "log int, ids array<string>, n array<long>, slices binary, terms array<long>, holders array<long>, documents long, total long"


def terms_of(text: str) -> list[bytes]:
    """The terms of a text: runs of digits, letters and all that is not ASCII, A-Z in lower case."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower())


def weight(documents: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def length_part(n: int, documents: int, total: int) -> int:
    """m: 100 for a document of average length."""
    return 25 + 75 * n * documents // total


def occurrence_part(tf: int, m: int) -> int:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _places(terms: np.ndarray, level: int, probe: int, log: int) -> np.ndarray:
    return (mixed(terms + np.uint64((level * PROBES + probe + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - log)).astype(np.int64)


def _counted_terms(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term hash, occurrences) of each distinct term of each document of a portion, documents in order."""
    doc = np.repeat(np.arange(len(words.n)), words.n)
    order = np.lexsort((words.hashes, doc))
    doc, term = doc[order], words.hashes[order]
    first = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(term) != 0))[: len(doc)])
    return doc[first], term[first], np.diff(np.append(first, len(doc)))


@dataclass
class _Block:
    """Rows of one size of signature that wait to be sliced."""

    ids: list[str | None] = field(default_factory=list)
    n: list[int] = field(default_factory=list)
    row: list[np.ndarray] = field(default_factory=list)
    place: list[np.ndarray] = field(default_factory=list)

    def closed(self, log: int) -> dict:
        """Slice p holds bit p of all rows, one bit a row."""
        wide = -(-len(self.ids) // 8) * 8
        flags = np.zeros((1 << log, wide), bool)
        flags[np.concatenate(self.place), np.concatenate(self.row)] = True
        return {"log": log, "ids": self.ids, "n": self.n, "slices": np.packbits(flags, axis=1, bitorder="little").tobytes()}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A written table of bit-sliced signatures of all documents, with partial counts of terms.

    Rows with slices are blocks: ids, n (terms of each), log (signatures of 2^log bits), slices.
    A signature holds each term of its document once for every level, 2^level occurrences or
    more; documents go to blocks by the size that theirs needs, so long ones fill no short
    signature. Rows with terms say how many documents of a part hold each, and how many
    documents and terms there are. Documents without terms are in no block.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, _Block] = {}
        held: list[np.ndarray] = []
        waiting = documents = total = 0

        def counts() -> pa.RecordBatch:
            terms, holders = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_pylist([{"terms": terms.view(np.int64).tolist(), "holders": holders.tolist(), "documents": documents, "total": total}], schema=_INDEX)

        for table, words in gathered(batches, lower=True, outside=PUNCTUATION):
            doc, term, tf = _counted_terms(words)
            held.append(term)
            waiting += len(term)
            documents, total = documents + int((words.n > 0).sum()), total + int(words.n.sum())
            if waiting >= COUNTED_TERMS:
                yield counts()
                held, waiting, documents, total = [], 0, 0, 0
            level = np.minimum(np.frexp(tf)[1] - 1, LEVELS - 1)
            ids, starts = table.column("id").to_pylist(), np.searchsorted(doc, np.arange(len(words.n) + 1)).tolist()
            for k in np.flatnonzero(words.n).tolist():
                own, top = term[starts[k] : starts[k + 1]], level[starts[k] : starts[k + 1]]
                log = min(MOST_LOG, max(LEAST_LOG, math.ceil(math.log2((len(own) + int(top.sum())) * BITS_PER_ITEM))))
                block = open_.setdefault(log, _Block())
                parts = [_places(own[top >= j], j, p, log) for j in range(int(top.max()) + 1) for p in range(PROBES)]
                block.place.append(np.unique(np.concatenate(parts)).astype(np.int32))
                block.row.append(np.full(len(block.place[-1]), len(block.ids), np.int32))
                block.ids.append(ids[k])
                block.n.append(int(words.n[k]))
                if len(block.ids) >= max(8, BLOCK_BITS >> log):
                    yield pa.RecordBatch.from_pylist([open_.pop(log).closed(log)], schema=_INDEX)
        for log, block in sorted(open_.items()):
            yield pa.RecordBatch.from_pylist([block.closed(log)], schema=_INDEX)
        yield counts()

    return cut(docs.select(F.col(id_col).cast("string").alias("id"), text.alias("text")).mapInArrow(run, _COLUMNS), keep)


@dataclass(frozen=True)
class Items:
    """Some items of a query set, with what the corpus says of their terms; sent to every task."""

    #: distinct terms of all items: their hashes, and for each item the places of its terms here and their weight times repeats
    hashes: np.ndarray
    weights: list[tuple[np.ndarray, np.ndarray]]
    #: the same by their bytes
    words: list[dict[bytes, int]]
    documents: int
    total: int


def prepared(index: DataFrame, texts: list[str]) -> Items | None:
    """The items' terms that documents hold, weighed by the counts in the index; None where the corpus has no terms."""
    spark = index.sparkSession
    own = [Counter(terms_of(t)) for t in texts]
    words = sorted(set().union(*own))
    hashes = words_of([b" ".join(words)]).hashes if words else np.zeros(0, np.uint64)
    sums = index.where("terms is not null").agg(F.sum("documents"), F.sum("total")).first()
    documents, total = sums[0] or 0, sums[1] or 0
    if not total:
        return None
    asked = spark.createDataFrame([(h,) for h in hashes.view(np.int64).tolist()], "term long")
    each = index.where("terms is not null").select(F.explode(F.arrays_zip("terms", "holders")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.holders").alias("holders"))
    # one row for each term of the items reaches the driver
    found = {r["term"]: r["n"] for r in each.join(F.broadcast(asked), "term", "left_semi").groupBy("term").agg(F.sum("holders").alias("n")).collect()}
    of = {w: weight(documents, found[h]) for w, h in zip(words, hashes.view(np.int64).tolist(), strict=True) if h in found}
    at = {w: k for k, w in enumerate(of)}
    weights = []
    for item in own:
        some = [(at[w], of[w] * n) for w, n in sorted(item.items()) if w in of]
        weights.append((np.array([k for k, _ in some], np.int64), np.array([x for _, x in some], np.int64)))
    chosen = words_of([b" ".join(of)]).hashes if of else hashes[:0]
    return Items(chosen, weights, [{w: of[w] * n for w, n in item.items() if w in of} for item in own], documents, total)


def bounds(slices: bytes, log: int, n: list[int], items: Items) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, upper bounds by item and row) of a block, in portions of rows.

    A row may hold a term at a level only if all slices that the two choose have its bit. The
    highest level that it may hold limits the occurrences, and its length is known, so the
    bound differs from the score by what levels round up and by chance bits only.
    """
    lengths = np.array(n, np.int64)
    m = 25 + 75 * lengths * items.documents // items.total
    bits = np.frombuffer(slices, np.uint8).reshape(1 << log, -1)
    # occurrences that level j allows, and their part of the score for each row; level 0 of these is absence
    most = [2 ** (j + 1) - 1 for j in range(LEVELS - 1)]
    part = np.stack([np.zeros_like(m), *(1_000_000_000 * t // (1000 * t + 8 * m) for t in most), np.full_like(m, 1_000_000)])
    places = [[_places(items.hashes, j, p, log) for p in range(PROBES)] for j in range(LEVELS)]
    step = max(8, CELLS // max(1, len(items.hashes)) // 8 * 8)
    for begin in range(0, len(n), step):
        rows = min(step, len(n) - begin)
        some = bits[:, begin // 8 : (begin + step) // 8]
        level = np.zeros((len(items.hashes), rows), np.uint8)
        alive, have = np.arange(len(items.hashes)), None
        for j in range(LEVELS):
            got = some[places[j][0][alive]] & some[places[j][1][alive]] & some[places[j][2][alive]]
            have = got if have is None else got & have
            any_ = have.any(axis=1)
            alive, have = alive[any_], have[any_]
            if not len(alive):
                break
            level[alive] += np.unpackbits(have, axis=1, count=rows, bitorder="little")
        term, row = np.nonzero(level)
        value = part[level[term, row], begin + row]
        starts = np.searchsorted(term, np.arange(len(items.hashes) + 1))
        out = np.zeros((len(items.weights), rows), np.int64)
        for k, (at, weights) in enumerate(items.weights):
            own = out[k]
            for t, w in zip(at.tolist(), weights.tolist(), strict=True):
                a, b = starts[t], starts[t + 1]
                own[row[a:b]] += w * value[a:b]
        yield begin, out


_FOUND = pa.schema([("item", pa.int32()), ("id", pa.string()), ("bound", pa.int64())])


def likeliest(index: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, id, bound): of each item the k rows with the highest bounds, of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, str | None]]] = [[] for _ in items.weights]
        for batch in batches:
            for block in batch.to_pylist():
                for begin, out in bounds(block["slices"], block["log"], block["n"], items):
                    for own, of in zip(best, out, strict=True):
                        top = np.argpartition(of, -k)[-k:] if len(of) > k else np.arange(len(of))
                        own += [(int(of[r]), block["ids"][begin + r]) for r in top.tolist() if of[r] > 0]
                        own.sort(key=lambda x: -x[0])
                        del own[k:]
        rows = [(i, key, bound) for i, own in enumerate(best) for bound, key in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _FOUND.types[c]) for c in range(3)], schema=_FOUND)

    found = index.where("slices is not null").select("log", "ids", "n", "slices").mapInArrow(run, "item int, id string, bound long")
    by = Window.partitionBy("item").orderBy(F.col("bound").desc(), "id")
    return found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).drop("place")


def not_excluded(index: DataFrame, items: Items, least: list[int]) -> DataFrame:
    """(item, id): every row whose bound is at least what the item asks."""
    asked = np.array(least, np.int64)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                for begin, out in bounds(block["slices"], block["log"], block["n"], items):
                    item, row = np.nonzero(out >= asked)
                    keys = pa.array([block["ids"][begin + r] for r in row.tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), keys], schema=pa.schema([_FOUND.field(0), _FOUND.field(1)]))

    return index.where("slices is not null").select("log", "ids", "n", "slices").mapInArrow(run, "item int, id string")


def scored(docs: DataFrame, pairs: DataFrame, few: bool, items: Items, id_col: str, text_col: str) -> DataFrame:
    """(item, id, score) of the pairs (item, id) from the documents' texts, without zeros; each row of docs with such an id is scored."""
    schema = pa.schema([("item", pa.int32()), ("id", pa.string()), ("score", pa.int64())])
    asked = pairs.groupBy(F.col("id").alias("asked_id")).agg(F.collect_set("item").alias("items"))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(asked) if few else asked, F.col("id").eqNullSafe(F.col("asked_id"))).select("id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, wanted in zip(*(batch.column(c) for c in range(3)), strict=True):
                own = terms_of(text.as_py())
                tf, m = Counter(own), length_part(len(own), items.documents, items.total)
                for item in wanted.as_py():
                    of = items.words[item]
                    score = sum(of[w] * occurrence_part(tf[w], m) for w in of if w in tf)
                    if score > 0:
                        out.append((item, key.as_py(), score))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], schema.types[c]) for c in range(3)], schema=schema)

    return rows.mapInArrow(run, "item int, id string, score long")


def _together(queries: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items in groups of bounded size; the driver holds one at a time."""
    some, size = [], 0
    for row in queries.select(F.col(item_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).toLocalIterator():
        if some and (len(some) >= TOGETHER_ITEMS or size + len(row[1]) > TOGETHER_BYTES):
            yield some
            some, size = [], 0
        some.append((row[0], row[1]))
        size += len(row[1])
    if some:
        yield some


def search(index: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of queries its k best documents with a score above 0: item, rank, id, score.

    The score adds, over the item's terms, repeats included, weight() x occurrence_part().
    First the k rows with the highest bounds of each item are scored; the k-th of these scores
    is one that the k-th best document reaches. Then every document whose bound reaches it is
    scored, from its whole text, so nothing that could be among the best is left out, and
    nothing is capped: where bounds exclude little, more is scored.

    Ties go to the smaller id (nulls first). Null and empty texts have no terms and are never
    found; an item without terms that occur has no rows. Rows that repeat an id are documents
    of their own. Term counts rest on 64-bit hashes of terms: two that share one count as one,
    with probability 10^-5 for 10^4 terms of items and 10^10 of documents. Empty documents or
    queries give no rows; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    id_kind, item_kind = docs.schema[id_col].dataType, queries.schema[item_col].dataType
    out = []
    for group in _together(queries, item_col, item_text):
        items = prepared(index, [text for _, text in group])
        if items is None:
            break
        old: list[str] = []
        first, n = counted(likeliest(index, items, k), keep=old)
        score = F.col("score")
        tried = scored(docs, first.select("item", "id"), n <= BROADCAST_PAIRS, items, id_col, text_col)
        at_kth = Window.partitionBy("item").orderBy(score.desc(), "id")
        # at most one row an item reaches the driver
        kth = {r["item"]: r["score"] for r in tried.withColumn("place", F.row_number().over(at_kth)).where(F.col("place") == k).collect()}
        pairs, n = counted(not_excluded(index, items, [kth.get(i, 1) for i in range(len(group))]), keep=old)
        ties = Window.partitionBy("item").orderBy(score.desc(), id_col)
        found = scored(docs, pairs, n <= BROADCAST_PAIRS, items, id_col, text_col).select("item", F.col("id").cast(id_kind).alias(id_col), "score")
        ranked = found.withColumn("rank", F.row_number().over(ties)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, None if key is None else str(key)) for i, (key, _) in enumerate(group)], "item int, name string")
        ranked = ranked.join(F.broadcast(names), "item")
        out.append(cut(ranked.select(F.col("name").cast(item_kind).alias(item_col), "rank", id_col, "score")))
        drop(spark, old)
    if not out:
        none = docs.select(F.lit(None).cast(item_kind).alias(item_col), F.lit(0).alias("rank"), F.col(id_col), F.lit(0).cast("long").alias("score"))
        return none.where("false")
    return reduce(DataFrame.unionByName, out)


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """search() of docs through an index made for it, which is deleted afterwards."""
    made: list[str] = []
    out = search(build_index(docs, keep=made), docs, queries, k)
    drop(docs.sparkSession, made)
    return out
