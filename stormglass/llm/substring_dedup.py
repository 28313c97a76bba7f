"""Repeated word sequences, found by anchors at difference-cover positions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormglass.llm.bpe import restore_id
from stormglass.llm.common import cut, drop
from stormglass.llm.packing import from_low_bytes, from_planes, low_bytes, planes
from stormglass.llm.words import BASES, Words, gathered, window_hashes

#: Difference covers by period: every residue is a difference of two members.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
PERIOD = 21
#: Sequences after which a task closes a block of documents.
BLOCK = 1 << 19
#: Bytes of text for each bucket of sequences.
BUCKET_BYTES = 1 << 24
#: Bytes of an anchor's key besides its bucket: a chance match only costs a look at the windows.
ANCHOR_BYTES = 5

_DOCS = "array<struct<id:string,th:long>>"
_DOC = pa.list_(pa.struct([("id", pa.string()), ("th", pa.int64())]))
_SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary()), ("docs", _DOC)])
_TOLD = pa.schema([f for f in _SENT if f.name in ("block", "doc", "pos", "docs")])
#: Stands for the document of a sequence that its block knows to repeat.
_KNOWN = 0xFFFFFFFF

#: (keys, further key bits, first words, documents by their place in the portion) of a portion's sequences.
Sequences = Callable[[pa.Table, Words], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _places(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document of each word, position in it)."""
    begin = np.cumsum(words.n) - words.n
    return np.repeat(np.arange(len(words.n)), words.n), np.arange(int(words.n.sum())) - np.repeat(begin, words.n)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the runs of equal values."""
    starts = np.flatnonzero(np.diff(values, prepend=-1))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(values)][: len(starts)], strict=True))


def _close(number: int, parts: list[tuple[np.ndarray, ...]], docs: list[dict], buckets: int, key_bytes: int) -> pa.RecordBatch:
    """What a block tells: to each bucket its sequences, one of each kind; to itself those that repeat inside it.

    A sequence that the block has once travels with its document and position. One that it has
    more often sends a single witness and is known to repeat. So a passage that a third of all
    documents share sends one entry a block and not one a document.
    """
    keys, more, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((more, keys))
    k, m = keys[order], more[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])])[: len(k)])
    count = np.diff(first, append=len(k))
    once, often = order[first[count == 1]], order[first[count > 1]]
    inside = np.ones(len(keys), bool)
    inside[once] = False
    used, back = np.unique(doc, return_inverse=True)
    at = np.flatnonzero(inside)
    rows = [{"bucket": ((number >> 32) + number) % buckets, "block": number, "doc": planes(back[at]), "pos": planes(pos[at]), "docs": [docs[d] for d in used.tolist()]}]
    to = (keys >> np.uint64(64 - int(math.log2(buckets)))).astype(np.int64)
    for flags, sender in ((False, once), (True, often)):
        sender = sender[np.lexsort((sender, to[sender]))]
        ends = np.searchsorted(to[sender], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(ends)).tolist():
            x = sender[ends[b] : ends[b + 1]]
            whose = np.full(len(x), _KNOWN) if flags else back[x]
            rows.append({"bucket": b, "block": number, "keys": low_bytes(keys[x], key_bytes), "more": low_bytes(more[x], 4) if key_bytes == 8 else None, "doc": planes(whose), "pos": planes(pos[x])})
    return pa.RecordBatch.from_pylist(rows, schema=_SENT)


def repeats(rows: DataFrame, sequences: Sequences, buckets: int, key_bytes: int, spans: Callable[[np.ndarray, int], list[int]]) -> DataFrame:
    """(id, th, spans) of the rows (id, th, text, ...) with sequences that occur more than once anywhere.

    Blocks of documents send their distinct sequences, packed by bucket; the task of a bucket
    finds those that several blocks have, or one block often, and tells each block. Nothing is
    broadcast, a frequent sequence has one entry a block, and only hits return.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, parts, docs, size = TaskContext.get().partitionId() << 32, [], [], 0
        for table, words in gathered(batches):
            keys, more, pos, doc = sequences(table, words)
            if len(keys):
                parts.append((keys, more, doc + len(docs), pos))
                docs += table.select(["id", "th"]).to_pylist()
                size += len(keys)
            if size >= BLOCK:
                yield _close(number, parts, docs, buckets, key_bytes)
                number, parts, docs, size = number + 1, [], [], 0
        if size:
            yield _close(number, parts, docs, buckets, key_bytes)

    def merge(group: pa.Table) -> pa.Table:
        asked = group.filter(group.column("keys").is_valid())
        kept = group.filter(group.column("keys").is_null()).select(_TOLD.names).cast(_TOLD)
        if not asked.num_rows:
            return kept
        packed = asked.column("keys").to_pylist()
        keys = from_low_bytes(b"".join(packed), key_bytes)
        n = [len(p) // key_bytes for p in packed]
        doc, pos = (np.concatenate([from_planes(p) for p in asked.column(c).to_pylist()]) for c in ("doc", "pos"))
        more = from_low_bytes(b"".join(asked.column("more").to_pylist()), 4) if key_bytes == 8 else np.zeros(len(keys), np.uint64)
        order = np.lexsort((more, keys))
        k, m = keys[order], more[order]
        change = np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])])
        kind = np.cumsum(change) - 1
        often = np.bincount(kind) + np.bincount(kind, doc[order] == _KNOWN) > 1
        hit = np.zeros(len(keys), bool)
        hit[order] = often[kind]
        hit &= doc != _KNOWN
        block = np.repeat(asked.column("block").to_numpy(), n)[hit]
        order = np.argsort(block, kind="stable")
        block, doc, pos = block[order], doc[hit][order], pos[hit][order]
        out = [{"block": int(block[s]), "doc": planes(doc[s:e]), "pos": planes(pos[s:e])} for s, e in _runs(block)]
        return pa.concat_tables([kept, pa.Table.from_pylist(out, schema=_TOLD)])

    result = pa.schema([("id", pa.string()), ("th", pa.int64()), ("spans", pa.list_(pa.int32()))])

    def gather(group: pa.Table) -> pa.Table:
        docs = next(d for d in group.column("docs").to_pylist() if d is not None)
        doc, pos = (np.concatenate([from_planes(p) for p in group.column(c).to_pylist()]) for c in ("doc", "pos"))
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        out = [docs[int(doc[s])] | {"spans": spans(pos[s:e].astype(np.int64))} for s, e in _runs(doc.astype(np.int64))]
        return pa.Table.from_pylist(out, schema=result)

    sent = rows.mapInArrow(send, f"bucket long, block long, keys binary, more binary, doc binary, pos binary, docs {_DOCS}")
    told = sent.groupBy("bucket").applyInArrow(merge, f"block long, doc binary, pos binary, docs {_DOCS}")
    return told.groupBy("block").applyInArrow(gather, "id string, th long, spans array<int>")


def _merged(low: np.ndarray, high: np.ndarray) -> list[int]:
    """[begin, end, begin, end, ...] of the union of ranges that come in order."""
    apart = low[1:] > high[:-1]
    return np.stack([low[np.append(True, apart)], high[np.append(apart, True)]], axis=1).reshape(-1).tolist()


def _within(spans: list[list[int] | None], n: np.ndarray) -> np.ndarray:
    """Which words of a portion lie in the spans of their documents."""
    edge = np.zeros(int(n.sum()) + 1, np.int64)
    for begin, size, own in zip((np.cumsum(n) - n).tolist(), n.tolist(), spans, strict=True):
        if own:
            at = begin + np.minimum(np.array(own, np.int64), size)
            np.add.at(edge, at[::2], 1)
            np.add.at(edge, at[1::2], -1)
    return np.cumsum(edge)[:-1] > 0


def remove_repeats(docs: DataFrame, length: int = 35, period: int = PERIOD, id_col: str = "doc_id", text_col: str = "text", text: bool = False) -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept_sha256 and, if text, kept (words left, joined by one space).

    A window is `length` consecutive words. Every word that a window covers whose words also
    start anywhere else goes, in all its places. Two equal windows at i and j share, at some
    offset below the period, a position that lies in the difference cover for both; the anchor
    of length - period + 1 words that begins there is hashed only at cover positions, in 5 of
    21 places. Anchors that occur twice are extended: the windows around them, and no others,
    are hashed whole (96 bits) and counted. Only documents with such windows travel again.

    Rows that repeat id and text are separate documents. Null texts have no words. Texts
    shorter than a window have none and only pass through. Null ids stay null. An empty table
    gives no rows; other columns are not read.
    """
    spark, kind, old = docs.sparkSession, docs.schema[id_col].dataType.simpleString(), []
    width, cover = length - period + 1, np.isin(np.arange(period), COVERS[period])
    raw: Column = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("\0")).alias("id"), F.xxhash64(raw).alias("th"), raw.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(4, math.ceil(math.log2(max(1, total / BUCKET_BYTES))))

    def anchors(table: pa.Table, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = window_hashes(words.hashes, width)
        doc, pos = (x[: len(h)] for x in _places(words))
        size = words.n[doc]
        at = np.flatnonzero(cover[pos % period] & (pos + width <= size) & (size >= length))
        return h[at], np.zeros(len(at), np.uint64), pos[at], doc[at]

    def windows(table: pa.Table, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        one, two = (window_hashes(words.hashes, length, b) for b in BASES)
        doc, pos = (x[: len(one)] for x in _places(words))
        chosen = _within(table.column("spans").to_pylist(), words.n)[: len(one)]
        at = np.flatnonzero(chosen & (pos + length <= words.n[doc]))
        return one[at], two[at] & np.uint64(0xFFFFFFFF), pos[at], doc[at]

    # a repeated anchor at h may lie in the windows that start up to period - 1 words before it
    around = lambda pos: _merged(np.maximum(pos - (period - 1), 0), pos + 1)
    found = cut(repeats(rows, anchors, buckets, ANCHOR_BYTES, around), old)
    fields = [("id", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *[("kept", pa.string())] * text]
    open_schema = pa.schema([*fields, ("th", pa.int64()), ("text", pa.binary()), ("spans", pa.list_(pa.int32()))])
    columns = "id string, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text

    def digest(key: str, raw: bytes, keep: np.ndarray | None) -> dict:
        own = raw.split()  # by ASCII white space, as words are
        kept = own if keep is None else list(compress(own, keep.tolist()))
        left = b" ".join(kept)
        out = {"id": key, "n_words": len(own), "n_removed": len(own) - len(kept), "kept_sha256": sha256(left).hexdigest()}
        return out | ({"kept": left.decode()} if text else {})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                some = batch.slice(k, 1024).to_pylist()
                yield pa.RecordBatch.from_pylist([digest(r["id"], r["text"], None) if r["spans"] is None else r for r in some], schema=open_schema)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, words in gathered(batches):
            starts = table.column("spans").to_pylist()
            covered = [s and [x if k % 2 == 0 else x - 1 + length for k, x in enumerate(s)] for s in starts]
            keep, keys, raw = ~_within(covered, words.n), table.column("id").to_pylist(), table.column("text").to_pylist()
            out = [digest(i, t, keep[b:e]) for i, t, (b, e) in zip(keys, raw, words.ranges(), strict=True)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    once = lambda spans: spans.dropDuplicates(["id", "th"])  # noqa: E731  rows that repeat id and text have equal spans
    parted = cut(rows.join(once(found).hint("shuffle_merge"), ["id", "th"], "left").mapInArrow(finish, f"{columns}, th long, text binary, spans array<int>"))
    unfinished = parted.where("text is not null").select("id", "th", "text", "spans")
    again = repeats(unfinished, windows, buckets, 8, lambda pos: _merged(pos, pos + 1))
    closed = unfinished.drop("spans").join(once(again).hint("shuffle_merge"), ["id", "th"], "left").mapInArrow(remove, columns)
    result = parted.where("text is null").drop("th", "text", "spans").unionByName(closed)
    drop(spark, old)
    return restore_id(result.withColumn("id", F.nullif("id", F.lit("\0"))), id_col, kind)
