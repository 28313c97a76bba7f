"""Language-model scores from a written model: exact counts of words and a log-frequency Bloom filter of bigram counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormglass.llm.common import counted, cut, drop
from stormglass.llm.packing import from_low_bytes, from_planes, low_bytes, planes
from stormglass.llm.words import Words, gathered, mixed

#: Bits a stored item gets, and bits that each item sets.
BITS_PER_ITEM, PROBES = 12, 4
#: Counts are stored by their level: level j stands for counts from FLOOR x 2^((j-1)/2).
STEPS_PER_DOUBLING = 2
#: Lowest count that is stored: bigrams that occur once are stored as well.
FLOOR = 1
#: Weight of the bigram estimate for contexts that are common, and the count at which it is half of that.
BIGRAM_WEIGHT, HALF_COUNT = 0.2, 50.0
#: Hash bits that tell bigrams of one bucket apart: a million of them share one with probability 0.0002, far below the filter's own errors.
KEY_BITS = 32
#: Tokens after which a task closes a block, and documents.
BLOCK_TOKENS, BLOCK_DOCS = 1 << 20, 1 << 15
#: Tokens of the corpus for each bucket of n-grams.
BUCKET_TOKENS = 1 << 20
#: Bytes up to which a model is sent to every worker; n-grams meet the segments of a larger one in a shuffle.
BROADCAST_BYTES = 1 << 25
_END = np.uint64(0x5851F42D4C957F2D)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token with an end after each document, tokens of each document)."""
    n = words.n + 1
    out = np.full(int(n.sum()), _END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(n) - 1] = False
    out[inner] = words.hashes
    return out, n


def _bigrams(names: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct bigram hashes in order, place in them of every token, code of the token before); the first of a document follows an end."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[:1] = np.searchsorted(names, _END)
    keys, place = np.unique(mixed(names[before] * _ODD + names[codes]), return_inverse=True)
    return keys, place, before


def _documents(docs: DataFrame, id_col: str, text_col: str, held_mod: tuple[int, int]) -> DataFrame:
    key: Column = F.col(id_col).cast("string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    held = F.coalesce(F.crc32(key.cast("binary")) % held_mod[0] == held_mod[1], F.lit(False))
    return docs.select(key.alias("id"), held.alias("held_out"), text.alias("text"))


_DOCS = pa.list_(pa.struct([("id", pa.string()), ("held_out", pa.bool_()), ("n", pa.int64())]))


def token_blocks(rows: DataFrame) -> DataFrame:
    """Documents as numbers: block, n (its tokens), trained (of them in training texts), docs, names, codes.

    One row for some million words: the hashes of its distinct tokens in order, and the place
    in them of each token. Texts are split once and do not travel; no block outgrows a task.
    """
    schema = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("trained", pa.int64()), ("docs", _DOCS), ("names", pa.binary()), ("codes", pa.binary())])

    def close(number: int, tokens: list[np.ndarray], ns: list[np.ndarray], tables: list[pa.Table]) -> pa.RecordBatch:
        names, codes = np.unique(np.concatenate(tokens), return_inverse=True)
        n, table = np.concatenate(ns), pa.concat_tables(tables)
        held = np.array(table.column("held_out").to_pylist(), bool)
        listed = [{"id": i, "held_out": h, "n": m} for i, h, m in zip(table.column("id").to_pylist(), held.tolist(), n.tolist(), strict=True)]
        return pa.RecordBatch.from_pylist([{"block": number, "n": len(codes), "trained": int(n[~held].sum()), "docs": listed, "names": names.tobytes(), "codes": planes(codes)}], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, open_ = TaskContext.get().partitionId() << 32, ([], [], [])
        for table, words in gathered(batches, lower=True):
            for some, x in zip(open_, (*_tokens(words), table.select(["id", "held_out"])), strict=True):
                some.append(x)
            if sum(map(len, open_[0])) >= BLOCK_TOKENS or sum(map(len, open_[1])) >= BLOCK_DOCS:
                yield close(number, *open_)
                number, open_ = number + 1, ([], [], [])
        if open_[0]:
            yield close(number, *open_)

    return rows.mapInArrow(read, "block long, n long, trained long, docs array<struct<id:string,held_out:boolean,n:long>>, names binary, codes binary")


def level_of(count: np.ndarray) -> np.ndarray:
    """1 for FLOOR, one more for every half doubling; 0 below FLOOR."""
    with np.errstate(divide="ignore"):
        return np.where(count < FLOOR, 0, 1 + np.floor(STEPS_PER_DOUBLING * np.log2(np.maximum(count, 1) / FLOOR) + 1e-9)).astype(np.int64)


def value_of(level: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(level > 0, np.ceil(FLOOR * 2.0 ** ((level - 1) / STEPS_PER_DOUBLING) - 1e-9), 0)


def _runs(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of the buckets that ordered hashes fall into, by their top bits; empty ones are not met."""
    if not len(keys):
        return
    of = keys >> np.uint64(64 - int(math.log2(buckets)))
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    yield from zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True)


def _sent(block: int, buckets: int, parts: dict[str, tuple[np.ndarray, dict]], schema: pa.Schema) -> pa.RecordBatch:
    """One row for each bucket that has ordered hashes of the block: of every part, what each of its columns makes of a range of them."""
    rows: dict[int, dict] = {}
    for keys, columns in parts.values():
        for bucket, a, b in _runs(keys, buckets):
            row = rows.setdefault(bucket, {"bucket": bucket, "block": block})
            row |= {name: pack(a, b) for name, pack in columns.items()}
    return pa.RecordBatch.from_pylist(list(rows.values()), schema=schema)


@dataclass(frozen=True)
class LanguageModel:
    """A written table of segments, one row a bucket of n-grams: bucket, buckets, tokens (of the
    training texts), types, words and words_n (exact counts), bits (of the filter of bigrams)."""

    table: DataFrame
    buckets: int
    tokens: int
    types: int
    size: int

    def save(self, path: str) -> None:
        self.table.write.parquet(path)


def load_model(table: DataFrame) -> LanguageModel:
    """The model of a table that LanguageModel.save() has written."""
    size = F.length("words") + F.length("words_n") + F.length("bits")
    got = table.agg(F.max("buckets"), F.max("tokens"), F.sum("types"), F.sum(size)).first()
    return LanguageModel(table, got[0] or 16, got[1] or 0, got[2] or 0, got[3] or 0)


def train(blocks: DataFrame, buckets: int, keep: list[str] | None = None) -> LanguageModel:
    """The model of the training texts of the blocks.

    A block sends its distinct n-grams with their counts in training texts, many in one row.
    The task of a bucket adds them up and fills the bucket's segment of the filter, whose size
    follows its own number of items. No count is too low to be kept. What is written is the
    model: counts of bigrams are gone from here on.
    """
    tokens = int(blocks.agg(F.sum("trained")).first()[0] or 0)
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("words_n", pa.binary()), ("pairs", pa.binary()), ("pairs_n", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, docs, names, codes = _block(batch.slice(k, 1))
                training = np.repeat(~docs[1], docs[2])
                keys, place, _ = _bigrams(names, codes)
                words_n, pairs_n = np.bincount(codes, training, len(names)).astype("<u4"), np.bincount(place, training, len(keys)).astype("<u4")
                names, words_n, keys, pairs_n = names[words_n > 0], words_n[words_n > 0], keys[pairs_n > 0], pairs_n[pairs_n > 0]
                yield _sent(block, buckets, {
                    "words": (names, {"words": lambda a, b, x=names: x[a:b].tobytes(), "words_n": lambda a, b, x=words_n: planes(x[a:b])}),
                    "pairs": (keys, {"pairs": lambda a, b, x=keys: low_bytes(x[a:b], KEY_BITS // 8), "pairs_n": lambda a, b, x=pairs_n: planes(x[a:b])}),
                }, schema)

    sent = blocks.select("block", "docs", "names", "codes").mapInArrow(send, "bucket long, block long, words binary, words_n binary, pairs binary, pairs_n binary")

    def segment(group: pa.Table) -> pa.Table:
        words, back = np.unique(_joined(group.column("words"), "<u8"), return_inverse=True)
        words_n = np.bincount(back, _counts(group.column("words_n")), len(words)).astype("<u8")
        keys, place = np.unique(from_low_bytes(b"".join(x for x in group.column("pairs").to_pylist() if x), KEY_BITS // 8), return_inverse=True)
        filter_ = fill(keys, level_of(np.bincount(place, _counts(group.column("pairs_n")), len(keys))))
        return pa.table({"bucket": group.column("bucket")[:1], "types": pa.array([len(words)]), "words": [words.tobytes()], "words_n": [words_n.tobytes()], "bits": [filter_.bits.tobytes()]})

    made = sent.groupBy("bucket").applyInArrow(segment, "bucket long, types long, words binary, words_n binary, bits binary")
    return load_model(cut(made.withColumns({"buckets": F.lit(buckets), "tokens": F.lit(tokens)}), keep))


class Segments:
    """Some segments of a model in memory: counts of words and levels of bigrams, by ordered hashes."""

    def __init__(self, rows: list[dict], buckets: int):
        self.buckets = buckets
        self.of = {r["bucket"]: (np.frombuffer(r["words"], "<u8"), np.frombuffer(r["words_n"], "<u8"), LogFrequencyFilter(np.frombuffer(r["bits"], np.uint8), 1, 1, 0, 0)) for r in rows}

    def counts(self, names: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), "<u8")
        for bucket, a, b in _runs(names, self.buckets):
            words, n, _ = self.of.get(bucket, (names[:0], out[:0], None))
            if len(words):
                at = np.minimum(np.searchsorted(words, names[a:b]), len(words) - 1)
                out[a:b] = np.where(words[at] == names[a:b], n[at], 0)
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.uint8)
        for bucket, a, b in _runs(keys, self.buckets):
            if bucket in self.of:
                out[a:b] = self.of[bucket][2].levels(keys[a:b])
        return out


def answers(blocks: DataFrame, model: LanguageModel) -> DataFrame:
    """(block, bucket, words, levels): what the segments say of the n-grams that each block asks of them, in the order of the hashes."""
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary())])
    buckets = model.buckets

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, _, names, codes = _block(batch.slice(k, 1))
                keys = _bigrams(names, codes)[0]
                yield _sent(block, buckets, {
                    "words": (names, {"words": lambda a, b, x=names: x[a:b].tobytes()}),
                    "pairs": (keys, {"pairs": lambda a, b, x=keys: low_bytes(x[a:b], KEY_BITS // 8)}),
                }, schema)

    def answer(asked: pa.Table, segment: pa.Table) -> pa.Table:
        if not len(asked):
            return pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "words": pa.array([], pa.binary()), "levels": pa.array([], pa.binary())})
        own = Segments(segment.to_pylist(), buckets)
        top = np.uint64(asked.column("bucket")[0].as_py()) << np.uint64(64 - int(math.log2(buckets)))
        out = []
        for row in asked.to_pylist():
            names, keys = np.frombuffer(row["words"] or b"", "<u8"), top | from_low_bytes(row["pairs"] or b"", KEY_BITS // 8)
            out.append({"block": row["block"], "bucket": row["bucket"], "words": planes(own.counts(names)), "levels": own.levels(keys).tobytes()})
        return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("words", pa.binary()), ("levels", pa.binary())]))

    asked = blocks.select("block", "docs", "names", "codes").mapInArrow(ask, "bucket long, block long, words binary, pairs binary")
    both = asked.groupBy("bucket").cogroup(model.table.select("bucket", "words", "words_n", "bits").groupBy("bucket"))
    return both.applyInArrow(answer, "block long, bucket long, words binary, levels binary")


def _block(row: pa.RecordBatch | pa.Table) -> tuple[int, tuple[pa.Array, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """(block, (ids, held out, tokens) of its documents, names, codes) of one row."""
    docs = row.column("docs")[0].values
    names = np.frombuffer(row.column("names")[0].as_py(), "<u8")
    codes = from_planes(row.column("codes")[0].as_py())
    return row.column("block")[0].as_py(), (docs.field("id"), np.array(docs.field("held_out").to_pylist(), bool), docs.field("n").to_numpy()), names, codes


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _counts(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, "<u4"), *(from_planes(x) for x in column.to_pylist() if x)])


class LogFrequencyFilter:
    """Membership bits of (n-gram, level) items. Bucket b has a segment of its own."""

    def __init__(self, bits: np.ndarray, buckets: int, low: int, tokens: int, types: int):
        self.bits, self.buckets, self.low, self.tokens, self.types = bits, buckets, low, tokens, types

    @staticmethod
    def place(keys: np.ndarray, level: int, probe: int, segment_bits: int) -> np.ndarray:
        """A bit place in the segment, from the low KEY_BITS bits of the keys."""
        h = mixed((keys & np.uint64((1 << KEY_BITS) - 1)) * _ODD + np.uint64(level * PROBES + probe))
        return h % np.uint64(segment_bits)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Stored levels, by probing level after level until one is missing."""
        segment = len(self.bits) * 8 // self.buckets
        begin = (keys >> np.uint64(64 - int(math.log2(self.buckets)))) * np.uint64(segment) if self.buckets > 1 else np.zeros(len(keys), np.uint64)
        level = np.zeros(len(keys), np.int64)
        left, j = np.arange(len(keys)), self.low
        while len(left):
            for k in range(PROBES):
                place = begin[left] + self.place(keys[left], j, k, segment)
                left = left[(self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            level[left] = j
            j += 1
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return value_of(self.levels(keys))


def fill(keys: np.ndarray, levels: np.ndarray) -> LogFrequencyFilter:
    """The segment of one bucket, with BITS_PER_ITEM bits for each of its items (64 at least), in whole bytes."""
    segment = max(64, -(-int(levels.sum()) * BITS_PER_ITEM // 8) * 8)
    flags = np.zeros(segment, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        keys, levels = keys[levels >= level], levels[levels >= level]
        for probe in range(PROBES):
            flags[LogFrequencyFilter.place(keys, level, probe, segment)] = True
    return LogFrequencyFilter(np.packbits(flags, bitorder="little"), 1, 1, 0, 0)


_RESULT = pa.schema([("id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_RESULT_COLUMNS = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(block: pa.RecordBatch | pa.Table, own: np.ndarray, levels: np.ndarray, place: np.ndarray, before: np.ndarray, tokens: int, types: int) -> pa.RecordBatch:
    """The documents of a block, from the counts of its names and the levels of its bigrams."""
    _, (ids, held, n), _, codes = _block(block)
    own, joint = own.astype(float), value_of(levels.astype(np.int64))[place]
    c, own = own[before], own[codes]
    weight = BIGRAM_WEIGHT * c / (c + HALF_COUNT)
    alone = (own + 1.0) / (tokens + types + 1.0)
    p = weight * np.minimum(joint, c) / np.maximum(c, 1.0) + (1 - weight) * alone
    doc = np.repeat(np.arange(len(n)), n)
    add = lambda x: np.bincount(doc, x, len(n))
    columns = [ids, pa.array(held), pa.array(n), pa.array(add(own > 0).astype(np.int64)), pa.array(np.full(len(n), tokens)), pa.array(add(np.log10(alone))), pa.array(add(np.log10(p)))]
    return pa.RecordBatch.from_arrays(columns, schema=_RESULT)


def score_blocks(blocks: DataFrame, model: LanguageModel) -> DataFrame:
    """The scores of all documents of the blocks by the model; nothing is counted here.

    A model of up to BROADCAST_BYTES goes to every worker, which probes it for its own blocks.
    The n-grams of blocks meet the segments of a larger one by bucket, and their counts come
    back to the blocks.
    """
    tokens, types, buckets = model.tokens, model.types, model.buckets
    rows = blocks.select("block", "docs", "names", "codes")
    if model.size <= BROADCAST_BYTES:
        segments = [r.asDict() for r in model.table.select("bucket", "words", "words_n", "bits").collect()]
        shared = blocks.sparkSession.sparkContext.broadcast(segments)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Segments(shared.value, buckets)
            for batch in batches:
                for k in range(batch.num_rows):
                    block = batch.slice(k, 1)
                    _, _, names, codes = _block(block)
                    keys, place, before = _bigrams(names, codes)
                    yield _scores(block, own.counts(names), own.levels(keys), place, before, tokens, types)

        return rows.mapInArrow(probe, _RESULT_COLUMNS)

    def score(block: pa.Table, answered: pa.Table) -> pa.Table:
        answered = answered.sort_by("bucket")
        _, _, names, codes = _block(block)
        _, place, before = _bigrams(names, codes)
        return pa.Table.from_batches([_scores(block, _counts(answered.column("words")), _joined(answered.column("levels"), np.uint8), place, before, tokens, types)])

    return rows.groupBy("block").cogroup(answers(blocks, model).groupBy("block")).applyInArrow(score, _RESULT_COLUMNS)


def buckets_for(tokens: int) -> int:
    """A power of two of buckets for a corpus of so many tokens."""
    return 1 << min(64 - KEY_BITS, max(4, math.ceil(math.log2(max(1, tokens / BUCKET_TOKENS)))))


def train_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_mod: tuple[int, int] = (7, 2), keep: list[str] | None = None) -> LanguageModel:
    """The model of the rows of docs that are not held out (see score_documents)."""
    old: list[str] = []
    blocks, everything = counted(token_blocks(_documents(docs, id_col, text_col, held_mod)), F.col("n"), old)
    model = train(blocks, buckets_for(everything), keep)
    drop(docs.sparkSession, old)
    return model


def score_with(model: LanguageModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_mod: tuple[int, int] = (7, 2)) -> DataFrame:
    """Scores of docs, as score_documents gives them, by a model of other documents."""
    return _named(score_blocks(cut(token_blocks(_documents(docs, id_col, text_col, held_mod))), model), docs, id_col)


def _named(scored: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    return scored.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *scored.columns[1:])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_mod: tuple[int, int] = (7, 2)) -> DataFrame:
    """Per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words, A-Z in lower case, and an end. Learned from the rows whose crc32 of the
    id, modulo held_mod[0], is not held_mod[1]: train() writes a model, score_blocks() reads it.
    base_score uses exact counts of words.

    score interpolates: w x c(v, t) / c(v) + (1 - w) x (c(t) + 1) / (N + V + 1), with a weight w
    that falls for rare contexts. Counts of words are exact; those of bigrams come from a filter
    that grows with their number and holds all of them. They are never above the true ones but
    for false positives, so the probabilities of all tokens after a context add up to at most 1.

    Null texts are empty and have one token; null ids are trained on. Rows that repeat id and
    text get equal results. An empty table gives no rows.
    """
    blocks, everything = counted(token_blocks(_documents(docs, id_col, text_col, held_mod)), F.col("n"))
    return _named(score_blocks(blocks, train(blocks, buckets_for(everything))), docs, id_col)
