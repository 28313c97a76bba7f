"""Near duplicates: a chosen-path set similarity join over minwise tokens."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormglass.llm.common import components, counted, cut, drop
from stormglass.llm.words import Words, gathered, mixed, window_hashes

#: Words of a shingle.
SHINGLE = 5
#: Minwise tokens of a document that paths choose from.
TOKENS = 64
#: Independent trees. The root of tree t chooses token t.
TREES = 10
#: A node of up to this many documents is compared exhaustively; a larger one branches, up to LEVELS
#: times below the root. What is still larger then is compared exhaustively as well, part by part.
SMALL, LEVELS = 4096, 12
#: Tokens that a node of a level may choose from; those of a path's levels and of its root differ.
CHOICES = 4
#: Shingles of a part of a node whose full sets are compared in one task.
TOGETHER_SHINGLES = 1 << 22
#: The sketch: shingles fall into BINS by their hash, the least of each bin sets a bit to its parity.
BINS, BITS = 1 << 12, 1 << 11
#: Standard deviations below the threshold at which the sketches of a pair rule it out.
SLACK = 5.0

_MULTIPLY = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: Tokens that roots leave to the levels below: a prime number, so that multiples of any number but 0 run through all.
_BELOW = 53
_ROW = [("node", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("bins", pa.int32()), ("sketch", pa.binary())]


def shingle_sets(words: Words) -> list[np.ndarray]:
    """The sorted distinct hashes of each document's shingles; a shorter text is one shingle, no words none."""
    h, out = window_hashes(words.hashes, SHINGLE), []
    for begin, end in words.ranges():
        if end - begin >= SHINGLE:
            out.append(np.unique(h[begin : end - SHINGLE + 1]))
        elif end > begin:
            out.append(mixed(window_hashes(words.hashes[begin:end], end - begin) + np.uint64(end - begin)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(shingles: np.ndarray, salt: int = 0) -> int:
    return int(mixed(shingles ^ np.uint64(salt)).sum().view(np.int64))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """TOKENS minima of the set, each under a hash of its own; 32 bits."""
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(shingles), 2048):
        part = (np.multiply.outer(shingles[k : k + 2048], _MULTIPLY) + _ADD) >> np.uint64(32)
        np.minimum(out, part.min(axis=0), out=out)
    return out.astype("<u4")


def parity_sketch(shingles: np.ndarray) -> tuple[int, bytes]:
    """(bins that hold a shingle, BITS parities over the least shingle of each bin) of a sorted set."""
    least = shingles[np.flatnonzero(np.diff(shingles >> np.uint64(64 - BINS.bit_length() + 1), prepend=np.uint64(1 << 63)))]
    at = mixed(least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS.bit_length() + 1)
    return len(least), np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8), bitorder="little").tobytes()


def confidence(n: np.ndarray, bins: np.ndarray, sketch: np.ndarray, k: int, to: slice, percent: int) -> np.ndarray:
    """For row k and each row of `to`: by how many standard deviations their similarity seems above the threshold.

    At the threshold the sizes give the union, so the bins that it fills, those that agree
    and the bits that differ; the noise is that of sampling by bins and of parities that
    collide. Pairs whose sizes alone rule them out have minus infinity.
    """
    share = percent / 100
    n1, n2 = float(n[k]), n[to].astype(float)
    union = (n1 + n2) / (1 + share)
    have = float(bins[k]) + bins[to]
    # the union fills more or less than expected as its parts do
    filled = np.expm1(-union / BINS) * have / (np.expm1(-n1 / BINS) + np.expm1(-n2 / BINS))
    apart = np.maximum(have - 2 * share * filled, 0.0)
    fade = np.exp(-2 * apart / BITS)
    sampled = 4 * filled * share * (1 - share) * (1 - np.minimum(filled / union, 1.0))
    noise = np.sqrt(fade * fade * sampled + BITS / 4 * (1 - fade * fade) - apart * fade * fade + 0.5)
    differ = np.bitwise_count(sketch[k] ^ sketch[to]).sum(axis=1, dtype=np.int64)
    out = (BITS / 2 * (1 - fade) - differ) / noise
    out[100 * np.minimum(n1, n2) < percent * np.maximum(n1, n2)] = -np.inf
    return out


@dataclass
class _Nodes:
    """Rows of whole nodes, in the order of nodes."""

    node: np.ndarray
    rid: np.ndarray
    n: np.ndarray
    bins: np.ndarray
    sketch: np.ndarray
    label: np.ndarray | None = None

    def ranges(self) -> Iterator[tuple[int, int]]:
        starts = np.flatnonzero(np.diff(self.node, prepend=~self.node[:1]))
        yield from zip(starts.tolist(), [*starts[1:].tolist(), len(self.node)], strict=True)


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[_Nodes]:
    """The rows of a task, which come sorted by node, in portions that hold whole nodes of at most 2 x SMALL rows."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks()
        node = table.column("node").to_numpy()
        end = int(np.searchsorted(node, node[-1]))
        if end:
            yield _nodes(table.slice(0, end))
        left = table.slice(end).combine_chunks().to_batches()[0]
    if left is not None and left.num_rows:
        yield _nodes(pa.Table.from_batches([left]))


def _nodes(table: pa.Table) -> _Nodes:
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, BITS // 64)
    more = (table.column("label").to_numpy(),) if "label" in table.column_names else ()
    return _Nodes(*(table.column(c).to_numpy() for c in ("node", "rid", "n", "bins")), sketch, *more)


def _forest(x: _Nodes, a: int, b: int, percent: int) -> tuple[list[tuple[int, int]], bool]:
    """(the likeliest links that join all candidates of a node, whether pairs near the threshold are left out).

    Every pair of the node is compared: each row that joins the tree meets all that are not in it.
    """
    size = b - a
    best, parent, out = np.full(size, -np.inf), np.zeros(size, np.int64), np.ones(size, bool)
    links, doubtful, k = [], 0, 0
    for _ in range(size - 1):
        out[k] = False
        c = confidence(x.n, x.bins, x.sketch, a + k, slice(a, b), percent)
        c[~out] = -np.inf
        doubtful += int(np.count_nonzero((c >= -SLACK) & (c < SLACK)))
        better = c > best
        best[better], parent[better] = c[better], k
        k = int(np.argmax(np.where(out, best, -np.inf)))
        if not out[k]:  # nothing left is like the tree: start another
            k = int(np.argmax(out))
        elif best[k] >= -SLACK:
            links.append((a + int(parent[k]), a + k))
            doubtful -= bool(best[k] < SLACK)
    return links, doubtful > 0


def node_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, node): links that span the candidates of each node; a row with null a and b marks a node
    that has doubtful pairs besides. rows: (node, rid, n, bins, sketch), whole nodes, sorted."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_nodes(batches):
            links, marked = [], []
            for a, b in x.ranges():
                if b - a > 1:
                    found, more = _forest(x, a, b, percent)
                    links += found
                    if more:
                        marked.append(int(x.node[a]))
            one, two = (x.rid[np.array([p[k] for p in links], np.int64)] for k in (0, 1))
            n = len(links)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.nulls(n, pa.int64())], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(marked), pa.int64())] * 2 + [pa.array(marked, pa.int64())], schema=schema)

    return rows.mapInArrow(run, "a long, b long, node long")


def crossing_rows(rows: DataFrame, percent: int) -> DataFrame:
    """(node, rid): the rows of each node that have a candidate of another label in it. rows: as for node_links, with label."""
    schema = pa.schema([("node", pa.int64()), ("rid", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole_nodes(batches):
            told = np.zeros(len(x.rid), bool)
            for a, b in x.ranges():
                for k in range(a, b - 1):
                    c = confidence(x.n, x.bins, x.sketch, k, slice(k + 1, b), percent)
                    crosses = (c >= -SLACK) & (x.label[k + 1 : b] != x.label[k])
                    told[k] |= crosses.any()
                    told[k + 1 : b] |= crosses
            yield pa.RecordBatch.from_arrays([pa.array(x.node[told]), pa.array(x.rid[told])], schema=schema)

    return rows.mapInArrow(run, "node long, rid long")


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share, exactly; shingles of one set alone are left out before."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = row[many[column] > 1], column[many[column] > 1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.unique(column[order], return_inverse=True)[1]
    out, width = np.zeros((len(sets), len(sets)), np.float32), 1024
    ends = np.searchsorted(column, np.arange(0, int(column.max(initial=-1)) + 1 + width, width))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] % width] = 1
        out += part @ part.T
    return out


def crossing_links(label: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between rows of different labels, by their full sets: as many as it takes to join what they join."""
    n, common = np.array([len(s) for s in sets]), common_shingles(sets)
    linked = 100 * common >= percent * (n[:, None] + n - common)
    now, links = np.unique(label, return_inverse=True)[1], []
    for k in range(len(n)):
        others = np.flatnonzero(linked[k] & (now != now[k]))
        _, first = np.unique(now[others], return_index=True)
        for j in others[first].tolist():
            links.append((k, j))
            now[now == now[j]] = now[k]
    return links


def node_crossings(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join different labels of a node. rows: (node, rid, label, shingles), sorted by node."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def close(rid: list[int], label: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        links = crossing_links(np.array(label), sets, percent) if len(set(label)) > 1 else []
        pairs = [sorted((rid[k], rid[j])) for k, j in links]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, open_ = None, ([], [], [])
        for batch in batches:
            shingles = batch.column("shingles")
            for k, (node, rid, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("node", "rid", "label")), strict=True)):
                if node != here:
                    if open_[0]:
                        yield close(*open_)
                    here, open_ = node, ([], [], [])
                for some, x in zip(open_, (rid, label, shingles[k].values.to_numpy()), strict=True):
                    some.append(x)
        if open_[0]:
            yield close(*open_)

    return rows.mapInArrow(run, "a long, b long")


def to_pivots(rows: DataFrame, percent: int) -> DataFrame:
    """rows with their confidence to be as similar to the node's pivot (p_n, p_bins, p_sketch) as the
    threshold says (above), and within 4/3 (near), 2 (beyond) and 1/3 (close) of its distance."""
    names = [*(c for c, _ in _ROW), "tree", "pivot"]
    schema = pa.schema([*_ROW, ("tree", pa.int32()), ("pivot", pa.int64()), ("above", pa.float64()), ("near", pa.float64()), ("beyond", pa.float64()), ("close", pa.float64())])
    away = 100 - percent
    limits = [percent, int(100 - 4 * away / 3), max(1, 100 - 2 * away), 100 - away // 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bins = batch.column("n").to_numpy(), batch.column("bins").to_numpy()
            own, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("sketch", "p_sketch"))
            p_n, p_bins = batch.column("p_n").to_numpy(), batch.column("p_bins").to_numpy()
            out = np.zeros((4, len(n)))
            starts = np.flatnonzero((np.diff(p_n, prepend=-1) != 0) | (np.diff(batch.column("pivot").to_numpy(), prepend=-1) != 0))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(n)], strict=True):
                x = [np.concatenate([a[s : s + 1], b[s:e]]) for a, b in ((p_n, n), (p_bins, bins), (other, own))]
                for k, limit in enumerate(limits):
                    out[k, s:e] = confidence(*x, 0, slice(1, None), limit)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(o) for o in out)], schema=schema)

    return rows.mapInArrow(run, "node long, rid long, n long, bins int, sketch binary, tree int, pivot long, above double, near double, beyond double, close double")


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row of docs: id, n_shingles, a and b (128-bit hash of the set), bins, sketch, tokens."""
    schema = pa.schema([("id", pa.string()), ("n_shingles", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("bins", pa.int32()), ("sketch", pa.binary()), ("tokens", pa.binary())])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, words in gathered(batches, lower=True):
            out = []
            for key, s in zip(table.column("id").to_pylist(), shingle_sets(words), strict=True):
                row = {"id": key, "n_shingles": len(s)}
                if len(s):
                    bins, sketch = parity_sketch(s)
                    row |= {"a": set_hash(s), "b": set_hash(s, 0x5851F42D4C957F2D), "bins": bins, "sketch": sketch, "tokens": minwise(s).tobytes()}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    columns = "id string, n_shingles long, a long, b long, bins int, sketch binary, tokens binary"
    return docs.select(F.col(id_col).cast("string").alias("id"), text.alias("text")).mapInArrow(run, columns)


def full_sets(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, shingles array) of the texts that needed (rid, id, a) names; of rows that repeat an id, those whose set has the hash a."""
    schema = pa.schema([("rid", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, words in gathered(batches, lower=True):
            sets, a = shingle_sets(words), table.column("a").to_pylist()
            right = [k for k, s in enumerate(sets) if len(s) and set_hash(s) == a[k]]
            if right:
                offsets = np.cumsum([0, *(len(sets[k]) for k in right)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([sets[k] for k in right]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([table.column("rid").take(pa.array(right)).combine_chunks(), flat], schema=schema)

    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(needed, "id")
    return rows.select("rid", "a", "text").mapInArrow(run, "rid long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 x intersection >= percent x union."""
    left = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of nodes that hold more than one document, with size, that number; all of a node's rows at once."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(sizes, "node")


def _chosen(node: Column, at: Column) -> Column:
    return F.xxhash64(node, at, F.expr("substring(tokens, cast(at * 4 + 1 as int), 4)"))


def _choices(depth: int, percent: int) -> Column:
    """The one or two tokens that a node chooses on a level, by its hash: 100 / percent on average, so
    that a pair at the threshold goes on along one path on average, whatever the depth.

    Each tree runs through the tokens that no root has in an order of its own, CHOICES a level.
    """
    node = lambda salt, of: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(of))
    first = node(1, CHOICES)
    second = F.pmod(first + 1 + node(2, CHOICES - 1), F.lit(CHOICES))
    step, start = (1 + F.pmod(F.xxhash64("tree", F.lit(k)), F.lit(_BELOW - 1)) for k in (3, 4))
    token = lambda i: TREES + F.pmod(start + step * (CHOICES * (depth - 1) + i), F.lit(_BELOW))
    return F.when(node(5, 1000) < 1000 * (100 - percent) // percent, F.array(token(first), token(second))).otherwise(F.array(token(first)))


def _in_parts(rows: DataFrame, parts: Column) -> DataFrame:
    """rows whose nodes are dealt to so many parts (an aggregate, rounded up), and every two parts of a node to a node of their own."""
    sizes = rows.groupBy("node").agg(F.greatest(F.ceil(parts), F.lit(1)).cast("long").alias("parts"))
    dealt = rows.join(sizes, "node").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    paired = dealt.withColumn("other", other).withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")))
    # with two parts or more, no part meets itself alone
    return paired.where("parts = 1 or own <> other").select(*[c for c in rows.columns if c != "tree"])


def near_components(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id.

    A document is the set of its distinct five-word shingles (A-Z in lower case). Documents
    with equal sets form a class, and only classes go on. In each tree the root deals them out
    by one minwise token. A node of up to SMALL classes compares all its pairs by their
    sketches; a larger node branches on further tokens, one or two as a hash of the node says,
    none of them met before on the path, until its parts are small. After LEVELS levels the
    parts of a node that is still large are compared two by two, so the recursion ends with
    every pair of every node compared. Two classes at the threshold share a node of one tree
    with probability 0.85 where the root's nodes are small: ten trees miss one in 170 million.
    Below, a pair goes on along one path a tree on average, and k levels down is met in a tree
    with probability 1 / (1 + k / 8) or more; at the last level ten trees meet 0.99 of pairs.

    Links are wanted only as far as they join components, so a node sends the likeliest links
    that span its candidates, one for each class at most. They are verified on the full sets;
    then the nodes that had pairs near the threshold besides look again: rows with a candidate
    in another component bring their full sets, are compared exactly, part by part where the
    sets are large, and send the links that join components. A node that is large below the root's level also compares its classes with one of
    them, its pivot: those linked with it are one component and leave the node if the classes
    that could be linked with them, but not with the pivot (distances obey the triangle
    inequality), are few; those few meet them in parts of SMALL. So a group of copies costs
    rows and links in its size, not in its square, and no link is cut.

    Null or wordless texts are alone. Rows that repeat an id are separate documents under one
    name. Null ids have a null component. An empty table gives no rows; other columns are not
    read.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    old: list[str] = []
    level: list[str] = []
    rows = cut(sketches(docs, id_col, text_col).withColumn("id", F.col("id").cast(kind)))
    full = rows.where("n_shingles > 0 and id is not null")
    first = full.groupBy("a", "b", "n_shingles").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("bins", "sketch", "tokens")])
    classes = cut(first.withColumnRenamed("n_shingles", "n").withColumn("rid", F.monotonically_increasing_id()), old)

    drawn = classes.select("rid", "tokens", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    drawn = drawn.withColumn("at", F.col("tree"))
    nodes = cut(_sized(drawn.select("tree", _chosen(F.col("tree"), F.col("at")).alias("node"), "rid")), level)
    leaves, links = nodes.where(f"size <= {SMALL}").select("node", "rid"), None
    opened = nodes.where(f"size > {SMALL}").select("tree", "node", "rid")
    depth = 0
    while depth < LEVELS and not opened.isEmpty():
        depth, going = depth + 1, opened
        if depth > 1:  # most large nodes fall apart by themselves at once
            settled, going, sure = _around_pivots(opened, classes, percent, level)
            leaves, links = leaves.unionByName(settled), sure if links is None else links.unionByName(sure)
        below = going.join(classes.select("rid", "tokens"), "rid").withColumn("at", F.explode(_choices(depth, percent)))
        nodes = cut(_sized(below.select("tree", _chosen(F.col("node"), F.col("at")).alias("node"), "rid")), level)
        leaves = leaves.unionByName(nodes.where(f"size <= {SMALL}").select("node", "rid"))
        opened = nodes.where(f"size > {SMALL}").select("tree", "node", "rid")
    if depth == LEVELS:
        leaves = leaves.unionByName(_in_parts(opened, F.count(F.lit(1)) * 2 / SMALL))

    leaf_rows = cut(leaves.join(classes.select("rid", "n", "bins", "sketch"), "rid").select(*[c for c, _ in _ROW]), old)
    found = cut(node_links(_by_node(leaf_rows), percent), old)
    edges = found.where("a is not null").select("a", "b")
    candidates = cut((edges if links is None else edges.unionByName(links)).distinct(), old)
    drop(spark, level)
    doubtful = leaf_rows.join(found.where("a is null").select("node"), "node", "left_semi")
    wanted, n_wanted = counted(candidates.select(F.explode(F.array("a", "b")).alias("rid")).unionByName(doubtful.select("rid")).distinct(), keep=old)
    sets, n_sets = counted(full_sets(docs, classes.select("rid", "id", "a").join(wanted, "rid", "left_semi"), id_col, text_col), keep=old)
    if n_sets > n_wanted:  # rows that repeat id and text
        sets = cut(sets.dropDuplicates(["rid"]), old)
    linked = cut(verified(candidates, sets, percent), old)
    known = components(linked, old).withColumnRenamed("node", "rid")
    labelled = doubtful.join(known, "rid", "left").withColumn("label", F.coalesce("component", "rid")).drop("component")
    crossing, n_crossing = counted(crossing_rows(_by_node(labelled), percent), keep=old)
    if n_crossing:
        rest = crossing.join(known, "rid", "left").select("node", "rid", F.coalesce("component", "rid").alias("label")).join(sets, "rid")
        parts = _in_parts(rest, F.sum(F.size("shingles").cast("long")) * 2 / TOGETHER_SHINGLES)
        more, n_more = counted(node_crossings(_by_node(parts).select("node", "rid", "label", "shingles"), percent).distinct(), keep=old)
        if n_more:
            known = components(linked.unionByName(more), old).withColumnRenamed("node", "rid")
    # a component is known by the smallest id of all its rows
    member = classes.select("rid", "id", "a", "b", "n").join(known, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    named = member.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = cut(member.join(named, "component").select(F.col("a").alias("a_"), F.col("b").alias("b_"), F.col("n").alias("n_"), "component_id"))
    drop(spark, old)
    same = (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")) & (F.col("n_shingles") == F.col("n_"))
    joined = rows.select("id", "n_shingles", "a", "b").join(of_class, same, "left")
    return joined.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def _by_node(rows: DataFrame) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node", "rid")


def _around_pivots(opened: DataFrame, classes: DataFrame, percent: int, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of small nodes, rows that branch on, links with pivots) of large nodes.

    The members linked with the pivot leave their node if at most SMALL others lie within
    reach of them, else those within a third of the linking distance if at most SMALL others
    lie within reach of these, else none. Those within reach meet the leaving members in parts.
    """
    pivot = opened.groupBy("node").agg(F.min_by("rid", F.xxhash64("rid", "node")).alias("pivot"))
    of = classes.select("rid", "n", "bins", "sketch")
    pivots = pivot.join(of.withColumnsRenamed({"rid": "pivot", "n": "p_n", "bins": "p_bins", "sketch": "p_sketch"}), "pivot")
    placed = cut(to_pivots(opened.join(of, "rid").join(pivots, "node"), percent).drop("n", "bins", "sketch"), keep)
    linked, close = F.col("above") >= SLACK, F.col("close") >= SLACK
    far, some = ~linked & (F.col("beyond") >= -SLACK), ~close & (F.col("near") >= -SLACK) & (F.col("above") < SLACK)
    sums = placed.groupBy("node").agg(F.count_if(far).alias("far_n"), F.count_if(some).alias("some_n"))
    way = F.when(F.col("far_n") <= SMALL, 2).when(F.col("some_n") <= SMALL, 1).otherwise(0)
    told = placed.join(sums.select("node", way.alias("way")), "node")
    leaves = ((F.col("way") == 2) & linked) | ((F.col("way") == 1) & close)
    border = ((F.col("way") == 2) & far) | ((F.col("way") == 1) & some)
    told = cut(told.select("tree", "node", "rid", "pivot", (leaves & (F.col("rid") != F.col("pivot"))).alias("leaves"), border.alias("border")), keep)
    gone = told.where("leaves").groupBy("node").agg(F.ceil(F.count(F.lit(1)) / SMALL).alias("parts"))
    part = told.where("leaves").join(gone, "node").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    meet = told.where("border").join(gone, "node").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    settled = part.unionByName(meet).select(F.xxhash64("node", "part", F.lit("part")).alias("node"), "rid")
    sure = told.where("leaves").select(F.least("rid", "pivot").alias("a"), F.greatest("rid", "pivot").alias("b"))
    return settled, told.where("not leaves").select("tree", "node", "rid"), sure


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component; columns as they were.

    Rows with null ids stay, as do null and wordless texts and all rows that repeat an id
    that stays. An empty table gives no rows. Texts are shuffled once, to meet the ids that go.
    """
    found = near_components(docs, percent, id_col, text_col)
    names = docs.columns
    gone = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("key")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("key"))
    return packed.join(gone, "key", "left_anti").select(*[F.col(f"row.`{c}`") for c in names])
