"""Merkle manifest of a dataset: trees of groups, a root over their roots, and proofs by pointer jumping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormglass.llm.common import cut, placed

#: Nodes of a run, which share a parent.
FANOUT = 8
#: Rows of a pointer jump that may meet at one ancestor; beyond that the ancestor is repeated.
TOGETHER = 512

Step = "struct<left:string,right:string>"


def digest(x: Column) -> Column:
    """H: sha256 in lower-case hexadecimal digits."""
    return F.sha2(x, 256)


def record(columns: list[Column]) -> Column:
    """The fields of a leaf, one after another: `-` if null, else the number of UTF-8 bytes, a colon and the value."""
    text = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def proof_digest(proof: Column) -> Column:
    """H of a proof's siblings, level by level, left to right."""
    return digest(joined(F.transform(proof, lambda s: F.concat(s["left"], s["right"]))))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(proof, leaf, lambda own, s: digest(F.concat(s["left"], own, s["right"])))


def _between(kids: Column, begin: Column | int, length: Column) -> Column:
    return joined(F.transform(F.slice(kids, begin, length), lambda k: k["digest"]))


def _step(kids: Column, at: Column) -> Column:
    """Siblings on both sides of the kid at a place, from 0."""
    return F.struct(_between(kids, F.lit(1), at).alias("left"), _between(kids, at + 2, F.size(kids)).alias("right"))


def _name(tree: Column, level: int, place: Column) -> Column:
    return F.concat(F.lit(f"{level}/"), place.cast("string"), F.lit("/"), tree)


def _grow(nodes: DataFrame, most: int, keep: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(steps of every node to its parent, the node that each tree comes to) above nodes (tree, place, n, node, digest, height).

    n is the number of the tree's nodes on their level, most the largest of them. A level is
    one grouping by (tree, place / FANOUT); each level has an eighth of the rows of the one below.
    """
    steps, tops, level = [], nodes.where("n = 1"), 0
    while most > 1:
        level, most = level + 1, -(-most // FANOUT)
        kid = F.struct("place", "digest", "node", "height")
        up = nodes.where("n > 1").groupBy("tree", F.floor(F.col("place") / FANOUT).cast("long").alias("place"), "n").agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        up = up.select("tree", "place", F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), _name(F.col("tree"), level + 1, F.col("place")).alias("node"), digest(_between(F.col("kids"), 1, F.size("kids"))).alias("digest"), (F.array_max(F.transform("kids", lambda k: k["height"])) + 1).alias("height"), "kids")
        up = cut(up, keep)
        each = up.select("node", "digest", "n", "kids", F.posexplode("kids").alias("at", "kid"))
        path = F.array(_step(F.col("kids"), F.col("at"))).alias("path")
        steps.append(each.select(F.col("kid.node").alias("node"), F.col("node").alias("up"), path, F.when(F.col("n") == 1, F.col("digest")).alias("sub"), F.col("kid.height").alias("height")))
        nodes = up.drop("kids")
        tops = tops.unionByName(nodes.where("n = 1"))
    return steps, tops


def _paths(steps: DataFrame, depth: int, keep: list[str]) -> DataFrame:
    """(node, path to the root, sub) from the steps to parents: each round joins the table with itself and doubles what a row spans.

    A row that has reached the root finds nothing above and stays. 8^distance rows may meet at
    an ancestor; it is repeated as often as keeps them to TOGETHER a copy, and only nodes with
    that many levels below are asked at all, so the copies are fewer than the rows.
    """
    table, span = cut(steps, keep), 1
    while span < depth:
        copies = max(1, min(FANOUT**span, 1 << 40) // TOGETHER)
        own = table.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(copies)))
        above = table.where(F.col("height") >= span).select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("path").alias("rest"), F.col("sub").alias("above"))
        above = above.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
        far = own.join(above, ["up", "salt"], "left")
        table = cut(far.select("node", F.coalesce("further", "up").alias("up"), F.concat("path", F.coalesce("rest", F.array().cast(f"array<{Step}>"))).alias("path"), F.coalesce("sub", "above").alias("sub"), "height"), keep)
        span *= 2
    return table.select("node", "path", "sub")


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", carry: dict[str, Column] | None = None) -> DataFrame:
    """Per row of docs: id, group, place, leaf, subroot, root, proof (array of left and right siblings), and the columns of carry.

    A leaf is the digest of the record of fields. The leaves of a group ascend by id (nulls
    first; equal ids by leaf); while a group has several nodes, every FANOUT consecutive ones,
    the last run fewer, become the digest of theirs. What remains is the group's subroot, and
    subroots in the order of groups (null first, then bytewise) become the root likewise. A
    proof holds the siblings from the leaf's own run up to the root's; fold() of it and the
    leaf gives the root. A single leaf is subroot and root, with an empty proof.

    Texts do not travel: digests are dealt by ranges of (group, id), which number them without
    sorting a group in one task, and each run becomes one row with its leaves. Runs and the
    nodes above point to their parents with the siblings on that step; self-joins double the
    distance until every row has reached the root, and the runs' leaves take over their path.
    So the jumps move an eighth of the leaves' number of rows.

    Null fields count as `-`, an empty text as `0:`. Rows that repeat are leaves of their own.
    An empty table gives no rows. Other columns of docs, whatever their names, are not read.
    """
    scratch: list[str] = []
    more = carry or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    payload = F.struct(*[c.alias(name) for name, c in more.items()]) if more else F.lit(None).cast("string")
    hashed = cut(docs.select(tree.alias("tree"), F.col(id_col).alias("id"), F.col(group_col).alias("group"), digest(record([F.col(f) for f in fields])).alias("digest"), payload.alias("payload")), scratch)
    rows, sizes = placed(hashed, ["tree"], ["id", "digest"], scratch)
    most, trees = sizes.agg(F.coalesce(F.max("n"), F.lit(1)), F.count(F.lit(1))).first()
    kid = F.struct("place", "digest", "id", "group", "payload")
    runs = rows.groupBy("tree", F.floor(F.col("place") / FANOUT).cast("long").alias("place"), "n").agg(F.array_sort(F.collect_list(kid)).alias("kids"))
    # a lone leaf is no run: its digest goes on as it is
    alone = F.col("n") == 1
    runs = runs.select(
        "tree", "place", F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), alone.alias("alone"), _name(F.col("tree"), 1, F.col("place")).alias("node"),
        F.when(alone, F.col("kids")[0]["digest"]).otherwise(digest(_between(F.col("kids"), 1, F.size("kids")))).alias("digest"), F.lit(0).alias("height"), "kids",
    )
    runs = cut(runs, scratch)
    steps, subroots = _grow(runs.drop("kids", "alone"), -(-most // FANOUT), scratch)
    tops = placed(subroots.select("tree", "node", "digest", "height").withColumn("all", F.lit(0)), ["all"], ["tree"], scratch)[0]
    over, roots = _grow(tops.select(F.lit("^").alias("tree"), "place", "n", "node", "digest", "height"), trees, scratch)
    root = cut(roots.select(F.col("digest").alias("root")), scratch)
    levels = [*steps, *over]
    kids = runs.select("tree", "node", "alone", F.when(F.col("n") == 1, F.col("digest")).alias("own_sub"), "kids")
    if levels:
        kids = kids.join(_paths(reduce(DataFrame.unionByName, levels), len(levels), scratch), "node", "left")
    else:
        kids = kids.withColumns({"path": F.lit(None).cast(f"array<{Step}>"), "sub": F.lit(None).cast("string")})
    leaf = kids.select("tree", "alone", "kids", "path", F.coalesce("own_sub", "sub").alias("subroot"), F.posexplode("kids").alias("at", "kid")).join(F.broadcast(root))
    none = F.array().cast(f"array<{Step}>")
    own = F.when(F.col("alone"), none).otherwise(F.array(_step(F.col("kids"), F.col("at"))))
    return leaf.select(
        F.col("kid.id").alias(id_col), F.col("kid.group").alias("group"), F.col("kid.place").alias("place"), F.col("kid.digest").alias("leaf"), "subroot", "root",
        F.concat(own, F.coalesce("path", none)).alias("proof"), *[F.col(f"kid.payload.{name}").alias(name) for name in more],
    )


def audit(docs: DataFrame, altered: dict[str, Column], when: Column, fields: list[str], id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """manifest(), and folded_root and verified: the root that each proof gives if the fields in altered are changed where `when` holds.

    verified says whether it still is the root. Nothing is altered where `when` is null.
    """
    changed = digest(record([altered.get(f, F.col(f)) for f in fields]))
    rows = manifest(docs, fields, id_col, group_col, {"altered_leaf": F.when(when, changed)})
    folded = fold(F.coalesce("altered_leaf", "leaf"), F.col("proof"))
    return rows.withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root")).drop("altered_leaf")
