"""Exact duplicates: groups by a 128-bit content hash, bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormglass.llm.common import cut, text_or_empty


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are. The 128-bit hash leads the grouping key and the
    text itself follows, so rows whose hashes collide are told apart by their bytes. The
    grouping combines on the map side: of a hot text each task ships one row. The rows then
    fetch their group by (hash, sha256), an equi-join that adaptive execution can split.

    keep: "min" or "max" id of a group stays. Null text counts as empty; a null id is kept
    only where a group has no other. Of rows that repeat id and text one is marked kept. An
    empty table gives no rows; other columns, whatever their names, are not read.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    hashed = rows.withColumn("h", F.unhex(F.md5("text")))
    groups = cut(
        hashed.groupBy("h", "text")
        .agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")
    )
    members = hashed.select("h", F.unhex(F.sha2("text", 256)).alias("sha"), "id").groupBy("h", "sha", "id").agg(F.count(F.lit(1)).alias("copies"))
    return members.join(groups, ["h", "sha"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("is_keep"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    ).select(id_col, "keep_id", "group_size", (F.col("is_keep") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """docs with one whole row for each distinct text, the one with the min or max id.

    Rows are chosen by (id is null, id, hash of the row) alone, and the row is carried beside
    that order through a min_by or max_by that combines on the map side, so columns may have
    any type, maps included, and any name. A null id stays only where a text has no other; of
    rows that repeat id and text, the one whose hash is smallest (or largest) stays, one of
    equal rows. Null text equals empty text; the row that stays keeps its own. Columns and
    their order stay as they are. An empty table gives no rows.
    """
    pick = {"min": F.min_by, "max": F.max_by}[keep]
    names = docs.columns
    kept = [c for c in names if c != text_col]
    # maps have no hash; their JSON has one
    hashed = [F.to_json(F.struct(_named(c).alias("x"))) if "map<" in kind else _named(c) for c, kind in docs.dtypes if c != text_col]
    missing = _named(id_col).isNull()
    tagged = docs.select(
        text_or_empty(f"`{text_col}`").alias("text"),
        F.struct((missing if keep == "min" else ~missing).alias("rank"), _named(id_col).alias("id"), F.xxhash64(*hashed).alias("hash")).alias("order"),
        F.struct(F.struct(*[_named(c).alias(f"c{k}") for k, c in enumerate(kept)]).alias("row"), _named(text_col).isNull().alias("null")).alias("carried"),
    )
    won = tagged.groupBy(F.unhex(F.md5("text")).alias("h"), "text").agg(pick("carried", "order").alias("won"))
    return won.select(*[(F.when(~F.col("won.null"), F.col("text")) if c == text_col else F.col(f"won.row.c{kept.index(c)}")).alias(c) for c in names])


def _named(column: str) -> Column:
    return F.col(f"`{column}`")
