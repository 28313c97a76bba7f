"""The Merkle manifest against trees built in memory."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from stormglass.llm import common, merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place string, tree int, root double"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def rec(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(digests):
    """(root, siblings on both sides, step by step, of every leaf)."""
    proofs, own, level = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(level) > 1:
        above, members = [], []
        for a in range(0, len(level), 8):
            run = level[a : a + 8]
            for j in range(len(run)):
                for i in own[a + j]:
                    proofs[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(H("".join(run)))
            members.append(sum(own[a : a + 8], []))
        level, own = above, members
    return level[0], proofs


def brute(rows):
    by, trees, out = {}, [], []
    for r in rows:
        by.setdefault(r[2], []).append(r)
    for lang in sorted(by, key=lambda x: (x is not None, (x or "").encode())):
        mine = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, H(rec(r))))
        trees.append((mine, *tree([H(rec(r)) for r in mine])))
    root, over = tree([t[1] for t in trees])
    for (mine, sub, proofs), rest in zip(trees, over, strict=True):
        for r, proof in zip(mine, proofs, strict=True):
            steps, leaf = proof + rest, H(rec(r))
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            folded = H(rec((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))) if changed else leaf
            for a, b in steps:
                folded = H(a + folded + b)
            out.append((r[0], leaf, sub, root, H("".join(a + b for a, b in steps)), folded, folded == root))
    return out


def audited(docs):
    key = F.col("doc_id").cast("string").cast("binary")
    found = merkle.audit(docs, {"text": common.lower_ascii(F.col("text"))}, F.crc32(key) % 3 == 0, FIELDS)
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), "folded_root", "verified")


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], SCHEMA).repartition(4)


def odd(n):
    rows = [(k, f"s{k % 3}" if k % 5 else None, ["en", "de", None, ""][k % 7 % 4], k if k % 4 else None, f"Text ÄÉ {k} Big" if k % 6 else None) for k in range(n)]
    return rows + [(None, None, None, None, None)] * 2 + [(5, "a", "en", 1, "TWICE"), (5, "a", "en", 1, "TWICE"), (6, "", "fr", 0, "")]


@pytest.mark.parametrize("n", [0, 7, 150, 1200])
def test_manifest_equals_trees_in_memory(spark, n):
    rows = odd(n)
    got = [tuple(r) for r in audited(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_every_group_of_one_document_and_copies_at_hot_ancestors(spark, monkeypatch):
    """As many groups as documents: the tree of subroots is the deep one, and ancestors are repeated."""
    monkeypatch.setattr(merkle, "TOGETHER", 4)
    rows = [(k, "s", f"lang{k}", 1, f"Text {k}") for k in range(200)] + [(k, "s", "en", 1, "x" * k) for k in range(600)]
    got = [tuple(r) for r in audited(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_one_document_none_and_very_long_texts(spark):
    one = [(3, "s", "en", 2, "A" * 1_000_000)]
    assert [tuple(r) for r in audited(documents(spark, one)).collect()] == brute(one)
    assert audited(documents(spark, one).limit(0)).count() == 0


def test_proofs_are_rows_of_the_manifest(spark):
    rows = merkle.manifest(documents(spark, odd(100)), FIELDS, carry={"copy": F.col("text")})
    assert rows.columns == ["doc_id", "group", "place", "leaf", "subroot", "root", "proof", "copy"]
    assert rows.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert rows.groupBy("group", "place").count().where("count > 1").count() == 0
