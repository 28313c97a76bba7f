"""Nulls, empty and very long texts, ties, repeated rows and empty tables, for every corpus operator."""

from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from stormglass.llm import bpe, classifier, exact_dedup, fingerprints, licenses, lm, merkle, mixing, near_dedup, sharding, substring_dedup, token_counts, words  # noqa: E402
from test_llm import brute_components, table  # noqa: E402

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def marks(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(1, 12)], "doc_id long, quality int")


#: Operators that return one row a document.
ROWWISE = {
    "quality": lambda d: classifier.score_quality(d, marks(d.sparkSession)),
    "near_dedup": lambda d: near_dedup.near_components(d, 85),
    "bpe": lambda d: bpe.encode_documents(d, BYTES, ids=False),
    "exact_dedup": exact_dedup.exact_groups,
    "substring_dedup": substring_dedup.remove_repeats,
    "lm": lm.score_documents,
    "licenses": licenses.scan,
    "merkle": lambda d: merkle.manifest(d, ["doc_id", "source", "text"]),
    "mixing": lambda d: mixing.mix_copies(d).withColumn("doc_id", F.col("id")).withColumn("each", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("each"),
    "sharding": lambda d: sharding.assign_shards(d, 1000),
    "token_counts": lambda d: token_counts.count_tokens(d, PIECES, 100),
    "fingerprints": fingerprints.compare_with_next,
}
#: Operators that return rows of their input.
KEEPING = {
    "keep_good": lambda d: classifier.keep_good(d, marks(d.sparkSession)),
    "keep_one": near_dedup.keep_one,
    "drop_exact": exact_dedup.drop_exact,
    "mixed_documents": mixing.mixed_documents,
}
ODD = [
    (None, "no id here at all, but a text", "a"), (None, None, None), (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "same words in each of these rows", "b"),
    (4, "same words in each of these rows", "b"), (5, "same words in each of these rows", "c"), (6, "same id with one text", "a"), (6, "same id with quite another text", "a"), (7, "x", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).repartition(3).cache()


@pytest.mark.parametrize("name", [*ROWWISE, *KEEPING])
def test_empty_tables(spark, name):
    empty = table(spark, ODD).limit(0)
    out = (ROWWISE | KEEPING)[name](empty)
    assert out.count() == 0
    assert name not in KEEPING or out.columns == empty.columns


@pytest.mark.parametrize("name", ROWWISE)
def test_null_ids_and_repeated_rows(odd, name):
    rows = ROWWISE[name](odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d) for d, _, _ in ODD)
    twice = [r for r in rows if r["doc_id"] == 4]
    own = [c for c in twice[0].asDict() if c not in ("kept", "copies", "place", "proof", "near_next", "edited_sha256", "edited_fingerprint", "near_edited")]
    assert len(twice) == 2 and all(twice[0][c] == twice[1][c] for c in own)


def test_meaning_of_odd_rows(odd):
    near = near_dedup.near_components(odd, 85).collect()
    assert {r["component_id"] for r in near if r["doc_id"] in (4, 5)} == {4}
    assert all(r["component_id"] is None for r in near if r["doc_id"] is None)
    assert {r["component_id"] for r in near if r["doc_id"] in (1, 2, 3)} == {1, 2, 3}
    kept = [r["doc_id"] for r in near_dedup.keep_one(odd).collect()]
    assert kept.count(None) == 2 and kept.count(4) == 2 and 5 not in kept
    assert sum(r["n"] for r in mixing.mix_copies(odd).select("id", "source", "size", "n").distinct().collect()) == len(ODD)


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(9)
    many = " ".join(f"w{rng.randrange(5000)}" for _ in range(1_000_000))
    return table(spark, [(1, many, "a"), (2, many + " end", "a"), (3, "x" * 1_000_000, "b"), (4, "日" * 300_000, "b"), (5, "short one", "a")]).repartition(2).cache()


@pytest.mark.parametrize("name", KEEPING)
def test_very_long_texts_stay_whole(long, name):
    size = {r["doc_id"]: len(r["text"]) for r in long.collect()}
    rows = KEEPING[name](long).collect()
    assert rows and all(len(r["text"]) == size[r["doc_id"]] for r in rows)
    assert name != "drop_exact" or len(rows) == 5


@pytest.mark.parametrize("name", ROWWISE)
def test_very_long_texts(long, name):
    rows = {r["doc_id"]: r for r in ROWWISE[name](long).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    if name == "near_dedup":
        assert [rows[k]["component_id"] for k in range(1, 6)] == [1, 1, 3, 4, 5] and rows[3]["n_shingles"] == 1
    if name == "substring_dedup":
        assert rows[1]["n_removed"] == 1_000_000 and rows[2]["n_removed"] == 1_000_000 and rows[3]["n_removed"] == 0


def test_portions_are_bounded():
    """Neither a million empty texts nor texts without spaces pile up in a task."""
    empty = pa.record_batch([pa.array([b""] * 100_000, pa.binary())], ["text"])
    sizes = [t.num_rows for t, _ in words.gathered(iter([empty] * 10))]
    assert sum(sizes) == 1_000_000 and max(sizes) <= words.TOGETHER_ROWS
    solid = pa.record_batch([pa.array(["日本".encode() * 50_000] * 40, pa.binary())], ["text"])
    sizes = [t.num_rows for t, _ in words.gathered(iter([solid] * 3))]
    assert sum(sizes) == 120 and max(sizes) <= 1 + words.TOGETHER_BYTES // 300_000


def test_stores_of_the_encoder_are_bounded_in_bytes():
    """Words of thousands of letters, alone and glued by punctuation, leave nothing behind."""
    rng = random.Random(2)
    encoder = bpe.ByteBPE(BYTES)
    long = ["".join(rng.choices("abcdefgh", k=3000)) for _ in range(60)]
    encoder.encode([" ".join(long), "  ".join(long), " ".join(f"x{w}-{w}" for w in long), "short words stay"])
    for store in (encoder.words, encoder.pieces):
        assert store and max(map(len, store)) <= bpe.LONG


def test_drop_exact_takes_any_type_and_name(spark):
    rows = [(2, "a", {"k": 1}, "x"), (1, "a", {"k": 2}, "y"), (1, "a", {"k": 3}, "y"), (None, "a", None, "z"), (None, None, {}, None), (None, "", None, "w"), (3, "b", {"k": 4}, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_was_null_ map<string,int>, row string")
    got = exact_dedup.drop_exact(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    kept = {(r["doc_id"], r["text"], str(r["text_was_null_"])) for r in got.collect()}
    assert {(d, t or "") for d, t, _ in kept} == {(1, "a"), (None, ""), (3, "b")}
    assert (3, "b", "{'k': 4}") in kept and kept <= {(d, t, str(m)) for d, t, m, _ in rows}
    again = {(r["doc_id"], r["text"], str(r["text_was_null_"])) for r in exact_dedup.drop_exact(docs.orderBy(F.rand(3)).repartition(5)).collect()}
    assert again == kept
    assert {r["doc_id"] for r in exact_dedup.drop_exact(docs, keep="max").collect()} == {2, None, 3}


def test_words_are_those_of_split():
    rng = random.Random(1)
    for lower in (False, True):
        for _ in range(300):
            texts = ["".join(rng.choices("abCé \t\n\x0b\x1c日 ", k=rng.randrange(60))).encode() for _ in range(rng.randrange(4))]
            got, want = words.words_of(texts, lower), [(t.lower() if lower else t).split() for t in texts]
            flat = [x for w in want for x in w]
            assert got.n.tolist() == [len(w) for w in want] and [got.at(k) for k in range(len(got.starts))] == flat
            known: dict[bytes, int] = {}
            assert all(known.setdefault(x, h) == h for x, h in zip(flat, got.hashes.tolist(), strict=True)) and len(set(known.values())) == len(known)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_near_dedup_equals_all_pairs_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    texts = [tuple(r) for r in docs.collect()]
    for percent in (80, 85):
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(docs, percent).collect()}
        assert got == brute_components(texts, percent)[1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_quality_beats_chance_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.score_quality(docs, labels).where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.8


def test_near_copies_of_a_spread_group(spark, monkeypatch):
    """Copies with few to many edits, as many as make large nodes: components equal those of all pairs."""
    monkeypatch.setattr(near_dedup, "SMALL", 30)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(150)]
    texts = []
    for k in range(120):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(0, 9)):
            copy[at] = f"c{k}_{at}"
        texts.append((k, " ".join(copy), "a"))
    texts += [(500 + k, " ".join(f"s{(k // 3) * 5 + j}" for j in range(100)), "a") for k in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(table(spark, texts), 85).collect()}
    assert got == brute_components(texts, 85)[1]


def spread_pairs(rng, pairs, words=400, apart=8, own=6):
    """Pairs of documents near the threshold, all of them edited copies of one template."""
    base, texts = [f"b{k}" for k in range(words)], []
    for k in range(pairs):
        one = list(base)
        for at in rng.sample(range(0, words, 8), apart):
            one[at] = f"c{k}_{at}"
        other = list(one)
        for at in rng.sample(range(4, words, 8), own):
            other[at] = f"d{k}_{at}"
        texts += [(2 * k, " ".join(one), "a"), (2 * k + 1, " ".join(other), "a")]
    return texts


def test_deep_trees_end_and_find_the_pairs_of_a_template(spark, monkeypatch):
    """400 documents at 0.68 to each other hold 200 pairs at 0.86: every node of more than 16 branches, 12 levels deep."""
    monkeypatch.setattr(near_dedup, "SMALL", 16)
    texts = spread_pairs(random.Random(7), 200)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(table(spark, texts), 85).collect()}
    want = brute_components(texts, 85)[1]
    linked = [k for k in range(200) if want[2 * k] == want[2 * k + 1]]
    assert len(linked) > 190 and sum(got[2 * k] == got[2 * k + 1] for k in linked) >= 0.99 * len(linked)
    assert all(want[d] == want[c] for d, c in got.items())


def test_nodes_that_do_not_fall_apart_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 10)
    monkeypatch.setattr(near_dedup, "LEVELS", 1)
    monkeypatch.setattr(near_dedup, "TOGETHER_SHINGLES", 3000)
    texts = spread_pairs(random.Random(8), 40, apart=5, own=5)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(table(spark, texts), 85).collect()}
    assert got == brute_components(texts, 85)[1]


def test_paths_never_choose_a_token_twice(spark):
    rows = spark.range(50).select(F.col("id").alias("node"), (F.col("id") % 10).cast("int").alias("tree")).cache()
    seen: dict[int, list[int]] = {}
    for depth in range(1, near_dedup.LEVELS + 1):
        for r in rows.select("tree", F.explode(near_dedup._choices(depth, 85)).alias("at")).distinct().collect():
            assert near_dedup.TREES <= r["at"] < near_dedup.TOKENS
            seen.setdefault(r["tree"], []).append((depth, r["at"]))
    for own in seen.values():
        assert len({at for _, at in own}) == len(own)
    many = spark.range(20000).select(F.col("id").alias("node"), F.lit(3).alias("tree"))
    assert abs(many.agg(F.avg(F.size(near_dedup._choices(2, 85)))).first()[0] - 100 / 85) < 0.02


def test_crossing_links_join_what_full_sets_join():
    rng = np.random.default_rng(3)
    for _ in range(20):
        base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(60) < 0.95], rng.integers(0, 1 << 60, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(30)]
        label = rng.integers(0, 12, 30)
        links = near_dedup.crossing_links(label, sets, 85)
        between = ~np.eye(30, dtype=bool)
        assert (near_dedup.common_shingles(sets) == np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets]))[between].all()
        pairs = [(i, j) for i in range(30) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]

        def joined(extra, label=label):
            own = label.copy()
            for i, j in extra:
                own[own == own[i]] = own[j]
            return [[own[i] == own[j] for j in range(30)] for i in range(30)]

        assert joined(links) == joined(pairs) and len(links) < 12
        assert all((max(p), min(p)) in pairs for p in links)
