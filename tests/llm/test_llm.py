"""Corpus operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from stormglass.llm import bpe, classifier, common, exact_dedup, fingerprints, lm, mixing, near_dedup, sharding, substring_dedup, token_counts  # noqa: E402

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Columns that clash with names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, id string, size string, keep_id double"


def words(rng, n, of=60):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def table(spark, texts):
    """Rows (doc_id, text, source) with clashing extra columns."""
    return spark.createDataFrame([(d, t, None, s, len(t or ""), 7, "x", "y", 1.5) for d, t, s in texts], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    passage = words(rng, 60, 1000)
    base = words(rng, 120, 1000)
    out = [(0, "", "a"), (1, None, None), (2, "one two", "b"), (3, "One TWO", "b"), (4, "a" * 3000, "c"), (5, " \t\n ", "a")]
    out += [(10 + k, base if k < 4 else base.replace(" w1", f" x{k} w1", 1), "a") for k in range(8)]
    out += [(30 + k, f"{words(rng, 20, 1000)} {passage} {words(rng, 10 + k, 1000)}", "a" if k % 3 else "é") for k in range(12)]
    out += [(60 + k, words(rng, rng.randrange(1, 200)), rng.choice(["a", "b", "c", None])) for k in range(40)]
    out += [(200, "déjà vu — naïve <|endoftext|> 日本語 𐍈  x", "b"), (201, "the " * 400, "b"), (202, "don't I'LL 123abc\n\n  x\t", "c")]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, texts).repartition(4).cache()


def split(text, lower=True):
    b = (text or "").encode()
    return (b.lower() if lower else b).split()


def test_exact_groups(spark, docs, texts):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs, keep="max").collect()}
    groups = defaultdict(list)
    for d, t, _ in texts:
        groups[t or ""].append(d)
    for d, t, _ in texts:
        r, same = got[d], groups[t or ""]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(same), len(same), d == max(same))
        assert r["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    twice = exact_dedup.exact_groups(docs.unionByName(docs)).where("doc_id = 2").collect()
    assert len(twice) == 2 and sum(r["kept"] for r in twice) == 1
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_drop_exact_keeps_rows_whole(docs, texts):
    got = exact_dedup.drop_exact(docs)
    assert got.columns == docs.columns
    first = {}
    for d, t, _ in sorted(texts, key=lambda r: r[0]):
        first.setdefault(t or "", (d, t))
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == set(first.values())


def brute_components(texts, percent):
    sets = {}
    for d, t, _ in texts:
        w = split(t)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return sets, {d: root(d) for d in sets}


def test_near_components(docs, texts):
    sets, want = brute_components(texts, 85)
    got = {r["doc_id"]: r for r in near_dedup.near_components(docs, 85).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(got[d]["n_shingles"] == len(s) for d, s in sets.items())


def test_large_nodes_lose_no_link(spark, monkeypatch):
    """A star of copies that are like their source and less like each other, beside a chain and strangers."""
    monkeypatch.setattr(near_dedup, "SMALL", 16)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(400)]
    texts = [(1000, " ".join(base), "a")]
    for k in range(40):
        copy = list(base)
        for at in rng.sample(range(0, 400, 8), 5):
            copy[at] = f"c{k}_{at}"
        texts.append((k, " ".join(copy), "a"))
    texts += [(500 + k, " ".join(f"s{(k // 2) * 7 + j}" for j in range(300)), "a") for k in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(table(spark, texts), 85).collect()}
    assert got == brute_components(texts, 85)[1]


def test_keep_one_keeps_columns(docs, texts):
    got = near_dedup.keep_one(docs, 80)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == set(brute_components(texts, 80)[1].values())


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_bpe_equals_the_library(docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    for r in bpe.encode_documents(docs, BYTES).collect():
        text = dict((d, t) for d, t, _ in texts)[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False) == text
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_bpe_on_random_characters():
    from tokenizers import Tokenizer

    library, mine, rng = Tokenizer.from_file(BYTES), bpe.byte_bpe(BYTES), random.Random(1)
    alphabet = [chr(c) for c in [*range(0x250), 0x2009, 0x2028, 0x3000, 0x4E00, 0xAC00, 0x1F600, 0x301]]
    some = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(400)] + ["x" * 5000, "ab" * 700]
    for text, ids in zip(some, mine.encode(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_on_glued_and_doubled_white_space():
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(BYTES), random.Random(2)
    some = ["x\u00a0y\u00a0z \u00a0 \u00a0 b", "a\tb  c", "a\x1cb  c", "a\n b\tc", " a\u00a0b", "a b\nc d", "a ", ""]
    some += ["".join(rng.choices("ab1.' \n\t\u00a0\u3000", k=rng.randrange(30))) for _ in range(2000)]
    for text, ids in zip(some, bpe.byte_bpe(BYTES).encode(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_counts_equal_the_library(docs, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    of = {d: t or "" for d, t, _ in texts}
    for r in token_counts.count_tokens(docs, PIECES, 100).collect():
        n = len(library.encode(of[r["doc_id"]]))
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 100, len(of[r["doc_id"]].encode()))
    mine = token_counts.piece_counts(PIECES)
    for n in range(70):
        for tail in ("", "a", "ﬁ", "▁b"):
            assert mine.count(" " * n + tail) == len(library.encode(" " * n + tail))
    word = "internationalization"
    assert mine.prefix_counts(word)[1:] == [len(library.encode(word[: k + 1])) for k in range(len(word))]
    rng = random.Random(8)
    some = ["some words that go on and on", "  two  marks", "日本語 の x", "", "a" * 700] + ["".join(rng.choices("ab ▁éte.", k=30)) for _ in range(60)]
    for text in some:
        counts = [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        for limit in {0, 1, 3, counts[-1] // 2, counts[-1]}:
            want = max(k for k, c in enumerate(counts) if c <= limit)
            assert mine.truncate(text, limit) == text[:want], (text, limit)


def brute_repeats(texts, length):
    docs = [(d, split(t, False)) for d, t, _ in texts]
    seen = Counter(tuple(w[i : i + length]) for _, w in docs for i in range(len(w) - length + 1))
    out = {}
    for d, w in docs:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("length,period", [(35, 21), (25, 13), (9, 7)])
def test_repeats(docs, texts, length, period):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs, length, period).collect()}
    assert got == brute_repeats(texts, length)


def test_difference_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_repeats_of_repeated_rows(spark, docs):
    rows = docs.where("doc_id = 60 or doc_id = 10")
    got = substring_dedup.remove_repeats(rows.unionByName(rows)).where("doc_id = 10").collect()
    assert len(got) == 2 and all(r["n_removed"] == r["n_words"] for r in got)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(docs, texts):
    rows = mixing.mix_copies(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in texts:
        sizes[s] += len(split(t))
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s, words_ in taken.items():
        assert abs(words_ - want[s]) <= max(20, 0.05 * want[s])
    again = {(r["id"], r["copies"]) for r in mixing.mix_copies(docs.repartition(7)).collect()}
    assert again == {(r["id"], r["copies"]) for r in rows}
    assert mixing.mix_copies(docs.limit(0)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] * r["n"] for r in rows)


def test_tilt_is_the_capped_exponential(docs):
    for r in mixing.mix_copies(docs).where("size > 0").groupBy("source").agg(F.sum(F.col("rate") * F.col("size") * F.col("n")).alias("mixed"), F.first("target").alias("target")).collect():
        assert r["mixed"] == pytest.approx(r["target"], rel=1e-6)


@pytest.mark.parametrize("limit", [200, 2000, 10**9])
def test_shards_fit(docs, texts, limit):
    rows = sharding.assign_shards(docs, limit).collect()
    assert len(rows) == len(texts)
    load = defaultdict(int)
    for r in rows:
        load[r["depth"], r["bucket"], r["page"]] += r["n_bytes"]
        assert len(r["bucket"]) == r["depth"]
    for r in rows:
        assert load[r["depth"], r["bucket"], r["page"]] == r["shard_bytes"]
        assert r["shard_bytes"] <= limit or (r["oversized"] and r["shard_bytes"] == r["n_bytes"])
    names = {r["bucket"] for r in rows}
    assert not any(a != b and b.startswith(a) for a in names for b in names if a or len(names) > 1)


def test_shards_of_one_id(spark):
    rows = table(spark, [(1, "x" * 50, "a")] * 30)
    got = sharding.assign_shards(rows, 200).collect()
    assert len(got) == 30 and max(Counter(r["page"] for r in got).values()) == 4


def test_written_shards_keep_their_limit(spark, tmp_path):
    rows = [(1, "x" * 50, "a")] * 30 + [(None, "y" * 20, "b")] * 3 + [(2, None, "c"), (3, "z" * 500, "c")]
    docs_ = table(spark, rows).withColumn("shard", F.lit("s")).withColumn("n_bytes", F.lit(3))
    sharding.write_shards(docs_, str(tmp_path / "shards"), 200)
    got = spark.read.parquet(str(tmp_path / "shards"))
    assert got.count() == len(rows) and got.select("row.*").columns == docs_.columns
    sizes = got.groupBy("shard").agg(F.sum(F.length("row.text")).alias("n"), F.count("*").alias("k")).collect()
    assert all((r["n"] or 0) <= 200 or r["k"] == 1 for r in sizes)


def test_names_that_clash(spark):
    names = ["id_", "source_", "size_", "copies_", "copy_", "gone_", "key", "row", "id", "size", "copies", "own_id"]
    docs_ = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, None, None)], "doc_id long, text string, source string")
    docs_ = docs_.withColumns({n: F.lit(k) for k, n in enumerate(names)})
    for out in (mixing.mixed_documents(docs_), near_dedup.keep_one(docs_), exact_dedup.drop_exact(docs_)):
        assert out.columns == docs_.columns
        assert all(r["copy_"] == 4 and r["own_id"] == 11 for r in out.collect())


def brute_winnow(text, gram, window):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = [int(fingerprints.gram_hashes(points[i : i + gram], gram)[0]) for i in range(max(1, len(points) - gram + 1))] if text else []
    out = []
    for i in range(max(1, len(h) - window + 1)) if h else []:
        part = h[i : i + window]
        at = i + max(k for k, x in enumerate(part) if x == min(part))
        if not out or out[-1] != at:
            out.append(at)
    return [h[k] for k in out], out


def test_winnowing(spark, docs, texts):
    for text in ("", "a", "short", "abc" * 50, "".join(random.Random(2).choices("abcdé日", k=300))):
        hashes, positions = fingerprints.winnow(text, 7, 5)
        assert (hashes.tolist(), positions.tolist()) == brute_winnow(text, 7, 5)
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs).collect()}
    order = sorted(((d, t or "") for d, t, _ in texts), reverse=True)
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t)
        edited = t[: n - n // 3] + after[: n // 3]
        r = got[d]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple("".join(f"{h:08x}" for h in brute_winnow(x, 16, 32)[0]) if len(x) <= 3000 else fingerprints.as_text(fingerprints.winnow(x)[0]) for x in (t, edited))
        a, b, c = (set(fingerprints.winnow(x)[0].tolist()) for x in (t, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert r["near_edited"] == pytest.approx(like(a, b)) and r["near_next"] == pytest.approx(like(a, c))
    one = table(spark, [(None, "alone text", "a")])
    assert fingerprints.compare_with_next(one).first()["near_next"] == 1.0
    assert fingerprints.compare_with_next(one.limit(0)).count() == 0


def test_lm_base_and_model(docs, texts):
    rows = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    tokens = {d: [*split(t), None] for d, t, _ in texts}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in tokens.items():
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0
    trained = [d for d in tokens if not held[d]]
    assert sum(rows[d]["score"] for d in trained) > sum(rows[d]["base_score"] for d in trained)


def test_lm_scores_follow_all_counts(spark, docs, texts):
    tokens = {d: [*split(t), None] for d, t, _ in texts}
    training = [ws for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for ws in training for w in ws)
    pairs = Counter(p for ws in training for p in zip([None, *ws], ws))
    n, v, near = sum(c.values()), len(c), 0
    for r in lm.score_documents(docs).collect():
        want = 0.0
        for a, b in zip([None, *tokens[r["doc_id"]]], tokens[r["doc_id"]]):
            weight = lm.BIGRAM_WEIGHT * c[a] / (c[a] + lm.HALF_COUNT)
            joint = lm.value_of(lm.level_of(np.array([pairs[a, b]])))[0]
            want += math.log10(weight * joint / max(c[a], 1) + (1 - weight) * (c[b] + 1) / (n + v + 1))
        # false positives of the filter can only raise a score
        assert r["score"] > want - 1e-9
        near += r["score"] < want + 0.01 * len(tokens[r["doc_id"]])
    assert near > 0.95 * len(tokens)
    # words that occur once differ from words that never occur
    few = table(spark, [(0, "a b b", "a"), (1, "a once", "a"), (4, "once", "a"), (5, "never", "a")])
    rows = {r["doc_id"]: r for r in lm.score_documents(few, held_mod=(2, 0)).collect()}
    assert [rows[d]["held_out"] for d in (0, 1, 4, 5)] == [False, False, True, True] and rows[4]["score"] > rows[5]["score"]
    assert lm.score_documents(few.limit(0)).count() == 0


def test_filter_grows_with_its_items():
    for size in (10, 1000, 100_000):
        keys, levels = np.arange(size, dtype=np.uint64) * np.uint64(977), np.ones(size, np.int64)
        segment = lm.fill(keys, levels)
        assert len(segment.bits) * 8 >= size * lm.BITS_PER_ITEM and (segment.levels(keys) >= 1).all()


def test_filter_counts_are_floors():
    keys = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    true = np.random.default_rng(2).integers(2, 5000, 3000)
    segment = 1 << 20
    levels = lm.level_of(true)
    flags = np.zeros(segment, bool)
    for level in range(1, levels.max() + 1):
        for probe in range(lm.PROBES):
            flags[lm.LogFrequencyFilter.place(keys[levels >= level], level, probe, segment)] = True
    model = lm.LogFrequencyFilter(np.packbits(flags, bitorder="little"), 1, 1, 10, 10)
    got = model.counts(keys)
    assert np.mean((got <= true) & (got * 2**0.5 > true - 1)) > 0.95
    assert np.mean(model.counts(keys + np.uint64(1)) == 0) > 0.95


def test_quality_learns_and_is_total(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(240):
        good = k % 2
        text = words(rng, 60, 40) if good else " ".join(f"W{rng.randrange(40)}!!" for _ in range(60))
        rows.append((k, text, "a"))
        labels.append((k, good))
    rows += [(900, "", "a"), (901, None, "a")]
    docs_, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in classifier.score_quality(docs_, marks).collect()}
    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] for k in held) and not got[1]["held_out"] == (1 not in held)
    assert np.mean([got[k]["predicted"] == k % 2 for k in held]) > 0.95
    assert 0 <= got[900]["score"] == got[901]["score"] <= 1
    kept = classifier.keep_good(docs_, marks)
    assert kept.columns == docs_.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["predicted"]}
    assert classifier.score_quality(docs_.limit(0), marks).count() == 0
    assert classifier.score_quality(docs_, marks.limit(0)).count() == 242


def test_a_saved_classifier_scores_another_table(spark, docs, tmp_path):
    """A network that was written and read again scores as the one that was fitted, on tables without labels too."""
    labels = spark.createDataFrame([(r["doc_id"], r["doc_id"] % 2) for r in docs.select("doc_id").distinct().collect() if r["doc_id"] is not None], "doc_id long, quality int")
    model = classifier.train(docs, labels)
    classifier.save_model(spark, model, str(tmp_path / "net"))
    again = classifier.load_model(spark, str(tmp_path / "net"))
    want = sorted(map(str, classifier.score_quality(docs, labels).collect()))
    assert sorted(map(str, classifier.score_with(docs, again).collect())) == want
    other = spark.createDataFrame([("x", "an unseen text of plain words"), ("y", None), (None, "")], "name string, body string")
    got = classifier.score_with(other, again, id_col="name", text_col="body")
    assert got.columns == ["name", "held_out", "score", "predicted"] and got.count() == 3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.collect())
    assert classifier.score_with(other.limit(0), again, id_col="name", text_col="body").count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs.select("doc_id", F.when(F.col("doc_id") == 201, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, rows, str(tmp_path)))
        assert out.columns == rows.columns
        rows = out
    near = [r["doc_id"] for r in rows.select("doc_id").distinct().collect()]
    assert not {11, 12, 13} & set(near)
    assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() == rows.count()


@pytest.mark.parametrize("sent", [0, 1 << 26])
def test_a_saved_model_scores_another_table(spark, docs, texts, tmp_path, monkeypatch, sent):
    """The model is what train() wrote; with it alone, other documents get the scores that its counts say, whichever way it reaches them."""
    monkeypatch.setattr(lm, "BROADCAST_BYTES", sent)
    lm.train_model(docs).save(str(tmp_path / "model"))
    model = lm.load_model(spark.read.parquet(str(tmp_path / "model")))
    tokens = {d: [*split(t), None] for d, t, _ in texts}
    training = [ws for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for ws in training for w in ws)
    pairs = Counter(p for ws in training for p in zip([None, *ws], ws, strict=False))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.types) == (n, v)
    other = [(1, "w1 w2 w3 w4", "a"), (2, "never seen words", "b"), (3, None, None), (4, "W5 w5 " * 400, "a")]
    for r in lm.score_with(model, table(spark, other)).collect():
        own, want = [*split(dict((d, t) for d, t, _ in other)[r["doc_id"]]), None], 0.0
        for a, b in zip([None, *own], own, strict=False):
            weight = lm.BIGRAM_WEIGHT * c[a] / (c[a] + lm.HALF_COUNT)
            joint = lm.value_of(lm.level_of(np.array([pairs[a, b]])))[0]
            want += math.log10(weight * joint / max(c[a], 1) + (1 - weight) * (c[b] + 1) / (n + v + 1))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
        assert want - 1e-9 < r["score"] < want + 0.02 * len(own) + 1e-9
    assert lm.score_with(model, table(spark, other).limit(0)).count() == 0


def test_the_model_comes_the_same_way_to_blocks(spark, docs, monkeypatch):
    scores = []
    for sent in (0, 1 << 26):
        monkeypatch.setattr(lm, "BROADCAST_BYTES", sent)
        scores.append(sorted(map(tuple, lm.score_documents(docs).collect())))
    assert scores[0] == scores[1]
