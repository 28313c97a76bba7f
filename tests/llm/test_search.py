"""Ranked search against scores of all pairs, in memory."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stormglass.llm import search

DOCS = "doc_id long, text string, item int, score string, id double, items string"
QUERIES = "item_id long, text string, doc_id long, rank string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    own = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n, total = sum(x[2] > 0 for x in own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, size in own:
            m = 100 - 75 + 75 * size * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(*r, 1, "x", 2.0, "y") for r in docs], DOCS).repartition(4),
        spark.createDataFrame([(*r, 7, "z") for r in items], QUERIES),
    )


def corpus(seed, n=400):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 3000}"
    docs = [(k, " ".join(word() for _ in range(rng.choice([3, 30, 200])))) for k in range(n)]
    passage = " ".join(word() for _ in range(30))
    docs += [(1000 + k, f"{docs[k][1]}. {passage}" if k % 2 else passage) for k in range(60)]
    docs += [(None, passage), (None, "w1 W1"), (7, passage), (7, passage), (2000, None), (2001, ""), (2002, " .,\n"), (2003, "Éa éA é"), (2004, "rare " * 5000)]
    items = [(0, passage), (1, "w1"), (2, ""), (3, None), (4, "absent words only"), (5, "rare"), (6, "é W1 w1, w1!"), (7, "w2 rare"), (None, "w3 w4 w5"), (8, passage), (8, "w9 w9 w8")]
    items += [(10 + k, docs[k][1]) for k in range(20)]
    return docs, items


def test_search_equals_all_pairs(spark):
    docs, items = corpus(1)
    got = search.rank_documents(*tables(spark, docs, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_small_blocks_groups_of_items_and_a_shuffle(spark, monkeypatch):
    """Whatever is bounded comes in several portions: blocks, counts, items, cells; documents meet their pairs in a shuffle."""
    for name, value in (("BLOCK_BITS", 1 << 12), ("COUNTED_TERMS", 500), ("TOGETHER_ITEMS", 7), ("CELLS", 2000), ("BROADCAST_PAIRS", 0)):
        monkeypatch.setattr(search, name, value)
    docs, items = corpus(2, 150)
    got = search.rank_documents(*tables(spark, docs, items), k=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 3)


@pytest.mark.parametrize("which", ["docs", "items", "words"])
def test_empty_tables(spark, which):
    docs, items = tables(spark, [(1, "a b"), (2, None)] if which != "words" else [(1, "."), (2, None)], [(1, "a")])
    docs, items = (docs.limit(0) if which == "docs" else docs), (items.limit(0) if which == "items" else items)
    assert search.rank_documents(docs, items).collect() == []


def test_bounds_are_never_below_scores(spark):
    docs, items = corpus(3)
    index = search.build_index(tables(spark, docs, items)[0])
    own = search.prepared(index, [t or "" for _, t in items])
    rows = {(block["ids"][begin + r], k): int(out[k, r]) for block in index.where("slices is not null").collect() for begin, out in search.bounds(block["slices"], block["log"], block["n"], own) for k in range(len(items)) for r in range(out.shape[1])}
    close = []
    for d, t in docs:
        c, m = Counter(search.terms_of(t or "")), search.length_part(len(terms(t)), own.documents, own.total)
        for k in range(len(items)):
            if c and d is not None and d != 7:
                score = sum(w * search.occurrence_part(c[x], m) for x, w in own.words[k].items() if x in c)
                assert rows[str(d), k] >= score
                close.append(score / max(rows[str(d), k], 1))
    assert np.mean([x for x in close if x]) > 0.9


def test_a_saved_index_answers_other_items(spark):
    docs, items = corpus(4, 100)
    table, queries = tables(spark, docs, items)
    index = search.build_index(table)
    for some in (items[:4], items[12:15]):
        got = search.search(index, table, tables(spark, docs, some)[1])
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, some)


def test_very_long_texts(spark):
    rng = random.Random(6)
    docs = [(1, " ".join(f"t{rng.randrange(400_000)}" for _ in range(1_000_000))), (2, "x" * 1_000_000), (3, "t5 t6"), (4, "日" * 300_000)]
    items = [(1, "t5 t6 t7"), (2, "x" * 1_000_000)]
    assert sorted(map(tuple, search.rank_documents(*tables(spark, docs, items)).collect()), key=str) == brute(docs, items)
