"""License scans against every block and template, in memory."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from stormglass.llm import licenses

SCHEMA = "doc_id long, text string, words string, h int, label double, id string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2.0, "y") for r in rows], SCHEMA).repartition(3)


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, phrases=licenses.PHRASES, templates=licenses.TEMPLATES, percent=licenses.PERCENT):
    w, found, labels, score = words(text), [], set(), 0.0
    for phrase, label in phrases.items():
        own = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(own)] == own]
        found += [(i, label) for i in at]
    for label, template in templates:
        width, own = licenses.width_of(len(template.split())), set(template.split())
        for k in range(max(-(-len(w) // width) - 1, 1)):
            share = len(own & set(w[k * width : (k + 2) * width])) / len(own)
            if share * 100 >= percent:
                labels.add(label)
                score = max(score, share)
    base = {label for _, label in found}
    at = [i for i, _ in found]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if at else score)


def check(spark, rows, **options):
    got = licenses.scan(documents(spark, rows), **options).drop("blocks").collect()
    options = {k: v for k, v in options.items()}
    assert sorted(map(tuple, got), key=str) == sorted(((d, *brute(t, **options)) for d, t in rows), key=str)


def spoiled(rng, template, n):
    own = template.split()
    for at in rng.sample(range(len(own)), min(n, len(own))):
        own[at] = f"z{rng.randrange(99)}"
    return " ".join(own)


def test_scan_equals_every_block(spark):
    rng = random.Random(4)
    common = " ".join(t for _, t in licenses.TEMPLATES).split()
    rows = [(0, None), (1, ""), (2, " \n"), (3, "Under the MIT License! under-the-mit-license"), (3, "Under the MIT License! under-the-mit-license"), (4, "apache license version 2.0"), (5, "CC BY-NC, mit"), (None, "under the mit license")]
    rows += [(6, "éthe under the mit licenseé"), (7, "İ under the mit license K"), (8, "the licensE of mit under")]
    for k in range(120):
        _, template = rng.choice(licenses.TEMPLATES)
        filler = lambda n: " ".join(rng.choice(common) if rng.random() < 0.2 else f"w{rng.randrange(50)}" for _ in range(n))
        rows.append((10 + k, f"{filler(rng.randrange(90))}. {spoiled(rng, template, rng.randrange(6)).upper() if k % 2 else template}\n{filler(rng.randrange(200))}"))
    check(spark, rows)


def test_other_templates_and_shares(spark):
    rng = random.Random(8)
    templates = [("x", "a b c d"), ("x", "b c d e f"), ("y", " ".join(f"w{k}" for k in range(30))), ("z", "w1 w2 w3")]
    rows = [(k, " ".join(rng.choice([*"abcdef", *(f"w{j}" for j in range(30))]) for _ in range(rng.randrange(80)))) for k in range(150)]
    for percent in (60, 100):
        check(spark, rows, templates=templates, phrases={"a b": "p", "b": "q", "a a": "r"}, percent=percent)


def test_very_long_texts_and_empty_tables(spark):
    text = "free of the " * 400_000 + licenses.TEMPLATES[4][1] + " end " * 100_000
    check(spark, [(1, text), (2, "x" * 1_000_000)])
    assert licenses.scan(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_blocks_tell_where(spark):
    text = "word " * 70 + licenses.TEMPLATES[7][1]
    (row,) = licenses.scan(documents(spark, [(1, text)])).collect()
    (block,) = row["blocks"]
    assert (block["label"], block["containment"]) == ("bsd", 1.0) and block["first_word"] <= 70 < block["first_word"] + block["n_block_words"]


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(documents(spark, [(1, "under the mit license")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_global_order_counts_all_documents(spark):
    """The rarest words of a template lead its prefix, whatever rows they come from."""
    kinds = licenses.by_width([("x", "rare often usual")], 100)
    rows = licenses.read(documents(spark, [(k, "often usual" if k % 2 else "usual") for k in range(20)] + [(99, "rare often usual")]), {}, kinds, "doc_id", "text").cache()
    assert [r["template"] for r in licenses.block_matches(rows, kinds).collect()] == [0]
    index = licenses._index(spark, {"rare": 0, "often": 1, "usual": 2}, kinds[16])
    assert [tuple(r) for r in index.select("word", "i", F.array_join("words", " ")).collect()] == [("rare", 0, "rare often usual")]
