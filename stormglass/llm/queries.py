"""The registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.llm import bpe, classifier, common, exact_dedup, fingerprints, licenses, lm, merkle, mixing, near_dedup, search, sharding, substring_dedup, token_counts

#: Bytes of text that a shard may hold.
SHARD_BYTES = 1 << 20
#: Tokens that a document may have before it counts as over the limit.
TOKEN_LIMIT = 4096


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is installed; every worker has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.score_quality(documents(spark, sf_dir), labels)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_components(documents(spark, sf_dir), percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), ids=False)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="max")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir), length=35)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_copies(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies",
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("row"),
    ).drop("row")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), SHARD_BYTES)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), TOKEN_LIMIT)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, key = F.col("text"), F.col("doc_id").cast("string").cast("binary")
    found = merkle.audit(documents(spark, sf_dir), {"text": common.lower_ascii(text)}, F.crc32(key) % 3 == 0, ["doc_id", "source", "lang", "n_chars", "text"])
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("blocks")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_near_dedup": op2_near_dedup,
    "op3_bpe": op3_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_mixing": op6_mixing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_sharding": op8_sharding,
    "op9_token_counts": op9_token_counts,
    "op10_fingerprints": op10_fingerprints,
    "op11_merkle": op11_merkle,
    "op12_licenses": op12_licenses,
    "op13_search": op13_search,
}

#: The record of a leaf with a text, and the remainder of crc32 of the id in decimal, bit by bit.
_RECORD = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))))"""
_MERKLE = f"""
    WITH RECURSIVE leaves AS (
        SELECT row_number() OVER () AS r, coalesce('=' || lang, '') AS tree, doc_id, sha256({_RECORD.replace("{text}", "text")}) AS leaf,
               CASE WHEN {_CRC} % 3 = 0
                    THEN sha256({_RECORD.replace("{text}", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS altered
        FROM documents
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM leaves
    ), nodes AS (
        SELECT 0 AS level, tree, p, n, leaf AS digest FROM numbered
        UNION ALL
        SELECT level + 1, tree, p // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY p)) FROM nodes WHERE n > 1 GROUP BY level, tree, p // 8, n
    ), subs AS (
        SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1
    ), tops AS (
        SELECT 0 AS level, '^' AS tree, p, n, digest FROM subs
        UNION ALL
        SELECT level + 1, tree, p // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY p)) FROM tops WHERE n > 1 GROUP BY level, tree, p // 8, n
    ), steps AS (
        SELECT tree, level, p, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
               coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM (SELECT level, tree, p, n, digest FROM nodes UNION ALL SELECT * FROM tops) WINDOW run AS (PARTITION BY tree, level, p // 8 ORDER BY p)
    ), climb AS (
        SELECT r AS row, tree, 0 AS level, p, n, coalesce(altered, leaf) AS folded, '' AS proof FROM numbered
        UNION ALL
        SELECT c.row, CASE WHEN c.n > 1 THEN c.tree ELSE '^' END, CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END, CASE WHEN c.n > 1 THEN c.p // 8 ELSE u.p END,
               CASE WHEN c.n > 1 THEN (c.n + 7) // 8 ELSE u.n END, CASE WHEN c.n > 1 THEN sha256(s.l || c.folded || s.r) ELSE c.folded END,
               CASE WHEN c.n > 1 THEN c.proof || s.l || s.r ELSE c.proof END
        FROM climb c LEFT JOIN steps s ON c.n > 1 AND s.tree = c.tree AND s.level = c.level AND s.p = c.p
        LEFT JOIN subs u ON c.n = 1 AND u.tree = c.tree WHERE c.n > 1 OR c.tree <> '^'
    )
    SELECT m.doc_id, m.leaf, s.digest AS subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.digest AS verified
    FROM climb c JOIN numbered m ON c.tree = '^' AND c.n = 1 AND c.row = m.r JOIN subs s ON s.tree = m.tree, (SELECT digest FROM tops WHERE n = 1) t
"""

_TEMPLATE_ROWS = ", ".join(f"('{label}', {licenses.width_of(len(text.split()))}, list_distinct(string_split('{text}', ' ')))" for label, text in licenses.TEMPLATES)
_PHRASE_ROWS = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in licenses.PHRASES.items())
_LICENSES = f"""
    WITH templates AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) t(label, width, own)),
    phrases AS (SELECT * FROM (VALUES {_PHRASE_ROWS}) t(label, own)),
    texts AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
        FROM documents
    ), base AS (
        SELECT r, label, i - 1 AS place
        FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM texts), phrases WHERE words[i] = own[1] AND words[i : i + len(own) - 1] = own
    ), blocks AS (
        SELECT r, width, list_distinct(words[k * width + 1 : (k + 2) * width]) AS held
        FROM (SELECT r, words, width, unnest(range(0, greatest((len(words) + width - 1) // width - 1, 1))) AS k FROM texts, (SELECT DISTINCT width FROM templates))
    ), met AS (
        SELECT r, label, max(len(list_intersect(held, own)) / len(own)) AS share
        FROM blocks JOIN templates USING (width) WHERE 100 * len(list_intersect(held, own)) >= {licenses.PERCENT} * len(own) GROUP BY r, label
    ), of_base AS (
        SELECT r, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r
    ), of_all AS (
        SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION SELECT r, label FROM met) GROUP BY r
    )
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first_word, b.last_word, coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
           CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce((SELECT max(share) FROM met m WHERE m.r = t.r), 0.0)::DOUBLE END AS score
    FROM texts t LEFT JOIN of_base b USING (r) LEFT JOIN of_all a USING (r)
"""

_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SEARCH = f"""
    WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
    facts AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM texts WHERE len(terms) > 0),
    counts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM texts) GROUP BY ALL),
    weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, facts GROUP BY term),
    items AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
    scores AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(terms) * docs) // total))))::BIGINT AS score
        FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN texts USING (r), facts GROUP BY item_id, r, doc_id
    )
    SELECT item_id, row_number() OVER best AS rank, doc_id, score FROM scores WHERE score > 0
    WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 10
"""

ORACLES: dict[str, str] = {
    "op11_merkle": _MERKLE,
    "op12_licenses": _LICENSES,
    "op13_search": _SEARCH,
    "op4_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_sharding": f"""
        WITH keyed AS (
            SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
                   ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
            FROM documents
        ), levels AS (
            SELECT k.*, d.depth, h >> (60 - d.depth)::INTEGER AS prefix
            FROM keyed k, (SELECT unnest(range(0, 41)) AS depth) d
        ), summed AS (
            SELECT *, sum(n_bytes) OVER (PARTITION BY depth, prefix)::BIGINT AS shard_bytes FROM levels
        )
        SELECT doc_id, n_bytes, depth::INTEGER AS depth,
               right(lpad(bin(prefix), 60, '0'), depth::INTEGER) AS bucket, 0::BIGINT AS page, shard_bytes,
               n_bytes > {SHARD_BYTES} AS oversized
        FROM summed WHERE shard_bytes <= {SHARD_BYTES}
        QUALIFY row_number() OVER (PARTITION BY r ORDER BY depth) = 1
    """,
}
