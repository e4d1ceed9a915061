"""One registered query per operator, with production parameters, over its whole tables.

An operator without SQL has no entry in ``llm_oracles``; it is tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    audit,
    decontaminate,
    html,
    license,
    merkle,
    mixing,
    multiset,
    packing,
    pii,
    simhash,
    substring,
    tokens,
    toxicity,
)

#: No source may make up more of the mix than this; the others keep their proportions.
LARGEST_SHARE = 0.25
TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(_table(spark, sf_dir, "documents"), keep_text=False)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.compare_neighbours(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.schedule(docs, mixing.capped_weights(docs, LARGEST_SHARE))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.check_tampered(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_substring_dedup,
        op2_simhash,
        op3_fingerprints,
        op4_toxicity,
        op5_licenses,
        op6_decontaminate,
        op7_token_files,
        op8_mixing,
        op9_main_text,
        op10_personal_data,
        op11_manifest,
        op12_filter_audit,
        op13_packing,
    )
    return {query.__name__: query for query in every}


OP1_SQL = r"""
WITH split_texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM split_texts WHERE len(w) >= 20)
), later AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later
), word_rows AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split_texts
), kept AS (
    SELECT word_rows.doc_id, string_agg(word, ' ' ORDER BY word_rows.p) AS t, count(*) AS n
    FROM word_rows LEFT JOIN covered ON word_rows.doc_id = covered.doc_id AND word_rows.p = covered.p
    WHERE covered.p IS NULL GROUP BY word_rows.doc_id
)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM split_texts s LEFT JOIN kept ON s.doc_id = kept.doc_id
"""

OP6_SQL = r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)
), lengths AS (
    SELECT DISTINCT n FROM item_windows
), doc_windows AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n)
), hits AS (
    SELECT doc_id, i, d.n, item_id FROM doc_windows d JOIN item_windows b ON d.k = b.k AND d.n = b.n
), hit_words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items t ON d.doc_id = t.doc_id
"""

OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS entry
    FROM (SELECT unnest(range(256)) AS i)
), tampered AS (
    SELECT doc_id, source, lang, n_chars, text,
           coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                    lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, entry[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 0, false) AS hit
    FROM documents, crc_table
), fields AS (
    SELECT doc_id, source AS tree, text, hit, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
           || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
    FROM tampered
), hashed AS (
    SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           CASE WHEN hit THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS changed
    FROM fields
), leaves AS (
    SELECT doc_id, tree, leaf, coalesce(changed, leaf) AS found,
           row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
           count(*) OVER (PARTITION BY tree) AS n
    FROM hashed
), nodes AS (
    SELECT tree, 0 AS depth, place, n, leaf AS h FROM leaves
    UNION ALL
    SELECT tree, depth + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place))
    FROM nodes WHERE n > 1 GROUP BY tree, depth, place // 16, n
), subroots AS (
    SELECT tree, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), crown AS (
    SELECT 0 AS depth, place, n, h FROM subroots
    UNION ALL
    SELECT depth + 1, place // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY place)) FROM crown WHERE n > 1 GROUP BY depth, place // 16, n
), around AS (
    SELECT tree, depth, place,
           coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
           coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY tree, depth, place // 16 ORDER BY place)
), crown_around AS (
    SELECT depth, place,
           coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
           coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM crown WHERE n > 1 WINDOW w AS (PARTITION BY depth, place // 16 ORDER BY place)
), climb AS (
    SELECT doc_id, tree, leaf, 0 AS depth, place, n, found AS h, '' AS proof FROM leaves
    UNION ALL
    SELECT doc_id, c.tree, leaf, c.depth + 1, c.place // 16, (n + 15) // 16, sha256(before || h || after), proof || before || after
    FROM climb c JOIN around a ON a.tree IS NOT DISTINCT FROM c.tree AND a.depth = c.depth AND a.place = c.place WHERE n > 1
), crown_climb AS (
    SELECT doc_id, leaf, s.h AS subroot, 0 AS depth, s.place, s.n, c.h, proof
    FROM climb c JOIN subroots s ON s.tree IS NOT DISTINCT FROM c.tree WHERE c.n = 1
    UNION ALL
    SELECT doc_id, leaf, subroot, c.depth + 1, c.place // 16, (n + 15) // 16, sha256(before || h || after), proof || before || after
    FROM crown_climb c JOIN crown_around a ON a.depth = c.depth AND a.place = c.place WHERE n > 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, c.h AS folded_root, c.h = root AS verified
FROM crown_climb c, (SELECT h AS root FROM crown WHERE n = 1) WHERE c.n = 1
"""

OP12_SQL = r"""
WITH marks AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           min(coalesce(doc_id, -9223372036854775808)) OVER (PARTITION BY coalesce(text, '')) AS first
    FROM documents
), failed AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           CASE WHEN len(w) < 100 THEN 1 ELSE 0 END AS a,
           CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 1 ELSE 0 END AS b,
           CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 1 ELSE 0 END AS c,
           CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
           CASE WHEN coalesce(texts.doc_id, -9223372036854775808) > first THEN 1 ELSE 0 END AS e
    FROM texts LEFT JOIN marks ON texts.doc_id = marks.doc_id
), sets AS (
    SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT p.f || q.f || r.f || s.f || u.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
    FROM letters p, letters q, letters r, letters s, letters u
    WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, u.bit])) = 5
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before
    FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM orders)
), results AS (
    SELECT part, filter_order, step, bit,
           sum(CASE WHEN fails & (CAST(before AS INTEGER) | bit) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN fails & bit <> 0 AND fails & CAST(before AS INTEGER) = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN fails & bit <> 0 AND fails & CAST(before AS INTEGER) <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN fails & bit <> 0 AND fails & CAST(before AS INTEGER) = 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN fails & bit <> 0 AND fails & CAST(before AS INTEGER) = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM sets, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM results
"""


def llm_oracles() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op6_decontaminate": OP6_SQL, "op11_manifest": OP11_SQL, "op12_filter_audit": OP12_SQL}
