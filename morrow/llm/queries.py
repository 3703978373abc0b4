"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morrow.llm import (
    byte_bpe, exact_dedup, filter_audit, html_text, line_dedup, merkle, mixing, near_dedup, packing, pii, repeats, toxicity,
    vector_topk,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_digest(_table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=100)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_digest(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(_table(spark, sf_dir, "documents"))


def word_tokenizer() -> str:
    """Where the public tokenizer of the packing query lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(_table(spark, sf_dir, "documents"), min_lines=3, long_words=50)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), word_tokenizer(), 4096)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_digest(_table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.token_digest(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_mixing": op5_mixing,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_pii": op7_pii,
    "op8_html_extraction": op8_html_extraction,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        w AS (
          SELECT doc_id, n, i, lines[i : i + n - 1] AS run
          FROM (SELECT doc_id, lines, n, unnest(range(1, len(lines) - n + 2)) AS i FROM d, (VALUES (1), (2), (3)) AS depth(n))),
        v AS (
          SELECT * FROM w
          WHERE n = 3 OR len(regexp_extract_all(array_to_string(run, chr(10)), '[^\x20\x09-\x0D]+')) > 50),
        s AS (SELECT doc_id, i, n FROM v QUALIFY row_number() OVER (PARTITION BY n, run ORDER BY doc_id, i) > 1),
        g AS (SELECT DISTINCT doc_id, i + unnest(range(n)) AS i FROM s),
        r AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
        a AS (SELECT doc_id, list(i) AS gone, count(*) AS n_removed, count(DISTINCT island) AS n_runs FROM r GROUP BY doc_id)
        SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
               sha256(coalesce(array_to_string(list_filter(lines, lambda x, j: gone IS NULL OR NOT list_contains(gone, j)), chr(10)), '')) AS kept_sha256
        FROM d LEFT JOIN a USING (doc_id)""",
    "op3_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)""",
    "op10_exact_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS p FROM embeddings),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.p, c.p) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (
          SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
          FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_pii": r"""
        WITH kinds(rank, kind, pattern) AS (VALUES
          (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
          (2, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
          (3, 'card', '[0-9]([\x20-]?[0-9])+'),
          (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
          (5, 'iban', '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b')),
        d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents),
        m AS (
          SELECT row, rank, kind, regexp_extract_all(body, pattern) AS found,
                 regexp_split_to_array(body, pattern) AS between
          FROM d, kinds),
        e AS (
          SELECT row, rank, kind, i, found[i] AS v,
                 list_sum(list_transform(between[1:i], lambda x: length(x)))
                 + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS place
          FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m WHERE len(found) > 0)),
        g AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS n FROM e),
        h AS (
          SELECT row, rank, kind, CAST(place AS BIGINT) AS s, CAST(place + length(v) AS BIGINT) AS t FROM g
          WHERE CASE kind
            WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3
                           OR coalesce(TRY_CAST(nullif(ltrim(x, '0'), '') AS INT), 0) > 255)) = 0
            WHEN 'card' THEN length(n) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(n) + 1),
                           lambda j: CASE WHEN j % 2 = 1 THEN CAST(substr(reverse(n), j, 1) AS INT)
                                ELSE CAST(substr(reverse(n), j, 1) AS INT) * 2
                                     - CASE WHEN substr(reverse(n), j, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0
            WHEN 'phone' THEN length(n) BETWEEN 9 AND 15
            WHEN 'iban' THEN list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(
                           string_split(substr(replace(v, ' ', ''), 5) || left(replace(v, ' ', ''), 4), ''),
                           lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 + 1000 ELSE CAST(c AS BIGINT) END)),
                           lambda a, c: CASE WHEN c >= 1000 THEN (a * 100 + c - 1000) % 97 ELSE (a * 10 + c) % 97 END) = 1
            ELSE true END),
        a AS (
          SELECT row, count(*) FILTER (rank = 1) AS n_email, count(*) FILTER (rank = 2) AS n_ip,
                 count(*) FILTER (rank = 3) AS n_card, count(*) FILTER (rank = 4) AS n_phone,
                 string_agg(kind || ':' || s || ':' || t, ',' ORDER BY s, rank) FILTER (rank <= 4) AS base,
                 string_agg(kind || ':' || s || ':' || t, ',' ORDER BY s, rank) AS spans
          FROM h GROUP BY row)
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
               coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN a USING (row)""",
    # Every document goes through every order, filter by filter.
    "op11_filter_audit": r"""
        WITH l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                     min(doc_id) OVER (PARTITION BY body) AS least FROM t),
        f AS (
          SELECT row_number() OVER () AS row, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
                  'C': 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body),
                  'D': regexp_matches(body, '[#$%&*|]'), 'E': coalesce(w.doc_id > least, least IS NOT NULL)} AS fails
          FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (
          SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        e AS (
          SELECT part, good, toxic, filter_order,
                 list_transform(string_split(filter_order, ''),
                   lambda x: CASE x WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END) AS hit
          FROM f, o),
        s AS (SELECT *, coalesce(list_position(hit, true), 6) AS goes, len(list_filter(hit, lambda h: h)) AS n_hit, unnest(range(1, 6)) AS step FROM e),
        c AS (
          SELECT part, filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INT), 1) AS filter,
                 count(*) FILTER (goes > step) AS kept, count(*) FILTER (goes = step) AS removed,
                 count(*) FILTER (goes < step AND hit[step]) AS redundant, count(*) FILTER (n_hit = 1 AND hit[step]) AS unique_fails,
                 count(*) FILTER (goes = step AND good = 1) AS good_lost, count(*) FILTER (goes = step AND toxic = 1) AS toxic_lost
          FROM s GROUP BY ALL)
        SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM c""",
    # Levels are built from below, one at a time; every proof is joined from its level's runs.
    "op12_merkle_manifest": r"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, lang, n_chars, text,
                 (SELECT list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                    lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
                      lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) AS rest
          FROM documents),
        h AS (
          SELECT doc_id, source, text, xor(rest, 4294967295) % 2 = 0 AS hit,
                 coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
                 || coalesce(octet_length(encode(source)) || ':' || source, '-')
                 || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
                 || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
                 replace(text, chr(10), '') AS joined
          FROM d),
        leaves AS (
          SELECT *, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                 sha256(head || coalesce(octet_length(encode(joined)) || ':' || joined, '-')) AS other
          FROM h),
        ranked AS (
          SELECT doc_id, leaf, CASE WHEN hit THEN other ELSE leaf END AS found,
                 dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
                 row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
          FROM leaves),
        nodes(tree, level, i, hash, n) AS (
          SELECT tree, 0, rank, leaf, count(*) OVER (PARTITION BY tree) FROM ranked
          UNION ALL
          SELECT tree, level + 1, i // 3, sha256(string_agg(hash, '' ORDER BY i)), (max(n) + 2) // 3
          FROM nodes WHERE n > 1 GROUP BY tree, level, i // 3),
        subroots AS (SELECT tree, level AS height, hash AS subroot FROM nodes WHERE n = 1),
        above(level, i, hash, n) AS (
          SELECT 0, tree - 1, subroot, count(*) OVER () FROM subroots
          UNION ALL
          SELECT level + 1, i // 3, sha256(string_agg(hash, '' ORDER BY i)), (max(n) + 2) // 3 FROM above WHERE n > 1 GROUP BY level, i // 3),
        pairs AS (
          SELECT a.tree, a.level, a.i, coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
                 coalesce(string_agg(b.hash, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
          FROM (SELECT * FROM nodes UNION ALL SELECT 0, level, i, hash, n FROM above) a
          JOIN (SELECT * FROM nodes UNION ALL SELECT 0, level, i, hash, n FROM above) b
            ON a.tree = b.tree AND a.level = b.level AND a.i // 3 = b.i // 3
          WHERE a.n > 1 GROUP BY a.tree, a.level, a.i),
        steps AS (
          SELECT r.tree, r.rank, p.level, p.l, p.r FROM ranked r JOIN pairs p
            ON p.tree = r.tree AND p.i = r.rank // CAST(pow(3, p.level) AS BIGINT)
          UNION ALL
          SELECT r.tree, r.rank, s.height + p.level, p.l, p.r FROM ranked r JOIN subroots s ON s.tree = r.tree
          JOIN pairs p ON p.tree = 0 AND p.i = (r.tree - 1) // CAST(pow(3, p.level) AS BIGINT)),
        fold(tree, rank, level, hash) AS (
          SELECT tree, rank, 0, found FROM ranked
          UNION ALL
          SELECT f.tree, f.rank, f.level + 1, sha256(s.l || f.hash || s.r)
          FROM fold f JOIN steps s ON s.tree = f.tree AND s.rank = f.rank AND s.level = f.level),
        ends AS (SELECT tree, rank, max_by(hash, level) AS folded_root FROM fold GROUP BY tree, rank),
        proofs AS (SELECT tree, rank, sha256(string_agg(l || r, '' ORDER BY level)) AS proof FROM steps GROUP BY tree, rank)
        SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM ranked JOIN subroots USING (tree) JOIN ends USING (tree, rank) LEFT JOIN proofs USING (tree, rank),
             (SELECT hash AS root FROM above WHERE n = 1)""",
}
