"""The corpus operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, common, decontamination, exact_dedup, language_id, lm, mixing, negatives, packing, quality, resampling, simhash, suffix_dedup, token_counts


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(common.table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(common.table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passages(common.table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(common.table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(common.table(spark, sf_dir, "conversations"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(common.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=2)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(common.table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(common.table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), 4096)
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(common.table(spark, sf_dir, "documents"), width=4, radius=4)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, least=20, percent=10, seed=2024)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(common.table(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), span=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_chat_format": op5_chat_format,
    "op6_packing": op6_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op10_simhash": op10_simhash,
    "op11_resampling": op11_resampling,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_decontamination": op13_decontamination,
}

SQL: dict[str, str] = {
    "op3_suffix_dedup": r"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        places AS (SELECT r, doc_id, ws, unnest(range(0, len(ws) - 49)) AS start FROM texts WHERE len(ws) >= 50),
        windows AS (SELECT r, doc_id, start, sha256(array_to_string(ws[start + 1 : start + 50], ' ')) AS h FROM places),
        shared AS (SELECT h FROM windows GROUP BY h HAVING min(r) < max(r)),
        found AS (SELECT r, doc_id, start, lag(start) OVER (PARTITION BY r ORDER BY start) AS before FROM windows SEMI JOIN shared USING (h)),
        islands AS (SELECT *, sum(CASE WHEN start <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY start) AS island FROM found)
        SELECT any_value(doc_id) AS doc_id, min(start) AS start, max(start) + 50 - min(start) AS length FROM islands GROUP BY r, island""",
    "op5_chat_format": r"""
        WITH added AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        sized AS (SELECT *, strlen(role) + len(regexp_extract_all(role, '[\n\\]')) + strlen(text) + len(regexp_extract_all(text, '<\\*\|')) + 24 AS n,
            length(role) + len(regexp_extract_all(role, '[\n\\]')) + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 24 AS chars,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS seq FROM added),
        placed AS (SELECT *, sum(n) OVER so_far AS upto, first_value(CASE WHEN role = 'system' THEN seq END IGNORE NULLS) OVER so_far AS sys_seq,
            first_value(CASE WHEN role = 'system' THEN chars END IGNORE NULLS) OVER so_far AS sys_chars,
            greatest(3072 - coalesce(first_value(CASE WHEN role = 'system' THEN n END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0), 1024) AS stride
            FROM sized WINDOW so_far AS (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        dealt AS (SELECT *, 2 * ((upto - n) // stride) + CASE WHEN upto > ((upto - n) // stride + 1) * stride THEN 1 ELSE 0 END AS win FROM placed),
        seen AS (SELECT *, lag(win) OVER w IS DISTINCT FROM win AND seq > 1 AS opens, lag(n) OVER w AS n1, lag(chars) OVER w AS chars1, lag(n, 2) OVER w AS n2, lag(chars, 2) OVER w AS chars2
            FROM dealt WINDOW w AS (PARTITION BY conv_id ORDER BY seq)),
        counted AS (SELECT *, CASE WHEN opens THEN CASE WHEN sys_seq < seq THEN sys_chars ELSE 0 END
            + CASE WHEN n1 <= 1024 AND sys_seq IS DISTINCT FROM seq - 1 THEN chars1 ELSE 0 END
            + CASE WHEN n1 + n2 <= 1024 AND sys_seq IS DISTINCT FROM seq - 2 THEN chars2 ELSE 0 END ELSE 0 END AS repeated FROM seen)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(chars + repeated)::BIGINT AS formatted_chars FROM counted GROUP BY conv_id""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_resampling": r"""
        WITH crc AS (SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t
            FROM (SELECT unnest(range(256)) AS i)),
        texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        aims AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        used AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM texts) GROUP BY r, w),
        coded AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM used UNION SELECT w FROM aims)),
        bytes AS (SELECT w, list_transform(range(1, length(h), 2), lambda i: 16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1) AS b FROM coded),
        codes AS (SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], b), lambda c, x: xor(c // 256, t[(xor(c, x) & 255) + 1]))) % 10000 AS bucket FROM bytes, crc),
        s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM used JOIN codes USING (w) GROUP BY bucket),
        t AS (SELECT bucket, count(*)::DOUBLE AS t FROM aims JOIN codes USING (w) GROUP BY bucket),
        gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
        sums AS (SELECT r, sum(n) AS n, sum(n * gain) AS total FROM used JOIN codes USING (w) JOIN gains USING (bucket) GROUP BY r),
        weighed AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
            list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[i]) - 1), lambda a, x: 16 * a + x)::DOUBLE AS h
            FROM texts LEFT JOIN sums USING (r)),
        scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM weighed),
        placed AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM placed WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM placed""",
    "op12_hard_negatives": """
        WITH sound AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM sound a JOIN sound b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
        positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id NULLS LAST) <= 5),
        pairs AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
            row_number() OVER (PARTITION BY p.r, p.id ORDER BY n.score DESC, n.id NULLS LAST) AS rank
            FROM positives p JOIN scores n ON n.r = p.r AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= 5""",
    "op13_decontamination": r"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        windows AS (SELECT DISTINCT item, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i : i + n - 1], ' '))) AS key
            FROM (SELECT *, least(10, len(ws)) AS n FROM items WHERE len(ws) > 0)),
        lengths AS (SELECT DISTINCT n FROM windows),
        starts AS (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM texts, lengths WHERE len(ws) >= n),
        runs AS (SELECT r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS key FROM starts),
        hits AS (SELECT r, n, i, item FROM runs JOIN windows USING (n, key)),
        covered AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS word FROM hits) GROUP BY r),
        named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM texts LEFT JOIN covered USING (r) LEFT JOIN named USING (r)""",
}
