"""The corpus queries and, where SQL can state them, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adaptive_rules, chat_tree, head_tail, importance, jaccard_join, mixing, nra, packing, positional_index, suffix_dedup, token_counts, url_trie, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def good_labels(labels: DataFrame) -> DataFrame:
    """doc_id, good: of quality 1. Toxicity is another matter than quality and stays out of it."""
    return labels.select("doc_id", (F.col("quality") == 1).alias("good"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), good_labels(_table(spark, sf_dir, "labels")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.top_k(_table(spark, sf_dir, "embeddings"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    fixed = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    import public_tokenizers

    tokenizer = (tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return chat_tree.read_back(chat_tree.build_tree(rows.unionByName(fixed), *tokenizer), *tokenizer)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules.judge(_table(spark, sf_dir, "documents")).withColumn("failed", F.array_join("failed", ","))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), with_ids=False)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    fields = {"source": token_counts.whole, "text": token_counts.lines}
    return token_counts.attribute(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, fields)


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_trie.filter_urls(_table(spark, sf_dir, "pages"), rules)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head_tail.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_importance_resampling": op1,
    "op2_nra_top_k": op2,
    "op3_chat_prefix_tree": op3,
    "op4_adaptive_rules": op4,
    "op5_mix_to_targets": op5,
    "op6_hilbert_packing": op6,
    "op7_suffix_dedup": op7,
    "op8_jaccard_join": op8,
    "op9_token_attribution": op9,
    "op10_url_trie": op10,
    "op11_head_tail_resampling": op11,
    "op12_positional_index": op12,
    "op13_resident_lloyd": op13,
}

OP2_SQL = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 20 = 0 AND q.id <> c.id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""

OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('=' || lang, '') AS g, coalesce('=' || source, '') AS h FROM documents
), w AS (
  SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), u AS (
  SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM w
), t AS (
  SELECT r, i, a, lead(a) OVER (PARTITION BY r ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM u
), n AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM t WHERE c IS NOT NULL
), rep AS (
  SELECT r, count(DISTINCT place) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM n WHERE n > 1) GROUP BY r
), m AS (
  SELECT d.r, doc_id, g, h, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols * 10000 // word_chars ELSE 0 END AS symbols,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words ELSE 0 END AS repeats,
    CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS mean_chars
  FROM m
), x AS (
  SELECT g, h, measure, value, greatest(length(bin(value)) - 6, 0) AS s
  FROM (SELECT g, h, symbols, dup_lines, repeats, mean_chars FROM v WHERE NOT base_failed) UNPIVOT (value FOR measure IN (symbols, dup_lines, repeats, mean_chars))
), k AS (
  SELECT CAST(lv AS INTEGER) AS lv, CASE WHEN lv < 2 THEN g END AS g, CASE WHEN lv < 1 THEN h END AS h, measure, (value >> s) << s AS low, count(*) AS n
  FROM x, (VALUES (0), (1), (2)) z(lv) GROUP BY ALL
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY lv, g, h, measure ORDER BY low) AS up_to, sum(n) OVER (PARTITION BY lv, g, h, measure) AS docs FROM k
), q AS (
  SELECT lv, g, h, measure, CAST(max(docs) AS BIGINT) AS docs, min(CASE WHEN up_to * 4 >= docs THEN low END) AS q1, min(CASE WHEN up_to * 4 >= docs * 3 THEN low END) AS q3 FROM c GROUP BY ALL
), f AS (
  SELECT *, 3 * greatest(q3 - q1, CASE measure WHEN 'symbols' THEN 200 WHEN 'dup_lines' THEN 1000 WHEN 'repeats' THEN 500 ELSE 100 END) AS spread FROM q
), b AS (
  SELECT o.g, o.h, o.measure,
    (o.docs * (o.q1 - o.spread) + 100 * ((l.docs * (l.q1 - l.spread) + 100 * (e.q1 - e.spread)) // (l.docs + 100))) // (o.docs + 100) AS low,
    (o.docs * (o.q3 + o.spread) + 100 * ((l.docs * (l.q3 + l.spread) + 100 * (e.q3 + e.spread)) // (l.docs + 100))) // (o.docs + 100) AS high
  FROM f o JOIN f l ON o.lv = 0 AND l.lv = 1 AND o.g = l.g AND o.measure = l.measure JOIN f e ON e.lv = 2 AND e.measure = o.measure
), z AS (
  SELECT g, h, max(CASE WHEN measure = 'symbols' THEN high END) AS s, max(CASE WHEN measure = 'dup_lines' THEN high END) AS d, max(CASE WHEN measure = 'repeats' THEN high END) AS r,
    max(CASE WHEN measure = 'mean_chars' THEN high END) AS m, max(CASE WHEN measure = 'mean_chars' THEN low END) AS ml FROM b GROUP BY g, h
), j AS (
  SELECT v.*, concat_ws(',', CASE WHEN symbols > z.s THEN 'symbols' END, CASE WHEN dup_lines > z.d THEN 'dup_lines' END, CASE WHEN repeats > z.r THEN 'repeats' END, CASE WHEN mean_chars > z.m OR mean_chars < z.ml THEN 'mean_chars' END) AS failed
  FROM v LEFT JOIN z ON v.g = z.g AND v.h = z.h
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, failed, NOT base_failed AND failed = '' AS kept FROM j
"""

OP10_SQL = """
WITH p AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path
  FROM p
), r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC NULLS LAST, length(rule_path) DESC) AS n
  FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM m WHERE n = 1
"""

# Words of the texts of a table, in order, as lists.
_WORDS = r"""list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

# A CRC-32 is the exclusive or of what each byte gives at its distance from the end, and of the CRC of as many zero bytes.
OP11_SQL = (
    """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, %s AS w FROM documents
), f AS (
  SELECT r, w[i] AS f FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d)
  UNION ALL SELECT r, w[i] || ' ' || w[i + 1] FROM (SELECT r, w, unnest(generate_series(1, len(w) - 1)) AS i FROM d)
  UNION ALL SELECT r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)
), e AS (
  SELECT %s AS w FROM benchmark
), g AS (
  SELECT w[i] AS f FROM (SELECT w, unnest(generate_series(1, len(w))) AS i FROM e)
  UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM e)
  UNION ALL SELECT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT w, unnest(generate_series(1, len(w) - 2)) AS i FROM e)
), n AS (
  SELECT f, CAST(sum(s) AS BIGINT) AS s, CAST(sum(t) AS BIGINT) AS t FROM (SELECT f, 1 AS s, 0 AS t FROM f UNION ALL SELECT f, 0, 1 FROM g) GROUP BY f
), step AS (
  SELECT CAST(b AS BIGINT) AS b, list_reduce(list_prepend(CAST(b AS BIGINT), generate_series(1, 8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM range(256) t(b)
), far AS (
  SELECT b, 0 AS dist, v FROM step
  UNION ALL SELECT far.b, dist + 1, xor(far.v // 256, step.v) FROM far JOIN step ON step.b = far.v % 256 WHERE dist < (SELECT max(octet_length(encode(f))) FROM n)
), zero AS (
  SELECT 0 AS len, CAST(4294967295 AS BIGINT) AS v
  UNION ALL SELECT len + 1, xor(zero.v // 256, step.v) FROM zero JOIN step ON step.b = zero.v % 256 WHERE len < (SELECT max(octet_length(encode(f))) FROM n)
), h AS (
  SELECT f, hex(encode(f)) AS x, octet_length(encode(f)) AS len FROM n
), y AS (
  SELECT f, len, len - i AS dist, CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT) AS b FROM (SELECT f, x, len, unnest(generate_series(1, len)) AS i FROM h)
), k AS (
  SELECT f, max(len) AS len, bit_xor(v) AS v FROM y JOIN far USING (b, dist) GROUP BY f
), c AS (
  SELECT f, xor(xor(k.v, zero.v), 4294967295) %% 10000 AS bucket FROM k JOIN zero USING (len)
), u AS (
  SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM n JOIN c USING (f) GROUP BY bucket
), z AS (
  SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM n
), q AS (
  SELECT bucket, CAST(floor(1000 * ln((u.t + 1) * (z.s + 10000) / ((u.s + 1) * (z.t + 10000)))) AS BIGINT) AS gain FROM u, z
), o AS (
  SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN c USING (f) JOIN q USING (bucket) GROUP BY r
), p AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN o USING (r)
), a AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS docs FROM p
)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * docs // 100 THEN place END AS rank FROM a
"""
    .replace("%%", "%")
    .replace("%s", _WORDS.format("text"))
)

OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, %s AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, %s AS w FROM benchmark
), q AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), z AS (
  SELECT DISTINCT size FROM q
), p AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS run FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, z)
), m AS (
  SELECT r, i, size, item FROM p JOIN q USING (size, run)
), h AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(generate_series(i, i + size - 1)) AS at FROM m) GROUP BY r
), n AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
""".replace("%s", _WORDS.format("text"))


def _lloyd_sql(rounds: int = 4) -> str:
    """Lloyd's rounds, written out one after the other."""
    nearest = "SELECT r, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT v.r, v.p, v.x, b.e, CAST(list_sum(list_transform(generate_series(1, len(v.x)), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i]))) AS BIGINT) AS d FROM v JOIN {0} b USING (p)) GROUP BY r, p, x"
    parts = []
    for n in range(rounds):
        parts.append(f"a{n} AS MATERIALIZED ({nearest.format(f'b{n}')})")
        means = f"SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, x, unnest(generate_series(1, len(x))) AS i FROM a{n}) GROUP BY p, e, i) GROUP BY p, e"
        parts.append(f"b{n + 1} AS MATERIALIZED (SELECT b{n}.p, b{n}.e, coalesce(m.x, b{n}.x) AS x FROM b{n} LEFT JOIN ({means}) m USING (p, e))")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), v AS MATERIALIZED (
  SELECT r, p, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] AS x FROM k, (VALUES (0), (1), (2), (3)) t(p)
), b0 AS (
  SELECT p, r - 1 AS e, x FROM v WHERE r <= 256
), {", ".join(parts)}, z AS MATERIALIZED (
  {nearest.format(f"b{rounds}")}
), c AS (
  SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY r
), s AS (
  SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM b{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (r), s
"""


SQL = {"op2_nra_top_k": OP2_SQL, "op3_chat_prefix_tree": OP3_SQL, "op4_adaptive_rules": OP4_SQL, "op10_url_trie": OP10_SQL, "op11_head_tail_resampling": OP11_SQL, "op12_positional_index": OP12_SQL, "op13_resident_lloyd": _lloyd_sql()}
