"""The registered queries of the numbered operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.chat import chat_digests, probe
from casewright.llm.common import table, written
from casewright.llm.decontaminate import find_leaks
from casewright.llm.filter_audit import filter_audit
from casewright.llm.html_text import extract_text
from casewright.llm.jaccard import near_groups
from casewright.llm.language import host_parts, identify
from casewright.llm.licences import scan_licences
from casewright.llm.mixing import mixed_words
from casewright.llm.packing import pack
from casewright.llm.prefix_trie import prefix_trie, rebuilt
from casewright.llm.token_count import count_tokens
from casewright.llm.topk import top_k
from casewright.llm.toxicity import toxicity


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), declared=F.col("lang"), host=F.col("source"))


def language_id_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    texts = extract_text(pages.select("page_id", F.struct("url", declared.alias("declared")).alias("url"), "html"))
    texts = written(texts, "texts")  # identify reads them several times, and each reading would parse every page again
    host, domain, suffix = host_parts(F.col("url.url"))
    return identify(texts, declared=F.col("url.declared"), host=host, domain=domain, suffix=suffix, id_col="page_id")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), size=3, percent=90)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(table(spark, sf_dir, "documents"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), F.col("doc_id").cast("string"))
    return scan_licences(docs, path)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(rows.unionByName(probe(spark)))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op12_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "language_id_of_pages": language_id_of_pages,
    "op4_topk_search": op4_topk_search,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_html_text": op7_html_text,
    "op8_source_mixing": op8_source_mixing,
    "op9_licence_scan": op9_licence_scan,
    "op10_chat_format": op10_chat_format,
    "op11_filter_audit": op11_filter_audit,
    "op12_pattern_packing": op12_pattern_packing,
    "op13_prefix_trie": op13_prefix_trie,
}

ESCAPED = "replace({0}, chr(92), chr(92) || chr(92))"
for _c in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN]", "[/TURN]"):
    ESCAPED = f"replace({ESCAPED}, '{_c}', '{_c[0]}' || chr(92) || '{_c[1:]}')"

ORACLE_SQL: dict[str, str] = {
    "op4_topk_search": """
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10""",
    "op6_jaccard_join": r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM cut),
flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
links AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM flat p JOIN flat q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY p.doc_id, q.doc_id) x
  JOIN sizes m ON m.doc_id = x.a JOIN sizes n ON n.doc_id = x.b WHERE 100 * c >= 90 * (m.n + n.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM sizes s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n""",
    "op10_chat_format": f"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length({ESCAPED.format("text")}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 13 END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op11_filter_audit": r"""
WITH cut AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
judged AS (
  SELECT doc_id, part, CAST(len(w) < 200 AS INTEGER) + CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER) * 2
    + CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INTEGER) * 4 + CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) * 8
    + CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) * 16 AS mask FROM cut),
marked AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM judged LEFT JOIN marked USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND p.b | q.b | r.b | s.b | t.b = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[:step]) - bits[step] AS before FROM orders, generate_series(1, 5) g(step)),
told AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | before)::INTEGER = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before::INTEGER = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before::INTEGER <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before::INTEGER = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before::INTEGER = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM told""",
    "op13_prefix_trie": r"""
WITH RECURSIVE crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS k, 4294967295::BIGINT AS c FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT conv_id, s, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END
  FROM (SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(c, ascii(s[k // 8 + 1])::BIGINT) ELSE c END AS v FROM crc WHERE k < 8 * length(s))),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(c, 4294967295) % 6 AS h FROM crc WHERE k = 8 * length(s)),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
whole AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
deep AS (SELECT conv_id, text, {'r': role, 't': text} AS said, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM whole),
paths AS (
  SELECT conv_id, depth, text, list(said) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM deep
  UNION ALL SELECT conv_id, 0, '', [] FROM convs),
lengths AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(length(text)) AS chars,
    string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM paths JOIN lengths USING (conv_id) GROUP BY path),
ups AS (SELECT n.depth, n.conv_id, n.n_convs, n.chars, n.ends, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM ups WHERE depth > 0 GROUP BY parent_conv_id, depth - 1),
told AS (SELECT u.*, coalesce(k.n_children, 0) AS n_children FROM ups u LEFT JOIN kids k ON k.conv_id = u.conv_id AND k.depth = u.depth),
named AS (SELECT p.conv_id AS member, p.depth, n.conv_id FROM paths p JOIN nodes n ON n.path = p.path),
sums AS (
  SELECT a.conv_id, a.depth, sum(CASE WHEN t.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((t.n_convs - 1) * t.chars) AS saved
  FROM told t JOIN named a ON a.member = t.conv_id AND a.depth <= t.depth GROUP BY a.conv_id, a.depth)
SELECT t.conv_id, CAST(t.depth AS BIGINT) AS depth, t.parent_conv_id, CAST(t.n_convs AS BIGINT) AS n_convs, CAST(t.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(t.ends, '')) AS ends_sha256
FROM told t JOIN sums s ON s.conv_id = t.conv_id AND s.depth = t.depth""",
}
