"""The queries ``opN_<name>``: each operator over its whole table, with production
parameters.  ``queries()`` maps names to ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citemill.llm import ann, bpe, chat, fingerprint, jaccard, language_id, packing, quality, url_filter, warc
from citemill.llm.common import scratch_dir, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_classes(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.trees(turns))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "evidence", "host_posterior", "path_posterior", "quality_score", (scored["quality_score"] >= 0.5).alias("keep"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), scratch_dir(spark)))


# what SQL can say of operators that it can't express whole
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and fixed rule of every URL."""
    return op5_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and edited text of every document."""
    return op2_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def byte_bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ids of every text decode to."""
    return op7_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def nearest_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different neighbours every query has, and the last rank."""
    found = op4_nearest(spark, sf_dir)
    return found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("found"), F.max("rank").cast("bigint").alias("last"))


def queries() -> dict:
    own = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return own | {f.__name__: f for f in (url_rules, fingerprint_edits, byte_bpe_decoded, nearest_ranks)}


ORACLES = {
    # the longest rule that fits decides
    "url_rules": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
 r(h, q) AS (VALUES ('org', '/'), ('example.org', '/es/'), ('example.org', '/en/1'), ('com', '/fr/'), ('com', '/de/'))
SELECT page_id, host, path, arg_max(h || q, length(h || q)) AS rule FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id, host, path""",
    # next document by descending id; after the last the first
    "fingerprint_edits": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS u FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(u, 1, length(t) // 2)) AS edited_sha256 FROM n""",
    "byte_bpe_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "nearest_ranks": r"""
WITH v AS (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT vec_id AS query_id, least(20, (SELECT count(*) FROM v) - 1)::BIGINT AS found, least(20, (SELECT count(*) FROM v) - 1)::BIGINT AS last FROM v WHERE vec_id % 20 = 0""",
    # shingle sets by lists, linked pairs by a self-join, reachability by recursion
    "op3_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
              ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
 x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (na + nb - k)),
 r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id))::BIGINT AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(other) AS low FROM r GROUP BY 1) m ON m.doc_id = s.doc_id""",
    "op8_chat": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt,
              sum(15 + length(role) + length(text) + len(regexp_extract_all(role, '\\|###|</turn>|: ')) + len(regexp_extract_all(text, '\\|###|</turn>|: '))) AS chars FROM t GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, chars::BIGINT AS formatted_chars FROM g""",
    # base32 of a digest: 32 groups of five of its 160 bits
    "op10_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low FROM pages),
 b AS (SELECT *, array_to_string(list_transform(string_split(sha1(body), ''), lambda h: right('000' || bin(instr('0123456789abcdef', h) - 1), 4)), '') AS bits FROM p)
SELECT page_id, strlen(body) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to
FROM b""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express whole."""
    return dict(ORACLES)
