"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlens.llm import ann, bpe, chat, common, divergence, language, packing, pivots, quality, resampling, simhash, suffixes, tokencounts, warc


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Conversations as tool calls: a user's turn calls the tool ``reply``, the assistant's turn after it is the
    result, a follow-up is called after the question before it, and other turns are plain messages."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    call = lambda back: F.concat(F.lit("c"), (F.col("turn") - back).cast("string"))
    question = F.to_json(F.struct(F.col("text").alias("question"), "turn", F.when(F.col("turn") >= 2, call(2)).alias("after")))
    return conversations.select(
        "conv_id", "turn", F.when(assistant, "tool").otherwise(F.col("role")).alias("role"), F.when(~user, F.col("text")).alias("text"),
        F.when(user, call(0)).when(assistant, call(1)).alias("call_id"), F.when(user, "reply").alias("tool"),
        F.when(user, question).alias("arguments"), F.when(user & (F.col("turn") >= 2), F.array(call(2))).alias("after"),
    )


def op1_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "SELECT * FROM VALUES ('reply', 'question', 'string', true), ('reply', 'turn', 'integer', true), ('reply', 'after', 'string', true) AS t (tool, param, type, required)"
    return chat.format_chat(conversation_events(common.table(spark, sf_dir, "conversations")), spark.sql(schema))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(common.table(spark, sf_dir, "embeddings"))


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest's columns, and what is left of the text (``text``, without characters that are cut) and what goes (``removed``)."""
    return suffixes.remove_repeats(common.table(spark, sf_dir, "documents"), results=("n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "removed"))


def op7_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.pivot_search(common.table(spark, sf_dir, "embeddings"))


def op9_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted_languages(common.table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "warc")
    warc.write_archives(common.table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_chat_tool_calls, op2_best_fit_packing, op3_bpe, op4_adaptive_ann, op5_simhash_golay, op6_suffix_dedup, op7_quality_ftrl, op8_pivot_topk, op9_language_centroids, op10_warc, op11_source_divergence, op12_resampling, op13_token_counts)}

ORACLE: dict[str, str] = {
    "op1_chat_tool_calls": """
        WITH e AS (
            SELECT *, role = 'user' AS is_call, role = 'assistant' AS is_result,
                   'c' || CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS call_id,
                   bool_or(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS asked,
                   bool_or(role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS answered
            FROM conversations)
        SELECT conv_id, turn, CASE WHEN is_call THEN 'call' WHEN is_result THEN 'result' ELSE 'message' END AS kind, call_id,
               CASE WHEN is_call THEN CASE WHEN answered THEN 'linked' ELSE 'unanswered' END
                    WHEN is_result THEN CASE WHEN asked THEN 'linked' ELSE 'orphan' END END AS status,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position,
               CASE WHEN is_call AND turn < 2 THEN 'after: missing' ELSE '' END AS errors,
               CASE WHEN is_call THEN '{"arguments":{' || CASE WHEN turn >= 2 THEN '"after":"c' || (turn - 2) || '",' ELSE '' END
                         || '"question":' || to_json(text) || ',"turn":' || turn || '},"call_id":"' || call_id || '"'
                         || CASE WHEN turn < 2 THEN ',"errors":["after: missing"]' ELSE '' END || ',"role":"user","tool":"reply"}'
                    WHEN is_result THEN '{"call_id":"' || call_id || '","content":' || to_json(text) || ',"role":"tool"}'
                    ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' END AS json
        FROM e""",
    "op8_pivot_topk": """
        WITH rows AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM rows q JOIN rows c ON c.vec_id <> q.vec_id
            WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS kept FROM d)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j:
                       (CAST('0x' || hex[CAST(floor((5 * i + j) / 4) AS INTEGER) + 1] AS INTEGER) >> (3 - (5 * i + j) % 4) & 1) * (1 << (4 - j))))::INTEGER, 1)), '') AS payload_digest,
               CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> kept THEN kept END AS refers_to
        FROM g""",
    "op11_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
        w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
        k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
        l AS (SELECT lang, sum(n)::HUGEINT AS n, count(*)::HUGEINT AS v FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
        t AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
        g AS (SELECT lang, source, coalesce(t.n, 0) AS n, l.v, l.n AS lang_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN t USING (lang, source) LEFT JOIN l USING (lang)),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (g.n + 5 * g.v) AS p, 1 + 1000000000 * (k.n + 5) // (g.lang_n + 5 * g.v) AS q
              FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, CAST(row_number() OVER u AS INTEGER) AS rank FROM o
        WINDOW u AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER u <= 50""",
    "op12_resampling": """
        WITH k AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS step),
        d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
        b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
        dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM d) GROUP BY ALL),
        bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) GROUP BY ALL),
        w AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
        c AS (SELECT word, xor(list_reduce(list_transform(range(0, CAST(len(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)),
                                           lambda x, y: xor(step[(xor(x, y) & 255) + 1], x >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM w, k),
        s AS (SELECT bucket, sum(n)::BIGINT AS s FROM dw JOIN c USING (word) GROUP BY bucket),
        t AS (SELECT bucket, sum(n)::BIGINT AS t FROM bw JOIN c USING (word) GROUP BY bucket),
        g AS (SELECT i AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE
                                       / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
              FROM range(0, 10000) x(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
        m AS (SELECT r, sum(n * gain)::BIGINT AS total FROM dw JOIN c USING (word) JOIN g USING (bucket) GROUP BY r),
        o AS (SELECT r, doc_id, len(words)::BIGINT AS n_features,
                     CASE WHEN len(words) = 0 THEN 0 ELSE (total - ((total % len(words)) + len(words)) % len(words)) // len(words) END::BIGINT AS weight,
                     CAST('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8) AS BIGINT) AS h
              FROM d LEFT JOIN m USING (r)),
        p AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM o),
        q AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM p WHERE n_features >= 20 QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= 10 * count(*) OVER () // 100)
        SELECT doc_id, n_features, weight, score, rank FROM p LEFT JOIN q USING (r)""",
}
