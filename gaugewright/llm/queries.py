"""The queries of this subpackage's operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugewright.llm import exact_dedup, html_text, language_id, near_dedup, packing, piece_codec, quotations, sharding, top_k, warc
from gaugewright.session import table


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=24)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_codec.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, separator=0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), spark, revisit_bytes=0)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search_table(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op5_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.reply_order(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op5_quotations": op5_quotations,
    "op1_top_k": op1_top_k,
    "op10_html_text": op10_html_text,
    "op8_warc": op8_warc,
    "op2_near_dedup": op2_near_dedup,
    "op7_language_id": op7_language_id,
    "op4_packing": op4_packing,
    "op3_sentencepiece": op3_sentencepiece,
    "op6_exact_dedup": op6_exact_dedup,
    "op9_sharding": op9_sharding,
}

def _crc32_table() -> str:
    entries = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        entries.append(str(n))
    return f"[{', '.join(entries)}]::BIGINT[]"


ORACLE_SQL = {
    "op1_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM scored QUALIFY rank <= 20
    """,
    "op5_quotations": r"""
        WITH lines AS (
            SELECT conv_id, turn, k, line, regexp_extract(line, '^(?:[ \t]*>)*') AS marks,
                   lower(trim(regexp_replace(regexp_replace(line, '^([ \t]*>)+[ \t]?', ''), '\s+', ' ', 'g'))) AS plain,
                   coalesce(lead(line) OVER (PARTITION BY conv_id, turn ORDER BY k), '') AS next
            FROM (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM conversations)
        ),
        levels AS (SELECT *, length(marks) - length(replace(marks, '>', '')) AS level FROM lines),
        origins AS (SELECT conv_id, plain, min(turn) AS source FROM levels WHERE level = 0 AND plain <> '' GROUP BY ALL),
        links AS (
            SELECT q.conv_id, q.turn, level, source, sum(length(plain)) AS chars FROM levels q JOIN origins USING (conv_id, plain)
            WHERE level > 0 AND source < q.turn GROUP BY ALL
        ),
        parents AS (SELECT conv_id, turn, last(source ORDER BY -level, chars, source) AS parent FROM links GROUP BY ALL),
        own AS (
            SELECT conv_id, turn, count(*) FILTER (regexp_matches(line, '^[ \t]*>')) AS n_quoted,
                   regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT regexp_matches(line, '^[ \t]*>') AND NOT (regexp_matches(line, '(?i)^[ \t]*(on|am|le|el)\b.*\b(wrote|schrieb|a écrit|escribió)[ \t]*:[ \t\r]*$') AND regexp_matches(next, '^[ \t]*>'))), ''), '^\s+|\s+$', '', 'g') AS text
            FROM lines GROUP BY ALL
        ),
        paths AS (
            WITH RECURSIVE up(conv_id, turn, node, path) AS (
                SELECT conv_id, turn, turn, [turn] FROM conversations
                UNION ALL
                SELECT up.conv_id, up.turn, parent, list_prepend(parent, path) FROM up JOIN parents ON parents.conv_id = up.conv_id AND parents.turn = up.node
            )
            SELECT conv_id, turn, last(path ORDER BY len(path)) AS path FROM up GROUP BY ALL
        )
        SELECT c.conv_id, c.turn, role, own.text, n_quoted, parent AS parent_turn, len(path) - 1 AS depth,
               row_number() OVER (PARTITION BY c.conv_id ORDER BY path, role) - 1 AS position
        FROM conversations c JOIN own USING (conv_id, turn) JOIN paths USING (conv_id, turn) LEFT JOIN parents USING (conv_id, turn)
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        bits AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper, list_transform(range(1, 41, 5), lambda k: ('0x' || h[k:k + 4])::BIGINT) AS words FROM p)
        SELECT page_id, n AS payload_bytes,
               array_to_string(list_transform(words, lambda w: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((w >> s) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM bits
    """,
    "op2_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents
        ),
        sets AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
            FROM words
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        links AS (
            SELECT x.doc_id AS a, y.doc_id AS b
            FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id
            JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
            GROUP BY x.doc_id, y.doc_id, p.n, q.n
            HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
        ),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
        FROM documents d LEFT JOIN sizes USING (doc_id)
        JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) USING (doc_id)
    """,
    "op9_sharding": f"""
        WITH RECURSIVE crc_table AS (SELECT {_crc32_table()} AS t),
        jump(doc_id, state, j) AS (
            SELECT doc_id, doc_id::HUGEINT, 0::BIGINT FROM documents
            UNION ALL
            SELECT doc_id, next, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((next // 8589934592) + 1)::DOUBLE))::BIGINT
            FROM (SELECT doc_id, j, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS next FROM jump WHERE j < 25)
        ),
        placed AS (
            SELECT doc_id, max(j) FILTER (j < 24) AS shard, max(j) FILTER (j < 25) AS grown_shard FROM jump GROUP BY doc_id
        ),
        rows AS (
            SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
                   CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 4294967295 - list_reduce(
                       [4294967295::BIGINT] || list_transform(string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ','), ','), lambda x: ('0x' || x)::BIGINT),
                       lambda acc, x: xor(acc >> 8, t[1 + (xor(acc, x) & 255)])) END AS text_crc32,
                   ((doc_id::HUGEINT * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT) // 8589934592 AS spread
            FROM documents, crc_table
        )
        SELECT doc_id, size, text_crc32, 'key' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY spread % (SELECT greatest(1, (count(*) + 24575) // 24576) FROM documents), doc_id) - 1 AS slot,
               grown_shard
        FROM rows JOIN placed USING (doc_id)
    """,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
