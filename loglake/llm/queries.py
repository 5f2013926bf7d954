"""The registered queries of the operators, one ``opN_<name>`` each, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglake.llm import alignment, ann, chat, decontaminate, htmltext, minhash, pieces, quality, repeats, sharding, tokencount, urlfilter, whitening
from loglake.llm.shared import table

SHARDS = 40


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes for a SQL dialect without that function: two nibbles a byte."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 * (c & 1))
        table.append(c)
    step = f"xor(a >> 4, ({table}::BIGINT[])[1 + (a & 15)])"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({data}, lambda c, b: list_reduce([1, 2], lambda a, k: {step}, xor(c, b)), 4294967295::BIGINT), 4294967295)"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), pieces.Vocabulary.load())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokencount.ranks_of())


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages, htmltext.train(pages)).select("page_id", "url", "text", "n_chars")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_log(chat.log_of(rows)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, urlfilter.RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), alignment.ByteTokens(), alignment.PieceTokens())


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_counts": op2_token_counts,
    "op3_html_text": op3_html_text,
    "op4_sharding": op4_sharding,
    "op5_decontamination": op5_decontamination,
    "op6_chat": op6_chat,
    "op7_quality": op7_quality,
    "op8_minhash": op8_minhash,
    "op9_neighbours": op9_neighbours,
    "op10_url_filter": op10_url_filter,
    "op11_alignment": op11_alignment,
    "op12_repeats": op12_repeats,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op4_sharding": f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, coalesce('=' || source, '') AS src FROM documents
), c AS (
  SELECT doc_id, source, src, CAST(octet_length(encode(t)) + 16 AS BIGINT) AS size, {crc32_sql('t')} AS text_crc32 FROM d
), h AS (
  SELECT *, CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(text_crc32 AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM c
), n AS (
  SELECT src, count(*) AS n, CAST('0x' || substr(md5('0|' || src), 1, 15) AS BIGINT) AS sh FROM h GROUP BY src
), u AS (
  SELECT src, n, (row_number() OVER (PARTITION BY n ORDER BY sh, src) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY n)
    + (CAST('0x' || substr(md5('0|' || CAST(n AS VARCHAR)), 1, 15) AS BIGINT) >> 8) / 4503599627370496::DOUBLE AS o FROM n
), r AS (
  SELECT h.*, n, o - floor(o) AS u, row_number() OVER (PARTITION BY src ORDER BY h, doc_id, text_crc32, size) - 1 AS rank, count(*) OVER () AS total FROM h JOIN u USING (src)
), p AS (
  SELECT *, row_number() OVER (ORDER BY (rank + u) / n, src, rank) - 1 AS pos FROM r
)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, CAST(pos * {SHARDS} // total AS INTEGER) AS shard,
  CAST(pos - ((pos * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p""",
    "op6_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS et,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS er FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length(er) + length(et) + 14) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g""",
    "op8_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM w
), items AS (
  SELECT doc_id, len(grams) AS n, hash(unnest(grams)) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_id AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, len(s.grams) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM sets s JOIN least_id m ON s.doc_id = m.a""",
    "op10_url_filter": """
WITH a AS (
  SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), c AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM b
)
SELECT page_id, host, path, rule, CASE
  WHEN rule = 'example.com/en/7' THEN 'allow'
  WHEN rule IS NOT NULL OR regexp_matches(host, '(^|[.])(spam-farm|cheap-pills|free-bets|adult-x|ads-track)[.]') THEN 'block' ELSE 'allow' END AS verdict
FROM c""",
}
