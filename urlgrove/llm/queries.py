"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, dialogues, fill_middle, fixity, line_runs, near_duplicates, packing, passages, rendezvous, resampling, topk, training_order, transport_stream
from .store import Scratch, pick, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    byte_bpe.check_ranks(path, vocabulary("byte_bpe_50k.tiktoken"))
    docs = pick(table(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string"})
    done = byte_bpe.round_trip(docs, path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_chars", "n_split", "offsets_crc32", "n_slices")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.digests(transport_stream.read_back(transport_stream.store(table(spark, sf_dir, "documents"))))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_spans(table(spark, sf_dir, "documents"), Scratch(spark, "passages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.repeated_runs(table(spark, sf_dir, "documents"), Scratch(spark, "lines"), min_lines=1)


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def damaged(archived: DataFrame) -> DataFrame:
    """A second replica: in every record of a page whose id leaves 13 modulo 97 the last byte has become a zero."""
    spoilt = F.concat(F.expr("substring(record, 1, length(record) - 1)"), F.lit("0"))
    return archived.withColumn("record", F.when(F.col("page_id") % 97 == 13, spoilt).otherwise(F.col("record")))


def op8_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    archived = fixity.archive(table(spark, sf_dir, "pages"))
    return fixity.audit(fixity.hashed(archived), fixity.hashed(damaged(archived)))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op11_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equal weight, and where each record goes when a ninth joins."""
    return rendezvous.sharded(table(spark, sf_dir, "documents"), {s: 1.0 for s in range(8)}, {8: 1.0}, Scratch(spark, "shards"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.repair(table(spark, sf_dir, "conversations"), Scratch(spark, "dialogues"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_best_fit_packing, op3_media_columns, op4_substring_dedup, op5_line_dedup,
        op6_training_order, op7_exact_top_k, op8_fixity_audit, op9_importance_resampling, op10_near_duplicates,
        op11_rendezvous_shards, op12_conversation_repair, op13_fill_in_middle,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_top_k": """
WITH x AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 64) AS BIGINT)) AS vec
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(range(1, len(q.vec) + 1), lambda i: q.vec[i] * c.vec[i])) AS BIGINT) AS score
      FROM x q JOIN x c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.vec) = len(c.vec))
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 20
""",
    "op8_fixity_audit": """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
i AS (SELECT *, md5(concat_ws('|', CAST(page_id AS VARCHAR), url, md5(html))) AS id, chr(13) || chr(10) AS nl FROM p),
n AS (SELECT page_id, id, concat('WARC/1.0', nl, 'WARC-Type: resource', nl, 'WARC-Record-ID: <urn:uuid:', regexp_replace(id, '^(.{8})(.{4})(.{4})(.{4})', '\\1-\\2-\\3-\\4-'), '>', nl,
          'WARC-Date: 2024-01-01T00:00:00Z', nl, 'WARC-Target-URI: ', url, nl, 'Content-Type: text/html', nl, 'Content-Length: ', CAST(strlen(html) AS VARCHAR), nl, nl, html, nl, nl) AS record FROM i),
f AS (SELECT page_id, record, CAST(concat('0x', substr(id, 1, 8)) AS BIGINT) % (SELECT greatest(1, CAST(ceil(count(*) / 1000.0) AS BIGINT)) FROM p) AS file,
        substr(id, 9) || substr(id, 1, 8) AS key, count(*) AS copies FROM n GROUP BY ALL),
o AS (SELECT *, CAST(strlen(record) * copies AS BIGINT) AS size, CAST(sum(strlen(record) * copies) OVER (PARTITION BY file ORDER BY key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM f)
SELECT file, key, "end" - size AS "start", "end", sha256(record) AS digest_a, sha256(concat(substr(record, 1, length(record) - 1), '0')) AS digest_b, copies AS copies_a, copies AS copies_b
FROM o WHERE page_id % 97 = 13
""",
    # CRC-32 byte by byte over a table of its polynomial's remainders
    "op11_rendezvous_shards": """
WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS tab),
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hx FROM documents),
c AS (SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, CAST(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT))),
        lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]))) AS BIGINT) AS text_crc32 FROM d, t),
w AS (SELECT *, list_transform(range(9), lambda s: -1.0 / ln((CAST('0x' || substr(md5('11:' || CAST(s AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)) AS offers FROM c),
p AS (SELECT doc_id, size, text_crc32, CAST(list_position(offers[1:8], list_max(offers[1:8])) - 1 AS INTEGER) AS shard, CAST(list_position(offers, list_max(offers)) - 1 AS INTEGER) AS grown_shard FROM w)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM p
""",
    "op13_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, CAST(len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS n, list_transform(range(4), lambda k: CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT)) AS hs FROM d),
k AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
c AS (SELECT *, CASE WHEN a = 0 THEN 0 WHEN a = n THEN length(text) ELSE length(array_to_string(parts[1:a], chr(10))) + 1 END AS pa, CASE WHEN b = 0 THEN 0 WHEN b = n THEN length(text) ELSE length(array_to_string(parts[1:b], chr(10))) + 1 END AS pb FROM k),
x AS (SELECT *, substr(text, 1, pa) AS pre, substr(text, pa + 1, pb - pa) AS mid, substr(text, pb + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(pa AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(pb - pa AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM x
""",
}
