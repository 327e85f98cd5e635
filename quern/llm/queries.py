"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.archives import archive_round_trip
from quern.llm.bpe import encode_and_decode
from quern.llm.codes import codebooks_digest, label_errors, quantize
from quern.llm.common import read_table
from quern.llm.decontaminate import decontaminate
from quern.llm.exact_dedup import exact_dedup
from quern.llm.html_text import extract_text
from quern.llm.language_id import identify
from quern.llm.lm_scoring import score_texts
from quern.llm.mixing import mix
from quern.llm.quality import quality_scores
from quern.llm.repeats import repeated_bytes
from quern.llm.simhash import near_dedup
from quern.llm.whitening import whitened_components


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=13)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), holdout=5, threshold=0.3)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), max_epochs=3).drop("source")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(read_table(spark, sf_dir, "documents"), width=200).drop("spans")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"), holdout=3, held=1)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"), holdout=10)


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read_table(spark, sf_dir, "pages"), version=1, min_bytes=0)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = quantize(read_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256.0)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return label_errors(coded.withColumn("code", code)).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(read_table(spark, sf_dir, "embeddings"), components=32)


def op13_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_and_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    listed = F.to_json("ids")  # as one text in brackets, without a string for each id
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.substring(listed, F.lit(2), F.length(listed) - 2), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_dedup, op2_decontamination, op3_quality, op4_mixing, op5_html_extraction, op6_repeated_bytes, op7_language_id, op8_exact_dedup, op9_lm_scoring, op10_warc_archives, op11_vector_codes, op12_whitening, op13_bpe_coding)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op2_decontamination": f"""
WITH items AS (SELECT item_id, w, len(w) AS n, least(13, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
wins AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM items, unnest(range(1, n - k + 2)) AS t(i) WHERE n > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM docs, (SELECT DISTINCT k FROM wins) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
found AS (SELECT r, i, grams.k AS k, item_id FROM grams JOIN wins ON grams.g = wins.g AND grams.k = wins.k),
hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + k)) AS t(j) GROUP BY r),
which AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN which USING (r)""",
    "op4_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS HUGEINT) AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
f AS (SELECT *, CAST(sum(source_size) OVER () AS HUGEINT) AS total, CAST(coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS filled, CAST(sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS weights, row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, rank) AS place FROM r),
o AS (SELECT place, filled, weights FROM f WHERE (total - filled) * weight <= 3 * source_size * weights ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN f.place < o.place THEN CAST(3 * source_size AS DOUBLE) ELSE CAST((total - o.filled) * weight AS DOUBLE) / CAST(o.weights AS DOUBLE) END AS target FROM f, o),
c AS (SELECT d.*, t.source_size, t.target, CAST(round(t.target) AS HUGEINT) AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM c)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - prefix)) AS BIGINT) AS taken FROM e""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_warc_archives": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT) + 1, 1)) AS chars FROM p),
g AS (SELECT page_id, payload_bytes, array_to_string(chars, '') AS payload_digest, max(page_id) OVER (PARTITION BY h) AS best, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS n FROM b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n = 1 THEN NULL ELSE best END AS refers_to FROM g""",
}
