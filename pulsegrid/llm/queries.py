"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import bfd_packing, decontamination, exact_dedup, lm_scoring, merkle, packing, secret_scan, simhash, token_counts, toxicity, url_filters, warc, whitening
from pulsegrid.llm.common import documents, fresh_path

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call, so every distinct content is encoded once."""
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path(), fresh_path(spark, "token_cache"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.derive_records(warc.responses_of_pages(pages), short=True)  # as the SQL has it


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).drop("row")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_along_curve(documents(spark, sf_dir), tokenizer_path(), with_ids=False)


def _spans(spans) :
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a path with one version; the ledger starts empty, so every distinct blob is scanned once."""
    found = secret_scan.scan_versions(documents(spark, sf_dir), fresh_path(spark, "blob_ledger"), ["doc_id"], "text")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["nth"] < len(secret_scan.BASE_RULES))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(_spans(base), 256).alias("base_sha256"), _spans(F.col("spans")).alias("spans"), "blob_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).drop("row", "component")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.crc32(F.col("label_id").cast("string")) % 5 != 0)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "segments")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", held)
    return lm_scoring.score_documents(docs, ~F.col("held_out"), ["doc_id", "held_out"], order=2)  # the highest that fits the disk budget


def op10_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfd_packing.pack_best_fit(documents(spark, sf_dir), tokenizer_path())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = merkle.lowered_text(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return merkle.manifest(docs, tampered=tampered).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_warc_derivatives, op3_exact_dedup, op4_decontamination, op5_curve_packing, op6_secret_scan, op7_simhash, op8_toxicity, op9_lm_scoring, op10_bfd_packing, op11_whitening, op12_url_filter, op13_merkle_manifest)}
QUERIES["pipeline"] = corpus_pipeline.run

#: Lower-casing of A-Z only; DuckDB's lower() is wider.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _uuid(h: str) -> str:
    return f"'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _sha1(text: str) -> str:
    """Base-32 SHA-1: eight groups of five hex digits give four letters each."""
    value = f"CAST(('0x' || substr(sha1({text}), 5 * i + 1, 5)) AS BIGINT)"
    letters = " || ".join(f"substr('{warc.BASE32}', CAST(({value} >> {k}) & 31 AS INTEGER) + 1, 1)" for k in (15, 10, 5, 0))
    return f"'sha1:' || array_to_string(list_transform(range(0, 8), lambda i: {letters}), '')"


def _plain(html: str) -> str:
    text = html
    for pattern, by in ((warc.HIDDEN, "' '"), (warc.LINES, "chr(10)"), (r"<[^>]*>", "''")):
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    for name, char in warc.NAMED:
        quoted = char.replace("'", "''")
        text = f"replace({text}, '{name.replace(chr(39), chr(39) * 2)}', '{quoted}')"
    text = f"regexp_replace({text}, '[ \\t\\r\\f]+', ' ', 'g')"
    return f"trim(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


_CRLF = "chr(13) || chr(10)"

ORACLE_SQL = {
    "op2_warc_derivatives": f"""
        WITH p AS (SELECT md5(coalesce(CAST(page_id AS VARCHAR), '') || ' ' || coalesce(url, '')) AS h, coalesce(url, '') AS target_uri, coalesce(html, '') AS body FROM pages),
        b AS (SELECT {_uuid('h')} AS refers_to, target_uri, '2024-01-01T00:00:00Z' AS date,
                'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(body) || {_CRLF} || {_CRLF} AS source_header,
                {_sha1('body')} AS payload_digest, trim(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title', 1)) AS title,
                regexp_extract_all(body, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) AS links, {_plain('body')} AS text FROM p),
        d AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, 'title: ' || title || {_CRLF} || 'source-status: 200' || {_CRLF} ||
                coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x || {_CRLF}), ''), '') AS block FROM b
              UNION ALL SELECT *, 'conversion', 'text/plain', text FROM b),
        e AS (SELECT *, md5(record_type || ' ' || refers_to) AS h FROM d)
        SELECT {_uuid('h')} AS record_id, record_type, refers_to, target_uri, date, content_type, CAST(strlen(block) AS BIGINT) AS content_length, {_sha1('block')} AS block_digest,
               payload_digest, source_header, CAST(len(links) AS BIGINT) AS n_links, block FROM e""",
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM d JOIN g USING (norm)""",
    "op4_decontamination": f"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
        starts AS (SELECT item_id, words, unnest(range(1, greatest(len(words) - 13, 0) + 2)) AS i FROM b WHERE len(words) > 0),
        win AS (SELECT item_id, array_to_string(words[i : i + 12], ' ') AS phrase, least(len(words), 13) AS n FROM starts),
        sizes AS (SELECT DISTINCT n FROM win),
        pos AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n),
        grams AS (SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS phrase FROM pos),
        occ AS (SELECT DISTINCT doc_id, i, grams.n, item_id FROM grams JOIN win ON win.phrase = grams.phrase AND win.n = grams.n),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
