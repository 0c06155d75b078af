"""Token counts through a digest cache.

Each text is keyed by the SHA-256 of its normalised content and each tokenizer by the SHA-256 of its file.  Counts
already stored under both are joined; only the distinct contents that miss are encoded, and their counts are
appended to the cache for later runs.  Normalisation (CR LF to LF, outer ASCII white space off) leaves the number
of tokens as it is for tokenizers that drop white space; for others the content is keyed unchanged.

Defined cases: a null text counts as empty (0 tokens); repeated rows give a row each; an empty table gives an empty
result; other columns of the input are ignored, whatever their names; texts of any length are encoded whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.blobs import content_digest, open_ledger, unseen
from pulsegrid.llm.common import materialise, prepare, text_of
from pulsegrid.llm.tokenization import encoder, splits_at_spaces, tokenizer_digest

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"


def normalised(text, drops_space: bool):
    """Content under which counts are stored."""
    return F.trim(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit(" \t\n\r\f\v")) if drops_space else text


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache_path: str, max_tokens: int = 2048, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit, content_digest), one for each row of ``docs``.

    ``cache_path`` is a Parquet folder that driver and executors share; it is created if missing and appended to.
    """
    spark = docs.sparkSession
    prepare(spark)
    version = tokenizer_digest(tokenizer_path)
    with open(tokenizer_path, encoding="utf-8") as f:
        drops_space = splits_at_spaces(json.load(f))
    text = text_of(text_column)
    norm = normalised(text, drops_space)
    keyed = docs.select(content_digest(norm).alias("content_digest"), norm.alias("content"))
    schema = spark.createDataFrame([], CACHE_SCHEMA).schema

    def stored() -> DataFrame:
        return open_ledger(spark, cache_path, schema).filter(F.col("tokenizer_digest") == version)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in batches:
            counts = pa.array(enc.counts(b.column("content").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("content_digest"), pa.array([version] * b.num_rows, pa.string()), counts], names=schema.names)

    misses = unseen(keyed, "content_digest", "content", stored())
    misses.mapInArrow(encode, schema).write.mode("append").parquet(cache_path)
    # two runs may have appended alike; written, so that the join's exchanges can be split where a content is frequent
    counts = materialise(stored().groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    light = docs.select(
        F.col(id_column).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), content_digest(norm).alias("content_digest")
    )
    return light.join(counts, "content_digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"), "content_digest"
    )
