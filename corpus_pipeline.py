"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes the documents that the one before it kept and returns those it keeps, with all their columns; the
last returns the packed pieces.  A stage names its rows by digests of what it judges (the text, or id and text), so
texts are neither copied nor moved: it filters by a checked broadcast of the rejected names, or by Spark's shuffled
join beyond its bound.  Labels are taken from the table ``labels``.

Defined cases: every row is judged by its own text, whether its id is null or shared with other rows; of equal texts
the row with the largest id stays, of a near-duplicate group the one with the smallest (null ids come last, and of
repeats of one row one stays); null texts count as empty, and copies of each other; extra columns, whatever their
names, stay as they are; empty tables give empty results; without labels of both classes, or without benchmark
items, nothing is rejected for them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontamination, exact_dedup, packing, simhash, toxicity
from pulsegrid.llm.common import broadcast_if_small, fresh_name, materialise, text_of

#: Names of rejected rows up to this many (32 bytes each) are broadcast.
BROADCAST_ROWS = 500_000
#: A document scoring at least this is rejected.
TOXIC = 0.5


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a digest of each row's id and text, and that column's name; rows of one name are repeats of one row."""
    row = fresh_name(docs, "row_digest")
    return docs.withColumn(row, F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text_of("text")), 256))), row


def _without(docs: DataFrame, row: str, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows whose names are in ``rejected`` (row)."""
    names = materialise(rejected.select(F.col("row").alias(row)).distinct(), "rejected")
    return docs.join(broadcast_if_small(names, BROADCAST_ROWS), row, "left_anti")


def _once(docs: DataFrame, row: str, found: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose names are in ``kept`` (row) out of all in ``found`` (row); of repeats of one row, one."""
    counted = materialise(found.groupBy("row").agg(F.count(F.lit(1)).alias("n")).join(kept.select("row", F.lit(True).alias("stays")).distinct(), "row", "left"), "names")
    out = _without(docs, row, counted.filter("stays IS NULL"))
    repeated = materialise(counted.filter("stays AND n > 1").select(F.col("row").alias(row)), "repeated")
    if repeated.isEmpty():
        return out.drop(row)
    few = broadcast_if_small(repeated, BROADCAST_ROWS)
    return out.join(few, row, "left_anti").unionByName(out.join(few, row, "left_semi").dropDuplicates([row])).drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model is fitted on all labelled documents of this stage."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh_name(docs, "toxicity_score")
    return toxicity.score(docs, model, score_column=score, segments_column=None).filter(F.col(score) < TOXIC).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id."""
    rows, row = _named(docs)
    found = materialise(exact_dedup.exact_duplicates(rows, row_column=row), "copies")
    return _once(rows, row, found, found.filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    rows, row = _named(docs)
    found = materialise(simhash.near_duplicates(rows, row_column=row), "near")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    return _once(rows, row, found, found.groupBy("component").agg(first).select("first.row"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate; equal texts are judged alike."""
    text = fresh_name(docs, "text_digest")
    named = docs.withColumn(text, F.unhex(F.sha2(text_of("text"), 256)))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(named, items, id_column=text).filter("contaminated")
    return _without(named, text, found.select(F.col("doc_id").alias("row"))).drop(text)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_along_curve(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("curve_packing", pack),
]

#: SQL can't express the toxicity model, the fingerprints and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
