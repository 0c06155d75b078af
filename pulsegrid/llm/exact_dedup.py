"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so, so equal stretches are cut alike wherever they stand.  Each chunk gets a
64-bit identifier, verified against the chunk's SHA-256: chunks that share 64 bits but not the digest get an
ordinal beside them.  A document is then its ordered list of identifiers (its recipe); equal recipes are equal
texts.  Texts are read once and never shuffled: only identifiers move.

Defined cases: null text counts as empty, and the recipe of an empty text is the empty list; of equal texts the row
with the largest id stays (null ids come last), of repeats of that row one; an empty table gives an empty result;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import ascii_lower, materialise, text_of

#: A chunk has MIN_CHUNK to MAX_CHUNK characters and ends after three characters of these classes, else at the maximum.
MIN_CHUNK, MAX_CHUNK = 256, 4096
BOUNDARY = "[aeinortu.][ ,\n\r\t][a-h0-9]"


def chunks_of(text: Column, smallest: int = MIN_CHUNK, largest: int = MAX_CHUNK, boundary: str = BOUNDARY) -> Column:
    """The chunks of a text; joined they give the text again.  Cuts depend on the content near them alone."""
    pattern = f"(?s).{{{smallest},{largest - 3}}}?{boundary}|.{{1,{largest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, id_column: str, text_column: str, id_bits: int = 64, row_column: str | None = None) -> DataFrame:
    """(row, doc_id, text_sha256, recipe): recipe is the ordered list of verified chunk identifiers.

    ``id_bits`` below 64 weakens the identifiers, so that tests meet collisions.  ``row_column`` numbers the rows;
    without it they get numbers here.
    """
    norm = ascii_lower(text_of(text_column))
    keep = (1 << id_bits) - 1 if id_bits < 64 else -1
    number = F.col(row_column) if row_column else F.monotonically_increasing_id()
    cut = docs.select(number.alias("row"), F.col(id_column).alias("doc_id"), norm.alias("norm")).select(
        "row",
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(
            chunks_of(F.col("norm")),
            lambda c: F.struct(F.xxhash64(c).bitwiseAND(F.lit(keep)).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest")),
        ).alias("chunks"),
    )
    cut = materialise(cut, "recipes")
    store = cut.select(F.explode("chunks").alias("c")).select("c.*").distinct()
    clashing = materialise(
        store.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("digest")).alias("digests")).filter("n > 1"), "clashes"
    )
    if clashing.isEmpty():  # each identifier stands for one content
        return cut.select("row", "doc_id", "text_sha256", F.transform("chunks", lambda c: F.struct(c["id"].alias("id"), F.lit(0).alias("nth"))).alias("recipe"))
    pieces = cut.select("doc_id", "text_sha256", "row", F.posexplode_outer("chunks").alias("pos", "c"))
    named = pieces.join(clashing, F.col("c.id") == clashing["id"], "left").select(
        "row", "doc_id", "text_sha256", "pos",
        F.struct(F.col("c.id").alias("id"), F.coalesce(F.array_position("digests", F.col("c.digest")), F.lit(1)).cast("int").alias("nth")).alias("part"),
    )
    named = named.withColumn("part", F.col("part").withField("nth", F.col("part.nth") - 1))
    listed = named.groupBy("row", "doc_id", "text_sha256").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("part.id").isNotNull(), F.struct("pos", "part")))), lambda x: x["part"]).alias("recipe")
    )
    return listed.select("row", "doc_id", "text_sha256", "recipe")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", id_bits: int = 64, row_column: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, row), one row for each row of ``docs``.

    ``row`` is ``row_column`` (a number of its own for each row) where that is given, else a number given here.

    Groups are counted before the shuffle, written, and only those of two or more are joined back; that join has
    plain exchanges on both sides, which adaptive execution splits where a group is large.
    """
    rows = recipes(docs, id_column, text_column, id_bits, row_column)
    sizes = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(sizes.filter("group_size > 1"), "groups")
    joined = rows.join(groups, "recipe", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep.row"))).alias("kept"), "text_sha256", "row",
    )
