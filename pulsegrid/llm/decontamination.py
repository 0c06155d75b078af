"""Benchmark decontamination on a distributed positional inverted index, in DataFrame functions only.

Test items are cut into windows of consecutive words.  The corpus is counted for the words of those windows, and
each window is looked up from its rarest words: only their postings are stored - word, row, position, and the
words around that position - in files that stay where their documents were read.  The offset-adjusted lists of a
window's rarest words are intersected on (window, row, start); what is left is compared word by word with the
stored neighbourhood, so a match is exact.  Texts are not shuffled while the items' words can be broadcast, and no
group is larger than one document.

Documents are read once: their words are written with a number for each row, and all else goes by that number.
Words are runs of letters, digits and all non-ASCII characters, after lower-casing A-Z.

Defined cases: null texts have no words; items without words match nothing; an item of a null id hits words but is
no item that is listed; repeated rows, rows that share an id and rows of a null id are judged each by its own text;
empty tables give empty results, and without items nothing is contaminated; other columns of the inputs are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import ascii_lower, broadcast_if_small, is_small, materialise, text_of

#: Runs of characters that are in no word, once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Lists that are intersected for each window before the words are compared.
RAREST = 2
#: Tables about the test items are broadcast up to so many rows (about 100 bytes each); beyond, joins shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: str | Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text_of(text)), SEPARATORS), "")


def document_words(docs: DataFrame, id_column: str, text_column: str, row_column: str | None) -> DataFrame:
    """(row, doc_id, n_words, joined): each row's words, joined by spaces; ``row_column`` numbers rows, else they get numbers here."""
    row = F.col(row_column) if row_column else F.monotonically_increasing_id()
    split = docs.select(row.alias("row"), F.col(id_column).alias("doc_id"), words_of(text_column).alias("words"))
    return materialise(split.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("joined")), "words", "zstd")


def _split(words: DataFrame) -> DataFrame:
    return words.filter("n_words > 0").select("row", "doc_id", F.split("joined", " ").alias("words"))


def item_windows(items: DataFrame, item_column: str, text_column: str, window: int) -> DataFrame:
    """(item_id, at, phrase): windows of ``window`` words, or one shorter window for a shorter item."""
    words = items.select(F.col(item_column).alias("item_id"), words_of(text_column).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    return words.select("item_id", "words", F.explode(starts).alias("at")).select(
        "item_id", "at", F.slice("words", F.col("at") + 1, window).alias("phrase")
    )


def corpus_frequencies(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, frequency) of the given terms over all words of all documents; 0 for those that never occur."""
    tokens = _split(words).select(F.explode("words").alias("term"))
    seen = tokens.join(broadcast_if_small(terms, BROADCAST_ROWS), "term").groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("frequency", F.lit(0)).alias("frequency"))


def rarest_terms(phrases: DataFrame, frequencies: DataFrame, rarest: int) -> DataFrame:
    """(phrase_id, phrase, term, shift, lists): for each phrase its rarest terms, each at its first place in it."""
    places = phrases.select("phrase_id", "phrase", F.posexplode("phrase").alias("shift", "term"))
    first = places.groupBy("phrase_id", "term").agg(F.min("shift").alias("shift"), F.any_value("phrase").alias("phrase"))
    by_rarity = Window.partitionBy("phrase_id").orderBy("frequency", "term")
    ranked = first.join(frequencies, "term").withColumn("nth", F.row_number().over(by_rarity)).filter(F.col("nth") <= rarest)
    size = F.count(F.lit(1)).over(Window.partitionBy("phrase_id"))
    return ranked.select("phrase_id", "phrase", "term", "shift", size.alias("lists"))


def build_postings(words: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """The stored index (term, row, doc_id, pos, around, lead): the postings of ``terms`` over all documents.

    ``around`` holds the words from ``lead`` before ``pos`` to ``reach`` - 1 after it.  Terms that can be broadcast
    are met where the documents are read; beyond that bound (row, position, term) alone move to the terms, and
    each text then meets the places of its row once.
    """
    wanted = terms.select("term").distinct()
    if is_small(wanted, BROADCAST_ROWS):
        hit = _split(words).select("row", "doc_id", "words", F.posexplode("words").alias("pos", "term")).join(F.broadcast(wanted), "term")
    else:
        places = _split(words).select("row", F.posexplode("words").alias("pos", "term")).join(wanted, "term")
        by_row = places.groupBy("row").agg(F.collect_list(F.struct("pos", "term")).alias("places"))
        met = _split(words).join(by_row, "row").select("row", "doc_id", "words", F.explode("places").alias("at"))
        hit = met.select("row", "doc_id", "words", "at.pos", "at.term")
    lead = F.least(F.col("pos"), F.lit(reach - 1))
    around = F.slice("words", F.col("pos") - lead + 1, lead + reach)
    return materialise(hit.select("term", "row", "doc_id", "pos", around.alias("around"), lead.alias("lead")), "postings")


def phrase_matches(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """(phrase_id, row, doc_id, start, length): all exact occurrences, by intersecting offset-adjusted lists."""
    adjusted = postings.join(broadcast_if_small(anchors, BROADCAST_ROWS), "term").withColumn("start", F.col("pos") - F.col("shift"))
    from_word = F.col("lead") - F.col("shift") + 1  # of the neighbourhood, counted from 1
    exact = (F.col("start") >= 0) & (F.slice("around", F.greatest(from_word, F.lit(1)), F.size("phrase")) == F.col("phrase")) & (from_word > 0)
    lists = adjusted.filter(exact).groupBy("phrase_id", "row", "start").agg(
        F.count_distinct("term").alias("met"), F.any_value("lists").alias("lists"), F.any_value(F.size("phrase")).alias("length"), F.any_value("doc_id").alias("doc_id")
    )
    return lists.filter(F.col("met") == F.col("lists")).select("phrase_id", "row", "doc_id", "start", "length")


def proximity_matches(postings: DataFrame, anchors: DataFrame, span: int) -> DataFrame:
    """(phrase_id, row, doc_id, start, stop): places where all of a phrase's rarest terms stand within ``span`` words."""
    near = Window.partitionBy("phrase_id", "row").orderBy("pos").rangeBetween(0, span - 1)
    placed = postings.join(broadcast_if_small(anchors, BROADCAST_ROWS), "term").select("phrase_id", "row", "doc_id", "pos", "term", "lists")
    met = placed.select(
        "phrase_id", "row", "doc_id", F.col("pos").alias("start"), F.max("pos").over(near).alias("stop"), "lists",
        F.size(F.array_distinct(F.collect_list("term").over(near))).alias("met"),
    )
    return met.filter(F.col("met") == F.col("lists")).select("phrase_id", "row", "doc_id", "start", "stop").distinct()


class BenchmarkIndex:
    """The windows of the items, and the postings of their rarest words in the documents."""

    def __init__(
        self, docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST, id_column: str = "doc_id",
        text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", row_column: str | None = None,
    ) -> None:
        self.words = document_words(docs, id_column, text_column, row_column)
        windows = item_windows(items, item_column, item_text_column, window)
        named = windows.withColumn("phrase_id", F.sha2(F.array_join("phrase", " "), 256))
        self.phrase_items = materialise(named.select("phrase_id", "item_id").distinct(), "phrase_items")
        phrases = materialise(named.select("phrase_id", "phrase").dropDuplicates(["phrase_id"]), "phrases")
        terms = materialise(phrases.select(F.explode("phrase").alias("term")).distinct(), "terms")
        frequencies = materialise(corpus_frequencies(self.words, terms), "frequencies")
        self.anchors = materialise(rarest_terms(phrases, frequencies, rarest), "anchors")
        occurring = self.anchors.join(frequencies.filter("frequency > 0"), "term", "left_semi")
        self.postings = build_postings(self.words, occurring, window)

    def phrases(self) -> DataFrame:
        return phrase_matches(self.postings, self.anchors)

    def near(self, span: int) -> DataFrame:
        return proximity_matches(self.postings, self.anchors, span)


def covered(spans: Column) -> Column:
    """Number of positions inside the union of (start, length) spans that are sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["start"] + s["length"] - F.greatest(s["start"], acc["end"]), F.lit(0))).cast("long").alias("n"),
        F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
    )
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, rarest: int = RAREST, id_column: str = "doc_id",
    text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", row_column: str | None = None,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated, row), one row for each row of ``docs``.

    A word is hit inside any occurrence of a window; a document with 1 / ``share`` of its words hit is contaminated.
    ``row`` is ``row_column`` (a number of its own for each row) where that is given, else a number given here.
    """
    index = BenchmarkIndex(docs, items, window, rarest, id_column, text_column, item_column, item_text_column, row_column)
    found = materialise(index.phrases(), "occurrences")
    hits = found.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    names = found.select("row", "phrase_id").distinct().join(broadcast_if_small(index.phrase_items, BROADCAST_ROWS), "phrase_id")
    named = names.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    by_row = hits.join(named, "row").select("row", covered(F.col("spans")).alias("n_hit"), "items")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return index.words.select("row", "doc_id", "n_words").join(by_row, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), "row",
    )
