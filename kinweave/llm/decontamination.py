"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions alone.

The index has a posting (term, document row, position) for every place of the training texts that has a term of the
tests, and is stored in the shared folder. A test passage is a window of consecutive words of an item. Its terms are
taken from the rarest in the index on: the positions of the rarest, less its offset in the window, are where the window
may begin, and the lists of the next ones, adjusted by their offsets, are intersected with these (LISTS lists in all).
What is left is compared word for word with the text, so matches are exact. `proximity` finds where the rarest terms of
an item occur together within a span, in any order.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased.

Defined results: a null or empty text has no words and is clean; an item without words has no windows; repeated
documents, keys and items are judged each for itself (items of one id are one in the lists of items); a null key passes
through; with no items every document is clean. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Posting lists that are intersected before the words are compared.
LISTS = 3
#: Most rows of distinct test terms, or of places of these in windows, that are broadcast: numbers alone, of 40 bytes at
#: most. Beyond these Spark joins by shuffle, the rows of a term dealt over SALTS parts.
SMALL_ROWS, SALTS = 200_000, 16

#: Stands after the last word of each row; no word is empty. Its place is the number of words.
END = ""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)


def by_term(left: DataFrame, right: DataFrame, n_right: int, spread: Column, how: str = "inner") -> DataFrame:
    """left joined on term with right, which is broadcast if it has few rows; else a term's rows of left are dealt over
    SALTS parts by `spread`, so that none has all rows of a frequent one."""
    if n_right <= SMALL_ROWS:
        return left.join(F.broadcast(right), "term", how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(right.select("*", salts), ["term", "_salt"], how).drop("_salt")


def few(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if it has so few rows of numbers, which are counted."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def items_of(items: DataFrame, size: int, item: str, text: str) -> DataFrame:
    """(item, window, words) of all windows of each item: a hash of the words, and the words."""
    split = items.select(F.col(item).cast("string").alias("item"), word_array(F.col(text)).alias("all")).filter(F.size("all") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))).alias("at")
    return split.select("item", "all", at).select("item", F.slice("all", F.col("at"), size).alias("words")).withColumn("window", F.xxhash64("words"))


def row_of(key: str, text: str) -> Column:
    """Tells rows of different key or text apart; equal rows have equal results."""
    return F.xxhash64(F.col(key), F.col(text)).alias("row")


def rows_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, all): the words of each row, and END."""
    return docs.select(row_of(key, text), F.array_append(word_array(F.col(text)), F.lit(END)).alias("all"))


def postings(rows: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, row, pos) of all places of the given terms (a hash of the word) in rows."""
    placed = rows.select("row", F.posexplode("all").alias("pos", "word")).select(F.xxhash64("word").alias("term"), "row", "pos")
    return by_term(placed, terms, n_terms, F.col("row"), "left_semi")


def rarest(places: DataFrame, counts: DataFrame, n_counts: int, group: str) -> DataFrame:
    """(group, rank, term, offset): the LISTS rarest terms of each group of places (group, term, offset), the rarest
    first. A group with a term that the index lacks occurs nowhere and is left out."""
    rank = Window.partitionBy(group).orderBy("n", "term", "offset")
    every = Window.partitionBy(group)
    joined = by_term(places, counts, n_counts, F.col(group), "left").withColumn("lost", F.max(F.col("n").isNull()).over(every)).filter(~F.col("lost"))
    return joined.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= LISTS).select(group, "rank", "term", "offset")


def intersected(index: DataFrame, rare: DataFrame, n_rare: int) -> DataFrame:
    """(window, row, start) where the rarest terms of a window all stand at their offsets."""
    found = None
    for rank in range(1, LISTS + 1):
        terms = rare.filter(F.col("rank") == rank).select("window", "term", "offset")
        if found is None:
            starts = by_term(index, terms, n_rare, F.col("row")).select("window", "row", (F.col("pos") - F.col("offset")).alias("start"))
            found = starts.filter("start >= 0")
            continue
        # only lists of this rank's terms are moved; a window of fewer terms than lists stays as it is
        lists = by_term(index, terms.select("term").distinct(), n_rare, F.col("row"), "left_semi")
        longer = found.join(few(terms, n_rare), "window", "left")
        asked = longer.filter("term is not null").withColumn("pos", F.col("start") + F.col("offset"))
        kept = asked.join(lists, ["row", "term", "pos"], "left_semi").select("window", "row", "start")
        found = kept.unionByName(longer.filter("term is null").select("window", "row", "start"))
    return found


def near(index: DataFrame, rare: DataFrame, n_rare: int, span: int) -> DataFrame:
    """(window, row, pos) where the rarest terms of a window all stand within `span` words of the rarest of them."""
    found = None
    for rank in range(1, LISTS + 1):
        terms = rare.filter(F.col("rank") == rank).select("window", "term")
        if found is None:
            found = by_term(index, terms, n_rare, F.col("row")).select("window", "row", "pos")
            continue
        cell = F.floor(F.col("pos") / span)
        lists = by_term(index, terms.select("term").distinct(), n_rare, F.col("row"), "left_semi").select("row", "term", F.col("pos").alias("at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
        longer = found.join(few(terms, n_rare), "window", "left")
        asked = longer.filter("term is not null").withColumn("cell", cell)
        close = (asked["row"] == lists["row"]) & (asked["term"] == lists["term"]) & (asked["cell"] == lists["cell"]) & (F.abs(F.col("pos") - F.col("at")) <= span)
        kept = asked.join(lists, close, "left_semi").select("window", "row", "pos")
        found = kept.unionByName(longer.filter("term is null").select("window", "row", "pos"))
    return found


class Index:
    """The postings of END and of the words of rows that occur in the items' windows, and each window's rarest. Words of
    rows, which are as long as their texts, are not stored."""

    def __init__(self, rows: DataFrame, items: DataFrame):
        every = stored(items, "items")
        self.items = every.select("window", "item")
        self.windows = stored(every.select("window", "words").dropDuplicates(["window", "words"]), "windows")
        words = self.windows.select("window", F.posexplode("words").alias("offset", "word")).select("window", "offset", F.xxhash64("word").alias("term"))
        end = self.items.sparkSession.range(1).select(F.xxhash64(F.lit(END)).alias("term"))
        terms = stored(words.select("term").unionByName(end).distinct(), "terms")
        n_terms = terms.count()
        self.index = stored(postings(rows, terms, n_terms), "postings")
        self.rare = stored(rarest(words, self.index.groupBy("term").agg(F.count("*").alias("n")), n_terms, "window"), "rare")
        self.n_rare = self.rare.count()

    def lengths(self) -> DataFrame:
        """(row, n_words) of every row."""
        return self.index.filter(F.col("term") == F.xxhash64(F.lit(END))).groupBy("row").agg(F.max("pos").cast("long").alias("n_words"))

    def phrases(self) -> DataFrame:
        return intersected(self.index, self.rare, self.n_rare)

    def proximity(self, span: int) -> DataFrame:
        return near(self.index, self.rare, self.n_rare, span)


def proximity(docs: DataFrame, items: DataFrame, span: int = 26, size: int = 13, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, pos): where the rarest terms of a window of an item stand within `span` words of the rarest one."""
    found = Index(rows_of(docs, key, text), items_of(items, size, item, item_text))
    places = found.proximity(span).join(found.items, "window").select("row", "pos", "item")
    return docs.select(row_of(key, text), key).join(places.distinct(), "row").select(key, "item", "pos")


def judged(
    docs: DataFrame, items: DataFrame, size: int = 13, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per row of docs: key, n_words, n_hit (words inside any match), n_items, items_sha256, contaminated (some word is
    hit, and a twentieth of all), and the columns of `keep`, whose names must differ from these.

    A row carries the places and the words of what is asked of it; items are joined to the windows that are confirmed."""
    found = Index(rows_of(docs, key, text), items_of(items, size, item, item_text))
    places = found.phrases().distinct().join(found.windows, "window")
    asked = places.groupBy("row").agg(F.collect_list(F.struct("start", F.size("words").alias("length"), "window", "words")).alias("asked"))
    # texts move once; only those with places are split into words again, once each: as the argument of a function they
    # are not split anew for each place
    kept = [F.struct(*keep).alias("kept")] if keep else []
    texts = docs.select(row_of(key, text), F.col(key), F.col(text).alias("text"), *kept)
    read = texts.join(found.lengths().join(asked, "row", "left"), "row")
    standing = lambda words: F.filter("asked", lambda a: F.slice(words, a["start"] + 1, a["length"]) == a["words"])
    confirmed = F.when(F.col("asked").isNotNull(), F.transform(F.array(word_array(F.col("text"))), standing)[0])
    hits = F.coalesce(confirmed, F.array().cast(read.schema["asked"].dataType))
    spots = F.transform(F.array_sort(hits), lambda a: F.struct(a["start"].alias("start"), a["length"].alias("length"), a["window"].alias("window")))
    # places of matches in order: each adds what lies beyond the end of those before it
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, h: F.struct(
        (acc["n"] + F.greatest(F.lit(0), h["start"] + h["length"] - F.greatest(acc["end"], h["start"]))).alias("n"), F.greatest(acc["end"], h["start"] + h["length"]).alias("end")
    )
    others = ["kept"] if keep else []
    read = read.select("row", key, *others, "n_words", spots.alias("hits"))
    counted = stored(read.select("row", key, *others, "n_words", F.aggregate("hits", none, step)["n"].cast("long").alias("n_hit"), F.array_distinct(F.transform("hits", lambda h: h["window"])).alias("windows")), "judged")
    # equal rows have the same windows, so that one of them stands for all
    hit = counted.filter(F.size("windows") > 0).select("row", F.explode("windows").alias("window")).distinct()
    lists = hit.join(found.items, "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    done = counted.join(lists, "row", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    return done.select(
        key,
        "n_words",
        "n_hit",
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
        *(F.col(f"kept.{c}").alias(c) for c in keep),
    )
