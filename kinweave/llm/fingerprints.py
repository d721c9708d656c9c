"""SimHash fingerprints of whole texts, and search of all fingerprints within a Hamming radius.

Every run of SHINGLE words is a term; its 64-bit hash votes with the term's weight, the number of characters of its
first word up to HEAVIEST, and a fingerprint has the bits that get more than half of all votes. Two votes are counted in
one long, 32 bits apart, so 32 sums count 64 bits. All of it is DataFrame functions.

Search uses permuted block tables: a fingerprint has BLOCKS blocks, and two that differ in `radius` bits at most agree
in BLOCKS - radius blocks at least; one table for each choice of so many blocks is an equal-key join.

Defined results: a null text is an empty one, and an empty text has the fingerprint of the empty word; a text of fewer
words than a shingle is one term; equal texts have equal fingerprints; rows of equal or null keys are rows of their own
(null last, ties by a hash of the text); of one row alone the next is itself; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHINGLE, HEAVIEST = 5, 15
BLOCKS = [(53, 11), (42, 11), (31, 11), (20, 11), (10, 10), (0, 10)]
#: The pairs of bits (j, j + 32) that one sum counts.
_PAIR = (1 << 32) | 1
#: Bytes of text of a neighbourhood of adjacent keys.
HOOD_BYTES = 32 << 20


def word_array(text: Column) -> Column:
    return F.split(text, r"[\x20\x09-\x0D]+")


def vote_sums(words: Column, at: Column) -> list[Column]:
    """32 sums over the terms that begin at each place, and the sum of their weights."""
    term = F.xxhash64(*(F.get(words, at + F.lit(k)) for k in range(SHINGLE)))
    weight = F.greatest(F.lit(1), F.least(F.lit(HEAVIEST), F.length(F.get(words, at)))).cast("long")
    return [F.sum(F.shiftrightunsigned(term, j).bitwiseAND(F.lit(_PAIR)) * weight).alias(f"v{j}") for j in range(32)] + [F.sum(weight).alias("votes")]


def fingerprint_bits() -> Column:
    """The fingerprint from the sums."""
    out = F.lit(0).cast("long")
    for j in range(32):
        for up, count in ((0, F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF))), (32, F.shiftrightunsigned(F.col(f"v{j}"), 32))):
            bit = 1 << (j + up)
            out = out.bitwiseOR(F.when(count * 2 > F.col("votes"), F.lit(bit - (1 << 64) if bit >> 63 else bit)).otherwise(F.lit(0)).cast("long"))
    return out


def terms(df: DataFrame, words: str, keep: list[str]) -> DataFrame:
    """Each row of df once for every place at which a term of its words begins."""
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    return df.select(*keep, words, F.explode(F.sequence(F.lit(0), last)).alias("at"))


def fingerprints(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Keys, which must tell rows apart, and the fingerprint of each text as a long."""
    split = df.select(*keys, word_array(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    return terms(split, "words", keys).groupBy(*keys).agg(*vote_sums(F.col("words"), F.col("at"))).select(*keys, fingerprint_bits().alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the share of differing bits stands for; 0 from half of the bits on."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * F.lit(3.141592653589793 / 64)))


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def in_neighbourhoods(df: DataFrame, key: str, text: str) -> DataFrame:
    """df by neighbourhoods of adjacent keys: place (descending keys) in its neighbourhood, and the text of the row next
    in the whole table. `extra` marks a copy of the row that follows a neighbourhood; after the last comes the first.

    Neighbourhoods are the parts of a range partitioning of about HOOD_BYTES each, stored so that all steps see the same
    ones. Of equal and null keys the hash of the text, and of equal rows their place in the scan, parts them further."""
    docs = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.desc_nulls_last(key), F.col("_by"), F.col("_nth")]
    placed = docs.withColumn("_by", F.xxhash64("text")).withColumn("_nth", F.monotonically_increasing_id()).repartitionByRange(max(4 * partitions, -(-size // HOOD_BYTES)), *order)
    rows = stored(placed.withColumn("hood", F.spark_partition_id()), "hoods")
    first = F.min_by(F.struct(F.col(key), "text"), F.struct(F.col(key).isNull(), F.negative(key), "_by", "_nth"))
    heads = stored(rows.groupBy("hood").agg(first.alias("head")), "heads")
    ids = sorted(r[0] for r in heads.select("hood").collect())  # as many as neighbourhoods
    after = df.sparkSession.createDataFrame([(ids[i - 1], hood) for i, hood in enumerate(ids)], "to int, hood int")
    extras = heads.join(after, "hood").select(F.col("to").alias("hood"), F.lit(1).alias("extra"), f"head.{key}", "head.text", F.lit(0).cast("long").alias("_by"), F.lit(0).cast("long").alias("_nth"))
    both = rows.select("hood", F.lit(0).alias("extra"), key, "text", "_by", "_nth").unionByName(extras)
    w = Window.partitionBy("hood").orderBy("extra", *order)
    return both.select("hood", "extra", key, "text", F.row_number().over(w).alias("place"), F.lead("text").over(w).alias("next"))


def with_edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: n_chars, edited_sha256, fingerprints (longs) of its text, of the edited text and of the next text.

    Terms are counted inside the partition that holds a neighbourhood, so texts are shuffled once."""
    hoods = in_neighbourhoods(df, key, text)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.coalesce("next", F.lit("")), F.lit(1), third))
    own = ["hood", "place", "extra", key]
    sides = hoods.withColumn("edited", edited).select(
        *own, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("s")
    )
    sides = sides.select(*own, F.col("s.side").alias("side"), F.length("s.t").alias("n"), F.sha2("s.t", 256).alias("sha"), word_array(F.col("s.t")).alias("words"))
    keep = [*own, "side", "n", "sha"]
    # n and sha are keys, not aggregates: an aggregate of strings would sort the terms together with their words
    prints = terms(sides, "words", keep).groupBy(*keep).agg(*vote_sums(F.col("words"), F.col("at"))).select(*keep, fingerprint_bits().alias("bits"))
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    rows = prints.groupBy(*own).agg(pick(0, "n").alias("n_chars"), pick(1, "sha").alias("edited_sha256"), pick(0, "bits").alias("bits"), pick(1, "bits").alias("edited_bits"))
    w = Window.partitionBy("hood").orderBy("place")
    return rows.withColumn("next_bits", F.lead("bits").over(w)).filter("extra = 0").drop("hood", "place", "extra")


def tables(radius: int) -> list[tuple[int, int, int]]:
    """For each choice of len(BLOCKS) - radius blocks: number, mask of these blocks, and the last one."""
    masks = [((1 << width) - 1) << low for low, width in BLOCKS]
    return [(i, sum(masks[b] for b in c), c[-1]) for i, c in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - radius))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (query, bits, distance) of fingerprints of `queries` and distinct ones of `prints` (both in a column bits).

    A pair is taken from the first table that has it alone: that of the first blocks in which the two agree."""
    of = F.array(*(F.struct(F.lit(i).alias("no"), F.lit(signed(m)).alias("mask"), F.lit(last).alias("last")) for i, m, last in tables(radius)))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("bits").alias(name)).distinct().withColumn("t", F.explode(of)).select(name, F.col("t.no").alias("no"), F.col("t.last").alias("last"), F.col("t.mask").bitwiseAND(F.col(name)).alias("part"))

    differ = F.col("bits").bitwiseXOR(F.col("query"))
    agree = [F.when(differ.bitwiseAND(F.lit(signed(((1 << width) - 1) << low))) == 0, 1).otherwise(0) for low, width in BLOCKS]
    before = sum((F.when(F.lit(i) <= F.col("l.last"), a).otherwise(0) for i, a in enumerate(agree)), F.lit(0))
    left, right = keyed(queries, "query").alias("l"), keyed(prints, "bits").alias("r")
    meets = (F.col("l.no") == F.col("r.no")) & (F.col("l.part") == F.col("r.part")) & (F.bit_count(differ) <= radius) & (before == len(BLOCKS) - radius)
    return left.join(right, meets).select("query", "bits", F.bit_count(differ).alias("distance"))


def near_counts(rows: DataFrame, is_query: Column, radius: int = 3) -> DataFrame:
    """rows (with bits) and n_near: for query rows how many other rows have fingerprints within the radius, else null."""
    counts = rows.groupBy("bits").count()
    pairs = within_radius(counts, rows.filter(is_query), radius)
    near = pairs.join(counts, "bits").groupBy("query").agg((F.sum("count") - 1).alias("n_near"))
    asked = rows.filter(is_query).join(near, F.col("bits") == F.col("query"), "left").drop("query")
    return asked.unionByName(rows.filter(~is_query).withColumn("n_near", F.lit(None).cast("long")))


def report(df: DataFrame, key: str = "doc_id", text: str = "text", every: int = 50, radius: int = 3) -> DataFrame:
    """The fingerprints of all rows, their likeness to the edited and the next text, and n_near of each `every`th key."""
    rows = stored(with_edited(df, key, text), "prints")
    asked = F.coalesce(F.col(key) % every == 0, F.lit(False))
    return near_counts(rows, asked, radius).select(
        key,
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        as_hex(F.col("bits")).alias("fingerprint"),
        as_hex(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
        likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
        "n_near",
    )
