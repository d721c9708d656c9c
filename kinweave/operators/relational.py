"""Joins, sets and aggregates of the gallery and of scan sessions, each a plain DataFrame plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored


def orphan_rows(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows whose owner is not there."""
    return rows.join(owners.select(key), key, "left_anti")


def with_sets(rows: DataFrame, members: DataFrame, key: str, member: str, name: str) -> DataFrame:
    """Rows with the sorted set of their members, an empty one where they have none."""
    sets = members.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias(name))
    kind = members.schema[member].dataType.simpleString()
    return rows.join(sets, key, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))


def finished_parents(parents: DataFrame, children: DataFrame, key: str, done: Column) -> DataFrame:
    """Parents that have children, and none that is not done."""
    return parents.join(children.select(key), key, "left_semi").join(children.filter(~done).select(key), key, "left_anti")


def latest_open_parent(parents: DataFrame, children: DataFrame, key: str, done: Column) -> DataFrame:
    """The newest parent that still has a child to do."""
    return parents.join(children.filter(~done).select(key), key, "left_semi").orderBy(F.desc(key)).limit(1)


def all_of(rows: DataFrame, wanted: DataFrame, group: str, member: str, n: int) -> DataFrame:
    """Groups that have every one of n wanted members (relational division). The few wanted ones go to the rows, which are
    dealt by group, never by member."""
    found = rows.join(F.broadcast(wanted.select(member).distinct()), member, "left_semi").select(group, member).repartition(group).distinct()
    return found.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") == n).select(group)


def ranked(rows: DataFrame, order: list[Column | str], group: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """Rows with their 1-based rank in an order, over the whole table or inside each group.

    The table is range-partitioned by group and order and stored, so that all steps see the same parts; a rank is that
    inside the part plus the group's rows in the parts before, so no task sorts a whole table or a large group."""
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parted = stored(rows.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parted.groupBy("_part", *group).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_before")
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    nth = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    return parted.withColumn("_nth", nth).join(counts, same).select(*rows.columns, (F.col("_nth") + F.col("_before")).cast("long").alias(name))


def batches(rows: DataFrame, order: list[str], size: int, label: str = "batch") -> DataFrame:
    """Rows with 1-based batch_index and item_index in an order over the whole table."""
    at = F.col("_rank") - 1
    return ranked(rows, order, name="_rank").withColumn(f"{label}_index", (F.floor(at / size) + 1).cast("long")).withColumn("item_index", (at % size + 1).cast("long")).drop("_rank")


def contained(sets: DataFrame, rows: DataFrame, key: str, group: str, member: str) -> DataFrame:
    """(key, group, members) for every set (key, member) and every group of rows (group, member) that has all its members.
    A set whose member no row has, and null members, meet nothing."""
    own = rows.select(group, member).filter(F.col(member).isNotNull())
    has = own.groupBy(group).agg(F.collect_set(member).alias("has"))
    return contained_in(sets, has, own.groupBy(member).agg(F.count("*").alias("often")), key, member).select(key, group, "members")


def contained_in(sets: DataFrame, groups: DataFrame, often: DataFrame, key: str, member: str) -> DataFrame:
    """`contained` for groups (has, ...) whose distinct members stand in an array; often: (member, often), about how many
    groups have each member there is. Gives the groups' columns with key and members.

    A set meets only the groups that have its rarest member, and is compared there with all that they have: a group is met
    as a row that carries its array, so what is found goes through no further shuffle."""
    named = sets.select(key, member).distinct().join(often, member, "left")
    rare = named.groupBy(key).agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), F.col(member).alias("member"))).alias("rare"), F.array_sort(F.collect_list(member)).alias("members"), F.count("*").alias("n"))
    rare = rare.filter((F.col("rare.often") > 0) & (F.size("members") == F.col("n"))).select(key, "members", F.col("rare.member").alias(member))
    # stored, so that its true size says whether it is sent to the groups
    found = groups.withColumn(member, F.explode("has")).join(stored(rare), member)
    return found.filter((F.size("members") <= F.size("has")) & (F.size(F.array_except("members", "has")) == 0)).drop(member)


def in_nested(rows: DataFrame, key: str, *levels: tuple[DataFrame, str, str | None]) -> DataFrame:
    """Rows whose key is one of the first level's (table, key, pointer) with a pointer among the next level's keys, and
    so on; the last level has no pointer. A chain of semi joins."""
    below: DataFrame | None = None
    for table, own, points in reversed(levels):
        chosen = table if below is None or points is None else table.join(below, F.col(points) == F.col("_k"), "left_semi")
        below = chosen.select(F.col(own).alias("_k"))
    return rows.join(below, F.col(key) == F.col("_k"), "left_semi")


def next_index(parents: DataFrame, rows: DataFrame, key: str, index: str) -> DataFrame:
    """The next free 0-based index of each parent."""
    top = rows.groupBy(key).agg(F.max(index).alias("top"))
    return parents.select(key).join(top, key, "left").select(key, (F.coalesce("top", F.lit(-1)) + 1).cast("long").alias("next_index"))


def continued(new: DataFrame, old: DataFrame, key: str, index: str, order: list[str]) -> DataFrame:
    """New rows numbered on from the largest index that their parent has."""
    after = next_index(new.select(key).distinct(), old, key, index)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return new.join(after, key).withColumn(index, (F.col("next_index") + nth).cast("long")).drop("next_index")


def ordered_members(rows: DataFrame, key: str, order: list[Column], member: Column, name: str = "members") -> DataFrame:
    """Per key one text of its members in an order."""
    listed = F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), member.alias("m"))))
    return rows.groupBy(key).agg(F.concat_ws(",", F.transform(listed, lambda s: s["m"])).alias(name))


def counts_by(rows: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """Per key the rows and, in one pass, the rows of each condition; 0 where there are none."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.when(c, 1).otherwise(0)).alias(name) for name, c in conditions.items()))


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, rows): distinct rows of one side alone; both 0 where the sets are equal."""
    left, right = a.distinct().withColumn("a", F.lit(1)), b.distinct().withColumn("b", F.lit(1))
    cols = a.columns
    both = left.join(right, cols, "full_outer")
    return both.agg(F.coalesce(F.sum(F.when(F.col("b").isNull(), 1)), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.when(F.col("a").isNull(), 1)), F.lit(0)).alias("only_b"))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def latest_per(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_nth = 1").drop("_nth")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A 1-based page."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def prefix_pairs(photos: DataFrame, movs: DataFrame) -> DataFrame:
    """Photos (dir, stem) with the smallest hidden MOV (dir, name) of their directory whose name begins with a dot and
    the stem: an equi-join on the directory and each prefix that the MOV's name has of the lengths photos' stems have."""
    lengths = photos.groupBy("dir").agg(F.collect_set(F.length("stem")).alias("lengths"))
    keyed = movs.filter(F.col("name").startswith(".")).join(lengths, "dir").select("dir", "name", F.explode("lengths").alias("n"))
    keyed = keyed.filter(F.length("name") > F.col("n")).select("dir", F.substring(F.col("name"), F.lit(2), F.col("n")).alias("stem"), "name")
    return photos.join(keyed.groupBy("dir", "stem").agg(F.min("name").alias("mov")), ["dir", "stem"], "left")
