"""Changes of the gallery's tables as functions from tables to tables, and their validation as one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strip


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows of new in place of those of old of the same key, which give the columns of `keep` (as created_at)."""
    o, n = old.alias("o"), new.alias("n")
    rows = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there = F.col(f"n.{key}").isNotNull()
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep or c == key else F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return rows.select(*(pick(c).alias(c) for c in old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new whose key old lacks; of rows of one key in new any one."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def guarded_insert(table: DataFrame, new: DataFrame, guard: Column) -> DataFrame:
    """The rows of new if no row of the table meets the guard, else none."""
    busy = table.filter(guard).select(F.lit(1).alias("one")).limit(1)
    return new.withColumn("one", F.lit(1)).join(F.broadcast(busy), "one", "left_anti").drop("one")


def set_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Columns set in the rows of a condition; a null condition changes nothing."""
    for name, value in values.items():
        df = df.withColumn(name, F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.col(name)))
    return df


def flagged(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """df with whether its key is among ids (a column of the same name)."""
    return df.join(ids.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def invalidate_templates(templates: DataFrame, members: DataFrame, persons: DataFrame) -> DataFrame:
    """Active templates that have any of these persons (id) become invalid."""
    hit = members.join(persons.select(F.col("id").alias("person_id")), "person_id", "left_semi").select(F.col("template_id").alias("id"))
    rows = flagged(templates, hit, "id", "_hit")
    return set_where(rows, F.col("_hit") & (F.col("status") == "active"), status=F.lit("invalid")).drop("_hit").select(*templates.columns)


def unfit_for_templates(persons: DataFrame) -> DataFrame:
    return persons.filter("status <> 'active' OR display_name IS NULL")


def invalidate_if_unfit(templates: DataFrame, members: DataFrame, persons: DataFrame, ids: DataFrame) -> DataFrame:
    """Of these persons (id) the ones that are inactive or have no name make their templates invalid."""
    return invalidate_templates(templates, members, unfit_for_templates(persons.join(ids.select("id"), "id", "left_semi")).select("id"))


def close_stale_runs(runs: DataFrame) -> DataFrame:
    return set_where(runs, F.col("status") == "running", status=F.lit("failed"))


def merge_winner(persons: DataFrame, headers: DataFrame, ids: list[str]) -> DataFrame:
    """The two persons with rank 1 for the one that stays: named before unnamed, then more samples, then smaller id."""
    rows = persons.filter(F.col("id").isin(ids)).join(headers.select("id", "samples"), "id")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("is_named"), F.desc("samples"), "id")))


def merge_error(persons: DataFrame, headers: DataFrame, ids: list[str]) -> DataFrame:
    """One row with error: why these persons cannot be merged, or null."""
    rows = persons.filter(F.col("id").isin(ids)).join(headers.select("id", "samples"), "id")
    seen = rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") != "active").alias("inactive"), F.count_if(F.col("samples") < 1).alias("empty"))
    return seen.select(F.when(F.lit(len(ids) != 2), "two persons are needed").when(F.lit(len(set(ids)) != len(ids)), "the same person twice").when(F.col("n") < 2, "no such person").when(F.col("inactive") > 0, "a person is inactive").when(F.col("empty") > 0, "a person has no samples").alias("error"))


def merge(tables: dict[str, DataFrame], headers: DataFrame, ids: list[str], operation: int) -> dict[str, DataFrame]:
    """The loser's active samples become the winner's; both revisions rise, the loser turns inactive and its templates
    invalid; the operation keeps what was before."""
    persons, assignments = tables["persons"], tables["assignments"]
    ranked = merge_winner(persons, headers, ids).select("id", "rank", "display_name", "is_named", "write_revision")
    side = lambda r, p: ranked.filter(F.col("rank") == r).select(*(F.col(c).alias(f"{p}_{n}") for c, n in (("id", "id"), ("display_name", "name"), ("is_named", "named"), ("write_revision", "before"))))
    pair = F.broadcast(side(1, "winner").crossJoin(side(2, "loser")))  # one row
    after = assignments.join(pair.select("winner_id", "loser_id"))
    moved = after.withColumn("person_id", F.when(F.col("active") & (F.col("person_id") == F.col("loser_id")), F.col("winner_id")).otherwise(F.col("person_id"))).select(*assignments.columns)
    role = F.when(F.col("person_id") == F.col("winner_id"), "winner").when(F.col("person_id") == F.col("loser_id"), "loser")
    members = after.filter("active").select(F.lit(operation).cast("long").alias("operation_id"), F.col("id").alias("assignment_id"), role.alias("role")).filter("role IS NOT NULL")
    row = pair.select(F.lit(operation).cast("long").alias("id"), "winner_id", "loser_id", (F.col("winner_before") + 1).alias("winner_revision"), (F.col("loser_before") + 1).alias("loser_revision"), "winner_name", "loser_name", "winner_named", "loser_named", F.current_timestamp().alias("merged_at"), F.lit(None).cast("timestamp").alias("undone_at"))
    changed = persons.join(F.broadcast(ranked.select("id", "rank")), "id", "left")
    changed = set_where(changed, F.col("rank").isNotNull(), write_revision=F.col("write_revision") + 1)
    changed = set_where(changed, F.col("rank") == 2, status=F.lit("inactive")).select(*persons.columns)
    return tables | {
        "assignments": moved,
        "persons": changed,
        "merge_operations": tables["merge_operations"].unionByName(row),
        "merge_members": tables["merge_members"].unionByName(members),
        "templates": invalidate_templates(tables["templates"], tables["template_persons"], ranked.filter("rank = 2")),
    }


def undo_state(tables: dict[str, DataFrame]) -> DataFrame:
    """One row for the newest merge: its columns, and whether it can be undone: it was not, nobody changed either person
    since, and their active samples are still those that the merge made."""
    last = tables["merge_operations"].orderBy(F.desc("id")).limit(1)
    persons, active = tables["persons"], tables["assignments"].filter("active")
    w = persons.select(F.col("id").alias("winner_id"), F.col("write_revision").alias("w_revision"), F.col("status").alias("w_status"))
    lo = persons.select(F.col("id").alias("loser_id"), F.col("write_revision").alias("l_revision"), F.col("status").alias("l_status"))
    members = tables["merge_members"].join(last.select(F.col("id").alias("operation_id")), "operation_id")
    sizes = members.groupBy("operation_id").agg(F.count_if(F.col("role") == "winner").alias("n_winner"), F.count_if(F.col("role") == "loser").alias("n_loser"), F.count_distinct("assignment_id").alias("n_members"))
    held = active.join(F.broadcast(last.select(F.col("winner_id").alias("person_id"), F.col("id").alias("operation_id"))), "person_id")
    same = held.select("operation_id", F.col("id").alias("assignment_id")).join(members, ["operation_id", "assignment_id"], "full_outer")
    strange = same.groupBy("operation_id").agg(F.count("*").alias("n_all"), F.count("role").alias("n_known"))
    own = held.groupBy("operation_id").agg(F.count("*").alias("n_held"))
    loose = active.join(F.broadcast(last.select(F.col("loser_id").alias("person_id"), F.col("id").alias("operation_id"))), "person_id").groupBy("operation_id").agg(F.count("*").alias("n_loose"))
    row = last.join(w, "winner_id", "left").join(lo, "loser_id", "left")
    for more in (sizes, strange, own, loose):
        row = row.join(more, row["id"] == more["operation_id"], "left").drop("operation_id")
    fine = (
        F.col("undone_at").isNull() & (F.col("n_winner") > 0) & (F.col("n_loser") > 0) & (F.col("n_members") == F.col("n_winner") + F.col("n_loser"))
        & (F.col("w_revision") == F.col("winner_revision")) & (F.col("l_revision") == F.col("loser_revision")) & (F.col("w_status") == "active") & (F.col("l_status") == "inactive")
        & (F.col("n_all") == F.col("n_known")) & (F.col("n_held") == F.col("n_members")) & F.col("n_loose").isNull()
    )
    return row.withColumn("can_undo", F.coalesce(fine, F.lit(False)))


def undo_merge(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables without the newest merge if it can be undone, else unchanged: exactly the loser's samples go back, names
    and states are those before it, both revisions rise, and templates of persons now inactive or unnamed turn invalid."""
    last = F.broadcast(undo_state(tables).filter("can_undo").select(F.col("id").alias("operation_id"), "winner_id", "loser_id", "winner_name", "loser_name", "winner_named", "loser_named"))
    back = tables["merge_members"].filter("role = 'loser'").join(last.select("operation_id", "loser_id"), "operation_id").select(F.col("assignment_id").alias("id"), F.col("loser_id").alias("_to"))
    assignments = tables["assignments"].join(back, "id", "left").withColumn("person_id", F.coalesce("_to", "person_id")).select(*tables["assignments"].columns)
    old = last.select(F.col("winner_id").alias("id"), F.col("winner_name").alias("_name"), F.col("winner_named").alias("_named")).union(last.select("loser_id", "loser_name", "loser_named")).withColumn("_hit", F.lit(True))
    persons = tables["persons"].join(old, "id", "left")
    persons = set_where(persons, F.col("_hit"), display_name=F.col("_name"), is_named=F.col("_named"), status=F.lit("active"), write_revision=F.col("write_revision") + 1)
    unfit = unfit_for_templates(persons.filter("_hit")).select("id")
    operations = tables["merge_operations"].join(last.select(F.col("operation_id").alias("id"), F.lit(True).alias("_hit")), "id", "left")
    return tables | {
        "assignments": assignments,
        "persons": persons.select(*tables["persons"].columns),
        "merge_operations": set_where(operations, F.col("_hit"), undone_at=F.current_timestamp()).select(*tables["merge_operations"].columns),
        "templates": invalidate_templates(tables["templates"], tables["template_persons"], unfit),
    }


def exclusion_error(tables: dict[str, DataFrame], person: str, assignment_ids: list[int]) -> DataFrame:
    """One row with error: why these samples cannot be excluded from a person, or null."""
    rows = tables["assignments"].filter(F.col("id").isin(assignment_ids))
    done = rows.join(tables["exclusions"].filter(F.col("person_id") == person).select("face_id"), "face_id", "left_semi").agg(F.count("*").alias("done"))
    seen = rows.agg(F.count("*").alias("n"), F.count_if(F.col("person_id") != person).alias("foreign"), F.count_if(~F.col("active")).alias("inactive")).crossJoin(F.broadcast(done))
    return seen.select(
        F.when(F.lit(not assignment_ids), "no samples").when(F.lit(len(set(assignment_ids)) != len(assignment_ids)), "the same sample twice").when(F.col("n") < len(assignment_ids), "no such sample")
        .when(F.col("foreign") > 0, "a sample of another person").when(F.col("inactive") > 0, "a sample is inactive").when(F.col("done") > 0, "excluded already").alias("error")
    )


def exclude(tables: dict[str, DataFrame], person: str, assignment_ids: list[int]) -> dict[str, DataFrame]:
    """The samples become inactive and their faces excluded from the person, whose revision rises; with no sample left
    the person turns inactive, and its templates invalid. The name stays."""
    chosen = F.col("id").isin(assignment_ids) & (F.col("person_id") == person) & F.col("active")
    assignments = set_where(tables["assignments"], chosen, active=F.lit(False))
    top = tables["exclusions"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = tables["assignments"].filter(chosen).select("face_id", "person_id", F.row_number().over(Window.orderBy("id")).alias("n"))  # as many as were asked for
    fresh = rows.crossJoin(F.broadcast(top)).select((F.col("top") + F.col("n")).cast("long").alias("id"), "face_id", "person_id", F.current_timestamp().alias("created_at"))
    left = assignments.filter(F.col("active") & (F.col("person_id") == person)).agg(F.count("*").alias("left"))
    persons = tables["persons"].crossJoin(F.broadcast(left))
    persons = set_where(persons, F.col("id") == person, write_revision=F.col("write_revision") + 1)
    persons = set_where(persons, (F.col("id") == person) & (F.col("left") == 0), status=F.lit("inactive"))
    gone = persons.filter((F.col("id") == person) & (F.col("left") == 0)).select("id")
    return tables | {"assignments": assignments, "exclusions": tables["exclusions"].unionByName(fresh), "persons": persons.drop("left"), "templates": invalidate_templates(tables["templates"], tables["template_persons"], gone)}


def name_change(persons: DataFrame, person: str, name: str) -> DataFrame:
    """One row (error, new_name, event_type) for naming a person; event_type null where nothing changes."""
    new = strip(F.lit(name))
    taken = persons.filter((F.col("status") == "active") & F.col("is_named") & (F.col("id") != person) & (F.col("display_name") == new)).agg(F.count("*").alias("taken"))
    own = persons.filter((F.col("id") == person) & (F.col("status") == "active")).agg(F.count("*").alias("n"), F.max("display_name").alias("old"), F.max("is_named").alias("named"))
    row = own.crossJoin(F.broadcast(taken)).withColumn("new_name", new)
    error = F.when(F.col("n") == 0, "no such person").when(F.col("new_name") == "", "the name is blank").when((F.col("taken") > 0) & ~F.coalesce(F.col("old") == F.col("new_name"), F.lit(False)), "the name is taken")
    event = F.when(F.coalesce(F.col("named") & (F.col("old") == F.col("new_name")), F.lit(False)), None).when(F.col("named"), "person_renamed").otherwise("person_named")
    return row.select(error.alias("error"), "old", "new_name", F.when(error.isNull(), event).alias("event_type"))


def apply_name(tables: dict[str, DataFrame], person: str, name: str) -> dict[str, DataFrame]:
    """Tables after a person got a name: the person is named and of one revision more, and an event says so. Nothing
    changes where the name cannot be given, or is the person's own already."""
    given = name_change(tables["persons"], person, name).filter("event_type IS NOT NULL").select(F.lit(person).alias("id"), F.col("old").alias("_old"), F.col("new_name").alias("_new"), F.col("event_type").alias("_event"))
    persons = tables["persons"].join(given, "id", "left")
    persons = set_where(persons, F.col("_new").isNotNull(), display_name=F.col("_new"), is_named=F.lit(True), write_revision=F.col("write_revision") + 1)
    top = tables["person_name_events"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    event = given.crossJoin(top).select((F.col("top") + 1).cast("long").alias("id"), F.col("id").alias("person_id"), F.col("_event").alias("event_type"), F.col("_old").alias("old_name"), F.col("_new").alias("new_name"), F.current_timestamp().alias("created_at"))  # one row each
    return tables | {"persons": persons.select(*tables["persons"].columns), "person_name_events": tables["person_name_events"].unionByName(event)}
