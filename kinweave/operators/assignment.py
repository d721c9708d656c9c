"""Assignment of faces to persons in two ordered passes.

A candidate's decision depends on the faces within the distance and on whom these belong to by then. Faces that already
have a person never change, so a candidate depends on earlier candidates among its neighbours alone, and in the second
pass on what the first decided. That is a graph without circles; it is worked off in rounds of joins over the table of
neighbours, each written to the shared folder, and no list of neighbours and no component is ever in one place.

A candidate is sure to pass over neighbours of excluded persons, and to find its person and its evidence no further than
at the nth neighbour that has another person from the start, n being the number of neighbours that count. So neighbours
are kept up to that one, and where a share of the faces has a person, their number grows with the faces alone."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import stable_id
from ..sources.store import Store, stored
from .neighbours import upto_owned
from .relational import orphan_rows, with_sets

DISTANCE, FACES, NEIGHBOURS = 0.5, 3, 3


def face_input(faces: DataFrame, assets: DataFrame, sources: DataFrame, embeddings: DataFrame, assignments: DataFrame, exclusions: DataFrame, variant: str = "main") -> DataFrame:
    """(id, sort_key, person, excluded, vector) of the faces of assets that were read: what `assign` takes. Vector and
    person are null where a face has none; the order is that of source path, file path and face."""
    a, s = assets.filter("processing_status = 'succeeded'"), sources.select(F.col("id").alias("source_id"), F.col("path").alias("source_path"))
    placed = a.select(F.col("id").alias("asset_id"), "source_id", "absolute_path").join(s, "source_id")
    rows = faces.select("id", "asset_id", "face_index").join(placed, "asset_id")
    rows = rows.join(embeddings.filter(F.col("variant") == variant).select(F.col("face_id").alias("id"), "vector"), "id", "left")
    rows = rows.join(assignments.filter("active").select(F.col("face_id").alias("id"), F.col("person_id").alias("person")), "id", "left")
    rows = with_sets(rows, exclusions.select(F.col("face_id").alias("id"), "person_id"), "id", "person_id", "excluded")
    return rows.select("id", F.struct("source_path", "absolute_path", "face_index").alias("sort_key"), "person", "excluded", "vector")


def near_faces(faces: DataFrame, distance: float, wanted: int = NEIGHBOURS) -> DataFrame:
    """(query, neighbour, distance): all that `assign` needs of the pairs of faces with vectors within the distance."""
    none = F.coalesce("excluded", F.array().cast("array<string>"))
    return upto_owned(faces.filter("person IS NULL").withColumn("excluded", none), faces, max(1, wanted), distance, "sort_key", owner="person")


def with_edges(faces: DataFrame, pairs: DataFrame, wanted: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the faces without a person, with `ban`, their excluded persons or null; and a row for each of their
    neighbours: its place `at` (distance, key, id), its person, and whether it is a candidate that comes before. Neighbours
    of excluded persons and those after the first `wanted` of other persons are left out.

    faces: (id, sort_key, person, excluded); pairs: (query, neighbour, distance) over all faces, each with itself, or
    those of `near_faces`."""
    ban = F.when(F.size("excluded") > 0, F.col("excluded"))
    nodes = stored(faces.filter("person IS NULL").select("id", "sort_key", ban.alias("ban")))
    near = faces.select(F.col("id").alias("n"), F.col("sort_key").alias("near_key"), F.col("person").alias("has"))
    own = pairs.join(nodes, pairs["query"] == nodes["id"]).join(near, F.col("neighbour") == F.col("n"))
    before = F.col("has").isNull() & (F.struct("near_key", "n") < F.struct("sort_key", "id"))
    rows = own.select("id", "n", F.struct("distance", "near_key", "n").alias("at"), "has", "ban", before.alias("before"))
    rows = rows.filter(F.coalesce(~F.array_contains("ban", F.col("has")), F.lit(True)))
    closer = F.count("has").over(Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return nodes, stored(rows.withColumn("closer", closer).filter(F.col("closer") < max(1, wanted)).drop("closer"))


def first_few(edges: DataFrame, wanted: int) -> DataFrame:
    """(id, found): of each face the first `wanted` of these neighbours, as structs (id, distance)."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    few = edges.select("id", "at", nth.alias("nth")).filter(F.col("nth") <= wanted)
    return few.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: F.struct(x["n"].alias("face"), F.format_string("%.6f", F.greatest(x["distance"], F.lit(0.0)) + F.lit(0.0)).alias("distance"))).alias("found"))


def settled(nodes: DataFrame, edges: DataFrame, faces: int, wanted: int, last: bool) -> DataFrame:
    """nodes (id, ban, early, person, points, is_new, found) with `early`, or in the last pass `late`, decided for all.

    In each round a candidate is decided once every earlier neighbour that could change its decision is; the first open
    one always is. One without excluded persons knows from the number of its neighbours whether it will be assigned, and
    joins the person of its first neighbour that is assigned by then, so it only points to that one, and pointers are
    followed in doubling steps. One with excluded persons waits until the persons of its earlier neighbours are known, up
    to the first that it can join and the `wanted` ones that count."""
    own = "late" if last else "early"
    opened = F.col(own).isNull() | ((F.col(own) == "assigned") & F.col("person").isNull() & F.col("points").isNull())
    pending = F.col("person").isNull() & F.col("points").isNotNull()
    mine = (F.col("early") == "deferred") if last else F.lit(True)
    state = nodes if last else nodes.withColumn("late", F.lit(None).cast("string"))
    while True:
        state = stored(state)
        left = state.agg(F.count_if(mine & opened).alias("open"), F.count_if(pending).alias("pending")).first()
        if not left["open"] and not left["pending"]:
            return state
        todo = state.filter(mine & opened).select("id")
        other = state.select(F.col("id").alias("n"), "early", "late", "person", "points")
        rows = edges.join(todo, "id", "left_semi").join(other, "n", "left")
        given = F.col("early") == "assigned"
        if last:
            owned = F.col("has").isNotNull() | given | (F.col("before") & (F.col("late") == "assigned"))
            unknown = F.col("before") & (F.col("early") == "deferred") & F.col("late").isNull()
        else:
            owned, unknown = F.col("has").isNotNull() | (F.col("before") & given), F.col("before") & F.col("early").isNull()
        owned, unknown = F.coalesce(owned, F.lit(False)), F.coalesce(unknown, F.lit(False))
        who = F.when(owned, F.coalesce("has", "person"))
        waits = unknown | (F.col("ban").isNotNull() & owned & who.isNull())
        allowed = F.coalesce(~F.array_contains("ban", who), F.lit(True))
        marked = rows.select("id", "n", "at", "ban", owned.alias("owned"), waits.alias("waits"), who.alias("who"), allowed.alias("allowed"), F.when(who.isNull(), F.coalesce("points", "n")).alias("next"))
        sure = F.min(F.when(F.col("waits"), F.col("at"))).over(Window.partitionBy("id"))  # all before it is known
        marked = marked.withColumn("sure", F.col("allowed") & (F.col("at") < F.coalesce(sure, F.col("at"))))
        first = lambda c: F.min(F.when(c, F.struct("at", "who", "next")))
        sums = marked.groupBy("id").agg(F.count_if("allowed").alias("n"), F.count_if("sure").alias("sure"), first(F.col("owned") & F.col("allowed")).alias("chosen"), first(F.col("waits")).alias("waits"))
        free = F.col("ban").isNull()
        few = first_few(marked.filter(F.col("ban").isNotNull() & F.col("allowed")), wanted).withColumnRenamed("found", "few")
        both = state.join(todo.join(sums, "id", "left").join(few, "id", "left").withColumn("todo", F.lit(True)), "id", "left")
        ready = F.coalesce(F.col("todo"), F.lit(False)) & (F.col("waits").isNull() | ((free | (F.col("sure") >= wanted)) & (F.col("chosen.at") < F.col("waits.at"))))
        n = F.least(F.coalesce("n", F.lit(0)), F.lit(wanted))
        core, none, some = n >= faces, F.col("chosen").isNull(), F.col("chosen").isNotNull()
        verdict = F.when(F.lit(faces > 1) & (n <= 1), "skipped").when(~core & F.lit(not last), "deferred").when(some, "assigned").when(~free, "skipped" if last else "deferred").when(core, "assigned").otherwise("skipped")
        founder = ready & (verdict == "assigned") & none
        joins = ready & (verdict == "assigned") & some
        to = state.filter(F.col("person").isNotNull() | F.col("points").isNotNull()).select(F.col("id").alias("to"), F.col("person").alias("to_person"), F.col("points").alias("to_points"))
        decided = both.select(
            "id", "ban",
            *(F.when(ready, verdict).otherwise(F.col(c)).alias(c) if c == own else F.col(c) for c in ("early", "late")),
            F.when(founder, F.concat(F.lit("new:"), F.col("id").cast("string"))).when(joins, F.col("chosen.who")).otherwise(F.col("person")).alias("person"),
            F.when(joins & F.col("chosen.who").isNull(), F.col("chosen.next")).otherwise(F.col("points")).alias("points"),
            (F.col("is_new") | F.coalesce(founder, F.lit(False))).alias("is_new"),
            F.when(ready & ~free, F.coalesce("few", F.array().cast(state.schema["found"].dataType))).otherwise(F.col("found")).alias("found"),
        )
        step = decided.join(to, decided["points"] == to["to"], "left")
        state = step.withColumn("person", F.coalesce("person", "to_person")).withColumn("points", F.when(F.col("person").isNull(), F.coalesce("to_points", "points"))).select(*state.columns)


def assign(faces: DataFrame, pairs: DataFrame, min_faces: int = FACES, num_results: int = NEIGHBOURS, two_passes: bool = True, run_id: str = "run") -> DataFrame:
    """(id, decision, person, is_new, was_deferred, evidence) of every candidate; a new person's id is made from the run
    and its founder, so a retry gives it again. Evidence is the neighbours that counted, as JSON."""
    nodes, edges = with_edges(faces, pairs, num_results)
    counts = edges.groupBy("id").agg(F.count("*").alias("n"))
    few = first_few(edges.filter("ban IS NULL"), num_results)
    n = F.least(F.coalesce("n", F.lit(0)), F.lit(num_results))
    early = F.when(F.lit(min_faces > 1) & (n <= 1), "skipped").when(n >= min_faces, "assigned").otherwise("deferred")
    text = F.lit(None).cast("string")
    empty = F.array().cast(few.schema["found"].dataType)
    start = nodes.join(counts, "id", "left").join(few, "id", "left").select(
        "id", "ban", F.when(F.col("ban").isNull(), early).alias("early"), text.alias("late"), text.alias("person"),
        F.lit(None).cast(faces.schema["id"].dataType).alias("points"), F.lit(False).alias("is_new"), F.coalesce("found", empty).alias("found"),
    )
    first = settled(start, edges, min_faces, num_results, False)
    deferred = F.col("early") == "deferred"
    done = settled(first, edges, min_faces, num_results, True) if two_passes else first.withColumn("late", F.when(deferred, "skipped")).withColumn("found", F.when(deferred, empty).otherwise(F.col("found")))
    made = F.when(F.col("person").startswith("new:"), stable_id(F.lit(run_id), F.substring(F.col("person"), F.lit(5), F.length("person")))).otherwise(F.col("person"))
    return done.select("id", F.coalesce("late", "early").alias("decision"), made.alias("person"), "is_new", deferred.alias("was_deferred"), F.to_json("found").alias("evidence"))


def counters() -> list[Column]:
    """Counters of a run; deferrals of the first pass are counted whatever the second made of them."""
    count = lambda c: F.count_if(c).alias
    return [
        F.count(F.lit(1)).alias("candidates"),
        count(F.col("decision") == "assigned")("assigned"),
        count(F.col("is_new"))("new_persons"),
        count(F.col("was_deferred"))("deferred"),
        count(F.col("decision") == "skipped")("skipped"),
    ]


def run_counts(decisions: DataFrame) -> DataFrame:
    return decisions.agg(*counters())


def with_counts(decisions: DataFrame) -> tuple[DataFrame, dict]:
    """decisions stored, and their counters, observed while they are written."""
    seen = Observation()
    return stored(decisions.observe(seen, *counters())), seen.get


def given_rows(decisions: DataFrame, assignments: DataFrame, run: int) -> DataFrame:
    """A row for each assigned face, numbered on from the assignments there are."""
    given = decisions.filter("decision = 'assigned'")
    first = assignments.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = given.select("id", "person", "evidence").withColumn("_n", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))).withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64)))
    sizes = numbered.groupBy("_s").count().withColumn("_b", F.coalesce(F.sum("count").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return numbered.join(F.broadcast(sizes), "_s").join(F.broadcast(first)).select(
        (F.col("top") + F.col("_b") + F.col("_n")).cast("long").alias("id"), F.col("id").alias("face_id"), F.col("person").alias("person_id"), F.lit(run).cast("long").alias("run_id"), F.lit("auto").alias("source"), F.lit(True).alias("active"), "evidence", F.current_timestamp().alias("created_at")
    )


def committed(decisions: DataFrame, assignments: DataFrame, persons: DataFrame, run: int) -> tuple[DataFrame, DataFrame]:
    """(assignments, persons) after a run: a row for each assigned face, new persons, and revisions up by one a face."""
    return assignments.unionByName(given_rows(decisions, assignments, run)), persons_after(decisions, persons)


def persons_after(decisions: DataFrame, persons: DataFrame) -> DataFrame:
    given = decisions.filter("decision = 'assigned'")
    up = given.groupBy("person").agg(F.count("*").alias("up"))
    fresh = decisions.filter("is_new").select(F.col("person").alias("id")).distinct().join(persons.select("id"), "id", "left_anti")
    fresh = fresh.select("id", F.lit(None).cast("string").alias("display_name"), F.lit(False).alias("is_named"), F.lit("active").alias("status"), F.lit(0).cast("long").alias("write_revision"), F.current_timestamp().alias("created_at"))
    every = persons.unionByName(fresh)
    return every.join(up, every["id"] == up["person"], "left").withColumn("write_revision", F.col("write_revision") + F.coalesce("up", F.lit(0))).drop("up", "person")


def run(store: Store, session: int, distance: float = DISTANCE, dimension: int = 512, **params: object) -> dict:
    """One run over a store: its row is written first, then faces are loaded, decided and committed together with the
    counts; a failure leaves a failed row with the reason, no assignment, and is raised again. Gives the run's row."""
    spark = store.spark
    number = (store.read("assignment_runs").agg(F.max("id")).first()[0] or 0) + 1
    row = {"id": number, "session_id": session, "status": "running", "params": json.dumps({"distance": distance, "dimension": dimension, **params}, sort_keys=True), "orphan_embeddings": None, "failure_reason": None}

    def with_row(**values: object) -> DataFrame:
        old = store.read("assignment_runs")
        now = spark.createDataFrame([tuple({**row, **values}.get(c) for c in old.columns if not c.endswith("_at"))], old.drop("started_at", "completed_at").schema)
        done = F.current_timestamp() if values else F.lit(None).cast("timestamp")
        before = old.filter(F.col("id") == number).agg(F.coalesce(F.max("started_at"), F.current_timestamp()).alias("started_at"))
        return old.filter(F.col("id") != number).unionByName(now.crossJoin(before).withColumn("completed_at", done))  # one row each

    store.commit({"assignment_runs": with_row()})
    try:
        faces, embeddings = store.read("faces"), store.read("embeddings")
        loaded = stored(face_input(faces, store.read("assets"), store.read("sources"), embeddings, store.read("assignments"), store.read("exclusions")))
        bad = loaded.filter(F.coalesce(F.size("vector"), F.lit(-1)) != dimension).take(1)
        if bad:
            raise ValueError(f"face {bad[0]['id']} has no vector of {dimension} numbers")
        orphans = orphan_rows(embeddings.select(F.col("face_id").alias("id")), faces, "id").count()
        decided, counts = with_counts(assign(loaded.drop("vector"), stored(near_faces(loaded, distance, params.get("num_results", NEIGHBOURS))), run_id=f"run-{number}", **params))
        tables = {"persons": persons_after(decided, store.read("persons")), "assignment_runs": with_row(status="completed", orphan_embeddings=orphans, **counts)}
        store.commit(tables, more={"assignments": given_rows(decided, store.read("assignments"), number)})
    except Exception as e:
        store.commit({"assignment_runs": with_row(status="failed", failure_reason=str(e)[:1000])})
        raise
    return store.read("assignment_runs").filter(F.col("id") == number).first().asDict()
