"""Export: which photos hold all chosen people, in which bucket and month, under which name, and what was delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import area
from ..operators.relational import contained_in, ranked
from ..sources.delivery import delivered
from ..sources.store import stored

#: A face counts beside the chosen people if it is at least this share of the smallest of their largest faces.
SHARE = 0.25


def bucketed(faces: DataFrame, chosen: DataFrame, n_chosen: int, share: float = SHARE) -> DataFrame:
    """(asset_id, bucket, threshold) of the assets that show every chosen person.

    faces: (asset_id, person, area), person null for a face that nobody owns; chosen: (person). The bucket is `group` if
    any face from the threshold on belongs to nobody or to somebody else, else `only`. The few chosen people go to the
    faces, which are never dealt by person. One shuffle by asset: its faces are summed up for each chosen person first,
    and once more for the asset."""
    picked = F.broadcast(chosen.select("person").distinct().withColumn("mine", F.lit(True)))
    marked = faces.join(picked, "person", "left").withColumn("mine", F.coalesce("mine", F.lit(False))).repartition("asset_id")
    # of an asset, each person's largest face; of all others the largest one
    who = F.when(F.col("mine"), F.col("person"))
    tops = marked.groupBy("asset_id", who.alias("who")).agg(F.max("area").alias("top"))
    rows = tops.groupBy("asset_id").agg(F.count("who").alias("n"), F.min(F.when(F.col("who").isNotNull(), F.col("top"))).alias("least"), F.max(F.when(F.col("who").isNull(), F.col("top"))).alias("other"))
    threshold = F.col("least") * share
    bucket = F.when(F.coalesce(F.col("other") >= threshold, F.lit(False)), "group").otherwise("only")
    return rows.filter(F.col("n") == n_chosen).select("asset_id", bucket.alias("bucket"), threshold.alias("threshold"))


def template_classes(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(template_id, class_id) and (class_id, person): templates of the same people are one class, named by its smallest
    template. One with a null person matches nothing and has no class."""
    listed = templates.groupBy("template_id").agg(F.array_sort(F.collect_set("person")).alias("people"), F.count_if(F.col("person").isNull()).alias("odd")).filter("odd = 0").drop("odd")
    listed = stored(listed)
    named = stored(listed.groupBy("people").agg(F.min("template_id").alias("class_id")))
    return listed.join(named, "people").select("template_id", "class_id"), named.select("class_id", F.explode("people").alias("person"))


def bucketed_by_class(faces: DataFrame, classes: DataFrame, share: float = SHARE) -> DataFrame:
    """(class_id, asset_id, bucket, threshold) of `bucketed` for every class (class_id, person) of templates in one pass: an
    asset carries its people's largest faces, as many as there are people on it, and meets classes by containment."""
    # dealt by asset once, which serves both groupings
    tops = faces.select("asset_id", "person", "area").repartition("asset_id").groupBy("asset_id", "person").agg(F.max("area").alias("top"))
    by_asset = tops.groupBy("asset_id").agg(F.collect_list(F.struct("person", "top")).alias("tops"))
    by_asset = by_asset.withColumn("has", F.transform(F.filter("tops", lambda x: x["person"].isNotNull()), lambda x: x["person"]))
    often = faces.filter("person IS NOT NULL").groupBy("person").agg(F.count("*").alias("often"))
    pairs = contained_in(classes, by_asset, often, "class_id", "person")
    chosen = lambda x: F.coalesce(F.array_contains("members", x["person"]), F.lit(False))
    least = F.array_min(F.transform(F.filter("tops", chosen), lambda x: x["top"]))
    other = F.array_max(F.transform(F.filter("tops", lambda x: ~chosen(x)), lambda x: x["top"]))
    rows = pairs.select("class_id", "asset_id", (least * share).alias("threshold"), other.alias("other"))
    return rows.select("class_id", "asset_id", F.when(F.coalesce(F.col("other") >= F.col("threshold"), F.lit(False)), "group").otherwise("only").alias("bucket"), "threshold")


def bucketed_for_all(faces: DataFrame, templates: DataFrame, share: float = SHARE) -> DataFrame:
    """(template_id, asset_id, bucket, threshold) of `bucketed` for every template (template_id, person). As many rows as
    templates match assets; what is asked of each template alone is had from its class, see `totals_for_all`."""
    of, classes = template_classes(templates)
    return bucketed_by_class(faces, classes, share).join(of, "class_id").select("template_id", "asset_id", "bucket", "threshold")


def totals_for_all(faces: DataFrame, templates: DataFrame, share: float = SHARE) -> DataFrame:
    """(template_id, bucket, assets, thresholds): per template and bucket the assets and the sum of their thresholds. They
    are summed for each class of templates, and every template takes its class's sums."""
    of, classes = template_classes(templates)
    sums = bucketed_by_class(faces, classes, share).groupBy("class_id", "bucket").agg(F.count("*").alias("assets"), F.sum("threshold").alias("thresholds"))
    return of.join(stored(sums), "class_id").select("template_id", "bucket", "assets", "thresholds")


def face_rows(faces: DataFrame, assignments: DataFrame) -> DataFrame:
    """(asset_id, face_id, person, assignment_id, area) of every face with its active owner, null without one."""
    owners = assignments.filter("active").select("face_id", F.col("person_id").alias("person"), F.col("id").alias("assignment_id"))
    rows = faces.select("asset_id", F.col("id").alias("face_id"), area(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("area"))
    return rows.join(owners, "face_id", "left")


def month_of(capture_month: Column) -> Column:
    return F.when(F.coalesce(F.length(capture_month), F.lit(0)) == 0, "unknown-date").otherwise(capture_month)


def preview(assets: DataFrame, faces: DataFrame, chosen: DataFrame, n_chosen: int) -> DataFrame:
    """(asset_id, month, bucket, file_name, cover_id): cover is the assignment of the first face of the smallest chosen person."""
    found = bucketed(faces, chosen, n_chosen)
    first = chosen.agg(F.min("person").alias("person"))
    cover = faces.filter("assignment_id IS NOT NULL").join(F.broadcast(first), "person").groupBy("asset_id").agg(F.min_by("assignment_id", "face_id").alias("cover_id"))
    rows = found.join(assets.select(F.col("id").alias("asset_id"), month_of(F.col("capture_month")).alias("month"), "file_name"), "asset_id")
    return rows.join(cover, "asset_id", "left").select("asset_id", "month", "bucket", "file_name", "cover_id")


def month_totals(rows: DataFrame) -> DataFrame:
    """Per month the assets, and those of each bucket."""
    one = lambda b: F.sum(F.when(F.col("bucket") == b, 1).otherwise(0))
    return rows.groupBy("month").agg(F.count("*").alias("total"), one("only").alias("n_only"), one("group").alias("n_group"))


def month_listing(rows: DataFrame) -> DataFrame:
    """The assets of each month and bucket with their 1-based place in the order of file names."""
    return ranked(rows, ["file_name", "asset_id"], ("month", "bucket"), "place").select("month", "bucket", "place", "asset_id", "file_name")


def name_parts(name: Column) -> tuple[Column, Column]:
    """Stem and ending of a file name; a leading dot begins no ending."""
    end = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(end)), end


def mov_name(mov: Column, original: Column, new: Column) -> Column:
    """The paired MOV's name beside a renamed photo: the photo's new stem, its own ending, and a leading dot if it had one."""
    name = F.substring_index(mov, "/", -1)
    dot = F.when(name.startswith("."), ".").otherwise("")
    return F.when(F.length(mov) > 0, F.when(new == original, name).otherwise(F.concat(dot, name_parts(new)[0], name_parts(name)[1])))


def labelled(assets: DataFrame, sources: DataFrame) -> DataFrame:
    """Assets with the label of their source, `unknown` where it is not there."""
    named = assets.join(sources.select(F.col("id").alias("source_id"), F.col("label").alias("source_label")), "source_id", "left")
    return named.withColumn("source_label", F.coalesce("source_label", F.lit("unknown")))


FOLDER = ["bucket", "month"]


def free_numbers(tails: DataFrame, known: DataFrame) -> DataFrame:
    """tails (FOLDER, prefix, ending, asset_id, c) with the c-th number from 2, counted from 0, that no known name has."""
    key = [*FOLDER, "prefix", "ending"]
    parts = known.select(*FOLDER, F.regexp_extract("file_name", r"^(.*-)([1-9][0-9]{0,17})((?:\.[^.]*)?)$", 1).alias("prefix"), F.regexp_extract("file_name", r"^(.*-)([1-9][0-9]{0,17})((?:\.[^.]*)?)$", 3).alias("ending"), F.regexp_extract("file_name", r"^(.*-)([1-9][0-9]{0,17})((?:\.[^.]*)?)$", 2).alias("number"))
    numbers = parts.filter("prefix <> ''").withColumn("number", F.col("number").cast("long")).filter("number > 1").distinct()
    # of a known number, how many free ones are before it; so many of a prefix are known before the c-th free one
    before = F.col("number") - 1 - F.row_number().over(Window.partitionBy(*key).orderBy("number"))
    rows = numbers.select(*key, before.alias("v"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("asset_id")).unionByName(tails.select(*key, F.col("c").alias("v"), F.lit(1).alias("asks"), "asset_id"))
    passed = F.sum(1 - F.col("asks")).over(Window.partitionBy(*key).orderBy("v", "asks").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("number", 2 + F.col("v") + passed).filter("asks = 1").select("asset_id", *FOLDER, "number")


def named_in_rounds(new: DataFrame, known: DataFrame) -> DataFrame:
    """new (FOLDER, asset_id, file_name, source_label, seen) with `given`, as if names were given one after the other by asset.

    An asset takes the first name of its own list that is free: its file name; with its label, unless the same name came
    with that label before; then that with numbers from 2. All propose at once; of those that propose one name the smallest
    asset keeps it for now, and the others and those that meet a known name go on to their next one, until none has to.
    Of assets with one name and label each comes after the last one's number, so ranks say at once where they begin."""
    stem, ending = name_parts(F.col("file_name"))
    family = [*FOLDER, "file_name"]
    first = F.row_number().over(Window.partitionBy(*family).orderBy("asset_id")) == 1
    later = F.when(F.col("seen"), 2).otherwise(1)
    state = new.select("*", F.concat(stem, F.lit("__"), "source_label").alias("labelled"), ending.alias("ending"), F.when(first, 0).otherwise(later).alias("step"), F.lit(0).cast("long").alias("c"), F.lit(True).alias("moved"))
    while True:
        # a number each: after the number of the asset before
        w = Window.partitionBy(*family, "source_label").orderBy("asset_id")
        tails = state.filter("step = 2").withColumn("nth", F.row_number().over(w)).withColumn("c", F.col("nth") + F.max(F.col("c") - F.col("nth")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        tails = tails.withColumn("c", F.greatest("c", F.col("nth") - 1)).select("asset_id", *FOLDER, F.concat("labelled", F.lit("-")).alias("prefix"), "ending", "c")
        tails = tails.join(free_numbers(tails, known), ["asset_id", *FOLDER]).select("asset_id", *FOLDER, F.col("c").alias("own_c"), "number")
        rows = state.join(tails, ["asset_id", *FOLDER], "left").withColumn("c", F.coalesce("own_c", "c"))
        given = F.when(F.col("step") == 0, F.col("file_name")).when(F.col("step") == 1, F.concat("labelled", "ending")).otherwise(F.concat("labelled", F.lit("-"), F.col("number").cast("string"), "ending"))
        rows = rows.withColumn("given", given)
        taken = known.select(*FOLDER, F.col("file_name").alias("given"), F.lit(True).alias("taken")).distinct()
        rows = rows.join(taken, [*FOLDER, "given"], "left").withColumn("moved", F.coalesce("taken", F.lit(False)) | (F.min("asset_id").over(Window.partitionBy(*FOLDER, "given")) < F.col("asset_id")))
        rows = stored(rows.select(*state.columns, "given"))
        if rows.filter("moved").isEmpty():
            return rows.select(*new.columns, "given")
        on = F.col("moved")
        state = rows.drop("given").withColumn("c", F.when(on & (F.col("step") == 2), F.col("c") + 1).otherwise(F.col("c"))).withColumn("step", F.when(on & (F.col("step") == 0), later).when(on, 2).otherwise(F.col("step")))


def plan_additions(found: DataFrame, assets: DataFrame, sources: DataFrame, plan: DataFrame, template: str) -> DataFrame:
    """Rows for the plan of a template that it lacks: (template_id, asset_id, bucket, month, file_name, mov_file_name,
    source_label). Rows of the plan stay as they are, and their assets only tell that their label came with their name."""
    own = plan.filter(F.col("template_id") == template)
    rows = found.join(labelled(assets, sources).select(F.col("id").alias("asset_id"), "source_label", "live_photo_mov_path"), "asset_id")
    rows = rows.join(own.select("asset_id", F.lit(True).alias("planned")), "asset_id", "left")
    seen = F.row_number().over(Window.partitionBy(*FOLDER, "file_name", "source_label").orderBy("asset_id")) > 1
    new = rows.withColumn("seen", seen).filter("planned IS NULL").select(*FOLDER, F.col("asset_id").cast("long").alias("asset_id"), "file_name", "source_label", "live_photo_mov_path", "seen")
    done = named_in_rounds(new, stored(own.select(*FOLDER, "file_name")))
    name = mov_name(F.col("live_photo_mov_path"), F.col("file_name"), F.col("given"))
    return done.select(F.lit(template).alias("template_id"), "asset_id", *FOLDER, F.col("given").alias("file_name"), name.alias("mov_file_name"), "source_label")


def plan_sources(plan: DataFrame, assets: DataFrame) -> DataFrame:
    """Planned files with the paths that they are copied from."""
    return plan.join(assets.select(F.col("id").alias("asset_id"), "absolute_path", "live_photo_mov_path"), "asset_id")


def deliver(plan: DataFrame, assets: DataFrame, root: str, run_id: int) -> DataFrame:
    """Copy every planned file to root/bucket/month/name on a file system that all executors see, unless it is there, and
    the paired MOV beside it; one row for each planned file. All of the plan is copied, whether or not it still matches.

    The files are delivered and their rows noted once, before this returns (see `sources.delivery`): a later action on the
    result reads the notes, and the same run delivered again gives them again."""
    to = F.concat_ws("/", F.lit(root.rstrip("/")), "bucket", "month", "file_name")
    rows = plan_sources(plan, assets).select(F.col("id").alias("plan_id"), to.alias("target_path"), F.col("absolute_path").alias("source_path"), F.col("mov_file_name").alias("mov_path"), F.col("live_photo_mov_path").alias("mov_source"))
    done = delivered(rows, root.rstrip("/"), run_id)
    return done.select("plan_id", "target_path", "result", "mov_result", F.lit(run_id).cast("long").alias("run_id"), "delivered_at")


def run_history(runs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Runs with live counts of their deliveries, 0 without any; one join instead of a lookup for each run."""
    one = lambda r: F.sum(F.when(F.col("result") == r, 1).otherwise(0)).alias
    counts = deliveries.groupBy("run_id").agg(one("copied")("n_copied"), one("skipped_exists")("n_skipped"), one("failed")("n_failed"))
    rows = runs.join(counts, runs["id"] == counts["run_id"], "left").drop("run_id")
    return rows.select("id", "template_id", "status", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_copied", "n_skipped", "n_failed"))).orderBy(F.desc("id"))


def run_details(runs: DataFrame, deliveries: DataFrame, templates: DataFrame) -> DataFrame:
    """Every delivery of every run with the run and the name of its template; a run without any has one row."""
    r, d, t = runs.alias("r"), deliveries.alias("d"), templates.alias("t")
    rows = r.join(t, F.col("r.template_id") == F.col("t.id"), "left").join(d, F.col("d.run_id") == F.col("r.id"), "left")
    return rows.select(F.col("r.id").alias("run_id"), F.col("r.status").alias("status"), F.col("t.name").alias("template_name"), F.col("d.id").alias("delivery_id"), F.col("d.target_path").alias("target_path"), F.col("d.result").alias("result"), F.col("d.mov_result").alias("mov_result"))
