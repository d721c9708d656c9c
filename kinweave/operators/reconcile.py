"""Detections of a photo met again: which faces stay, which come and which go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import iou

LEAST = 0.5


def overlaps(old: DataFrame, new: DataFrame, least: float = LEAST) -> DataFrame:
    """(asset_id, old_id, new_index, overlap) of pairs of one asset that overlap more than `least`. Boxes are x1 to y2
    with image_width and image_height; old ones have an id, new ones a face_index."""
    o, n = old.alias("o"), new.alias("n")
    box = lambda a: [F.col(f"{a}.{c}") for c in ("x1", "y1", "x2", "y2")]
    size = lambda a: (F.col(f"{a}.image_width"), F.col(f"{a}.image_height"))
    pairs = o.join(n, F.col("o.asset_id") == F.col("n.asset_id")).select(F.col("o.asset_id").alias("asset_id"), F.col("o.id").alias("old_id"), F.col("n.face_index").alias("new_index"), iou(box("o"), size("o"), box("n"), size("n")).alias("overlap"))
    return pairs.filter(F.col("overlap") > least)


def matched(pairs: DataFrame) -> DataFrame:
    """(asset_id, old_id, new_index): each new box in order takes the first old face by id that overlaps and is free.

    The pairs of an asset, as many as its faces allow, are folded in order inside one row."""
    kind = f"array<struct<new_index:{pairs.schema['new_index'].dataType.simpleString()},old_id:{pairs.schema['old_id'].dataType.simpleString()}>>"
    listed = pairs.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("new_index", "old_id"))).alias("pairs"))
    free = lambda acc, x: ~F.exists(acc, lambda m: (m["new_index"] == x["new_index"]) | (m["old_id"] == x["old_id"]))
    taken = F.aggregate("pairs", F.array().cast(kind), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return listed.select("asset_id", F.explode(taken).alias("m")).select("asset_id", F.col("m.old_id").alias("old_id"), F.col("m.new_index").alias("new_index"))


def reconciled(old: DataFrame, new: DataFrame, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, added, gone): old faces with the box, size, score and paths of the new ones they match; new boxes without
    a match; old faces without one, and all of failed assets (asset_id)."""
    match = matched(overlaps(old, new))
    fresh = new.select("asset_id", "face_index", "x1", "y1", "x2", "y2", "image_width", "image_height", "score", "crop_path", "context_path")
    keys = old.join(match, (old["id"] == match["old_id"])).select(old["id"], old["asset_id"], old["face_index"], "new_index")
    kept = keys.join(fresh.withColumnRenamed("face_index", "new_index"), ["asset_id", "new_index"]).drop("new_index")
    added = fresh.join(match.select("asset_id", F.col("new_index").alias("face_index")), ["asset_id", "face_index"], "left_anti")
    seen = new.select("asset_id").distinct()
    if failed is not None:
        seen = seen.union(failed.select("asset_id")).distinct()
    gone = old.join(seen, "asset_id", "left_semi").join(match.select(F.col("old_id").alias("id")), "id", "left_anti")
    return kept, added, gone


def delete_faces(gone: DataFrame, faces: DataFrame, embeddings: DataFrame, assignments: DataFrame, persons: DataFrame) -> dict[str, DataFrame]:
    """Tables without the faces that are gone: their assignments and embeddings go too, the persons they had get a
    revision more, and of these persons the ones left without an active assignment go. Exclusions stay."""
    ids = gone.select(F.col("id").alias("face_id")).distinct()
    left = assignments.join(ids, "face_id", "left_anti")
    touched = assignments.join(ids, "face_id", "left_semi").select(F.col("person_id").alias("id")).distinct()
    empty = touched.join(left.filter("active").select(F.col("person_id").alias("id")), "id", "left_anti")
    flagged = persons.join(touched.withColumn("_t", F.lit(1)), "id", "left").withColumn("write_revision", F.col("write_revision") + F.coalesce("_t", F.lit(0))).drop("_t")
    return {
        "assignments": left,
        "embeddings": embeddings.join(ids, "face_id", "left_anti"),
        "faces": faces.join(ids.withColumnRenamed("face_id", "id"), "id", "left_anti"),
        "persons": flagged.join(empty, "id", "left_anti"),
    }


def face_state(assets: DataFrame, faces: DataFrame, embeddings: DataFrame, assignments: DataFrame) -> DataFrame:
    """What is known of the faces of these assets (asset_id): box, image, vector of the main variant and active owner,
    null where there is none."""
    own = faces.join(assets.select("asset_id").distinct(), "asset_id", "left_semi")
    main = embeddings.filter("variant = 'main'").select(F.col("face_id").alias("id"), "dimension", "vector")
    owner = assignments.filter("active").select(F.col("face_id").alias("id"), "person_id")
    return own.join(main, "id", "left").join(owner, "id", "left").select("id", "asset_id", "x1", "y1", "x2", "y2", "image_width", "image_height", "dimension", "vector", "person_id")
