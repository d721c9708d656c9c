"""Scan sessions: their summary, what their workers give back, and the validation of requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import set_key
from ..sources.store import stored


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.select("id", "path", "label", "active").orderBy("id")


def active_sources(sources: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """The active sources by id; with the folders that can be read (path), those that cannot fail the job."""
    rows = sources.filter("active")
    if folders is not None:
        there = rows.join(folders.select("path", F.lit(True).alias("_there")), "path", "left")
        fail = F.raise_error(F.concat(F.lit("a source cannot be read: "), F.col("path"))).cast("boolean")
        rows = there.filter(F.when(F.col("_there").isNull(), fail).otherwise(True)).select(*sources.columns)
    return rows.orderBy("id")


def session_summary(items: DataFrame, faces: DataFrame) -> DataFrame:
    """Per session the items, the failed ones, the faces of its assets and the files made of them, two for a face.

    items: (session_id, asset_id, status); faces: (asset_id). Faces are counted by asset before the join, and all sums
    of a session come from one aggregate."""
    found = faces.groupBy("asset_id").agg(F.count("*").alias("n"))
    rows = items.join(found, "asset_id", "left")
    count = F.coalesce(F.sum("n"), F.lit(0))
    return rows.groupBy("session_id").agg(F.count("*").alias("n_items"), F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("n_failed"), count.alias("n_faces"), (count * 2).alias("n_files"))


def with_batch_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Batch items with the path and label of their source."""
    return items.join(sources.select(F.col("id").alias("source_id"), F.col("path").alias("source_path"), "label"), "source_id")


def result_errors(items: DataFrame, results: DataFrame) -> DataFrame:
    """(absolute_path, error) of what a worker gave back against what it was to read: a path that lacks or was not asked
    for or comes twice, a box that is no box, a score outside 0 to 1, a missing vector. Empty where all is well.

    results: (absolute_path, status, faces: array<struct<x1,y1,x2,y2,score,vector>>)."""
    seen = results.groupBy("absolute_path").agg(F.count("*").alias("n"))
    both = items.select("absolute_path").distinct().withColumn("asked", F.lit(True)).join(seen, "absolute_path", "full_outer")
    sets = both.select("absolute_path", F.when(F.col("n").isNull(), "no result").when(F.col("asked").isNull(), "not asked for").when(F.col("n") > 1, "more than one result").alias("error"))
    face = results.filter("status = 'succeeded'").select("absolute_path", F.explode("faces").alias("f"))
    shape = F.when(~((F.col("f.x1") < F.col("f.x2")) & (F.col("f.y1") < F.col("f.y2"))), "no box").when(~F.col("f.score").between(0, 1), "score out of range").when(F.coalesce(F.size("f.vector"), F.lit(0)) < 1, "no vector")
    return sets.unionByName(face.select("absolute_path", shape.alias("error"))).filter("error IS NOT NULL")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """What workers gave back, as JSON lines of the schema that `result_errors` takes; a line that is none fails the job."""
    face = "struct<x1:double,y1:double,x2:double,y2:double,score:double,vector:array<float>>"
    return spark.read.schema(f"absolute_path string, status string, faces array<{face}>").option("mode", "FAILFAST").json(path)


def template_error(persons: DataFrame, templates: DataFrame, name: str, root: str, ids: list[str]) -> DataFrame:
    """One row (error, dedup_key): why a template of these persons cannot be made, or null."""
    rows = persons.filter(F.col("id").isin(ids)).agg(F.count("*").alias("n"), F.count_if((F.col("status") != "active") | F.col("display_name").isNull()).alias("unfit"))
    key = set_key(F.array(*(F.lit(i) for i in ids)) if ids else F.array().cast("array<string>"))
    dedup = F.concat_ws("|", key, F.lit(root.rstrip("/")))
    same = templates.filter((F.col("dedup_key") == dedup) & (F.col("status") == "active")).agg(F.count("*").alias("same"))
    row = rows.crossJoin(F.broadcast(same))  # one row each
    return row.select(
        F.when(F.lit(not name.strip()), "the name is blank").when(F.lit(not root.strip()), "no folder").when(F.lit(not ids), "no persons").when(F.lit(len(set(ids)) != len(ids)), "the same person twice")
        .when(F.col("n") < len(ids), "no such person").when(F.col("unfit") > 0, "a person is inactive or has no name").when(F.col("same") > 0, "there is one already").alias("error"),
        dedup.alias("dedup_key"),
    )


def write_artifacts(faces: DataFrame, render: Callable[[], Callable[[dict], bytes]], root: str) -> DataFrame:
    """(face_id, path) of a picture made for each row by render()(row): written beside its final name in a folder that
    all executors see, then renamed, so a task that runs again replaces whole files. The pictures are made before this
    returns, and once: the result is a stored table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        draw = render()
        os.makedirs(root, exist_ok=True)
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                path = os.path.join(root, f"face_{row['face_id']}.jpg")
                part = f"{path}.part-{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(draw(row))
                os.replace(part, path)
                out.append((row["face_id"], path))
            yield pd.DataFrame(out, columns=["face_id", "path"])

    return stored(faces.mapInPandas(run, "face_id long, path string"))
