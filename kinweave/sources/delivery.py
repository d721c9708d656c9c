"""A sink for files in two phases: tasks copy into a staging folder and note what they did; the driver then commits the
notes as a whole, and only committed files are moved to their final names.

A task that fails or runs twice leaves nothing but staged files, an aborted write none at all. Notes are committed once for
each run: a run that is delivered again moves what is left to move and gives the same rows. The folder must be one that all
executors see. What reaches the driver is one name of notes for each task."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: What a delivery takes: key, final path, and the files to copy to it and beside it.
PLANNED = "plan_id long, target_path string, source_path string, mov_path string, mov_source string"
NOTED = "plan_id long, target_path string, result string, mov_result string, staged string, mov_path string, delivered_at timestamp"


@dataclass
class Notes(WriterCommitMessage):
    name: str


class TwoPhaseFiles(DataSource):
    """`two_phase_files`: options root and run."""

    @classmethod
    def name(cls) -> str:
        return "two_phase_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(folder(self.options["root"], self.options["run"]))


def folder(root: str, run: object) -> str:
    return os.path.join(root, f".delivery-{run}")


def copied(source: str, target: str) -> None:
    shutil.copyfile(source, f"{target}.part")
    os.replace(f"{target}.part", target)


class FileWriter(DataSourceWriter):
    def __init__(self, at: str):
        self.at = at

    def write(self, iterator: Iterator) -> Notes:
        own = uuid.uuid4().hex  # an attempt's own files and notes
        os.makedirs(os.path.join(self.at, own))
        with open(os.path.join(self.at, f"{own}.jsonl"), "w", encoding="utf-8") as notes:
            for row in iterator:
                staged, result, mov = os.path.join(self.at, own, str(row.plan_id)), "copied", "not_applicable"
                try:
                    if os.path.exists(row.target_path):
                        result = "skipped_exists"  # and its MOV is left as it is
                    else:
                        copied(row.source_path, staged)
                        if row.mov_path and row.mov_source:
                            copied(row.mov_source, f"{staged}.mov")
                            mov = "copied"
                except OSError:
                    result = "failed"
                notes.write(json.dumps({"plan_id": row.plan_id, "target_path": row.target_path, "result": result, "mov_result": mov, "staged": staged if result == "copied" else None, "mov_path": row.mov_path, "delivered_at": datetime.now(timezone.utc).isoformat()}) + "\n")
        return Notes(f"{own}.jsonl")

    def commit(self, messages: list[Notes | None]) -> None:
        part = os.path.join(self.at, f"_committed.{uuid.uuid4().hex}")
        with open(part, "w", encoding="utf-8") as f:
            f.write("\n".join(m.name for m in messages if m is not None))
        os.replace(part, os.path.join(self.at, "_committed"))

    def abort(self, messages: list[Notes | None]) -> None:
        shutil.rmtree(self.at, ignore_errors=True)


def committed(root: str, run: object) -> list[str] | None:
    """The notes of a run, one name a task; None if it was not committed."""
    at = os.path.join(folder(root, run), "_committed")
    if not os.path.exists(at):
        return None
    with open(at, encoding="utf-8") as f:
        return [os.path.join(folder(root, run), name) for name in f.read().split("\n") if name]


def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Staged files to their final names; what a task did before it was lost is done."""
    for b in batches:
        for r in b.itertuples():
            if r.staged:
                os.makedirs(os.path.dirname(r.target_path), exist_ok=True)
                pairs = [(r.staged, r.target_path)]
                if r.mov_result == "copied":
                    beside = os.path.join(os.path.dirname(r.target_path), r.mov_path)
                    pairs.insert(0, (f"{r.staged}.mov", beside))
                for source, target in pairs:
                    if os.path.exists(source) and not (source.endswith(".mov") and os.path.exists(target)):
                        os.replace(source, target)
        yield b.iloc[:0][["plan_id"]]


def delivered(rows: DataFrame, root: str, run: int) -> DataFrame:
    """NOTED of rows (PLANNED), delivered before this returns; of a run that was committed before, its rows as they are."""
    spark: SparkSession = rows.sparkSession
    if committed(root, run) is None:
        os.makedirs(root, exist_ok=True)
        shutil.rmtree(folder(root, run), ignore_errors=True)  # what a lost driver staged
        os.makedirs(folder(root, run))
        spark.dataSource.register(TwoPhaseFiles)
        rows.write.format("two_phase_files").option("root", root).option("run", str(run)).mode("append").save()
    notes = spark.read.schema(NOTED).json(committed(root, run) or []) if committed(root, run) else spark.createDataFrame([], NOTED)
    notes.mapInPandas(moved, "plan_id long").write.format("noop").mode("overwrite").save()
    return notes
