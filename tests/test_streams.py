"""Scans that are stopped and go on, and the folder source."""

import os

import pytest
from pyspark.sql import functions as F

from kinweave.sources import files
from kinweave.streaming import ingest


def test_folder_source_lists_each_file_once(spark, tmp_path):
    names = [f"a{i}.JPG" for i in range(30)] + [".hidden.MOV", "ü.png", "empty"]
    for k, n in enumerate(names):
        (tmp_path / n).write_bytes(b"x" * k)
    (tmp_path / "folder.jpg").mkdir()
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "b.jpg").write_bytes(b"")
    df = files.listing(spark, str(tmp_path), str(tmp_path / "other"), shares=5)
    assert df.rdd.getNumPartitions() == 10
    got = {os.path.relpath(r["path"], tmp_path): r for r in df.collect()}
    assert set(got) == {*names, "other/b.jpg"} and df.count() == len(got)
    s = os.stat(tmp_path / "a7.JPG")
    assert (got["a7.JPG"]["length"], got["a7.JPG"]["mtime_ns"], got["a7.JPG"]["inode"]) == (7, s.st_mtime_ns, s.st_ino)
    micros = df.select(F.unix_micros("modificationTime").alias("m"), "mtime_ns").filter("m <> mtime_ns div 1000")
    assert micros.count() == 0
    with pytest.raises(Exception, match="nowhere"):
        files.listing(spark, str(tmp_path / "nowhere")).collect()


def test_a_lost_scan_goes_on_and_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, ["succeeded", "failed", "pending"][i % 3 if i % 2 else 0], i) for i in range(40)], "session int, status string, face_count int")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    keep, runs = ingest.progress_once(str(tmp_path / "out"), "session"), []

    def handle(part, batch):
        runs.append(batch)
        keep(part, batch)
        if runs.count(2) == 1 and batch == 2:
            raise RuntimeError("lost")

    start = lambda: ingest.scan_new(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "checkpoint"), handle, 1)
    assert ingest.resumed(start) == 2
    assert sorted(runs) == [0, 1, 2, 2, 3, 4]
    total = ingest.total_progress(spark, str(tmp_path / "out"), "session")
    assert sorted(total.collect()) == sorted(ingest.progress(rows, "session").collect())
    start()
    assert len(runs) == 6  # nothing new
    with pytest.raises(RuntimeError, match="always"):
        ingest.resumed(lambda: (_ for _ in ()).throw(RuntimeError("always")), 2)
