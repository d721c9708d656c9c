"""The two-phase file sink."""

import os

import pytest
from pyspark.sql import functions as F

from kinweave.sources import delivery


def planned(spark, tmp_path, n=6):
    for i in range(n):
        (tmp_path / f"in{i}").write_bytes(b"x%d" % i)
    rows = [(i, str(tmp_path / f"out/m/f{i}.jpg"), str(tmp_path / f"in{i}"), f"f{i}.MOV" if i % 2 else None, str(tmp_path / f"in{i}") if i % 2 else None) for i in range(n)]
    return spark.createDataFrame(rows, delivery.PLANNED)


def files(at):
    return sorted(os.path.relpath(os.path.join(d, f), at) for d, _, names in os.walk(at) for f in names if ".delivery" not in d)


def test_a_second_action_changes_nothing(spark, tmp_path):
    rows, root = planned(spark, tmp_path), str(tmp_path / "out")
    done = delivery.delivered(rows, root, 1)
    want = {i: ("copied", "copied" if i % 2 else "not_applicable") for i in range(6)}
    for _ in range(2):
        assert {r["plan_id"]: (r["result"], r["mov_result"]) for r in done.collect()} == want
    assert files(root) == sorted([f"m/f{i}.jpg" for i in range(6)] + [f"m/f{i}.MOV" for i in (1, 3, 5)])
    assert (tmp_path / "out/m/f3.MOV").read_bytes() == b"x3"
    again = delivery.delivered(rows, root, 1)
    assert sorted(again.collect()) == sorted(done.collect())
    assert {r["result"] for r in delivery.delivered(rows, root, 2).collect()} == {"skipped_exists"}


def test_a_failed_task_leaves_no_final_file(spark, tmp_path):
    rows, root = planned(spark, tmp_path).repartition(3), str(tmp_path / "out")
    broken = rows.withColumn("target_path", F.when(F.col("plan_id") == 4, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("target_path")))
    with pytest.raises(Exception, match="lost"):
        delivery.delivered(broken, root, 1)
    assert files(root) == [] and delivery.committed(root, 1) is None
    assert {r["result"] for r in delivery.delivered(rows, root, 1).collect()} == {"copied"}


def test_a_driver_lost_after_the_commit(spark, tmp_path, monkeypatch):
    rows, root = planned(spark, tmp_path), str(tmp_path / "out")
    with monkeypatch.context() as m:
        m.setattr(delivery, "moved", lambda batches: (b.iloc[:0][["plan_id"]] for b in batches))
        delivery.delivered(rows, root, 1)
    assert files(root) == []  # committed, nothing moved yet
    done = delivery.delivered(rows.filter("plan_id < 0"), root, 1)
    assert done.count() == 6 and len(files(root)) == 9


def test_missing_sources_and_no_rows(spark, tmp_path):
    rows = planned(spark, tmp_path).withColumn("source_path", F.lit("/nowhere/x"))
    assert {r["result"] for r in delivery.delivered(rows, str(tmp_path / "a"), 1).collect()} == {"failed"}
    assert delivery.delivered(rows.limit(0), str(tmp_path / "b"), 1).collect() == []
