import datetime
import hashlib
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions import capture_month, file_name, iou, nocase, stem, strip, suffix
from kinweave.operators import gallery, reconcile, relational, sessions, transitions
from kinweave.plans import exports
from kinweave.schemas import TABLES, missing_columns, violations
from kinweave.sources import files
from kinweave.sources.store import Store, migrate, missing_tables
from kinweave.streaming import ingest

NOW = datetime.datetime(2024, 5, 6, 7, 8, 9)


def frame(spark, table, rows):
    names = TABLES[table].schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES[table].schema)


def tables(spark):
    person = lambda i, name: {"id": i, "display_name": name, "is_named": name is not None, "status": "active", "write_revision": 1}
    sample = lambda i, p: {"id": i, "face_id": i, "person_id": p, "active": True, "source": "auto"}
    return {
        "persons": frame(spark, "persons", [person("a", "Ann"), person("b", None), person("c", "Cy")]),
        "assignments": frame(spark, "assignments", [sample(1, "a"), sample(2, "b"), sample(3, "b"), sample(4, "c")]),
        "merge_operations": frame(spark, "merge_operations", []),
        "merge_members": frame(spark, "merge_members", []),
        "exclusions": frame(spark, "exclusions", []),
        "templates": frame(spark, "templates", [{"id": "t1", "status": "active"}, {"id": "t2", "status": "active"}]),
        "template_persons": frame(spark, "template_persons", [{"template_id": "t1", "person_id": "b"}, {"template_id": "t2", "person_id": "c"}]),
    }


def dicts(df, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) for r in df.collect()}


def test_merge_and_undo(spark):
    t = tables(spark)
    headers = gallery.person_headers(t["persons"], t["assignments"])
    assert transitions.merge_error(t["persons"], headers, ["a", "b"]).first()[0] is None
    assert transitions.merge_error(t["persons"], headers, ["a", "a"]).first()[0] == "the same person twice"
    m = {k: v.cache() for k, v in transitions.merge(t, headers, ["a", "b"], 1).items()}
    assert dicts(m["assignments"], "id", "person_id") == {1: ("a",), 2: ("a",), 3: ("a",), 4: ("c",)}  # the named one wins over more samples
    assert dicts(m["persons"], "id", "status", "write_revision") == {"a": ("active", 2), "b": ("inactive", 2), "c": ("active", 1)}
    assert dicts(m["templates"], "id", "status") == {"t1": ("invalid",), "t2": ("active",)}
    assert transitions.undo_state(m).first()["can_undo"]
    u = transitions.undo_merge(m)
    assert dicts(u["assignments"], "id", "person_id") == {1: ("a",), 2: ("b",), 3: ("b",), 4: ("c",)}
    assert dicts(u["persons"], "id", "status", "write_revision", "is_named") == {"a": ("active", 3, True), "b": ("active", 3, False), "c": ("active", 1, True)}
    assert not transitions.undo_state(u).first()["can_undo"]
    changed = m | {"persons": m["persons"].withColumn("write_revision", F.col("write_revision") + 1)}
    assert not transitions.undo_state(changed).first()["can_undo"]
    assert dicts(transitions.undo_merge(changed)["assignments"], "id", "person_id")[2] == ("a",)


def test_exclude_and_rename(spark):
    t = tables(spark)
    assert transitions.exclusion_error(t, "b", [2, 9]).first()[0] == "no such sample"
    assert transitions.exclusion_error(t, "b", [1]).first()[0] == "a sample of another person"
    one = transitions.exclude(t, "b", [2])
    assert dicts(one["persons"], "id", "status", "write_revision")["b"] == ("active", 2)
    both = transitions.exclude(one, "b", [3])
    assert dicts(both["persons"], "id", "status")["b"] == ("inactive",)
    assert sorted(r["face_id"] for r in both["exclusions"].collect()) == [2, 3]
    assert dicts(both["templates"], "id", "status")["t1"] == ("invalid",)
    change = lambda p, n: tuple(transitions.name_change(t["persons"], p, n).select("error", "new_name", "event_type").first())
    assert change("b", "  Bo ") == (None, "Bo", "person_named")
    assert change("a", "Ann") == (None, "Ann", None)
    assert change("a", "Cy")[0] == "the name is taken"
    assert change("a", " \t")[0] == "the name is blank"
    assert change("a", "Al")[2] == "person_renamed"
    t["person_name_events"] = frame(spark, "person_name_events", [{"id": 4}])
    named = transitions.apply_name(t, "b", "  Bo ")
    assert dicts(named["persons"], "id", "display_name", "is_named", "write_revision") == {"a": ("Ann", True, 1), "b": ("Bo", True, 2), "c": ("Cy", True, 1)}
    assert dicts(named["person_name_events"], "id", "event_type", "old_name", "new_name")[5] == ("person_named", None, "Bo")
    for person, name in (("a", "Cy"), ("a", "Ann"), ("a", " ")):  # taken, the same, blank: nothing changes
        same = transitions.apply_name(t, person, name)
        assert dicts(same["persons"], "id", "write_revision")["a"] == (1,) and same["person_name_events"].count() == 1


def test_reconcile(spark):
    box = lambda i, a, x, **m: {"asset_id": a, "x1": x, "y1": 20.0, "x2": x + 100, "y2": 180.0, "image_width": 640, "image_height": 480, **m}
    old = frame(spark, "faces", [box(0, 1, 20.0, id=1, face_index=0), box(0, 1, 220.0, id=2, face_index=1), box(0, 2, 20.0, id=3, face_index=0)])
    new = spark.createDataFrame([(1, 0, 21.0, 20.0, 121.0, 180.0, 640, 480, 0.9, "c", "x"), (1, 1, 380.0, 30.0, 460.0, 170.0, 640, 480, 0.8, "c", "x"), (1, 2, 22.0, 20.0, 122.0, 180.0, 640, 480, 0.7, "c", "x")], "asset_id long, face_index int, x1 double, y1 double, x2 double, y2 double, image_width int, image_height int, score double, crop_path string, context_path string")
    failed = spark.createDataFrame([(2,)], "asset_id long")
    kept, added, gone = reconcile.reconciled(old, new, failed)
    assert dicts(kept, "id", "x1", "score") == {1: (21.0, 0.9)}
    assert sorted(r["face_index"] for r in added.collect()) == [1, 2]  # the old face is used once
    assert sorted(r["id"] for r in gone.collect()) == [2, 3]
    t = tables(spark)
    left = reconcile.delete_faces(spark.createDataFrame([(2,), (4,)], "id long"), frame(spark, "faces", [{"id": i} for i in range(1, 5)]), frame(spark, "embeddings", [{"face_id": 4}]), t["assignments"], t["persons"])
    assert dicts(left["persons"], "id", "write_revision") == {"a": (1,), "b": (2,)}
    assert left["embeddings"].count() == 0 and left["faces"].count() == 2


def test_preview_plan_delivery(spark, tmp_path):
    faces = spark.createDataFrame([(1, 1, "a", 1, 100.0), (1, 2, "b", 2, 80.0), (2, 3, "a", 3, 100.0), (2, 4, "b", 4, 100.0), (2, 5, None, None, 25.0), (3, 6, "a", 6, 9.0), (4, 7, "a", 7, 100.0), (4, 8, "b", 8, 100.0), (4, 9, "z", 9, 24.9)], "asset_id long, face_id long, person string, assignment_id long, area double")
    src = tmp_path / "in"
    src.mkdir()
    rows = []
    for i in range(1, 5):
        (src / f"{i}.jpg").write_text(str(i))
        rows.append({"id": i, "source_id": i % 2, "file_name": "P.jpg", "capture_month": "" if i == 4 else "2024-01", "absolute_path": str(src / f"{i}.jpg")})
    assets = frame(spark, "assets", rows)
    chosen = spark.createDataFrame([("a",), ("b",)], "person string")
    found = exports.preview(assets, faces, chosen, 2).cache()
    assert dicts(found, "asset_id", "bucket", "month", "cover_id") == {1: ("only", "2024-01", 1), 2: ("group", "2024-01", 3), 4: ("only", "unknown-date", 7)}
    sources = spark.createDataFrame([(0, "X"), (1, "Y")], "id long, label string")
    empty = spark.createDataFrame([], "template_id string, asset_id long, bucket string, month string, file_name string")
    plan = exports.plan_additions(found, assets, sources, empty, "t").withColumn("id", F.col("asset_id")).cache()
    assert plan.count() == 3 and exports.plan_additions(found, assets, sources, plan, "t").count() == 0
    out = str(tmp_path / "out")
    assert {r["result"] for r in exports.deliver(plan, assets, out, 1).collect()} == {"copied"}
    assert {r["result"] for r in exports.deliver(plan, assets, out, 2).collect()} == {"skipped_exists"}
    assert (tmp_path / "out" / "group" / "2024-01" / "P.jpg").read_text() == "2"


def test_files(spark, tmp_path):
    for n in ("IMG_1.JPG", "IMG_10.heic", ".IMG_10.MOV", "b.txt", "a.png"):
        (tmp_path / n).write_bytes(n.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.jpg").write_bytes(b"x")
    found = files.with_movs(files.listing(spark, str(tmp_path)))
    got = {r["file_name"]: (r["live_photo_mov_path"] or "").rsplit("/", 1)[-1] for r in found.collect()}
    assert got == {"IMG_1.JPG": ".IMG_10.MOV", "IMG_10.heic": ".IMG_10.MOV", "a.png": ""}  # the prefix rule pairs IMG_1 too
    plan = found.select(F.lit(1).alias("source_id"), F.col("path").alias("absolute_path"), F.lit("f").alias("file_fingerprint"), F.lit("2024-01").alias("capture_month"), "live_photo_mov_path")
    prints = [files.plan_fingerprint(p, n).first()[0] for p, n in ((plan, 200), (plan.repartition(3), 200), (plan, 100), (plan.withColumn("capture_month", F.lit("2024-02")), 200), (plan.withColumn("file_fingerprint", F.lit("g")), 200), (plan.drop("live_photo_mov_path").withColumn("live_photo_mov_path", F.lit("x")), 200), (plan.limit(0), 200))]
    assert prints[0] == prints[1] and len(set(prints)) == 6
    fallback = files.fallback_fingerprints(files.listing(spark, str(tmp_path))).first()
    stat = os.stat(fallback["path"])
    assert fallback["file_fingerprint"] == hashlib.sha256(f"{fallback['path']}|{stat.st_size}|{stat.st_mtime_ns}|{stat.st_ino}".encode()).hexdigest()
    blobs = spark.createDataFrame([(1, bytearray(8)), (2, bytearray(3))], "id long, blob binary")
    assert dicts(files.decoded(blobs, "blob", 2, strict=False), "id", "vector") == {1: ([0.0, 0.0],), 2: (None,)}
    with pytest.raises(Exception, match="have not 2 numbers"):
        files.decoded(blobs, "blob", 2).collect()

    def load():
        return lambda c: [{"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0, "image_width": 2, "image_height": 2, "score": s, "vector": [0.5]} for s in (0.9, 0.5)] if c != b"bad" else 1 / 0

    images = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"bad"))], "asset_id long, content binary")
    assert dicts(files.detected(images, load), "asset_id", "face_index", "failure_reason") == {1: (0, None), 2: (None, "division by zero")}


def exif(entries, order="<"):
    """A JPEG's first bytes with an EXIF directory of texts and numbers, the original time in its own directory."""
    texts, head, own = b"", [], []
    at = 8 + 2 + 12 * (len([e for e in entries if e[0] < 36000]) + 1) + 4
    inner = [e for e in entries if e[0] > 36000]
    base = at + 2 + 12 * len(inner) + 4
    for tag, value in entries:
        if isinstance(value, int):
            row = struct.pack(f"{order}HHIH2x", tag, 3, 1, value)
        else:
            raw = value.encode() + b"\0"
            row = struct.pack(f"{order}HHII", tag, 2, len(raw), base + len(texts))
            texts += raw
        (own if tag > 36000 else head).append(row)
    head.append(struct.pack(f"{order}HHII", 34665, 4, 1, at))
    body = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", 8)
    for rows in (head, own):
        body += struct.pack(f"{order}H", len(rows)) + b"".join(rows) + b"\0\0\0\0"
    return b"\xff\xd8\xff\xe1\0\0Exif\0\0" + body + texts + b"rest"


def test_exif(spark):
    cases = [exif([(274, 6), (306, "2020:01:02 03:04:05"), (36867, "2019:12:31 00:00:00")], o) for o in "<>"] + [exif([(306, "2020:01:02 03:04:05")]), b"\xff\xd8 none", b"", exif([(274, 3)])[:40], None]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None, NOW) for i, c in enumerate(cases)], "id long, content binary, modified timestamp")
    got = files.with_exif(df).withColumn("month", capture_month(F.col("exif_original"), F.col("exif_digitized"), F.col("exif_changed"), modified=F.col("modified")))
    assert dicts(got, "id", "month", "orientation") == {0: ("2019-12", 6), 1: ("2019-12", 6), 2: ("2020-01", None), 3: ("2024-05", None), 4: ("2024-05", None), 5: ("2024-05", 3), 6: ("2024-05", None)}
    image = np.arange(6).reshape(2, 3, 1)
    assert files.upright(image, 6)[:, :, 0].tolist() == [[3, 0], [4, 1], [5, 2]] and files.upright(image, 8)[:, :, 0].tolist() == [[2, 5], [1, 4], [0, 3]]
    assert files.upright(image, 3)[:, :, 0].tolist() == [[5, 4, 3], [2, 1, 0]] and files.upright(image, None) is image
    assert files.upright_loader(lambda content: image)(cases[0]).shape == (3, 2, 1)


def test_functions(spark):
    r = spark.range(1).select(
        nocase(F.lit("ÄbC")), strip(F.lit("  a b\t")), stem(F.lit(".a")), suffix(F.lit("x.tar.gz")), file_name(F.lit("/a/b.c")),
        capture_month(F.lit("2024:13:01 x"), modified=F.lit(NOW)), capture_month(F.lit("20a4:01"), F.lit(None).cast("string"), modified=F.lit(NOW)),
        iou([F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)], (F.lit(0), F.lit(0)), [F.lit(0.0)] * 4, (F.lit(1), F.lit(1))),
    ).first()
    assert tuple(r) == ("Äbc", "a b", ".a", ".gz", "b.c", "2024-13", "2024-05", 0.0)


def test_relational(spark):
    rows = spark.createDataFrame([(i,) for i in (5, 3, 9, 1, 7)], "id long")
    assert dicts(relational.batches(rows, ["id"], 2), "id", "batch_index", "item_index") == {1: (1, 1), 3: (1, 2), 5: (2, 1), 7: (2, 2), 9: (3, 1)}
    names = spark.createDataFrame([(c,) for c in ("b", "a", "é", "")], "id string")
    assert dicts(relational.batches(names, ["id"], 3), "id", "batch_index", "item_index") == {"": (1, 1), "a": (1, 2), "b": (1, 3), "é": (2, 1)}
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert tuple(relational.set_differences(a, b).first()) == (1, 1)
    old = spark.createDataFrame([(1, "x", 7)], "id int, s string, at int")
    new = spark.createDataFrame([(1, None, 8), (2, "y", 9)], "id int, s string, at int")
    assert dicts(transitions.upsert(old, new, "id", ["at"]), "id", "s", "at") == {1: (None, 7), 2: ("y", 9)}
    assert transitions.guarded_insert(old, new, F.col("s") == "x").count() == 0
    assert transitions.guarded_insert(old, new, F.col("s") == "z").count() == 2


def test_store_and_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    people = tables(spark)["persons"]
    assert store.commit({"persons": people}, 0) == 1 and store.read("persons").count() == 3
    with pytest.raises(RuntimeError):
        store.commit({"persons": people}, 0)
    with pytest.raises(ValueError, match="display_name"):
        store.commit({"persons": people.withColumn("display_name", F.lit("same")).withColumn("is_named", F.lit(True))})
    assert store.read("persons").filter("display_name = 'Ann'").count() == 1  # a refused commit shows nothing
    assert violations(people, TABLES["persons"]).count() == 0
    assert migrate(store, {1: {"persons": lambda df: df.withColumn("write_revision", F.lit(5).cast("long"))}}) == 1
    assert migrate(store, {1: {"persons": lambda df: df.limit(0)}}) == 1
    assert {r["write_revision"] for r in store.read("persons").collect()} == {5}

    more = people.withColumn("id", F.concat(F.lit("x"), "id")).withColumn("display_name", F.concat(F.lit("x"), F.coalesce("display_name", "id")))
    assert store.append({"persons": more}) and store.read("persons").count() == 6
    for bad in (more, more.withColumn("id", F.concat(F.lit("y"), "id"))):  # a key, and a name among active named ones, that are there
        with pytest.raises(ValueError, match="persons"):
            store.append({"persons": bad})
    assert store.read("persons").count() == 6 and len(missing_tables(store)) == len(TABLES) - 2
    assert missing_columns(people.drop("status"), TABLES["persons"]) == ["status"]
    store.commit({"sources": frame(spark, "sources", [])})
    store.prune(1)
    assert store.read("persons").count() == 6

    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "seen")
    first = spark.range(3).withColumn("x", F.lit(1))
    first.coalesce(1).write.parquet(inbox)
    go = lambda: ingest.scan_new(spark, inbox, first.schema, str(tmp_path / "check"), ingest.append_once(out), 1)
    go()
    go()
    assert spark.read.parquet(out).count() == 3
    first.coalesce(1).write.mode("append").parquet(inbox)
    go()
    assert spark.read.parquet(out).count() == 6


def test_sessions(spark, tmp_path):
    t = tables(spark)
    check = lambda ids, name="n": sessions.template_error(t["persons"], t["templates"], name, "/out/", ids).first()
    assert check(["c", "a"])["error"] is None and check(["c", "a"])["dedup_key"] == check(["a", "c"])["dedup_key"] == "a,c|/out"
    assert [check(i)["error"] for i in (["a", "a"], ["b"], ["z"], [])] == ["the same person twice", "a person is inactive or has no name", "no such person", "no persons"]
    assert check(["a"], " ")["error"] == "the name is blank"
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "absolute_path string")
    results = spark.createDataFrame([("a", "succeeded", [(0.0, 0.0, 1.0, 1.0, 0.9, [1.0]), (1.0, 0.0, 1.0, 1.0, 0.9, [1.0])]), ("b", "failed", None), ("b", "failed", None), ("d", "succeeded", [])], "absolute_path string, status string, faces array<struct<x1:double,y1:double,x2:double,y2:double,score:double,vector:array<float>>>")
    assert {(r[0], r[1]) for r in sessions.result_errors(items, results).collect()} == {("a", "no box"), ("b", "more than one result"), ("c", "no result"), ("d", "not asked for")}
    (tmp_path / "r.json").write_text('{"absolute_path": "a", "status": "succeeded", "faces": [{"x1": 0, "y1": 0, "x2": 2, "y2": 1, "score": 1.5, "vector": [1]}]}\n')
    assert [r["error"] for r in sessions.result_errors(items.filter("absolute_path = 'a'"), sessions.read_results(spark, str(tmp_path / "r.json"))).collect()] == ["score out of range"]
    (tmp_path / "bad.json").write_text('{"absolute_path": \n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        sessions.read_results(spark, str(tmp_path / "bad.json")).collect()
    sources = frame(spark, "sources", [{"id": 2, "path": "/b", "active": True}, {"id": 1, "path": "/a", "active": True}, {"id": 3, "path": "/c", "active": False}])
    folders = spark.createDataFrame([("/a",)], "path string")
    assert [r["id"] for r in sessions.active_sources(sources).collect()] == [1, 2] and [r["id"] for r in sessions.list_sources(sources).collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="cannot be read: /b"):
        sessions.active_sources(sources, folders).collect()
    made = sessions.write_artifacts(spark.createDataFrame([(1,), (2,)], "face_id long"), lambda: lambda row: b"jpg", str(tmp_path / "art"))
    assert sorted(r["face_id"] for r in made.collect()) == [1, 2] and (tmp_path / "art" / "face_2.jpg").read_bytes() == b"jpg"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_headers_are_ordered_before_they_get_names(spark):
    runs = spark.createDataFrame([(i, i % 3, "done") for i in range(20)], "id long, template_id long, status string")
    templates = spark.createDataFrame([(0, "a", 1), (1, "b", 2)], "id long, name string, created_at long")
    members = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "template_id long, person_id long")
    persons = spark.createDataFrame([(1, "Zoe"), (2, "adam")], "id long, display_name string")
    df = gallery.run_headers(runs, templates, members, persons)
    plan = plan_of(df)
    own = {0: ("a", 2, "adam,Zoe"), 1: ("b", 1, "adam"), 2: (None, None, None)}
    assert list(map(tuple, df.collect())) == [(i, i % 3, "done", *own[i % 3]) for i in range(19, -1, -1)]
    assert plan.index("BroadcastHashJoin") < plan.index("Exchange rangepartitioning")


def test_long_names_are_written_in_short_pages(spark, tmp_path):
    """A task that writes headers holds a few rows of long names at a time, and as many tasks as a shuffle has parts make them."""
    runs = spark.range(100).selectExpr("id", "0L AS template_id", "'done' AS status")
    templates = spark.createDataFrame([(0, "a", 1)], "id long, name string, created_at long")
    persons = spark.range(8).selectExpr("id", "repeat(cast(id AS string), 65536) AS display_name")
    names = ["parquet.page.size.row.check.min", "parquet.block.size.row.check.min"]
    df = gallery.run_headers(runs, templates, persons.selectExpr("0L AS template_id", "id AS person_id"), persons)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and [r["id"] for r in df.select("id").collect()] == list(range(99, -1, -1))
    df.coalesce(1).write.parquet(f"{tmp_path}/out")
    for name in names:
        spark.conf.unset(name)
    j, (file,) = spark._jvm.org.apache.parquet.hadoop, (tmp_path / "out").glob("*.parquet")
    reader = j.ParquetFileReader.open(j.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(str(file)), spark._jsc.hadoopConfiguration()))
    pages = [reader.readOffsetIndex(c).getPageCount() for b in reader.getFooter().getBlocks() for c in b.getColumns() if c.getPath().toDotString() == "names"]
    reader.close()
    assert sum(pages) >= 25  # half a megabyte a row


def test_chosen_people_go_to_the_faces(spark):
    """Rows are never dealt by person: a few people would put all faces into as many tasks."""
    faces = spark.createDataFrame([(a, a * 4 + p, "xyz"[p], a * 4 + p, float(p + 1)) for a in range(30) for p in range(a % 4)], "asset_id long, face_id long, person string, assignment_id long, area double")
    assets = spark.createDataFrame([(a, "2020-01", f"{a}.jpg") for a in range(30)], "id long, capture_month string, file_name string")
    chosen = spark.createDataFrame([("x",), ("y",)], "person string")
    divided, shown = relational.all_of(faces, chosen, "asset_id", "person", 2), exports.preview(assets, faces, chosen, 2)
    want = {a for a in range(30) if a % 4 >= 2}
    assert {r[0] for r in divided.collect()} == {r["asset_id"] for r in shown.collect()} == want
    assert {(r["asset_id"], r["bucket"], r["cover_id"]) for r in shown.collect()} == {(a, "group" if a % 4 == 3 else "only", a * 4) for a in want}
    assert not [x for df in (divided, shown) for x in plan_of(df).splitlines() if "SortMergeJoin [person" in x]
