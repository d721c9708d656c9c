import json

import numpy as np
import pytest

from kinweave.operators import assignment, neighbours
from kinweave.schemas import TABLES
from kinweave.sources.store import Store, stored


def naive(faces, distance, wanted=3, least=3, two_passes=True):
    """The rule, face after face over one list."""
    person = {f["id"]: f["person"] for f in faces}
    ordered = sorted(faces, key=lambda f: f["sort_key"])
    out = {}

    def search(f, passes, most=None):
        found = []
        for g in ordered:
            x, y = np.array(f["vector"]), np.array(g["vector"])
            d = 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y)
            if d <= distance and passes(person[g["id"]]):
                found.append((d, g["sort_key"], g["id"]))
        return [i for _, _, i in sorted(found)][:most]

    def decide(f, last):
        ex = set(f["excluded"])
        near = search(f, lambda p: p is None or p not in ex, wanted)
        if least > 1 and len(near) <= 1:
            return "skipped"
        core = len(near) >= least
        if not core and not last:
            return "deferred"
        who = next((person[i] for i in near if person[i]), None) or next((person[i] for i in search(f, lambda p: p is not None and p not in ex, 1)), None)
        if not who and ex:
            return "skipped" if last else "deferred"
        if not who and core:
            who = f"new-{f['id']}"
        if not who:
            return "skipped"
        person[f["id"]] = who
        return "assigned"

    todo = [f for f in ordered if f["person"] is None]
    late = []
    for f in todo:
        out[f["id"]] = decide(f, False)
        if out[f["id"]] == "deferred":
            late.append(f)
    for f in late:
        out[f["id"]] = decide(f, True) if two_passes else "skipped"
    return out, person


def make(seed, n=60, groups=12, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    faces = []
    for i in range(n):
        v = centres[rng.integers(groups)] + rng.normal(size=size) * 0.25
        who = f"p{rng.integers(4)}" if rng.random() < 0.2 else None
        ex = [f"p{rng.integers(4)}"] if rng.random() < 0.25 else []
        faces.append({"id": i, "sort_key": f"{rng.integers(10**6):06d}-{i}", "person": who, "excluded": ex, "vector": [float(x) for x in v]})
    return faces


def run(spark, faces, distance, partitions=4, **more):
    df = spark.createDataFrame(faces, "id long, sort_key string, person string, excluded array<string>, vector array<double>").repartition(partitions)
    pairs = neighbours.eps_pairs(df, df, distance)
    return {r["id"]: r for r in assignment.assign(df.drop("vector"), pairs, **more).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_one_list(spark, seed):
    faces = make(seed)
    want, person = naive(faces, 0.15)
    got = run(spark, faces, 0.15)
    assert {k: v["decision"] for k, v in got.items()} == want
    same = {}
    for k, v in got.items():
        assert (v["person"] is None) == (person[k] is None)
        if v["person"]:
            assert same.setdefault(v["person"], person[k]) == person[k]
    assert sum(v["was_deferred"] for v in got.values()) > 0


def test_partitions_do_not_matter_and_one_pass(spark):
    faces = make(3, 40)
    a, b = run(spark, faces, 0.15, 1), run(spark, faces, 0.15, 7)
    assert {k: v["person"] for k, v in a.items()} == {k: v["person"] for k, v in b.items()}
    want, _ = naive(faces, 0.15, two_passes=False)
    assert {k: v["decision"] for k, v in run(spark, faces, 0.15, two_passes=False).items()} == want


def test_counts_and_commit(spark):
    faces = [{"id": i, "sort_key": str(i), "person": None, "excluded": [], "vector": [1.0, 0.01 * i]} for i in range(3)]
    df = spark.createDataFrame(faces, "id long, sort_key string, person string, excluded array<string>, vector array<double>")
    decided = assignment.assign(df.drop("vector"), neighbours.eps_pairs(df, df, 0.05)).cache()
    assert assignment.run_counts(decided).first().asDict() == {"candidates": 3, "assigned": 3, "new_persons": 1, "deferred": 0, "skipped": 0}
    assignments = spark.createDataFrame([], "id long, face_id long, person_id string, run_id long, source string, active boolean, evidence string, created_at timestamp")
    persons = spark.createDataFrame([], "id string, display_name string, is_named boolean, status string, write_revision long, created_at timestamp")
    rows, people = assignment.committed(decided, assignments, persons, 1)
    assert sorted(r["id"] for r in rows.collect()) == [1, 2, 3]
    assert [r["write_revision"] for r in people.collect()] == [3]


def test_run_over_a_store(spark, tmp_path):
    rows = lambda name, *rows: spark.createDataFrame([tuple(r.get(n) for n in TABLES[name].schema.fieldNames()) for r in rows], TABLES[name].schema)
    store = Store(spark, str(tmp_path / "store"))
    vectors = [{"face_id": i, "variant": "main", "dimension": 2, "vector": [1.0, 0.01 * i]} for i in range(5)]
    store.commit({
        "sources": rows("sources", {"id": 1, "path": "/in", "active": True}),
        "assets": rows("assets", {"id": 1, "source_id": 1, "absolute_path": "/in/a.jpg", "processing_status": "succeeded"}, {"id": 2, "source_id": 1, "absolute_path": "/in/b.jpg", "processing_status": "failed"}),
        "faces": rows("faces", *({"id": i, "asset_id": 1, "face_index": i} for i in range(3)), {"id": 3, "asset_id": 2, "face_index": 0}),
        "embeddings": rows("embeddings", *vectors),
    })
    done = assignment.run(store, 7, distance=0.05, dimension=2)
    assert {k: done[k] for k in ("id", "session_id", "status", "candidates", "assigned", "new_persons", "orphan_embeddings")} == {"id": 1, "session_id": 7, "status": "completed", "candidates": 3, "assigned": 3, "new_persons": 1, "orphan_embeddings": 1}
    assert done["started_at"] is not None and done["completed_at"] is not None and store.read("assignments").count() == 3 and store.read("persons").first()["write_revision"] == 3
    # faces of failed assets take no part; with nothing to do a second run completes
    assert assignment.run(store, 8, distance=0.05, dimension=2)["candidates"] == 0
    # a vector of another length fails the run, whose row says so, and assigns nothing
    store.commit({"embeddings": rows("embeddings", {**vectors[0], "vector": [1.0]}, *vectors[1:])})
    with pytest.raises(ValueError, match="no vector of 2 numbers"):
        assignment.run(store, 9, distance=0.05, dimension=2)
    last = store.read("assignment_runs").orderBy("id").collect()[-1]
    assert (last["id"], last["status"]) == (3, "failed") and "no vector" in last["failure_reason"] and store.read("assignments").count() == 3


def folded(rows, faces=3, wanted=3):
    """Decisions (decision, person, new, deferred, evidence) of (id, excluded, near) in order; near: (distance, id, person)."""
    owner, out, late = {}, {}, []

    def decide(face, excluded, near, last):
        person = lambda x: x[2] if x[2] is not None else owner.get(x[1])
        allowed = [x for x in near if person(x) is None or person(x) not in excluded]
        found = allowed[:wanted]
        if faces > 1 and len(found) <= 1:
            return "skipped", None, False, found
        if len(found) < faces and not last:
            return "deferred", None, False, found
        chosen = next((person(x) for x in allowed if person(x) is not None), None)
        if chosen is not None:
            return "assigned", chosen, False, found
        if excluded:
            return ("skipped" if last else "deferred"), None, False, found
        return ("assigned", f"new:{face}", True, found) if len(found) >= faces else ("skipped", None, False, found)

    for last in (False, True):
        for face, excluded, near in late if last else rows:
            got = decide(face, excluded, near, last)
            if got[0] == "deferred":
                late.append((face, excluded, near))
                continue
            if got[1] is not None:
                owner[face] = got[1]
            out[face] = (*got[:3], last, [(i, f"{d:.6f}") for d, i, _ in got[3]])
    return out


def in_rounds(spark, faces, pairs, **more):
    df = spark.createDataFrame(faces, "id long, sort_key string, person string, excluded array<string>")
    edges = spark.createDataFrame(pairs, "query long, neighbour long, distance double")
    got = assignment.assign(df, edges, **more).collect()
    return {r["id"]: (r["decision"], r["person"], r["is_new"], r["was_deferred"], [(e["face"], e["distance"]) for e in json.loads(r["evidence"])]) for r in got}


def expected(people, pairs, **more):
    about = {f[0]: f for f in people}
    near = {f[0]: [] for f in people}
    for q, n, d in pairs:
        near[q].append((d, about[n][1], n, about[n][2]))
    rows = [(f[0], set(f[3]), [(d, n, p) for d, _, n, p in sorted(near[f[0]])]) for f in sorted(people, key=lambda f: (f[1], f[0])) if f[2] is None]
    return folded(rows, **more)


def agree(got, want):
    names = {}
    assert set(got) == set(want)
    for i, (decision, person, new, deferred, evidence) in want.items():
        assert (got[i][0], *got[i][2:]) == (decision, new, deferred, evidence), i
        if person is not None and person.startswith("new:"):
            assert names.setdefault(person, got[i][1]) == got[i][1] and len(got[i][1]) == 32
        else:
            assert got[i][1] == person
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize(("seed", "faces", "degree", "banned"), [(1, 3, 4, 0.3), (2, 5, 6, 0.6), (3, 1, 2, 0.2), (4, 4, 9, 0.0)])
def test_rounds_equal_the_fold_on_random_graphs(spark, seed, faces, degree, banned):
    rng = np.random.default_rng(seed)
    n = 120
    rows = [(i, f"{rng.integers(40):03d}", f"p{rng.integers(4)}" if rng.random() < 0.15 else None, [f"p{k}" for k in range(4) if rng.random() < 0.4] if rng.random() < banned else []) for i in range(n)]
    links = {(int(a), int(b)) for a, b in rng.integers(0, n, (n * degree // 2, 2)) if a != b}
    pairs = [(i, i, 0.0) for i in range(n) if i % 17]
    for a, b in links:
        d = float(rng.integers(1, 9)) / 8
        pairs += [(a, b, d)] if (b, a) in links else [(a, b, d), (b, a, d)]
    agree(in_rounds(spark, rows, pairs, min_faces=faces, num_results=max(3, faces)), expected(rows, pairs, faces=faces, wanted=max(3, faces)))


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    n, written = 100_000, []
    monkeypatch.setattr(assignment, "stored", lambda df: written.append(1) or stored(df))
    rows = [(i, f"{i:06d}", None, ["p1"] if i in (500, 501) else []) for i in range(n)]
    pairs = [(i, j, 0.1 * abs(i - j)) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n]
    got = in_rounds(spark, rows, pairs)
    agree(got, expected(rows, pairs))
    assert len(written) < 40 and len({v[1] for v in got.values()}) < 10


def test_near_faces_give_what_all_pairs_give_with_fewer_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)  # several blocks and cells
    faces = make(4, 120, groups=3, size=4)
    for f in faces[:30]:
        f["vector"] = faces[0]["vector"]  # equal ones go by their keys
    df = spark.createDataFrame(faces, "id long, sort_key string, person string, excluded array<string>, vector array<double>")
    every, few = neighbours.eps_pairs(df, df, 0.7), stored(assignment.near_faces(df, 0.7))
    rows = lambda pairs: sorted(tuple(r) for r in assignment.assign(df.drop("vector"), pairs).select("id", "decision", "person", "is_new", "was_deferred", "evidence").collect())
    assert rows(few) == rows(every)
    assert few.count() * 2 < every.count()
    _, edges = assignment.with_edges(df.drop("vector"), few, 3)
    assert edges.groupBy("id").agg({"has": "count"}).filter("`count(has)` > 3").isEmpty()
