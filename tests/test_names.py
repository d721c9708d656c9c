"""Names in rounds against one name after the other, and containment against all pairs."""

import numpy as np
import pytest

from kinweave.operators import relational
from kinweave.plans import exports


def one_by_one(rows, known):
    """(asset, name, mov) of new assets (id, name, label, mov, planned), in the order of ids, in a folder with known names."""
    taken, labels, out = set(known), {}, []

    def split(name):
        dot = name.rfind(".")
        return (name[:dot], name[dot:]) if dot > 0 else (name, "")

    for asset, name, label, mov, planned in sorted(rows):
        seen = labels.setdefault(name, set())
        if not planned:
            stem, end = split(name)
            new, n = name, 2
            if new in taken:
                new = f"{stem}__{label}{end}"
                if label in seen or new in taken:
                    while (new := f"{stem}__{label}-{n}{end}") in taken:
                        n += 1
            taken.add(new)
            beside = None
            if mov:
                own = mov.rsplit("/", 1)[-1]
                beside = own if new == name else ("." if own.startswith(".") else "") + split(new)[0] + split(own)[1]
            out.append((asset, new, beside))
        seen.add(label)
    return out


def given(spark, rows, known):
    """What plan_additions names rows (id, name, label, mov, planned) in one folder with these names, all in one month."""
    found = spark.createDataFrame([(i, "m", "only", f, None) for i, f, *_ in rows], "asset_id long, month string, bucket string, file_name string, cover_id long")
    assets = spark.createDataFrame([(i, i, v) for i, _, _, v, _ in rows], "id long, source_id long, live_photo_mov_path string")
    sources = spark.createDataFrame([(i, lab) for i, _, lab, _, _ in rows], "id long, label string")
    planned = [("t", i, "only", "m", known[0]) for i, _, _, _, p in rows if p] + [("t", 10**6 + k, "only", "m", f) for k, f in enumerate(known)]
    plan = spark.createDataFrame(planned, "template_id string, asset_id long, bucket string, month string, file_name string")
    return sorted((r["asset_id"], r["file_name"], r["mov_file_name"]) for r in exports.plan_additions(found, assets, sources, plan, "t").collect())


def test_the_rule_of_names(spark):
    rows = [(1, "IMG.jpg", "A", None, False), (2, "IMG.jpg", "B", "/x/.IMG.MOV", False), (3, "IMG.jpg", "B", None, False), (4, "IMG.jpg", "A", None, False), (5, "noend", "A", None, False)]
    assert given(spark, rows, []) == [(1, "IMG.jpg", None), (2, "IMG__B.jpg", ".IMG__B.MOV"), (3, "IMG__B-2.jpg", None), (4, "IMG__A-2.jpg", None), (5, "noend", None)]
    # a planned asset tells its label; names of the plan are taken
    assert given(spark, [(1, "IMG.jpg", "A", None, True), (2, "IMG.jpg", "A", "/x/IMG.mov", False)], ["IMG.jpg"]) == [(2, "IMG__A-2.jpg", "IMG__A-2.mov")]
    assert given(spark, [(7, "IMG.jpg", "B", None, False)], ["IMG.jpg", "IMG__B.jpg"]) == [(7, "IMG__B-2.jpg", None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_names_in_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["a.jpg", "a__x.jpg", "a__x-2.jpg", "a__x-3.jpg", "b", ".c", "a.b.png", "a__x__y.jpg", "d-2.jpg", "d.jpg"]
    n = 150
    label = [f"{'xy'[rng.integers(2)]}" if rng.random() < 0.7 else ["x__y", "x-2", "unknown"][rng.integers(3)] for _ in range(n)]
    rows = [(i, ["only", "group"][rng.integers(2)], "2024-01", names[rng.integers(len(names)) if rng.random() < 0.7 else 0], label[i], f"/m/.{i}.MOV" if rng.random() < 0.5 else (None if rng.random() < 0.5 else f"/m/{i}.mov"), bool(rng.random() < 0.2)) for i in range(n)]
    known = {(b, f"{s}{k}.jpg") for b in ("only", "group") for s, k in (("a__x-", 2), ("a__x-", 3), ("a__x-", 7), ("a__y", ""), ("a__x-", "02"), ("d__x-", 2), ("a", ""))}
    planned = [("t", i, b, m, f"planned-{i}.jpg") for i, b, m, _, _, _, p in rows if p] + [("t", 10**6 + k, b, "2024-01", f) for k, (b, f) in enumerate(sorted(known))] + [("u", 0, "only", "2024-01", "d.jpg")]
    found = spark.createDataFrame([(i, m, b, f, None) for i, b, m, f, _, _, _ in rows], "asset_id long, month string, bucket string, file_name string, cover_id long")
    assets = spark.createDataFrame([(i, i if label[i] != "unknown" else -1, v) for i, _, _, _, _, v, _ in rows], "id long, source_id long, live_photo_mov_path string")
    sources = spark.createDataFrame([(i, label[i]) for i in range(n)], "id long, label string")
    plan = spark.createDataFrame(planned, "template_id string, asset_id long, bucket string, month string, file_name string")
    got = {(r["bucket"], r["asset_id"], r["file_name"], r["mov_file_name"]) for r in exports.plan_additions(found, assets, sources, plan, "t").collect()}
    want = set()
    for b in ("only", "group"):
        own = [(i, f, lab, v, p) for i, bb, _, f, lab, v, p in rows if bb == b]
        want |= {(b, *x) for x in one_by_one(own, [f for t, _, bb, _, f in planned if bb == b and t == "t"])}
    assert got == want


def test_many_of_one_name_take_few_rounds(spark, monkeypatch):
    written, own = [], exports.stored
    monkeypatch.setattr(exports, "stored", lambda df: written.append(1) or own(df))
    n = 400
    found = spark.createDataFrame([(i, "m", "only", "a.jpg", None) for i in range(n)], "asset_id long, month string, bucket string, file_name string, cover_id long")
    assets = spark.createDataFrame([(i, i % 2, None) for i in range(n)], "id long, source_id long, live_photo_mov_path string")
    sources = spark.createDataFrame([(0, "x"), (1, "y")], "id long, label string")
    known = ["a.jpg", "a__x.jpg", *(f"a__x-{k}.jpg" for k in range(2, 200))]
    plan = spark.createDataFrame([("t", 10**6 + k, "only", "m", f) for k, f in enumerate(known)], "template_id string, asset_id long, bucket string, month string, file_name string")
    got = {(r["asset_id"], r["file_name"], None) for r in exports.plan_additions(found, assets, sources, plan, "t").collect()}
    assert got == set(one_by_one([(i, "a.jpg", "xy"[i % 2], None, False) for i in range(n)], known))
    assert len(written) < 8


def test_containment(spark):
    rng = np.random.default_rng(4)
    sets = [(t, int(m)) for t in range(40) for m in rng.integers(0, 12, rng.integers(1, 6))] + [(40, None), (41, 3), (41, None), (42, 99)]
    rows = [(g, int(m)) for g in range(80) for m in rng.integers(0, 12, rng.integers(0, 9))] + [(80, None), (81, 3)] * 2
    got = {(r["t"], r["g"]) for r in relational.contained(spark.createDataFrame(sets, "t long, m long"), spark.createDataFrame(rows, "g long, m long"), "t", "g", "m").collect()}
    of = lambda pairs, k: {m for i, m in pairs if i == k}
    want = {(t, g) for t in {t for t, _ in sets} for g in {g for g, _ in rows} if None not in of(sets, t) and of(sets, t) <= of(rows, g)}
    assert got == want and want


def test_previews_of_equal_templates_are_made_once(spark):
    """Templates of the same people cost one preview; their rows are those of every template by itself."""
    rng = np.random.default_rng(6)
    templates = [(t, p) for t in range(300) for p in ((0, 1), (1,), (0, 2, 3), (9,))[t % 4]] + [(300, 0), (300, None), (301, None)]
    faces = [(a, None if p == 4 else int(p), float(rng.integers(1, 50))) for a in range(60) for p in rng.integers(0, 5, 4)]
    t, f = spark.createDataFrame(templates, "template_id long, person int"), spark.createDataFrame(faces, "asset_id long, person int, area double")
    _, classes = exports.template_classes(t)
    assert exports.bucketed_by_class(f, classes).count() <= 4 * 60
    want, sums = set(), {}
    for i, people in ((i, {p for k, p in templates if k == i}) for i in range(302)):
        for a in range(60):
            own = [(p, x) for k, p, x in faces if k == a]
            if None not in people and people <= {p for p, _ in own}:
                least = min(max(x for p, x in own if p == m) for m in people) * 0.25
                bucket = "group" if any(x >= least for p, x in own if p not in people) else "only"
                want.add((i, a, bucket, least))
                n, x = sums.get((i, bucket), (0, 0.0))
                sums[i, bucket] = n + 1, x + least
    assert set(map(tuple, exports.bucketed_for_all(f, t).collect())) == want and want
    assert {(r[0], r[1]): (r[2], r[3]) for r in exports.totals_for_all(f, t).collect()} == sums
