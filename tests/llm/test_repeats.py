"""Interval expansion against sorted suffixes, and the removal of repeated strings against counting all of them."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinweave.llm import intervals, queries, repeats

DATA = "/root/testdata/sf0.001"


def plain(texts, least):
    found, texts = Counter(), [(t or "").encode() for t in texts]
    for t in texts:
        found.update(t[i : i + least] for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - least + 1):
            if found[t[i : i + least]] > 1:
                gone[i : i + least] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_expansion_gives_common_prefixes_up_to_the_minimum():
    rng = np.random.default_rng(1)
    for _ in range(150):
        texts = list({bytes(rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 8))})
        texts = list(dict.fromkeys(texts + [t[3:] + b"xy" for t in texts[: rng.integers(0, 3)]]))
        symbols, begins = intervals.joined(texts)
        suffixes = [(t[i:], j) for j, t in enumerate(texts) for i in range(len(t) + 1)]
        turn = sorted(range(len(suffixes)), key=lambda i: suffixes[i])
        order, known = intervals.suffix_order(symbols)
        assert order.tolist() == turn
        least = int(rng.integers(1, 9))
        begin, end, common = intervals.classes(symbols, order, known, least)
        shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        want = [0] + [shared(suffixes[a][0], suffixes[b][0]) for a, b in zip(turn, turn[1:], strict=False)]
        assert common.tolist() == [x if x < least else -1 for x in want]
        inside = [i for i in range(len(turn)) if want[i] >= least or (i + 1 < len(turn) and want[i + 1] >= least)]
        assert [i for a, b in zip(begin, end, strict=True) for i in range(a, b + 1)] == inside


def test_only_owned_starts_count_by_weight():
    texts, owned = [b"abcabc", b"abcx"], np.array([2, 1])
    hit = lambda w: [h.tolist() for h in intervals.repeated(texts, owned, np.array(w), 3)]
    assert hit([1, 1]) == [[0], [0]] and hit([2, 1]) == [[0, 1], [0]]
    assert [h.tolist() for h in intervals.repeated(texts, np.array([2, 0]), np.array([1, 1]), 3)] == [[], []]


def made_up(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(30)]
    some = lambda a, b: " ".join(rng.choice(words, rng.integers(a, b)))
    base = [some(0, 60) for _ in range(30)]
    edited = [some(0, 20) + t[rng.integers(0, 50) :] + some(0, 20) for t in base[:20]]
    passage = [some(5, 6) + base[7] + some(5, 6) for _ in range(30)]  # one passage in many surroundings
    return [None, "", "a" * 100, "ab" * 80, "é" * 70, *base, *base[:5], *edited, *passage]


@pytest.mark.parametrize(("seed", "most", "blocks"), [(1, 512, (48, 8, 1)), (2, 2, (7, 2, 1)), (2, 1, (1,))])
def test_removal_equals_counting(spark, seed, most, blocks):
    texts = made_up(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in repeats.removed(df, least=40, most=most, blocks=blocks).orderBy("doc_id").collect()]
    assert got == plain(texts, 40)


def test_frequent_anchors_are_parted(spark):
    df = spark.createDataFrame(list(enumerate(made_up(3))), "doc_id long, text string")
    seen = []
    own = repeats.parted
    try:
        repeats.parted = lambda level, block, least: seen.append(block) or own(level, block, least)
        repeats.removed(df, least=40, most=2, blocks=(7, 2, 1)).collect()
    finally:
        repeats.parted = own
    assert seen == [7, 2, 1]


def test_segments_hold_each_start_once(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    monkeypatch.setattr(repeats, "TOGETHER", 256)
    for sizes in ([10, 500, 40, 39, 41, 0], [1000]):
        found = Counter((i, p) for part in repeats.segments(sizes, 40) for i, a, b in part for p in range(a, b - 39))
        assert found == Counter((i, p) for i, n in enumerate(sizes) for p in range(n - 39))


def test_query(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_repeats(spark, DATA).collect()}
    assert got == dict(zip(docs.doc_id, plain(docs.text, 400), strict=True))
    assert sum(r[1] for r in got.values()) > 0


def test_odd_rows(spark):
    long = " ".join(f"word{i % 997} of{i}" for i in range(20_000))
    line = "the same line again and again, with nothing new in it.\n"
    texts = [None, "", " ", long, long + " end", line * 40, line * 40, "x" * 3000, "y" * 401, "z" * 400, "z" * 400, "é" * 199 + "a"]
    rows = [(i if i != 3 else None, t, "t", 1.5, 2, 3, "g") for i, t in enumerate(texts)] + [(5, line * 40, "t", 1.5, 2, 3, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t1 string, place double, hits int, anchor int, grp string")
    got = sorted((tuple(r) for r in repeats.removed(df).collect()), key=repr)
    assert got == sorted(((r[0], *p) for r, p in zip(rows, plain([r[1] for r in rows], 400), strict=True)), key=repr)
    kept = repeats.removed(df, fields=("kept", "n_bytes")).filter("doc_id = 8").first()
    assert bytes(kept["kept"]) == b"" and kept["n_bytes"] == 401
    assert repeats.removed(df.limit(0)).collect() == []
    assert repeats.removed(df.withColumn("text", F.lit(None).cast("string"))).filter("n_bytes > 0").count() == 0
