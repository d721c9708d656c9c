import glob
import os

import duckdb
import pandas as pd

import corpus_pipeline
from kinweave.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = pd.read_parquet(f"{DATA}/benchmark.parquet").text[0]
    planted = [(10**6, None, "en", "s", 0), (10**6 + 1, "%%% 12", "en", "s", 6), (10**6 + 2, bench, "en", "s", len(bench)), (10**6 + 3, "Write to ann.b@mail1.example.com or 10.1.2.3 about these very ordinary words of ours", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {k: set(v.doc_id) for k, v in seen.items()}
    assert 10**6 not in ids["language_id"] and 10**6 + 1 not in ids["language_id"] and len(ids["language_id"]) >= 200
    assert ids["packing"] == ids["pii"] == ids["decontamination"] < ids["ngram_join"] < ids["language_id"]
    assert 10**6 + 2 not in ids["decontamination"]
    text = seen["pii"].set_index("doc_id").text[10**6 + 3]
    assert text == "Write to [EMAIL] or [IP] about these very ordinary words of ours"
    assert seen["packing"].groupby("sequence_id").length.sum().max() <= 4096


def test_repeated_and_missing_ids(spark):
    bench = pd.read_parquet(f"{DATA}/benchmark.parquet").text[0]
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in ("one", "two", "three"))
    rows = [(1, one), (2, one + " end"), (2, two), (None, one), (None, three), (None, three + " end"), (5, bench), (5, three + " other words " + two), (None, bench)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = [(r["doc_id"], r["text"]) for r in corpus_pipeline.without_near_duplicates(spark, docs, DATA).collect()]
    assert len(near) == 5 and set(near) - {(None, three), (None, three + " end")} == {(1, one), (2, two), (5, bench), rows[7]}
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminated(spark, docs, DATA).collect()]
    assert sorted(clean, key=str) == sorted((r for r in rows if r[1] != bench), key=str)


def test_oracles(spark):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, DATA).toPandas(), c.sql(sql).df()
        cols = sorted(want.columns)
        rows = lambda d: sorted(map(tuple, d[cols].values.tolist()))
        assert rows(got) == rows(want)


def test_stages_against_brute_force(spark):
    """Each stage on the rows that the one before kept, by plain Python; nulls, repeats and empty texts among them."""
    from test_operators import brute_join, encode, judge, plain_spans

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = pd.read_parquet(f"{DATA}/benchmark.parquet")
    first = docs.orderBy("doc_id").limit(3).collect()
    odd = [(None, first[0]["text"], None, None, None), tuple(first[1]), tuple(first[1]), (10**6, None, None, "s", 0), (10**6 + 1, "", "en", None, 0), (10**6 + 2, " 12 %%", "en", "s", 6), (None, bench.text[0], "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    rows = lambda df: sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["language_id"](spark, docs, DATA)
    assert rows(kept) == sorted((r for r in rows(docs) if r[1] and any(c.isalpha() for c in r[1])), key=repr)

    kept = corpus_pipeline.stored(kept, "test")
    before = rows(kept)
    distinct = list(dict.fromkeys((r[0], r[1]) for r in before))
    order = sorted(range(len(distinct)), key=lambda i: (distinct[i][0] is None, distinct[i][0] or 0))
    groups = {distinct[i]: g for i, (_, g, _) in zip(order, brute_join([distinct[i][1] for i in order], range(len(order))), strict=True)}
    near = rows(stages["ngram_join"](spark, kept, DATA))
    assert len(near) == len(set(groups.values())) and {groups[r[:2]] for r in near} == set(groups.values())
    assert all(order.index(distinct.index(r[:2])) == groups[r[:2]] or r[0] == distinct[order[groups[r[:2]]]][0] for r in near)

    kept = corpus_pipeline.stored(stages["ngram_join"](spark, kept, DATA), "test")
    before = rows(kept)
    found = judge([r[1] for r in before], zip(bench.item_id, bench.text, strict=True))
    clean = rows(stages["decontamination"](spark, kept, DATA))
    assert clean == [r for r, f in zip(before, found, strict=True) if not f[4]] and len(clean) < len(before)

    kept = corpus_pipeline.stored(stages["decontamination"](spark, kept, DATA), "test")
    masked = stages["pii"](spark, kept, DATA).toPandas()
    assert len(masked) == len(clean) and not any(plain_spans(t) for t in masked.text) and (masked.n_chars == masked.text.str.len()).all()
    untouched = {r[1] for r in clean if not plain_spans(r[1])}
    assert len(untouched - set(masked.text)) <= 2  # what the tagger adds

    kept = corpus_pipeline.stored(stages["pii"](spark, kept, DATA), "test")
    pieces = stages["packing"](spark, kept, DATA).toPandas()
    assert pieces.length.sum() == sum(map(len, encode([r[1] for r in rows(kept)]))) and pieces.groupby("sequence_id").length.sum().max() <= 4096

    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0, name
