"""The aligned pieces against whole texts, the perfect hash, and the query against loops over whole encodings."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinweave.llm import alignment, queries

DATA = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Whole texts by the tokenizers themselves."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def groups(self, text):
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False)
        x = [bytes(self.byte[c] for c in t) for t in a.tokens]
        b = self.b.encode(text)
        y = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in b)]
        if not b"".join(x) == b"".join(y) == b" " + text.encode():
            return []
        ends_a, ends_b = np.cumsum([len(t) for t in x]), np.cumsum([len(t) for t in y])
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        out, low = [], 0
        for high in cuts:
            own = lambda ids, ends: [i for i, e in zip(ids, ends.tolist(), strict=True) if low < e <= high]  # noqa: B023, E731
            out.append((own(a.ids, ends_a), own(b, ends_b)))
            low = high
        return out

    def rows(self, texts):
        found = [self.groups(t) for t in texts]
        links = [Counter((i, j) for a, b in g for i in a for j in b) for g in found]
        count = Counter(p for own in links for p in own)
        top = defaultdict(int)
        for (i, _), n in count.items():
            top[i] = max(top[i], n)
        out = []
        for g, own in zip(found, links, strict=True):
            sha = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g).encode()).hexdigest() if g else ""
            best = sum(m for p, m in own.items() if count[p] == top[p[0]])
            out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), best, sum(m * count[p] for p, m in own.items()), sha))
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "\n", "a\nb", "a \n b", "tab\t x", "é ü", "é  ü", "日本語 のテキスト", "日本語のテキスト" * 50, "<s> </s> <unk> <|endoftext|> <0x41>", "▁ ▁a", "a▁b",
    "don't can't I'll", "1234567 12 3.14", "…  …", "  x   y", "x ́y", "=" * 300, "a" * 1000, "\x00 \x7f", "  z", "🙂 🙂🙂", "mixed日本 words", "end.", " !", "! ", "﻿x y", "x\r\ny", "word " * 3000,
]


@pytest.mark.parametrize("wide", [1024, 1])
def test_pieces_give_what_whole_texts_give(plain, monkeypatch, wide):
    monkeypatch.setattr(alignment, "WIDE", wide)
    monkeypatch.setattr(alignment, "CHARS", 200)
    pieces = alignment.Pieces(*PATHS)
    rng = np.random.default_rng(5)
    signs = list("ab z.,'!?<>  \n\té▁日🙂1") + ["the ", "  ", " don't", "ing "]
    texts = ODD + ["".join(rng.choice(signs, rng.integers(1, 30))) for _ in range(800)]
    numbers, of = pieces.documents(texts)
    for i, text in enumerate(texts):
        want, ids = plain.groups(text), numbers[of == i]
        if not want:
            assert not len(ids) or pieces.bad[ids].any(), text
            continue
        assert ";".join(pieces.groups[i] for i in ids.tolist()) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want), text
        links = Counter()
        for i in ids.tolist():
            part = slice(pieces.first[i], pieces.first[i] + pieces.size[i])
            links.update(dict(zip(pieces.pairs[part].tolist(), pieces.times[part].tolist(), strict=True)))
        assert links == Counter(i << 24 | j for a, b in want for i in a for j in b), text
        assert (pieces.n_a[ids].sum(), pieces.n_b[ids].sum(), pieces.n_groups[ids].sum(), pieces.n_links[ids].sum()) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want), sum(len(a) * len(b) for a, b in want))


def test_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN", 50)
    pieces = alignment.Pieces(*PATHS)
    for k in range(40):
        pieces.documents([f"w{k} w{k + 1} " + "x" * 100])
        assert len(pieces.n_a) <= 60
    monkeypatch.setattr(alignment, "HELD", 100)
    pieces.documents(["y" * 1000])
    pieces.documents(["z"])
    assert pieces.held == 1


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 7, 50, 1000, 20_000):
        keys = np.unique(rng.integers(0, 1 << 47, 2 * n + 1))[: max(n, 0)]
        h = alignment.PerfectHash.of(keys)
        assert sorted(h.places(keys).tolist()) == list(range(len(keys)))
        assert (h.places(rng.integers(1 << 48, 1 << 50, 100)) == -1).all()
        assert h.seeds.nbytes + h.keys.nbytes <= 10 * max(1, len(keys)) + 8


@pytest.mark.parametrize("chunks", [1, 40])
def test_odd_rows(spark, plain, chunks):
    rows = [(i if i != 4 else None, t, 1, 2, "k", 3.5) for i, t in enumerate(ODD)] + [(9, ODD[9], 1, 2, "k", 3.5)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int, n_a int, key string, counts double")
    got = sorted((tuple(r) for r in alignment.align(df, *PATHS, chunks=chunks).collect()), key=repr)
    assert got == sorted(((r[0], *p) for r, p in zip(rows, plain.rows([r[1] for r in rows]), strict=True)), key=repr)
    if chunks == 1:
        assert alignment.align(df.limit(0), *PATHS).collect() == []
        assert {tuple(r)[1:] for r in alignment.align(df.withColumn("text", F.lit(None).cast("string")), *PATHS).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_query(spark, plain):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_alignment(spark, DATA).collect()}
    assert got == dict(zip(docs.doc_id, plain.rows(docs.text), strict=True))
