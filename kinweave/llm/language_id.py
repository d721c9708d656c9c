"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly the substrings of that text. A document is
parsed from left to right into the longest phrases that each automaton accepts; the language that needs the fewest
phrases, weighted by the bits that address a phrase in its text, wins.

The automata are flat transition tables, so that a task advances thousands of positions of its documents at a time. A
document begins at the root; where one is cut, what follows is parsed on until it meets the parse from the root, so that
counts depend on the document alone. Texts are read whole. Letters are taken in lower case (A-Z) and every run of other ASCII bytes as one space.

Defined results: a null text, or one without a letter, gives `und` and score 0; equal texts give equal results; ties
between languages go to the first name in alphabetical order; with no language to learn from all rows give `und`.
Rows are neither dropped nor merged, and columns beside the text pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, slices, text_bytes, with_columns

#: The bounded training sample of each language: rows, and bytes of these rows' whole texts together.
SAMPLE_DOCS, SAMPLE_BYTES = 96, 64_000
#: Positions that one stream of a task parses before the next one takes over the state it ends in.
STREAM = 1024
SPACE, STOP = 0x20, 0x00

_CLASS = np.full(256, SPACE, np.uint8)
_CLASS[0x80:] = np.arange(0x80, 0x100)
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case and single spaces between them, each document closed by STOP; and the new offsets."""
    n = len(offsets) - 1
    folded = _CLASS[data]
    space = folded == SPACE
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[firsts] = ~space[firsts]
    kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
    out = np.zeros(int(kept[-1]) + n, np.uint8)
    ends = kept[1:] + np.arange(n)
    where = np.ones(len(out), bool)
    where[ends] = False
    out[where] = folded[keep]
    return out, np.concatenate(([0], ends + 1))


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a text, state 0 the root; built online, one byte at a time."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


@dataclass
class LanguageModel:
    """names; the row of each language's root; one table over all automata whose entry is the next row, negative
    where a phrase ends and the byte starts another; bits for each phrase; columns of the bytes."""

    names: list[str]
    roots: np.ndarray
    table: np.ndarray
    bits: np.ndarray
    column: np.ndarray

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each document (columns) in each language (rows)."""
        text, ends = normal(data, offsets)
        total, langs = len(text), len(self.names)
        streams = -(-total // STREAM)
        codes = np.zeros(streams * STREAM, np.int32)
        codes[:total] = self.column[text]
        codes = np.ascontiguousarray(codes.reshape(streams, STREAM).T)
        at = np.repeat(self.roots[:, None], streams, 1)
        states = np.empty((STREAM, langs, streams), np.int32)  # negative where a phrase ends
        for t in range(STREAM):
            at += codes[t]
            states[t] = self.table.take(at)
            at = states[t] & 0x7FFFFFFF
        self.mended(codes, states)
        broke = (states < 0).transpose(1, 2, 0).reshape(langs, -1)[:, :total]
        sums = np.zeros((langs, total + 1), np.int64)
        np.cumsum(broke, axis=1, out=sums[:, 1:])
        return (sums[:, ends[1:]] - sums[:, ends[:-1]] + 1) * self.bits[:, None]

    def mended(self, codes: np.ndarray, states: np.ndarray) -> None:
        """Parse each stream on from the state that the one before ends in (the root after a STOP), until it meets the
        parse from the root, and again what follows a stream that it does not meet in."""
        langs, streams = states.shape[1:]
        lang, stream = np.repeat(np.arange(langs), max(0, streams - 1)), np.tile(np.arange(1, streams), langs)
        while len(stream):
            at = states[STREAM - 1, lang, stream - 1] & 0x7FFFFFFF
            k, s = lang, stream
            for t in range(STREAM):
                got = self.table.take(at + codes[t, s])
                old = states[t, k, s]
                states[t, k, s] = got
                apart = np.flatnonzero((got ^ old) & 0x7FFFFFFF)
                k, s, at = k[apart], s[apart], got[apart] & 0x7FFFFFFF
                if not len(s):
                    break
            follow = s + 1 < streams
            lang, stream = k[follow], s[follow] + 1


def model_of(texts: dict[str, list[str]]) -> LanguageModel:
    """The automata of labelled texts by language. Of each language texts are taken whole, in their order, as far as they
    fit in SAMPLE_BYTES together; one that does not fit is no part of the sample."""
    names, refs = sorted(texts), []
    for name in names:
        parts, size = [], 0
        for s in dict.fromkeys(texts[name]):
            raw = np.frombuffer(s.encode(), np.uint8)
            got, _ = normal(raw, np.array([0, len(raw)], np.int64))
            if size + len(got) <= SAMPLE_BYTES:
                parts.append(got.tobytes())
                size += len(got)
        refs.append(b"".join(parts) or b"\0")
    seen = np.zeros(256, bool)
    for r in refs:
        seen[np.frombuffer(r, np.uint8)] = True
    seen[STOP] = False
    column = np.zeros(256, np.int32)  # column 1: bytes that no language has
    column[:] = 1
    column[STOP] = 0
    column[seen] = np.arange(2, 2 + seen.sum())
    width = 2 + int(seen.sum())
    tables, roots, base = [], [], 0
    for r in refs:
        steps = automaton(r)
        own = np.full((len(steps), width), -1, np.int64)
        for s, row in enumerate(steps):
            for c, to in row.items():
                if c != STOP:
                    own[s, column[c]] = to
        fresh = np.where(own[0] >= 0, own[0], 0)
        ends = own < 0
        rows = np.where(ends, fresh[None, :], own) * width + base
        rows[ends] |= 1 << 31
        rows[:, 0] = base  # STOP: back to the root without a phrase
        tables.append((rows & 0xFFFFFFFF).astype(np.uint32).view(np.int32))
        roots.append(base)
        base += len(steps) * width
    bits = np.array([np.log2(max(2, len(r))) for r in refs])
    return LanguageModel(names, np.array(roots, np.int32), np.concatenate([t.ravel() for t in tables]) if tables else np.zeros(0, np.int32), bits, column)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Learn from whole texts of a sample of SAMPLE_DOCS documents of each language, the first in the order of a hash of
    their key and text among those of SAMPLE_BYTES at most. Hashes alone are ranked; then the chosen texts are read."""
    fits = F.col(lang).isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES) & F.col(text).rlike(r"\p{L}")
    rows = labelled.filter(fits).select(F.col(lang).alias("lang"), F.xxhash64(key, text, lang).alias("own"), F.col(text).alias("text"))
    chosen = [r["own"] for r in drawn(rows.select("lang", "own"), F.col("own"), SAMPLE_DOCS, "lang").select("own").collect()]
    # repeated rows have one hash and count once
    found = rows.filter(F.col("own").isin(chosen)).groupBy("lang", "own").agg(F.max("text").alias("text")).collect() if chosen else []
    texts: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["own"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return model_of(texts)


def predictions(model: LanguageModel, texts: pa.Array) -> dict:
    """lang_pred and score of each text: und and 0 without a letter, else 2 to the power of the bits by which the
    winner is shorter, over the sum of these weights of all languages."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    best, score = np.zeros(n, np.int64), np.zeros(n)
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not model.names:
        return {"lang_pred": pa.array(["und"] * n, pa.string()), "score": pa.array(score)}
    for a, b in slices(offsets):
        bits = model.costs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        best[a:b] = bits.argmin(0)
        score[a:b] = 1 / np.exp2(np.maximum(bits.min(0) - bits, -60)).sum(0)
    names = pa.array([*model.names, "und"], pa.string())
    return {"lang_pred": names.take(pa.array(np.where(letters, best, len(model.names)))), "score": pa.array(np.where(letters, score, 0.0))}


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """df with lang_pred and score of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: predictions(shared.value, texts)

    return with_columns(df, [("lang_pred", "string"), ("score", "double")], make, text)
