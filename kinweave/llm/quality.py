"""Quality of whole texts by a byte-level convolutional network in numpy.

Filters over WIDTH bytes read every byte of a document. Chunks of two halves overlap by one and cover the whole of it;
in each chunk a filter's largest response counts, a small hidden layer takes these, and the mean of all its chunks gives
one probability. Training (Adam, cross entropy) uses a bounded sample of labelled documents, as many of either label,
each of them whole; scoring uses every byte of every text.

Defined results: a null or empty text is one empty chunk and has a score too; equal texts have equal scores; with no
labelled row, or one label alone, every score is 0.5. Rows are neither dropped nor merged; the label, the key and any
other column are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, slices, text_bytes, with_columns

WIDTH, FILTERS, HIDDEN, HALF = 6, 24, 12, 256
#: The bounded sample: documents of each label, and most bytes of one of these (longer ones are not sampled).
SAMPLE_DOCS, SAMPLE_BYTES = 1200, 32 << 10
#: Bytes that one convolution takes at a time.
PART = 1 << 18


def halves_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the half chunks of documents of these offsets, and the offsets of documents in them."""
    n = np.diff(offsets)
    count = np.maximum(1, -(-n // HALF))
    ends = np.concatenate(([0], np.cumsum(count)))
    nth = np.arange(ends[-1]) - np.repeat(ends[:-1], count)
    starts = np.repeat(offsets[:-1], count) + nth * HALF
    return starts, np.minimum(HALF, np.repeat(offsets[1:], count) - starts), ends


def responses(data: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Responses (n - WIDTH + 1, FILTERS) of filters (WIDTH, 256, FILTERS) over bytes."""
    n = len(data) - WIDTH + 1
    out = filters[0].take(data[:n], 0)
    for j in range(1, WIDTH):
        out += filters[j].take(data[j : n + j], 0)
    return out


def pooled(data: np.ndarray, offsets: np.ndarray, filters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest responses of every chunk, its length, and the offsets of documents in the chunks."""
    # each document is followed by zero bytes, so that a filter never reads on into the next
    n, docs = np.diff(offsets), len(offsets) - 1
    apart = offsets + np.arange(docs + 1) * WIDTH
    wide = np.zeros(int(apart[-1]) + WIDTH, np.uint8)
    where = np.ones(int(apart[-1]), bool)
    where[(np.repeat(apart[1:] - WIDTH, WIDTH) + np.tile(np.arange(WIDTH), docs)).astype(np.int64)] = False
    wide[: len(where)][where] = data
    starts, lengths, ends = halves_of(offsets)
    starts = starts + np.repeat(np.arange(docs), np.diff(ends)) * WIDTH
    top = np.empty((len(starts), FILTERS), np.float32)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PART)))
        own = starts[at:to] - starts[at]
        stop = own + np.maximum(1, lengths[at:to])
        got = responses(wide[starts[at] : starts[at] + stop[-1] + WIDTH - 1], filters)
        # from the start of each half to its end, and from there, unused, to the next start
        top[at:to] = np.maximum.reduceat(got, np.stack([own, stop], 1).ravel()[:-1])[::2]
        at = to
    counts = np.diff(ends)
    chunks = np.maximum(1, counts - 1)
    cends = np.concatenate(([0], np.cumsum(chunks)))
    first = np.repeat(ends[:-1], chunks) + np.arange(cends[-1]) - np.repeat(cends[:-1], chunks)
    second = np.minimum(first + 1, np.repeat(ends[1:], chunks) - 1)
    size = lengths[first] + np.where(second > first, lengths[second], 0)
    return np.maximum(top[first], top[second]), size, cends


def chunk_inputs(top: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rectified responses, and how full the chunk is."""
    return np.concatenate([np.maximum(top, 0), (np.log1p(size) / np.log1p(2 * HALF))[:, None].astype(np.float32)], 1)


def forward(x: np.ndarray, ends: np.ndarray, w: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each document from the inputs of its chunks; with the hidden layer and its means."""
    hidden = np.tanh(x @ w["in"] + w["in0"])
    mean = np.add.reduceat(hidden, ends[:-1]) / np.diff(ends)[:, None]
    return 1 / (1 + np.exp(-np.clip(mean @ w["out"] + w["out0"], -30, 30))), hidden, mean


def probabilities(data: np.ndarray, offsets: np.ndarray, w: dict) -> np.ndarray:
    top, size, ends = pooled(data, offsets, w["filters"])
    return forward(chunk_inputs(top, size), ends, w)[0]


def trained(texts: list[list[bytes]], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 3) -> dict:
    """Weights from the chunks of each document and its label."""
    rng = np.random.default_rng(seed)
    w = {
        "filters": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32),
        "in": rng.normal(0, 0.3, (FILTERS + 1, HIDDEN)).astype(np.float32),
        "in0": np.zeros(HIDDEN, np.float32),
        "out": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
        "out0": np.zeros(1, np.float32),
    }
    m, v, step = {n: np.zeros_like(x) for n, x in w.items()}, {n: np.zeros_like(x) for n, x in w.items()}, 0
    long = 2 * HALF
    share = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))  # either label weighs a half
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            chunks = [c for i in own for c in texts[i]]
            ends = np.concatenate(([0], np.cumsum([len(texts[i]) for i in own])))
            size = np.array([len(c) for c in chunks])
            data = np.zeros((len(chunks), long + WIDTH - 1), np.uint8)
            for i, c in enumerate(chunks):
                data[i, : len(c)] = np.frombuffer(c, np.uint8)
            got = w["filters"][0][data[:, :long]]
            for j in range(1, WIDTH):
                got += w["filters"][j][data[:, j : long + j]]
            got[np.arange(long)[None, :] >= np.maximum(size, 1)[:, None]] = -1e9
            best = got.argmax(1)
            top = np.take_along_axis(got, best[:, None], 1)[:, 0]
            x = chunk_inputs(top, size)
            p, hidden, mean = forward(x, ends, w)
            dz = ((p - labels[own]) * share[labels[own]] / len(own)).astype(np.float32)
            g = {"out": mean.T @ dz, "out0": dz.sum(keepdims=True)}
            dh = np.repeat(dz[:, None] * w["out"] / np.diff(ends)[:, None], np.diff(ends), 0) * (1 - hidden**2)
            g |= {"in": x.T @ dh, "in0": dh.sum(0)}
            dtop = (dh @ w["in"].T)[:, :FILTERS] * (top > 0)
            g["filters"] = np.zeros_like(w["filters"])
            rows, cols = np.arange(len(chunks))[:, None], np.arange(FILTERS)[None, :]
            for j in range(WIDTH):
                np.add.at(g["filters"][j], (data[rows, best + j], cols), dtop)
            step += 1
            for n, d in g.items():
                m[n], v[n] = 0.9 * m[n] + 0.1 * d, 0.999 * v[n] + 0.001 * d * d
                w[n] = (w[n] - rate * (1 - epoch / epochs) * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def chunks_of(text: bytes) -> list[bytes]:
    """The overlapping chunks that cover a text."""
    return [text[x * HALF : (x + 2) * HALF] for x in range(max(1, -(-len(text) // HALF) - 1))]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label") -> dict | None:
    """Weights learnt from SAMPLE_DOCS whole documents of each label, the first in the order of a hash, of SAMPLE_BYTES at
    most; None if one label lacks. A null text is an empty one.

    The sample is drawn from the keys of `labels` alone, so that it can be broadcast to the texts, which stay in place.
    Where keys are repeated in `docs`, as many rows again are drawn from theirs."""
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("label")).distinct()
    sized = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    taken = [(r["k"], r["label"]) for r in drawn(known, F.xxhash64("k"), SAMPLE_DOCS, "label").collect()]
    keys = docs.sparkSession.createDataFrame(taken, f"k {labels.schema[key].dataType.simpleString()}, label int")
    rows = sized.join(F.broadcast(keys), "k").select("label", "text", F.xxhash64("k", "text").alias("own"))
    found = sorted((r["own"], r["label"], r["text"]) for r in drawn(rows, F.col("own"), SAMPLE_DOCS, "label").select("own", "label", "text").collect())
    marks = np.array([r[1] for r in found])
    if len(set(marks.tolist())) < 2:
        return None
    return trained([chunks_of(r[2].encode()) for r in found], marks)


def score(df: DataFrame, weights: dict | None, text: str = "text", column: str = "score") -> DataFrame:
    """df with the probability of label 1 of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = shared.value

        def work(texts: pa.Array) -> dict:
            data, offsets = text_bytes(texts)
            out = np.full(len(offsets) - 1, 0.5)
            if w is not None:
                for a, b in slices(offsets):
                    out[a:b] = probabilities(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], w)
            return {column: pa.array(out)}

        return work

    return with_columns(df, [(column, "double")], make, text)
