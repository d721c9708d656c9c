"""Packing of tokenized documents into fixed windows by minimum bin slack.

A document gives its whole windows, cut from its start, and one remaining piece. How the remaining pieces share windows
depends only on how many there are of each length, a table of at most `capacity` rows however large the corpus is. On
that table each window takes the longest piece left and, by subset-sum dynamic programming over a bitset, the multiset
of other lengths that comes closest to the capacity; the counts are read back from the bitsets, and the same filling is
used for as many windows as the lengths allow. Spark then ranks the pieces of each length, with salted counts so that
no length gathers in one task, and every piece finds its window from its rank.

Defined results: a null or empty text is a document of the end token alone; repeated rows and keys are packed as
documents of their own; an empty table gives an empty result. Every token is in exactly one piece.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, short_batches, slices, stored, text_bytes
from .words import LOWER, hashed, word_starts

#: Words that a task remembers the ids of, and the most bytes of one of these.
KNOWN_WORDS, LONGEST_KNOWN = 600_000, 64
#: Values of the salt that pieces of one length are spread by.
SALTS = 1 << 20
#: What the regular expression of the tokenizer surely takes as one run: letters, or marks but for ' and <.
_LETTER, _MARK, _OTHER = 0, 1, 2
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x30] = _KIND[0x3A:0x41] = _KIND[0x5B:0x61] = _KIND[0x7B:0x7F] = _MARK
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0xC3] = _LETTER
_KIND[[0x27, 0x3C]] = _OTHER


class WordTokenizer:
    """Ids of whole texts by a tokenizer file whose words never cross white space: each distinct word is encoded once.

    A word of letters (ASCII and U+00C0 to U+00FF) and marks alone is cut further into runs of either, in lower case,
    which the tokenizer takes one by one; so many new runs go to it as one text, and an id whose token ends a word
    closes each. Any other word goes to it as it is."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.hashes, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encoded(self, raw: bytes, starts: np.ndarray, lengths: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of these words, and the ids."""
        texts = [raw[a : a + n].decode() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        sizes, parts = np.zeros(len(texts), np.int64), [[]] * len(texts)
        runs = np.flatnonzero(plain)
        ids = np.array(self.tokenizer.encode(" ".join([texts[i] for i in runs]), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(runs):
            raise ValueError("the tokenizer joins or splits runs of letters or marks; encode its words one by one")
        sizes[runs] = np.diff(ends, prepend=0)
        rest = np.flatnonzero(~plain).tolist()
        for i, x in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            parts[i] = x.ids
            sizes[i] = len(x.ids)
        out = np.zeros(int(sizes.sum()), np.uint32)
        from_run = np.repeat(plain, sizes)
        out[from_run] = ids
        out[~from_run] = np.fromiter(chain.from_iterable(parts), np.uint32, int((~from_run).sum()))
        return sizes, out

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offsets of the documents in them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        first, solid = word_starts(data, offsets)
        kind, after = _KIND[data], np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        kind[after & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)] = _LETTER
        whole = np.flatnonzero(first)
        other = np.zeros(len(data), bool)
        if len(whole):
            odd = np.logical_or.reduceat((kind == _OTHER) & solid, whole)
            other[whole[0] :] = np.repeat(odd, np.diff(whole, append=len(data)))
        cut = np.zeros(len(data), bool)
        cut[1:] = kind[1:] != kind[:-1]
        first |= cut & solid & ~other
        data = np.where(other, data, LOWER[data])
        starts = np.flatnonzero(first)
        lengths, hashes = hashed(data, starts, solid)
        hashes ^= other[starts].astype(np.uint64)
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        begin, size, flat = self.lookup(data, distinct, starts[at], lengths[at], ~other[starts[at]])
        n_ids = size[which]
        ends = np.concatenate(([0], np.cumsum(n_ids)))
        ids = flat[np.repeat(begin[which] - ends[:-1], n_ids) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(starts, offsets)]

    def lookup(self, data: np.ndarray, distinct: np.ndarray, starts: np.ndarray, lengths: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of these distinct words begin, how many they are, and the ids."""
        spot = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        known = self.hashes[spot] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        begin, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        begin[known], size[known] = self.begin[spot[known]], self.size[spot[known]]
        new = np.flatnonzero(~known)
        if not len(new):
            return begin, size, self.flat
        size[new], ids = self.encoded(data.tobytes(), starts[new], lengths[new], plain[new])
        begin[new] = np.cumsum(size[new]) - size[new] + len(self.flat)
        flat = np.concatenate([self.flat, ids])
        if len(self.hashes) + len(new) > KNOWN_WORDS:
            self.forget()
        else:
            self.flat = flat
            keep = new[lengths[new] <= LONGEST_KNOWN]
            order = np.argsort(np.concatenate([self.hashes, distinct[keep]]), kind="stable")
            self.hashes, self.begin, self.size = (np.concatenate([old, x[keep]])[order] for old, x in ((self.hashes, distinct), (self.begin, begin), (self.size, size)))
        return begin, size, flat


def pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens, salt) of every document, whole windows first. The salt counts on
    inside a task, so that equal rows differ in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, salt = WordTokenizer(tokenizer), TaskContext.get().partitionId() * 7919
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                ids, ends = work.ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows, cols = [], ([], [], [], [])
                for i in range(b - a):
                    own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), capacity):
                        part = own[start : start + capacity]
                        rows.append(a + i)
                        for c, v in zip(cols, (start, len(part), zlib.crc32(part), len(own)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols), pa.array(np.arange(salt, salt + len(rows)) % SALTS)], names=[key, "start", "length", "ids_crc32", "doc_tokens", "_salt"])
                salt += len(rows)

    kind = df.schema[key].dataType.simpleString()
    return short_batches(df).select(key, text).mapInArrow(released(run), f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, _salt long")


def filling(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest length left and the multiset of the others that fills the rest of a window best."""
    longest = max(counts)
    room, full = capacity - longest, (1 << (capacity - longest + 1)) - 1
    sums, seen = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length] - (length == longest), room // length), 1
        while left > 0 and not sums >> room & 1:
            n = min(take, left)
            seen.append((length, n, sums))
            sums |= (sums << (length * n)) & full
            left, take = left - n, take * 2
        if sums >> room & 1:
            break
    at, out = sums.bit_length() - 1, {longest: 1}
    for length, n, before in reversed(seen):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + n
            at -= length * n
    return out


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Rows (length, rank, each, sequence, offset): pieces of a length from a rank on lie in windows from a sequence on,
    `each` to a window, one after another from an offset."""
    counts, sequence, rows = {k: v for k, v in counts.items() if v}, 0, []
    used = dict.fromkeys(counts, 0)
    while counts:
        parts = filling(counts, capacity)
        times = min(counts[length] // n for length, n in parts.items())
        offset = 0
        for length, n in parts.items():
            rows.append((length, used[length], n, sequence, offset))
            used[length] += n * times
            offset += n * length
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "each", "sequence", "offset"], dtype="int64")


def ranked(parts: DataFrame, key: str) -> DataFrame:
    """parts with rank, from 0 among the pieces of a length: counts by salt, summed, and a rank inside each salt."""
    salts = max(8, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = parts.withColumn("_salt", F.pmod("_salt", F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "_salt").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy("length", "_salt").orderBy(key, "start", "ids_crc32", "doc_tokens")
    return salted.withColumn("_nth", F.row_number().over(own) - 1).join(base, ["length", "_salt"]).withColumn("rank", F.col("_nth") + F.col("_base")).drop("_salt", "_nth", "_base")


def pack(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with the sequence_id of their window and their offset there."""
    parts = stored(pieces(df, tokenizer, capacity, end_id, key, text), "pieces")
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    shared = df.sparkSession.sparkContext.broadcast(plan(counts, capacity).sort_values(["length", "rank"]))
    names = [key, "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = {c: shared.value[c].to_numpy() for c in shared.value}
        starts = (p["length"] << 44) + p["rank"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = np.searchsorted(starts, (length << 44) + rank, "right") - 1
            nth = rank - p["rank"][row]
            each = p["each"][row]
            yield batch[names].assign(sequence_id=p["sequence"][row] + nth // each, offset=p["offset"][row] + nth % each * length)

    kind = df.schema[key].dataType.simpleString()
    return ranked(parts, key).mapInPandas(released(place), f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
