"""Alignment of two tokenizers over the same bytes, and in how many documents each pair of their ids is linked.

Both tokenizers cut a text into ranges of bytes; where both end, a group ends, and all ids of one side in a group are
linked with all of the other. No token of either crosses the place between a character that is no white space and a
space, so a text is cut there into pieces, each distinct piece is encoded and aligned once in a task, and a document is
the list of its pieces. (`Pieces` refuses tokenizer files for which that does not hold.)

First pass: documents are dealt into chunks by a hash; a task gathers each chunk's distinct pairs and in how many of the
chunk's documents each is linked. The distinct pairs of the corpus are cut into SHARDS by their first id, and each shard
gets a minimal perfect hash of its pairs: buckets, largest first, take the first displacement that sends all their pairs to
free places. Chunks' counts become dense vectors indexed by that hash, which are summed up FAN at a time until one a shard
is left; a key stored at each place verifies that a pair is what it seems. All pairs of a first id share a shard, so its
highest count is known there. Second pass: each chunk gets the totals of its own pairs, and its documents are aligned
again and look these up.

Nothing grows with the corpus but the number of chunks: a shard's table is bounded by the vocabularies (of 50,000 and 32,000
ids at most 6.3 million pairs), a chunk's pairs by what its documents hold. Nothing reaches the driver.

Defined results: texts that are null, empty, or not given back byte for byte by either tokenizer have no tokens: zeros, an
empty groups_sha256, and no part in any count. Repeated rows and null or repeated keys are documents of their own. Other
columns are ignored whatever their names. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, stored
from .intervals import spread
from .words import mix

#: Shards of the pairs, vectors that one step of the sums adds up, and pairs of a bucket on average.
SHARDS, FAN, BUCKET = 256, 16, 3
#: Pieces that a task remembers and their characters together, the longest that is looked up; pieces and characters that
#: are encoded together; links of a group from which its ids are counted before they are paired; and texts of a step.
KNOWN, HELD, LONGEST, TOGETHER, CHARS, WIDE, STEP = 400_000, 1 << 23, 64, 8192, 1 << 16, 1024, 128
#: Of a pair's key, the first id times 2^24 and the second; vocabularies are smaller than that.
PAIR = (1 << 48) - 1
#: Fixed value: the pattern of words that byte-level vocabularies of this kind are split by.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT, _OTHER = re.compile(r"(?<=[^\s▁]) "), re.compile(r"(?:^|[\s▁]) ")


def cut(text: str) -> list[str]:
    """The pieces of a text: parted at each space that follows neither white space nor the sign that stands for a space."""
    return _CUT.split(text) if _OTHER.search(text) else text.split(" ")


class Numbers(dict):
    """Numbers of strings; one that is new gets the next number and is noted."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.n = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = self.n
        self.n += 1
        self.new.append(word)
        return n


class Grown:
    """An array of numbers that grows."""

    def __init__(self, kind: type = np.int64):
        self.room, self.n = np.zeros(1024, kind), 0

    def extend(self, new: np.ndarray) -> None:
        if self.n + len(new) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(self.n + len(new), self.room.dtype)])
        self.room[self.n : self.n + len(new)] = new
        self.n += len(new)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.room[: self.n][at]

    def __len__(self) -> int:
        return self.n


class Pieces:
    """The aligned pieces of texts. A piece is what stands between two cuts; both tokenizers read it with a space before.

    New pieces that end in no white space are joined again by spaces and read as one text; since no token
    crosses a piece's end, the ids are those of each. What is not given back byte for byte is halved until the piece is
    found that is to blame."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level alphabet: printable bytes are themselves
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        vocabulary = self.read_bytes_file(bytes_path, byte)
        tokens = [vocabulary.get(i, "") for i in range(max(vocabulary) + 1)]
        self.a_bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        if any(re.search(rb"[!-~] ", t) for t in self.a_bytes) or any(re.search(rb"[^ ] ", t) for t in self.b_bytes):
            raise ValueError("a token crosses the end of a word; texts cannot be cut there")
        self.a_size, self.b_size = (np.array([len(t) for t in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        self.text_of = np.array([str(i) for i in range(max(len(tokens), len(names)))], object)
        self.forget()

    def read_bytes_file(self, path: str, byte: dict[str, int]) -> dict[int, str]:
        """The file's vocabulary by ids. Where ids are in the order of its merges, they are the ranks of tiktoken, which
        reads words several times as fast as the file's own library; else that library reads them."""
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        own = Tokenizer.from_file(path)
        if all(vocabulary.get("".join(m)) == 256 + i for i, m in enumerate(merges)) and len({vocabulary[c] for c in byte} & set(range(256))) == 256:
            ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(merges)}
            self.read_a = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            own.encode_special_tokens = True
            self.read_a = lambda text: own.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return {i: t for t, i in own.get_vocab(with_added_tokens=True).items()}

    def forget(self) -> None:
        self.known, self.row, self.held = Numbers(), Grown(), 0
        self.n_a, self.n_b, self.n_groups, self.n_links, self.first, self.size, self.pairs, self.times = (Grown() for _ in range(8))
        self.bad = Grown(bool)
        self.groups: list[str] = []

    def add(self, n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray, n_links: np.ndarray, size: np.ndarray, pairs: np.ndarray, times: np.ndarray, groups: list[str], bad: bool = False) -> None:
        self.first.extend(len(self.pairs) + np.cumsum(size) - size)
        for own, new in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.n_links, n_links), (self.size, size), (self.pairs, pairs), (self.times, times)):
            own.extend(np.asarray(new, np.int64))
        self.bad.extend(np.full(len(n_a), bad))
        self.groups += groups

    def learn(self, words: list[str]) -> None:
        """Add these pieces, in their order."""
        joined = " ".join(words)
        raw = (" " + joined).encode()
        a = np.array(self.read_a(" " + joined), np.int64)
        b = np.array(self.b.encode(joined, num_threads=1) if joined else [self.space], np.int64)
        good = b"".join([self.a_bytes[i] for i in a.tolist()]) == raw == b"".join([self.b_bytes[i] for i in b.tolist()])
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        if not good or not np.isin(ends, both).all():
            if len(words) > 1:
                self.learn(words[: len(words) // 2])
                self.learn(words[len(words) // 2 :])
            else:
                none = np.zeros(1, np.int64)
                self.add(none, none, none, none, none, none[:0], none[:0], [""], True)
            return
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        piece_a, piece_b, piece = (np.searchsorted(ends, x) for x in (end_a, end_b, both))
        n = len(words)
        links = np.zeros(n, np.int64)
        np.add.at(links, piece, in_a * in_b)
        wide = in_a * in_b > WIDE  # long groups of few ids: count these first
        times = in_b[group_a] * ~wide[group_a]
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        keys = [np.repeat(piece_a << 48 | a << 24, times) | b[spread(first_b[group_a], times)]]
        weights = [np.ones(len(keys[0]), np.int64)]
        for g in np.flatnonzero(wide).tolist():
            x, m = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            y, k = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            keys.append((piece[g] << 48 | x[:, None] << 24 | y[None, :]).ravel())
            weights.append((m[:, None] * k[None, :]).ravel())
        pairs, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, at, np.concatenate(weights))
        count = lambda x: np.bincount(x, minlength=n)
        place_a, place_b = np.arange(len(a)) + first_b[group_a], np.arange(len(b)) + (first_a + in_a)[group_b]
        out = np.full(2 * (len(a) + len(b)), ",", object)
        out[2 * place_a[first_a]] = ";"
        out[2 * place_b[first_b]] = "|"
        cuts = np.cumsum(count(piece_a) + count(piece_b))
        out[2 * (cuts - count(piece_a) - count(piece_b))] = ""
        out[2 * place_a + 1], out[2 * place_b + 1] = self.text_of[a], self.text_of[b]
        flat, bounds = out.tolist(), [0, *(2 * cuts).tolist()]
        groups = ["".join(flat[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
        self.add(count(piece_a), count(piece_b), count(piece), links, count(pairs >> 48), pairs & PAIR, sums, groups)

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces of these texts, in order, and the text of each; null and empty texts have none.
        Numbers hold until the next call."""
        if len(self.n_a) > KNOWN or self.held > HELD:
            self.forget()
        parts = [cut(t) if t else [] for t in texts]
        found = np.array(list(map(self.known.__getitem__, chain.from_iterable(parts))), np.int64)
        new, self.known.new = self.known.new, []
        if new:
            plain = np.array([bool(w) and not w[-1].isspace() and w[-1] != "▁" for w in new])
            order = np.argsort(~plain, kind="stable")
            row = np.empty(len(new), np.int64)
            row[order] = np.arange(len(new)) + len(self.n_a)
            self.row.extend(row)
            size, batch = 0, []
            for i in order.tolist():
                if batch and (size > CHARS or len(batch) == TOGETHER or not plain[i]):
                    self.learn(batch)
                    size, batch = 0, []
                size += len(new[i])
                batch.append(new[i])
            self.learn(batch)
            self.held += sum(map(len, new))
            for w in new:
                if len(w) > LONGEST:
                    del self.known[w]
        return self.row[found], np.repeat(np.arange(len(parts)), [len(p) for p in parts])


_READY: dict[tuple[str, str], Pieces] = {}


def pieces_of(paths: tuple[str, str]) -> Pieces:
    """The pieces that this worker process remembers, over tasks and both passes."""
    if paths not in _READY:
        _READY[paths] = Pieces(*paths)
    return _READY[paths]


def shard_of(keys: np.ndarray) -> np.ndarray:
    return (mix((keys >> 24).astype(np.uint64) + np.uint64(1)) % np.uint64(SHARDS)).astype(np.int64)


def hashed(keys: np.ndarray, seed: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (seed.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))


class PerfectHash:
    """A minimal perfect hash of distinct longs: n keys have the places 0 to n - 1, one each.

    A key's bucket tells its displacement; the key hashed with that is its place. The key stored there verifies it."""

    def __init__(self, seeds: np.ndarray, keys: np.ndarray):
        self.seeds, self.keys = seeds, keys

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        seeds, placed = np.zeros(max(1, -(-n // BUCKET)), np.int32), np.zeros(n, np.int64)
        bucket = cls.buckets(keys, len(seeds))
        turn = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=len(seeds))
        ends, free = np.cumsum(sizes), np.ones(n, bool)
        for size in range(int(sizes.max(initial=0)), 0, -1):
            left = np.flatnonzero(sizes == size)
            members = keys[turn[(ends[left] - size)[:, None] + np.arange(size)]]
            seed = 1
            while len(left):  # TRIES displacements at once; of buckets that meet the first stays, the others try again
                if size == 1 and seed > 64:  # single keys take what is left, their place itself as a negative seed
                    at = np.flatnonzero(free)
                    seeds[left], placed[at], free[at] = -1 - at, members[:, 0], False
                    break
                tries = np.arange(seed, seed + (1 if len(left) > 256 else 32))
                at = (hashed(members[:, None, :], tries[None, :, None]) % np.uint64(n)).astype(np.int64)
                ordered = np.sort(at, axis=2)
                good = free[at].all(axis=2) & (ordered[:, :, 1:] != ordered[:, :, :-1]).all(axis=2)
                rows = np.flatnonzero(good.any(axis=1))
                pick = good[rows].argmax(axis=1)
                flat = at[rows, pick]
                fresh = np.zeros(flat.size, bool)
                fresh[np.unique(flat.ravel(), return_index=True)[1]] = True
                keep = fresh.reshape(flat.shape).all(axis=1)
                rows, pick, flat = rows[keep], pick[keep], flat[keep]
                seeds[left[rows]] = tries[pick]
                placed[flat.ravel()] = members[rows].ravel()
                free[flat.ravel()] = False
                stay = np.ones(len(left), bool)
                stay[rows] = False
                left, members = left[stay], members[stay]
                if not len(rows) or len(tries) == 1:
                    seed += len(tries)
        return cls(seeds, placed)

    @staticmethod
    def buckets(keys: np.ndarray, n: int) -> np.ndarray:
        return (hashed(keys, np.zeros(len(keys), np.int64)) % np.uint64(n)).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those that are none of the hash's own."""
        if not len(self.keys) or not len(keys):
            return np.full(len(keys), -1, np.int64)
        seed = self.seeds[self.buckets(keys, len(self.seeds))].astype(np.int64)
        at = np.where(seed < 0, -1 - seed, (hashed(keys, np.maximum(seed, 0)) % np.uint64(len(self.keys))).astype(np.int64))
        return np.where(self.keys[at] == keys, at, -1)


class Tally:
    """In how many documents of a chunk each pair is linked."""

    def __init__(self) -> None:
        self.keys, self.counts, self.later, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.later.append(keys)
        self.held += len(keys)
        if self.held > 1 << 20:
            self.settle()

    def settle(self) -> None:
        if self.later:
            keys, at = np.unique(np.concatenate([self.keys, *self.later]), return_inverse=True)
            counts = np.bincount(at[len(self.keys) :], minlength=len(keys))
            counts[at[: len(self.keys)]] += self.counts
            self.keys, self.counts, self.later, self.held = keys, counts, [], 0


def used_pieces(pieces: Pieces, own: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, piece and how often, for each distinct piece of each text that is given back as a whole; by text."""
    keys, often = np.unique(text << 40 | own, return_counts=True)
    text, own = keys >> 40, keys & ((1 << 40) - 1)
    fine = ~np.isin(text, text[pieces.bad[own]])
    return text[fine], own[fine], often[fine]


PARTS = "chunk int, shard int, keys array<long>, counts array<long>"


def chunk_counts(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """PARTS: the distinct pairs of each chunk (chunk, text) by shards, with the number of the chunk's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, tallies = pieces_of(paths), {}
        for batch in batches:
            chunks, texts = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_pylist()
            for a in range(0, len(texts), STEP):
                text, own, _ = used_pieces(pieces, *pieces.documents(texts[a : a + STEP]))
                keys = np.unique(np.repeat(text, pieces.size[own]) << 48 | pieces.pairs[spread(pieces.first[own], pieces.size[own])])
                chunk = chunks[a : a + STEP][keys >> 48]
                for c in np.unique(chunk).tolist():
                    tallies.setdefault(c, Tally()).add(keys[chunk == c] & PAIR)
        for c, tally in tallies.items():
            tally.settle()
            shard = shard_of(tally.keys)
            turn = np.argsort(shard, kind="stable")
            used, first = np.unique(shard[turn], return_index=True)
            keys, counts = np.split(tally.keys[turn], first[1:]), np.split(tally.counts[turn], first[1:])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(used), pa.int32()), pa.array(used.astype(np.int32)), pa.array(keys, kind), pa.array(counts, kind)], names=["chunk", "shard", "keys", "counts"])

    return short_batches(docs.select("chunk", "text").repartition("chunk")).mapInArrow(run, PARTS)


def perfect_hashes(parts: DataFrame) -> DataFrame:
    """(shard, seeds, keys): the minimal perfect hash of each shard's distinct pairs, keys by place."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        h = PerfectHash.of(rows["pair"].to_numpy())
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "seeds": [h.seeds.tobytes()], "keys": [h.keys.tobytes()]})

    pairs = parts.select("shard", F.explode("keys").alias("pair")).distinct()
    return pairs.groupBy("shard").applyInPandas(build, "shard int, seeds binary, keys binary")


def read_hash(row: object) -> PerfectHash:
    return PerfectHash(np.frombuffer(row["seeds"], np.int32), np.frombuffer(row["keys"], np.int64))


def branched(parts: DataFrame, tables: DataFrame, branches: int) -> tuple[DataFrame, DataFrame]:
    """parts with their branch, and a copy of each table for every branch."""
    return parts.withColumn("branch", F.pmod("chunk", F.lit(branches))), tables.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(branches - 1))))


def totals(parts: DataFrame, hashes: DataFrame, branches: int) -> DataFrame:
    """(shard, seeds, keys, counts, best): dense count vectors summed over all chunks in a tree, and for each pair whether
    its count is its first id's highest."""

    def dense(part: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(table):
            return pd.DataFrame({"shard": [], "branch": [], "counts": []})
        h = read_hash(table.iloc[0])
        out = np.zeros(len(h.keys), np.int64)
        for keys, counts in zip(part["keys"], part["counts"], strict=True):
            at = h.places(np.asarray(keys))
            if (at < 0).any():
                raise ValueError("a pair is missing from its shard")
            out[at] += counts
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "branch": [part["branch"].iloc[0]], "counts": [out.tobytes()]})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        out = sum(np.frombuffer(c, np.int64) for c in rows["counts"])
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "branch": [rows["branch"].iloc[0]], "counts": [out.tobytes()]})

    left, right = branched(parts, hashes, branches)
    rows = left.groupBy("shard", "branch").cogroup(right.groupBy("shard", "branch")).applyInPandas(dense, "shard int, branch int, counts binary")
    while branches > 1:
        branches = -(-branches // FAN)
        rows = rows.withColumn("branch", F.pmod("branch", F.lit(branches))).groupBy("shard", "branch").applyInPandas(added, "shard int, branch int, counts binary")

    def with_best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flags = []
            for keys, counts in zip(b["keys"], b["counts"], strict=True):
                c, (_, own) = np.frombuffer(counts, np.int64), np.unique(np.frombuffer(keys, np.int64) >> 24, return_inverse=True)
                top = np.zeros(own.max() + 1, np.int64)
                np.maximum.at(top, own, c)
                flags.append((c == top[own]).tobytes())
            yield b.assign(best=flags)

    joined = hashes.join(rows.select("shard", "counts"), "shard")
    return joined.mapInPandas(with_best, "shard int, seeds binary, keys binary, counts binary, best binary")


def looked_up(parts: DataFrame, tables: DataFrame, branches: int) -> DataFrame:
    """(chunk, keys, counts, best) as bytes: the totals of each chunk's own pairs."""

    def find(part: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chunk, keys in zip(part["chunk"], part["keys"], strict=True) if len(part) else ():
            row, keys = table.iloc[0], np.asarray(keys)
            at = read_hash(row).places(keys)
            if (at < 0).any():
                raise ValueError("a pair is missing from its shard")
            out.append((chunk, keys.tobytes(), np.frombuffer(row["counts"], np.int64)[at].tobytes(), np.frombuffer(row["best"], bool)[at].tobytes()))
        return pd.DataFrame(out, columns=["chunk", "keys", "counts", "best"])

    left, right = branched(parts.select("chunk", "shard", "keys"), tables, branches)
    return left.groupBy("shard", "branch").cogroup(right.groupBy("shard", "branch")).applyInPandas(find, "chunk int, keys binary, counts binary, best binary")


FIELDS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(df: DataFrame, bytes_path: str, pieces_path: str, key: str = "doc_id", text: str = "text", chunks: int | None = None) -> DataFrame:
    """(key, *FIELDS) of every row. chunks: into how many the documents are dealt, as many as shuffle partitions if None."""
    spark, paths, kind = df.sparkSession, (bytes_path, pieces_path), df.schema[key].dataType.simpleString()
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    branches = -(-n // FAN)
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.pmod(F.xxhash64(key, text), F.lit(n)).cast("int").alias("chunk"))
    parts = stored(chunk_counts(docs, paths), "parts")
    hashes = stored(perfect_hashes(parts), "hashes")
    tables = stored(totals(parts, hashes, branches), "totals")
    found = looked_up(parts, tables, branches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, at, held = pieces_of(paths), None, None
        names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

        def table(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, counts, best = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) if rows else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, bool)))
            turn = np.argsort(keys)
            return keys[turn], counts[turn], best[turn]

        def about(texts: list[str | None], totals_of: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple]:
            numbers, of = pieces.documents(texts)
            text, own, often = used_pieces(pieces, numbers, of)
            out = np.zeros((6, len(texts)), np.int64)
            for row, x in zip(out, (pieces.n_a, pieces.n_b, pieces.n_groups, pieces.n_links), strict=False):
                np.add.at(row, text, x[own] * often)
            size = pieces.size[own]
            at = spread(pieces.first[own], size)
            keys, times, of_pair = pieces.pairs[at], pieces.times[at] * np.repeat(often, size), np.repeat(text, size)
            all_keys, counts, best = totals_of
            place = np.searchsorted(all_keys, keys)
            if len(keys) and (not len(all_keys) or (all_keys[np.minimum(place, len(all_keys) - 1)] != keys).any()):
                raise ValueError("a pair of a document is missing from its chunk")
            np.add.at(out[4], of_pair, times * best[place])
            np.add.at(out[5], of_pair, times * counts[place])
            ids, bounds = numbers.tolist(), np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
            sha = [hashlib.sha256(";".join([pieces.groups[i] for i in ids[x:y]]).encode()).hexdigest() if n else "" for x, y, n in zip(bounds, bounds[1:], out[0].tolist(), strict=False)]
            return list(zip(*out.tolist(), sha, strict=True))

        waiting: list[tuple] = []
        for batch in batches:
            chunk = batch.column(0).to_pylist()
            first, texts, cols = batch.column(1).to_pylist(), batch.column(3).to_pylist(), [batch.column(i) for i in (4, 5, 6)]
            out, kept, a = [], [], 0
            while a < len(chunk):
                if chunk[a] != at:
                    at, waiting, held = chunk[a], [], None
                if first[a] == 0:
                    waiting.append(tuple(c[a].as_py() for c in cols))
                    a += 1
                    continue
                if held is None:
                    held, waiting = table(waiting), []
                b = a
                while b < len(chunk) and b < a + STEP and chunk[b] == at:
                    b += 1
                out += about(texts[a:b], held)
                kept += range(a, b)
                a = b
            if kept:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(kept)), *(pa.array(c, pa.string() if i == 6 else pa.int64()) for i, c in enumerate(columns))], names=[key, *names])

    none = lambda t: F.lit(None).cast(t)
    counted = found.select("chunk", F.lit(0).alias("is_doc"), none(kind).alias("key"), none("string").alias("text"), "keys", "counts", "best")
    rows = docs.select("chunk", F.lit(1).alias("is_doc"), "key", "text", none("binary").alias("keys"), none("binary").alias("counts"), none("binary").alias("best"))
    both = counted.unionByName(rows).repartition("chunk").sortWithinPartitions("chunk", "is_doc")
    return short_batches(both).mapInArrow(run, f"`{key}` {kind}, {FIELDS}")
