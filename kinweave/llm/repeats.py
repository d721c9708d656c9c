"""Removal of byte strings that occur more than once, by suffix arrays over the places where that can be.

Each start of a `least`-byte string is named by an anchor, the string's k-byte window with the smallest hash, so equal
strings have equal anchors at equal places. Consecutive starts of a text that share an anchor are one run, and the run's
bytes all of its strings. Anchors that occur once in the corpus are settled. For all others equal runs are counted by a
128-bit hash before any text moves; where all runs of an anchor come more than once that says all. Else one of each is
fetched, and the runs of an anchor meet in one task, which builds their Burrows-Wheeler transform and expands its
intervals up to the minimum length (see `intervals`): a string is repeated if the starts in its interval count for two or
more.

An anchor with more distinct runs than MOST (a passage in very many surroundings) is parted: its runs are cut into blocks
of fewer starts, and a block's key takes in all bytes that its strings must share. Blocks shrink to a single start, where
a key has one run left, so no task ever gets more than MOST runs of a key and no start is left out.

Texts cross the network twice, once for each distinct text that holds an anchor's first run, once with what to remove.
Long texts are read in segments, so that memory does not grow with them but for the text itself.

Defined results: a null text counts as empty; equal texts, repeated rows and null or repeated keys are texts of their own,
so all of a text of `least` bytes or more that comes twice is removed; columns beside key and text are ignored whatever
their names; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals
from .common import short_batches, stored
from .words import mix

#: Distinct runs of a key that a task compares at a time, bytes of runs in one transform, and bytes of a segment.
MOST, TOGETHER, SEGMENT = 512, 1 << 18, 1 << 20
#: Starts of the blocks that the runs of frequent anchors are cut into, and again.
BLOCKS = (48, 8, 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 22) - 1)
RUN = "anchor long, place long, c1 long, c2 long"


def two_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(11), text).alias("t2")]


def name_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of byte strings as two longs each."""
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(p) for p in parts]), ">i8").astype(np.int64)
    return both[::2], both[1::2]


def window(least: int) -> int:
    return max(1, min(32, least // 12))


def packed(start: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Start of a run, its number of starts, and its anchor's place from its start, in one long."""
    return (start << 24) | (n << 12) | at


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 24, (place >> 12) & 4095, place & 4095


def anchors(data: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of segments at these places, of `least` bytes or more: the segment of each run, its start in the data, its number
    of starts, its anchor's place in the data and the anchor's hash."""
    k = window(least)
    width = least - k + 1
    power = np.full(len(data), _ODD, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    inverse = np.full(len(data), np.uint64(pow(int(_ODD), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    n = len(data) - k + 1
    hashes = mix((total[k:] - total[:n]) * inverse[:n])
    del power, inverse, total
    # the smallest hash, then the leftmost, of each window of `width` places, from the running minima of blocks
    key = (hashes & ~_LOW) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    key = np.concatenate([key, np.full(blocks * width - n, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(blocks, width)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = intervals.spread(firsts, sizes - least + 1)
    best = np.minimum(behind[starts], ahead[starts + width - 1])
    place = (best & _LOW).astype(np.int64)
    segment = np.repeat(np.arange(len(firsts)), sizes - least + 1)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (segment[1:] != segment[:-1])]))
    return segment[new], starts[new], np.diff(np.append(new, len(starts))), place[new], hashes[place[new]].astype(np.int64)


def segments(sizes: list[int], least: int) -> Iterator[list[tuple[int, int, int]]]:
    """Parts (text, from, to) that hold every start of these texts once, in lists of about SEGMENT bytes."""
    out, total = [], 0
    for i, size in enumerate(sizes):
        for a in range(0, size - least + 1, SEGMENT):
            b = min(size, a + SEGMENT + least - 1)
            out.append((i, a, b))
            total += b - a
            if total >= SEGMENT:
                yield out
                out, total = [], 0
    if out:
        yield out


def runs_of(texts: list[bytes], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Text, packed place, anchor of each run, and the segments' data with each run's ends in it."""
    for part in segments([len(t) for t in texts], least):
        pieces = [texts[i][a:b] for i, a, b in part]
        raw = b"".join(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        firsts = np.cumsum(sizes) - sizes
        segment, start, n, place, anchor = anchors(np.frombuffer(raw, np.uint8), firsts, sizes, least)
        text, from_ = np.array([i for i, _, _ in part])[segment], np.array([a for _, a, _ in part])[segment]
        yield text, packed(start - firsts[segment] + from_, n, place - start), anchor, np.stack([start, start + n + least - 1]), raw


def whole(column: pa.Array) -> list[bytes]:
    return [x.as_py() if x.is_valid else b"" for x in column.cast(pa.binary())]


def all_runs(docs: DataFrame, least: int) -> DataFrame:
    """(t1, t2, anchor, place, c1, c2) of every run of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for text, place, anchor, ends, raw in runs_of(whole(batch.column(2)), least):
                c1, c2 = name_of([raw[a:b] for a, b in ends.T.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t1[text], t2[text], anchor, place, c1, c2)], names=["t1", "t2", "anchor", "place", "c1", "c2"])

    return short_batches(docs).select("t1", "t2", "text").mapInArrow(run, f"t1 long, t2 long, {RUN}")


LEVEL = "grp long, c1 long, c2 long, n int, at int, weight long, big boolean, bytes binary"


def fetched(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """The bytes of the wanted runs (t1, t2, place, grp, c1, c2, weight, big), each once, as rows of LEVEL."""
    texts = docs.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    lists = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("place", "grp", "c1", "c2", "weight", "big")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, w in zip(whole(batch.column(0)), batch.column(1), strict=True):
                v = w.values
                place = v.field("place").to_numpy()
                start, n, at = unpacked(place)
                for a in range(0, len(place), 4096):
                    part = slice(a, a + 4096)
                    out = [text[s : s + m + least - 1] for s, m in zip(start[part].tolist(), n[part].tolist(), strict=True)]
                    cols = [v.field(c).slice(a, 4096) for c in ("grp", "c1", "c2")]
                    cols += [pa.array(n[part].astype(np.int32)), pa.array(at[part].astype(np.int32)), v.field("weight").slice(a, 4096), v.field("big").slice(a, 4096), pa.array(out, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["grp", "c1", "c2", "n", "at", "weight", "big", "bytes"])

    return short_batches(texts.join(lists, ["t1", "t2"]).select("text", "w")).mapInArrow(run, LEVEL)


def compared(level: DataFrame, least: int) -> DataFrame:
    """(grp, c1, c2, low, high): ranges of starts, from a run's own first one, whose strings occur more than once."""

    def ranges(keys: list[np.ndarray], n: np.ndarray, weight: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
        hits = intervals.repeated(texts, n, weight, least)
        own, low, high = [], [], []
        for i, h in enumerate(hits):
            if len(h):
                cut = np.flatnonzero(np.diff(h) != 1)
                low.append(h[np.append(0, cut + 1)])
                high.append(h[np.append(cut, len(h) - 1)] + 1)
                own.append(np.full(len(cut) + 1, i))
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        rows = flat(own).astype(np.int64)
        return pa.RecordBatch.from_arrays([*(pa.array(k[rows]) for k in keys), pa.array(flat(low)), pa.array(flat(high))], names=["grp", "c1", "c2", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def work(rows: pa.Table) -> pa.RecordBatch:
            get = lambda c: rows.column(c).to_numpy().astype(np.int64)
            return ranges([get("grp"), get("c1"), get("c2")], get("n"), get("weight"), rows.column("bytes").to_pylist())

        for batch in batches:
            grp = batch.column(0).to_numpy()
            sizes = np.cumsum(pc.binary_length(batch.column(5)).to_numpy().astype(np.int64))
            begin, done = 0, 0
            for cut in [*(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist()]:
                if size + int(sizes[cut - 1]) - done >= TOGETHER:
                    yield work(pa.Table.from_batches([*held, batch.slice(begin, cut - begin)]))
                    held, size, begin, done = [], 0, cut, int(sizes[cut - 1])
            if begin == 0 and held and size >= TOGETHER and grp[0] != held[-1].column(0)[-1].as_py():
                yield work(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(batch.slice(begin))
            size += int(sizes[-1]) - done if len(sizes) else 0
        if held:
            yield work(pa.Table.from_batches(held))

    rows = level.select("grp", "c1", "c2", "n", "weight", "bytes").repartition("grp").sortWithinPartitions("grp")
    return short_batches(rows).mapInArrow(run, "grp long, c1 long, c2 long, low long, high long")


def parted(level: DataFrame, block: int, least: int) -> DataFrame:
    """The runs of a level cut into blocks of starts: rows of LEVEL with the run (up: grp, c1, c2) and how far from its
    first start the block begins. The key of a block takes in the bytes that all of its strings have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for grp, c1, c2, n, at, weight, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for b in range(-at // block, (n - 1 - at) // block + 1):
                    low, high = max(0, at + b * block), min(n, at + (b + 1) * block)
                    core = text[at + b * block + block - 1 : at + b * block + least]
                    key = xxhash.xxh3_64_intdigest(b"%d %d %d " % (grp, block, b) + core) - (1 << 63)
                    out.append((grp, c1, c2, low, key, high - low, at - low, weight, text[low : high + least - 1]))
            if out:
                cols = list(zip(*out, strict=True))
                d1, d2 = name_of(cols[8])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip((*cols[:5], d1, d2, *cols[5:]), (pa.int64(),) * 7 + (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                    names=["up_grp", "up1", "up2", "off", "grp", "c1", "c2", "n", "at", "weight", "bytes"],
                )

    rows = short_batches(level).select("grp", "c1", "c2", "n", "at", "weight", "bytes")
    return rows.mapInArrow(run, "up_grp long, up1 long, up2 long, off long, grp long, c1 long, c2 long, n int, at int, weight long, bytes binary")


def with_size(contents: DataFrame, most: int) -> DataFrame:
    """Distinct runs with `settled`, whether all runs of their key come as often, more than once or not, as their weight
    says; and `big`, whether their key has more than `most` of them.

    A string of a run never stands at another start of it, since the anchor would be at another place. So a run of weight
    2 is repeated as a whole, and one that is alone with its key and comes once not at all."""
    sizes = contents.groupBy("grp").agg(F.count("*").alias("g"), F.min("weight").alias("w"))
    return contents.join(sizes, "grp").withColumn("settled", (F.col("g") == 1) | (F.col("w") > 1)).withColumn("big", F.col("g") > most).drop("g", "w")


def as_a_whole(contents: DataFrame, n: Column) -> DataFrame:
    """(grp, c1, c2, low, high) of the settled runs that are repeated, of n starts each."""
    return contents.filter("settled AND weight > 1").select("grp", "c1", "c2", F.lit(0).cast("long").alias("low"), n.cast("long").alias("high"))


def repeats(level: DataFrame, least: int, most: int, blocks: tuple[int, ...]) -> DataFrame:
    """(grp, c1, c2, low, high) over all runs of a level that are not settled: small keys are compared, large ones parted."""
    small, big = compared(level.filter("NOT big"), least), level.filter("big")
    if not blocks or big.isEmpty():
        return small if blocks else compared(level, least)
    cut = stored(parted(big, blocks[0], least), "blocks")
    links = cut.select("up_grp", "up1", "up2", "off", "grp", "c1", "c2")
    one = cut.groupBy("grp", "c1", "c2").agg(F.first("n").alias("n"), F.first("at").alias("at"), F.sum("weight").alias("weight"), F.first("bytes").alias("bytes"))
    below = stored(with_size(stored(one, "contents"), most), "level")
    rest = below.filter("NOT settled").select("grp", "c1", "c2", "n", "at", "weight", "big", "bytes")
    found = as_a_whole(below, F.col("n")).unionByName(repeats(rest, least, most, blocks[1:])).join(links, ["grp", "c1", "c2"])
    up = found.select(F.col("up_grp").alias("grp"), F.col("up1").alias("c1"), F.col("up2").alias("c2"), (F.col("low") + F.col("off")).alias("low"), (F.col("high") + F.col("off")).alias("high"))
    return small.unionByName(up)


def spans(df: DataFrame, text: str = "text", least: int = 400, most: int = MOST, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """(t1, t2, hits): for each distinct text with repeated strings, by its two hashes, ranges (low, high) of starts."""
    if not 1 <= least <= 4000:
        raise ValueError("least must be 1 to 4000 bytes")
    docs = df.select(F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.octet_length("text") >= least)
    docs = docs.select(*two_hashes(F.col("text")), "text")
    copies = docs.groupBy("t1", "t2").agg(F.count("*").alias("copies"))
    runs = stored(all_runs(docs, least), "all")
    often = stored(runs.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    live = runs.join(often, "anchor")
    live = stored(live.dropDuplicates(["t1", "t2", "place"]).join(copies, ["t1", "t2"]), "runs")
    contents = live.groupBy(F.col("anchor").alias("grp"), "c1", "c2").agg(F.sum("copies").alias("weight"), F.min(F.struct("t1", "t2", "place")).alias("r"))
    sized = stored(with_size(stored(contents, "contents"), most), "sized")
    wanted = sized.filter("NOT settled").select("r.*", "grp", "c1", "c2", "weight", "big")
    level = stored(fetched(docs, wanted, least), "level")
    starts = F.shiftright("r.place", 12).bitwiseAND(4095)
    found = stored(as_a_whole(sized, starts).unionByName(repeats(level, least, most, blocks)), "found").withColumnRenamed("grp", "anchor")
    start = F.shiftright("place", 24)
    hits = found.join(live.select("t1", "t2", "anchor", "place", "c1", "c2"), ["anchor", "c1", "c2"])
    return hits.groupBy("t1", "t2").agg(F.collect_list(F.struct((start + F.col("low")).alias("low"), (start + F.col("high")).alias("high"))).alias("hits"))


def without(text: bytes, low: np.ndarray, high: np.ndarray, least: int) -> tuple[int, bytes]:
    """Number of maximal runs removed, and what is left, of a text with these ranges of repeated starts."""
    turn = np.argsort(low, kind="stable")
    low, reach = low[turn], np.maximum.accumulate(high[turn] + least - 1)
    new = np.flatnonzero(np.append(True, low[1:] > reach[:-1]))
    begin, end = low[new].tolist(), reach[np.append(new[1:] - 1, len(reach) - 1)].tolist()
    return len(begin), b"".join([text[a:b] for a, b in zip([0, *end], [*begin, len(text)], strict=True)])


FIELDS = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary", "kept_sha256": "string"}


def removed(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 400, fields: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept_sha256"), **options: object) -> DataFrame:
    """(key, *fields) of every row; `kept` are the bytes left, which need not be UTF-8 any more."""
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("_key", "text", *two_hashes(F.col("text")))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {f: [] for f in FIELDS}
            for t, h in zip(whole(batch.column(1)), batch.column(2), strict=True):
                n, kept = without(t, h.values.field("low").to_numpy(), h.values.field("high").to_numpy(), least) if h.is_valid else (0, t)
                for f, x in zip(FIELDS, (len(t), len(t) - len(kept), n, kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    if f in fields:
                        out[f].append(x)
            types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[f], types[FIELDS[f]]) for f in fields)], names=[key, *fields])

    marked = rows.join(spans(df, text, least, **options), ["t1", "t2"], "left").select("_key", "text", "hits")
    return short_batches(marked).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{f} {FIELDS[f]}" for f in fields))
