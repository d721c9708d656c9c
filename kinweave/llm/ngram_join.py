"""Jaccard join of documents over word n-grams as a blocked sparse matrix product.

The matrix has a row for each distinct set of shingles (a class: all documents with that set) and a column for each
shingle. Tasks hold blocks of it as sorted arrays, by rows where texts are read and by columns where shingles are counted:

1. Column blocks find the shingles that one class alone has. A class in which these are so many that no other can reach
   the similarity is done; for most documents this is the end. A row block sends two entries of a shingle at most.
2. For the classes left, column blocks count for each shingle the classes that have it, and name one of them; a row block
   sends each of its shingles once, with its own count, so that a frequent one costs an entry for 2 MB of text.
   Ordered by that number, the first n - ceil(similarity n) + 1 shingles of a class (its prefix) meet those of every
   partner, so classes that share a prefix shingle are joined into candidate groups.
3. Inside each candidate group tiles of two row blocks are multiplied, column block by column block, adding up overlap
   counts; pairs whose sizes, or whose count so far with all the shingles still to come, stay below the bound are
   dropped. Links of a tile leave it as a spanning forest, so a group of thousands of near copies gives as many rows.

The result is exact up to chance agreement of 48-bit shingle hashes, of which a pair would need several.

Defined results: a document without words or text has no shingles, is linked with nothing and is its own component, and
so is one of fewer words than a shingle unless the whole sequences agree; equal sets are linked; repeated rows and keys
are documents of their own; a null key counts as a document but gives no component id; an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, short_batches, slices, stored, text_bytes
from .components import components
from .words import LOWER, mix, words

#: Bytes of text of a row block, entries of a column block, rows and entries of half a tile, and columns multiplied at once.
ROW_BYTES, COLUMN_ENTRIES, TILE_ROWS, TILE_ENTRIES, TILE_COLUMNS = 2 << 20, 3_000_000, 1024, 1_500_000, 2048
_TIMES = np.random.default_rng(77).integers(1, 1 << 64, 64, np.uint64) | np.uint64(1)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n must share with any partner."""
    return -(-n * percent // 100)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document one after another, the offsets in them, and the class of each set."""
    _, h, of_doc = words(LOWER[data], offsets)
    n_words = np.diff(of_doc)
    total = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        total += h[k : len(h) - size + 1 + k] * _TIMES[k]
    total = mix(total)
    sets, ends, classes = [], np.zeros(len(n_words) + 1, np.int64), np.zeros(len(n_words), np.uint64)
    for i, n in enumerate(n_words.tolist()):
        a = of_doc[i]
        if n >= size:
            own = np.unique(total[a : a + n - size + 1])
        elif n:
            own = mix((h[a : a + n] * _TIMES[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            own = np.zeros(0, np.uint64)
        sets.append(own)
        ends[i + 1] = ends[i] + len(own)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        classes[some] = mix(np.add.reduceat(mix(flat ^ _TIMES[63]), ends[some]) ^ mix(np.diff(ends)[some].astype(np.uint64)))
    return flat, ends, classes


def documents_of(df: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(key, n_shingles, class) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, ROW_BYTES):
                _, ends, classes = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(ends)), pa.array(classes.view(np.int64))], names=[key, "n_shingles", "class"])

    return short_batches(df).select(key, text).mapInArrow(released(run), f"`{key}` {df.schema[key].dataType.simpleString()}, n_shingles long, class long")


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 48-bit values as 32-bit steps, or as they are where a step is longer."""
    steps = np.diff(values, prepend=np.uint64(0))
    small = not len(steps) or steps[1:].max(initial=0) < 1 << 32
    if small and len(steps):
        return b"d" + values[:1].tobytes() + steps[1:].astype(np.uint32).tobytes()
    return b"r" + values.tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if raw[:1] == b"r":
        return np.frombuffer(raw, np.uint64, offset=1)
    out = np.concatenate([np.frombuffer(raw, np.uint64, 1, 1), np.frombuffer(raw, np.uint32, offset=9)])
    return np.cumsum(out, dtype=np.uint64)


_BLOCK = "col int, block long, hashes binary, rows binary, keys binary, others binary"


def matrix(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct classes of a row block with their sizes, and its entries in the order of shingles: row and shingle."""
    flat, ends, classes = shingle_sets(data, offsets, size)
    n = np.diff(ends)
    _, first = np.unique(classes, return_index=True)
    first = np.sort(first[n[first] > 0])
    chosen = np.zeros(len(n), bool)
    chosen[first] = True
    row = np.full(len(n), -1, np.int64)
    row[first] = np.arange(len(first))
    keep = np.repeat(chosen, n)
    entry_row, value = np.repeat(row, n)[keep], flat[keep] >> np.uint64(16)
    order = np.argsort(value, kind="stable")
    return classes[first], n[first], entry_row[order], value[order]


def begins(value: np.ndarray) -> np.ndarray:
    """Marks the first of each run of equal values."""
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    return new


def column_cuts(value: np.ndarray, columns: int) -> list[tuple[int, int, int]]:
    """(column block, from, to) of sorted shingles; column blocks are ranges of these."""
    if columns < 1 << 16:
        col = (value * np.uint64(columns) >> np.uint64(48)).astype(np.int64)
    else:
        col = (value // np.uint64(-(-(1 << 48) // columns))).astype(np.int64)
    cuts = np.flatnonzero(np.diff(col, prepend=-1, append=columns))
    return [(int(col[x]), x, y) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def sparse_parts(block: int, own: np.ndarray, n: np.ndarray, row: np.ndarray, value: np.ndarray, columns: int) -> list[tuple]:
    """What tells which shingles one class alone has: of each shingle two entries of the block at most, as any two say
    that it is no class's alone. For each column block sorted shingles with the row of each, and for each row its class
    and its place in the block (in `others`). The part of column -1 lists all classes with their sizes."""
    keep = begins(value)
    keep[1:] |= keep[:-1].copy()
    row, value = row[keep], value[keep]
    out = [(-1, block, b"", b"", own.tobytes(), n.tobytes())]
    for col, x, y in column_cuts(value, columns):
        there, at = np.unique(row[x:y], return_inverse=True)
        out.append((col, block, pack_sorted(value[x:y]), at.astype(np.uint16).tobytes(), own[there].tobytes(), there.astype(np.uint16).tobytes()))
    return out


def counted_parts(block: int, own: np.ndarray, n: np.ndarray, row: np.ndarray, value: np.ndarray, columns: int) -> list[tuple]:
    """What counts the classes of each shingle: for each column block the block's shingles once each, with the number (in
    `rows`) and the smallest (in `keys`) of its classes that have it. The part of column -1 has all entries and classes."""
    runs = np.flatnonzero(begins(value))
    count, least, once = np.diff(runs, append=len(value)).astype(np.uint16), np.minimum.reduceat(own[row], runs), value[runs]
    out = [(-1, block, pack_sorted(value), row.astype(np.uint16).tobytes(), own.tobytes(), b"")]
    for col, x, y in column_cuts(once, columns):
        out.append((col, block, pack_sorted(once[x:y]), count[x:y].tobytes(), least[x:y].tobytes(), b""))
    return out


def row_blocks(df: DataFrame, size: int, columns: int, text: str, parts: Callable[..., list[tuple]]) -> DataFrame:
    """The parts that a function gives of the matrix of the distinct classes of each row block. df must give a repeated
    task the same rows in the same order, as files do: a block is named by its task and its number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in slices(offsets, ROW_BYTES):
                found = matrix(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                if not len(found[0]):
                    continue
                cols = list(zip(*parts(block, *found, columns), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["col", "block", "hashes", "rows", "keys", "others"])
                block += 1

    return short_batches(df).select(text).mapInArrow(released(run), _BLOCK)


def column_group(parts: DataFrame):
    """By column block; the lists of rows go wherever their block hashes to."""
    return parts.groupBy(F.when(F.col("col") >= 0, F.col("col")).otherwise(-1 - F.pmod(F.xxhash64("block"), F.lit(1024)).cast("int")).alias("group"))


def entries(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all parts of a column block: shingle, class and part of each entry, in the order of the parts."""
    hashes = [unpack_sorted(x) for x in part["hashes"]]
    lengths = np.array([len(x) for x in hashes])
    classes = [np.frombuffer(k, np.uint64)[np.frombuffer(r, np.uint16)] for k, r in zip(part["keys"], part["rows"], strict=True)]
    return np.concatenate(hashes), np.concatenate(classes), lengths, np.concatenate(([0], np.cumsum(lengths)))


def alone(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """For each entry: whether no other class has its shingle."""
    order = np.lexsort((classes, hashes))
    h, c = hashes[order], classes[order]
    runs = np.flatnonzero(begins(h))
    last = np.append(runs[1:], len(h)) - 1
    out = np.empty(len(h), bool)
    out[order] = np.repeat(c[runs] == c[last], np.diff(runs, append=len(h)))
    return out


def undecided(parts: DataFrame, percent: int) -> DataFrame:
    """The classes that may have a partner: enough of their shingles belong to some other class too."""

    def lone(part: pd.DataFrame) -> pd.DataFrame:
        if part["col"].iloc[0] < 0:
            return part[["block", "keys"]].assign(counts=part["others"])
        hashes, classes, _, ends = entries(part)
        lonely = alone(hashes, classes)
        counts = []
        for i, rows in enumerate(part["rows"]):
            at = np.frombuffer(rows, np.uint16)[lonely[ends[i] : ends[i + 1]]]
            counts.append(np.bincount(at, minlength=len(part["keys"].iloc[i]) // 8).astype(np.uint32).tobytes())
        return pd.DataFrame({"block": part["block"], "keys": part["others"], "counts": counts})

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        full = [len(k) == len(c) for k, c in zip(part["keys"], part["counts"], strict=True)]
        head = part[full].iloc[0]
        n = np.frombuffer(head["counts"], np.int64)
        own = np.zeros(len(n), np.int64)
        for k, c in zip(part["keys"][~np.array(full)], part["counts"][~np.array(full)], strict=True):
            own[np.frombuffer(k, np.uint16)] += np.frombuffer(c, np.uint32)
        return pd.DataFrame({"class": np.frombuffer(head["keys"], np.int64)[n - own >= needed(n, percent)]})

    counted = column_group(parts).applyInPandas(lone, "block long, keys binary, counts binary")
    return counted.groupBy("block").applyInPandas(settle, "class long").distinct()


def prefixes(parts: DataFrame, percent: int) -> DataFrame:
    """(class, n, hashes, leaders) of the classes in these parts: the sorted shingles, and for each shingle of the prefix
    that other classes have the smallest of these classes. A class in several blocks counts in each; that alters the
    order of shingles for all alike."""

    def count(part: pd.DataFrame) -> pd.DataFrame:
        if part["col"].iloc[0] < 0:
            return part[["block", "col", "hashes", "rows", "keys"]].assign(df=b"", leaders=b"")
        sets = [unpack_sorted(x) for x in part["hashes"]]
        ends, hashes = np.cumsum([0, *map(len, sets)]), np.concatenate(sets)
        number, least = (np.concatenate([np.frombuffer(x, kind) for x in part[c]]) for c, kind in (("rows", np.uint16), ("keys", np.uint64)))
        order = np.argsort(hashes, kind="stable")
        new = begins(hashes[order])
        runs, which = np.flatnonzero(new), np.empty(len(hashes), np.int64)
        which[order] = np.cumsum(new) - 1
        df = np.minimum(np.add.reduceat(number[order].astype(np.int64), runs), 65535).astype(np.uint16)[which]
        leaders = np.minimum.reduceat(least[order], runs)[which]
        cut = lambda x: [x[ends[i] : ends[i + 1]].tobytes() for i in range(len(part))]
        return pd.DataFrame({"block": part["block"], "col": part["col"], "hashes": b"", "rows": b"", "keys": b"", "df": cut(df), "leaders": cut(leaders)})

    def assemble(part: pd.DataFrame) -> pd.DataFrame:
        head = part["col"] < 0
        own = part[head].iloc[0]
        classes, hashes, row = np.frombuffer(own["keys"], np.int64), unpack_sorted(own["hashes"]), np.frombuffer(own["rows"], np.uint16)
        part = part[~head].sort_values("col")
        # column blocks are ranges, so that their parts in order are the block's shingles in order
        which = np.cumsum(begins(hashes)) - 1
        df, leaders = (np.concatenate([np.frombuffer(x, kind) for x in part[c]])[which] for c, kind in (("df", np.uint16), ("leaders", np.int64)))
        order = np.lexsort((hashes, df, row))
        hashes, row, df, leaders = hashes[order], row[order], df[order], leaders[order]
        ends = np.searchsorted(row, np.arange(len(classes) + 1))
        out = []
        for i, own in enumerate(classes):
            a, b = ends[i], ends[i + 1]
            first = slice(a, a + (b - a) - int(needed(b - a, percent)) + 1)
            out.append((own, b - a, np.sort(hashes[a:b]).tobytes(), np.unique(leaders[first][df[first] > 1]).tolist()))
        return pd.DataFrame(out, columns=["class", "n", "hashes", "leaders"])

    counted = column_group(parts).applyInPandas(count, "block long, col int, hashes binary, rows binary, keys binary, df binary, leaders binary")
    return counted.groupBy("block").applyInPandas(assemble, "class long, n long, hashes binary, leaders array<long>")


def tile_links(classes: np.ndarray, n: np.ndarray, sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray, percent: int) -> pd.DataFrame:
    """The rows of a tile that have links: the class, the smallest class reached over links of the tile, and the number
    of documents linked. side: 0 or 1; with both in the tile only pairs of different sides count."""
    m = len(classes)
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(m), n)
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    low, high = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    bound = -(-(low + high) * percent // (100 + percent))
    alive = low * 100 >= high * percent
    if side.any() and not side.all():
        alive &= side[:, None] != side[None, :]
    np.fill_diagonal(alive, False)
    overlap, rest = np.zeros((m, m), np.float32), np.bincount(owner, minlength=m)
    total = int(shared.sum())
    for start in range(0, total, TILE_COLUMNS):
        x, y = np.searchsorted(column, (start, start + TILE_COLUMNS))
        part = np.zeros((m, min(TILE_COLUMNS, total - start)), np.float32)
        part[owner[x:y], column[x:y] - start] = 1
        overlap += part @ part.T
        rest = rest - np.bincount(owner[x:y], minlength=m)
        alive &= overlap + np.minimum(rest[:, None], rest[None, :]) >= bound
        if not alive.any():
            break
    linked = alive & (overlap >= bound)
    label = np.arange(m)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], m).min(1, initial=m))
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    some = linked.any(1)
    return pd.DataFrame({"a": classes[some], "b": classes[label[some]], "links": (linked @ copies)[some].astype(np.int64)})


def tiles(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, links): links of the sets (class, n, hashes, copies, root) inside the candidate groups named by root."""
    sizes = sets.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("n") / TILE_ENTRIES)).cast("int").alias("blocks"))
    cut = sets.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("root", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), F.when(F.col("own") > F.col("with"), 1).otherwise(0).alias("side"), "class", "n", "hashes", "copies")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(t: pd.DataFrame) -> pd.DataFrame:
            raw = [np.frombuffer(x, np.uint64) for x in t["hashes"]]
            return tile_links(t["class"].to_numpy(), t["n"].to_numpy(), raw, t["side"].to_numpy(), t["copies"].to_numpy(), percent)

        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            same = (batch[["root", "i", "j"]].diff() != 0).any(axis=1).to_numpy()
            cuts = np.append(np.flatnonzero(same), len(batch))
            done = [solve(batch.iloc[x:y]) for x, y in zip(cuts[:-2], cuts[1:-1], strict=True) if y - x > 1]
            held = batch.iloc[cuts[-2] :]
            if done:
                yield pd.concat(done)
        if held is not None and len(held) > 1:
            yield solve(held)

    return cut.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInPandas(released(run), "a long, b long, links long")


def join(df: DataFrame, percent: int = 80, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row of df: key, n_shingles, component_id (the smallest key reached over links) and n_links."""
    spark = df.sparkSession
    docs = stored(documents_of(df, size, key, text), "shingled")
    full = docs.filter("n_shingles > 0")
    classes = stored(full.groupBy("class").agg(F.min(key).alias("least"), F.count("*").alias("copies"), F.max("n_shingles").alias("n")), "classes")
    total = full.agg(F.sum("n_shingles")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    open_classes = undecided(row_blocks(df, size, max(partitions, -(-total // COLUMN_ENTRIES)), text, sparse_parts), percent)
    chosen = stored(classes.join(open_classes, "class"), "open")
    total = chosen.agg(F.sum("n")).first()[0] or 0
    texts = df.select(F.col(key).alias("least"), F.col(text).alias("text")).join(chosen.select(F.col("least").alias("k")).distinct(), F.col("least").eqNullSafe(F.col("k")), "left_semi")
    # stored, so that a repeated task cuts its rows into the same blocks
    texts = stored(texts.select("text"), "texts")
    sets = stored(prefixes(row_blocks(texts, size, max(partitions, -(-total // COLUMN_ENTRIES)), "text", counted_parts), percent), "sets")
    edges = sets.select(F.col("class").alias("a"), F.explode("leaders").alias("b")).filter("a <> b")
    groups = components(edges)
    in_groups = sets.drop("leaders").dropDuplicates(["class"]).join(groups, F.col("class") == F.col("node")).join(classes.select("class", "copies"), "class")
    links = stored(tiles(in_groups, percent), "links")
    roots = components(links)

    rooted = classes.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class")).drop("node")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    degree = links.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    result = rooted.join(ids, "root").join(degree, "class", "left").select("class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = full.join(result, "class").select(key, "n_shingles", "component_id", "n_links")
    return linked.unionByName(docs.filter("n_shingles = 0").select(key, "n_shingles", F.col(key).alias("component_id"), F.lit(0).cast("long").alias("n_links")))
