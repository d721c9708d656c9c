"""Photos as rows: discovery, paired videos, months, fingerprints, vectors as bytes, and a detector that the caller gives."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import directory, file_name, stem, suffix
from ..operators.relational import prefix_pairs

PHOTO_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".heif")


LISTED = "path string, length long, modificationTime timestamp, mtime_ns long, inode long"


@dataclass
class Share(InputPartition):
    """The files of a folder whose names have this remainder."""

    folder: str
    number: int
    of: int


class FolderFiles(DataSource):
    """`folder_files`: the regular files right inside the folders of option `folders` (a JSON list); `shares` tasks a folder."""

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(json.loads(self.options["folders"]), int(self.options.get("shares", "8")))


class FolderReader(DataSourceReader):
    def __init__(self, folders: list[str], shares: int):
        self.folders, self.shares = folders, shares

    def partitions(self) -> list[InputPartition]:
        return [Share(f, i, self.shares) for f in self.folders for i in range(self.shares)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Names are read by every task of a folder, but what is asked about a file only by the one that it belongs to."""
        for e in os.scandir(partition.folder):
            if zlib.crc32(os.fsencode(e.name)) % partition.of == partition.number and e.is_file():
                s = e.stat()
                yield e.path, s.st_size, datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=s.st_mtime_ns // 1000), s.st_mtime_ns, s.st_ino


def listing(spark: SparkSession, *folders: str, shares: int = 8) -> DataFrame:
    """(path, length, modificationTime, mtime_ns, inode) of the regular files right inside folders that all executors see;
    hidden ones, which Spark's own file sources leave out, included."""
    spark.dataSource.register(FolderFiles)
    return spark.read.format("folder_files").option("folders", json.dumps(folders)).option("shares", str(shares)).load()


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the files right inside a folder, hidden ones left out, by Spark's own reader."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "content")


def folded(c: Column) -> Column:
    """Sort key that folds case, sharp s and its like too."""
    return F.lower(F.upper(c))


def photos(files: DataFrame) -> DataFrame:
    """The files that have a photo's suffix in any case, in the order of their paths without and then with case."""
    name = file_name(F.col("path"))
    return files.filter(F.lower(suffix(name)).isin(*PHOTO_SUFFIXES)).withColumn("file_name", name).orderBy(folded(F.col("path")), "path")


def with_movs(files: DataFrame) -> DataFrame:
    """Photos and the path of the hidden MOV beside each, null without one."""
    found = photos(files).withColumn("dir", directory(F.col("path"))).withColumn("stem", stem(F.col("file_name")))
    movs = files.withColumn("name", file_name(F.col("path"))).filter(F.lower(suffix(F.col("name"))) == ".mov").select(directory(F.col("path")).alias("dir"), "name")
    return prefix_pairs(found, movs).withColumn("live_photo_mov_path", F.when(F.col("mov").isNotNull(), F.concat_ws("/", "dir", "mov"))).drop("dir", "stem", "mov")


def fingerprints(files: DataFrame) -> DataFrame:
    """SHA-256 of the contents of (path, content) rows."""
    return files.withColumn("file_fingerprint", F.sha2("content", 256))


def fallback_fingerprints(files: DataFrame) -> DataFrame:
    """For files whose content cannot be read: SHA-256 of path, length, time in nanoseconds and inode."""
    return files.withColumn("file_fingerprint", F.sha2(F.concat_ws("|", "path", "length", "mtime_ns", "inode"), 256))


PLANNED = ["source_id", "absolute_path", "file_fingerprint", "capture_month", "live_photo_mov_path"]


def plan_fingerprint(candidates: DataFrame, batch_size: int) -> DataFrame:
    """One text for what a scan will read (the columns PLANNED) and in which batches: a hash over the candidates' own
    hashes, whatever their order; these are added up, so no task holds the whole list."""
    own = F.sha2(F.to_json(F.struct(*PLANNED), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(own, i * 15 + 1, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return candidates.agg(F.sha2(F.concat_ws(",", F.lit(batch_size), F.count("*"), *(F.coalesce(p, F.lit(0)) for p in parts)), 256).alias("plan_fingerprint"))


def exif_tags(content: bytes) -> dict[int, object]:
    """The numbers and texts of the EXIF tags of a JPEG (of its main and EXIF directories), empty where there are none."""
    at = content.find(b"Exif\0\0", 0, 1 << 17)
    if content[:2] != b"\xff\xd8" or at < 0:
        return {}
    tiff, out = content[at + 6 :], {}
    order = "<" if tiff[:2] == b"II" else ">"

    def directory(start: int, depth: int) -> None:
        for i in range(struct.unpack_from(f"{order}H", tiff, start)[0]):
            tag, kind, n, raw = struct.unpack_from(f"{order}HHI4s", tiff, start + 2 + 12 * i)
            if kind == 2:
                a = struct.unpack(f"{order}I", raw)[0] if n > 4 else None
                out.setdefault(tag, (raw[:n] if a is None else tiff[a : a + n]).split(b"\0")[0].decode("latin-1"))
            elif kind in (3, 4):
                value = struct.unpack(f"{order}{'H2x' if kind == 3 else 'I'}", raw)[0]
                if tag == 34665 and depth == 0:
                    directory(value, 1)
                else:
                    out.setdefault(tag, value)

    try:
        directory(struct.unpack_from(f"{order}I", tiff, 4)[0], 0)
    except struct.error:  # a directory that points beyond the file
        pass
    return out


def with_exif(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows without the content, with the times that its EXIF tags tell, in the order in which they count (original,
    digitised, changed), and the orientation."""
    tags = {"exif_original": 36867, "exif_digitized": 36868, "exif_changed": 306, "orientation": 274}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [exif_tags(bytes(x)) if x is not None else {} for x in b[content]]
            yield b.drop(columns=[content]).assign(**{name: [f.get(tag) for f in found] for name, tag in tags.items()}).astype({"orientation": "Int32"})

    kept = [f for f in rows.schema.fields if f.name not in (content, *tags)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {'int' if n == 'orientation' else 'string'}" for n in tags)])
    return rows.select(*(f.name for f in kept), content).mapInPandas(run, schema)


def upright(image: np.ndarray, orientation: int | None) -> np.ndarray:
    """A picture (rows, columns, colours) as its EXIF orientation wants it shown."""
    flipped = {2: image[:, ::-1], 3: image[::-1, ::-1], 4: image[::-1]}
    turned = image.transpose(1, 0, *range(2, image.ndim))
    flipped |= {5: turned, 6: turned[:, ::-1], 7: turned[::-1, ::-1], 8: turned[::-1]}
    return flipped.get(orientation or 1, image)


def upright_loader(decode: Callable[[bytes], np.ndarray]) -> Callable[[bytes], np.ndarray]:
    """A loader for detectors: the picture that `decode` makes of a file's bytes, turned as its EXIF tag says."""
    return lambda content: upright(decode(content), exif_tags(content).get(274))


def decoded(rows: DataFrame, blob: str, dimension: int = 512, strict: bool = True) -> DataFrame:
    """rows with `vector` from little-endian float32 bytes. A blob of another length fails the job, or gives null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [isinstance(x, (bytes, bytearray)) and len(x) == 4 * dimension for x in b[blob]]
            if strict and not all(good):
                raise ValueError(f"{blob}: {good.count(False)} vectors have not {dimension} numbers")
            yield b.drop(columns=[blob]).assign(vector=[np.frombuffer(x, "<f4").tolist() if ok else None for x, ok in zip(b[blob], good, strict=True)])

    kept = [f for f in rows.schema.fields if f.name not in (blob, "vector")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "vector array<float>"])
    return rows.select(*(f.name for f in kept), blob).mapInPandas(run, schema)


def detected(images: DataFrame, load: Callable[[], Callable[[bytes], list[dict]]], least_score: float = 0.7) -> DataFrame:
    """Faces of (asset_id, content) rows by a detector: load() runs once in each task and gives a function from the bytes
    of an image to dicts of x1, y1, x2, y2, image_width, image_height, score and vector. Images it fails on give a row
    with the failure and no box."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = load()
        names = ["x1", "y1", "x2", "y2", "image_width", "image_height", "score", "vector"]
        for b in batches:
            out = []
            for asset, content in zip(b["asset_id"], b["content"], strict=True):
                try:
                    found = [d for d in work(content) if d["score"] >= least_score]
                    out += [(asset, i, *(d[n] for n in names), None) for i, d in enumerate(found)]
                except Exception as e:  # a broken image is a row of its own, not the end of the scan
                    out.append((asset, None, *[None] * len(names), str(e)))
            yield pd.DataFrame(out, columns=["asset_id", "face_index", *names, "failure_reason"])

    return images.select("asset_id", "content").mapInPandas(run, "asset_id long, face_index int, x1 double, y1 double, x2 double, y2 double, image_width int, image_height int, score double, vector array<float>, failure_reason string")


def clamped(v: Column, most: Column) -> Column:
    """A pixel place inside an image, rounded half to even."""
    return F.greatest(F.lit(0), F.least(F.bround(v).cast("int"), most))
