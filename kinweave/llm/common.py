"""Helpers that several operators share: tables, the shared scratch folder, and texts as byte arrays."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy pass takes at a time inside a task, and rows of a batch that goes to Python.
SLICE_BYTES, BATCH_ROWS = 2 << 20, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; where it names none, a temporary one for a
    local master alone, since the executors of a cluster would write to their own disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="kinweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def session_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/kinweave-{spark.sparkContext.applicationId}"


def discard(spark: SparkSession) -> None:
    """Delete all that this application stored, once no result that reads it is needed any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts lineage and outlives a lost executor."""
    path = f"{session_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(df: DataFrame) -> DataFrame:
    """df, with batches for Python of BATCH_ROWS rows unless the session has set another size than Spark's own: whole
    texts are long, and both the JVM and Python hold a batch at a time."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that, once it is through, gives memory that it has freed back to the machine: Python workers live
    on after a task, and what their allocators keep would add to what the next stage's tasks need."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        library = ctypes.CDLL(None)
        if hasattr(library, "malloc_trim"):
            library.malloc_trim(0)

    return wrapped


def crc_mod(col: str, mod: int):
    """crc32 of a key written as text, modulo mod; the split into folds."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def drawn(df: DataFrame, order: Column, n: int, *by: str, shares: int = 16) -> DataFrame:
    """About n rows for each value of `by`: of each of 16 shares of a hash the first n / 16, in the order of that hash.

    The rank filter lets a partition pass on so many rows at most; no value's rows meet in one task, none reach the driver."""
    own = df.withColumn("_h", order).withColumn("_s", F.pmod("_h", F.lit(shares)))
    nth = F.row_number().over(Window.partitionBy(*by, "_s").orderBy("_h"))
    return own.withColumn("_n", nth).filter(F.col("_n") <= -(-n // shares)).drop("_s", "_n")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, nulls as empty texts, and the offsets of its n + 1 ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    if not len(texts) or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes and 50,000 documents at most; a longer document has a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = min(a + 50_000, max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1))
        yield a, b
        a = b


def with_columns(df: DataFrame, fields: list[tuple[str, str]], make: Callable[[], Callable[[pa.Array], dict]], text: str = "text") -> DataFrame:
    """df and the columns that a function of its text column gives; a column of the same name is replaced.

    make() is called once in each task and returns the function from a string array to a dict of arrays."""
    names = {name for name, _ in fields}
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                new = work(batch.column(at))
                cols = [*batch.columns, *(pa.array(new[n]) if not isinstance(new[n], (pa.Array, pa.ChunkedArray)) else new[n] for n, _ in fields)]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *(n for n, _ in fields)])

    return short_batches(df).select(*kept).mapInArrow(released(run), schema)
