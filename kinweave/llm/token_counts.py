"""Token totals by source, language and tokenizer version, kept up by signed deltas in batches.

A change inserts a document's count, deletes it, or revises it (the old count goes, the new one comes, maybe under
another version). A batch of changes becomes one table of signed sums for each key, summed inside each task before the
shuffle, so that a source of a third of all rows moves as many rows as any other. The table is written under the id of
its batch; a batch that is there already is left alone, so a batch may be sent again after a failure. Totals are the
sums of all committed batches, and `compact` folds these into one that remembers their ids.

A version is a regular expression of VERSIONS, counted by Spark itself, or a tokenizer file, counted by `counted`.

Defined results: null source, language or version are keys of their own; null counts add 0; a key whose documents are
all gone has no total; an empty batch is committed without rows.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_columns

KEYS = ["source", "lang", "version"]
_ROWS = "source string, lang string, version string, docs long, tokens long"
#: Words, or runs of ASCII letters and digits and single other characters.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}


def tokens_of(text: Column, version: str) -> Column:
    """The count of a whole text by a tokenizer version; 0 for a null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(VERSIONS[version])).cast("long")


def changes(inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Signed rows (KEYS, docs, tokens) of counted rows that come and counted rows that go; a revision is both."""
    parts = [df.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.coalesce("tokens", F.lit(0)) * sign).cast("long").alias("tokens")) for df, sign in ((inserted, 1), (deleted, -1)) if df is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counted(df: DataFrame, files: dict[str, str], text: str = "text") -> DataFrame:
    """df with a column for each version: how many tokens its file (of the tokenizers library) finds in the whole text."""

    def make() -> Callable[[pa.Array], dict]:
        from tokenizers import Tokenizer

        known = {version: Tokenizer.from_file(path) for version, path in files.items()}
        return lambda texts: {v: pa.array([len(x.ids) for x in t.encode_batch([s or "" for s in texts.to_pylist()], add_special_tokens=False)], pa.int64()) for v, t in known.items()}

    return with_columns(df, [(version, "long") for version in files], make, text)


class Rollup:
    """Totals in a folder that all executors share: a folder of signed sums for each batch, and, in a compacted rollup,
    `base`, the sums of the batches whose ids are in `folded`. A folder counts once its writer has left _SUCCESS in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _done(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}/_SUCCESS"))

    def committed(self) -> list[str]:
        """The folders of the batches that are committed here."""
        found = self._fs.globStatus(self._path(f"{self.path}/batch=*/_SUCCESS")) or []
        return sorted(f.getPath().getParent().getName() for f in found)

    def taken(self, batch: str) -> bool:
        """Whether a batch is committed, here or in a rollup that this one was compacted from."""
        name = f"batch={quote(batch, safe='')}"
        return self._done(name) or (self._done("folded") and not self.spark.read.schema("batch string").parquet(f"{self.path}/folded").filter(F.col("batch") == name).isEmpty())

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add a batch; False if it is taken already. What a failed write left without _SUCCESS is overwritten."""
        if self.taken(batch):
            return False
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={quote(batch, safe='')}")
        return True

    def deltas(self) -> DataFrame:
        """The signed sums of all that is committed."""
        names = self.committed() + (["base"] if self._done("base") and self._done("folded") else [])
        if not names:
            return self.spark.createDataFrame([], _ROWS)
        return self.spark.read.schema(_ROWS).parquet(*(f"{self.path}/{n}" for n in names))

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens)."""
        sums = self.deltas().groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, path: str) -> Rollup:
        """A rollup elsewhere that has these totals as its base; batches sent again to it are known by their ids."""
        new = Rollup(self.spark, path)
        self.totals().select(*KEYS, F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens")).write.mode("overwrite").parquet(f"{new.path}/base")
        ids = self.spark.createDataFrame([(n,) for n in self.committed()], "batch string")
        if self._done("folded"):
            ids = ids.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/folded"))
        ids.write.mode("overwrite").parquet(f"{new.path}/folded")
        return new


ORACLE_SQL = r"""
WITH marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
kept AS (
  SELECT d.source, d.lang, CASE WHEN m.quality = 0 THEN 'pieces-2' ELSE 'words-1' END AS version,
         CASE WHEN m.quality = 0 THEN len(regexp_extract_all(coalesce(d.text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]'))
              ELSE len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) END AS tokens
  FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id
  WHERE coalesce(m.toxic, 0) <> 1)
SELECT source, lang, version, count(*) AS n_docs, CAST(sum(tokens) AS BIGINT) AS n_tokens
FROM kept GROUP BY source, lang, version
"""
