"""Tables as versions in a shared folder: a new version is written whole, checked, and then named the current one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES, violations


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a temporary one for a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="kinweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Snapshots of the gallery's tables under a root folder, by one writer at a time.

    A snapshot is a folder v=N with a folder for each table. It counts from the moment its marker is renamed into place,
    so readers see all of a commit's tables or none. Parquet of earlier versions stays until `prune`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/_committed")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def current(self) -> int:
        return (self.versions() or [0])[-1]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version: the newest folder of it that is not newer, and the rows appended since."""
        schema, folders = TABLES[name].schema, []
        for v in reversed([v for v in self.versions() if version is None or v <= version]):
            folders += [f for f in (f"{self.root}/v={v}/{name}.more", f"{self.root}/v={v}/{name}") if self._fs.exists(self._path(f))]
            if folders and folders[-1].endswith(f"/{name}"):
                break
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def append(self, tables: dict[str, DataFrame], based_on: int | None = None) -> int:
        """Add rows to tables as one snapshot without writing the old ones again. New rows are checked among themselves
        and their keys against those there are, by a join."""
        return self.commit({}, based_on, more=tables)

    def commit(self, tables: dict[str, DataFrame], based_on: int | None = None, check: bool = True, more: dict[str, DataFrame] | None = None) -> int:
        """Write new versions of tables as one snapshot; refuse if another commit came since `based_on`, or if a key or
        value rule of a table is broken."""
        if based_on is not None and based_on != self.current():
            raise RuntimeError(f"version {self.current()} came after {based_on}")
        new = self.current() + 1
        self._fs.delete(self._path(f"{self.root}/v={new}"), True)  # what a refused commit left
        for name, df in tables.items():
            path = f"{self.root}/v={new}/{name}"
            df.select(*TABLES[name].schema.fieldNames()).write.mode("overwrite").parquet(path)
            if check and (bad := violations(self.spark.read.schema(TABLES[name].schema).parquet(path), TABLES[name]).take(3)):
                raise ValueError(f"{name}: {bad}")
        for name, df in (more or {}).items():
            table, path = TABLES[name], f"{self.root}/v={new}/{name}.more"
            df.select(*table.schema.fieldNames()).write.mode("overwrite").parquet(path)
            rows, old = self.spark.read.schema(table.schema).parquet(path), self.read(name)
            bad = violations(rows, table).take(3)
            for rule, key in [("true", k) for k in table.keys] + list(table.partial):
                bad = bad or rows.filter(rule).join(old.filter(rule).select(*key), list(key), "left_semi").select(*key).take(3)
            if bad:
                raise ValueError(f"{name}: {bad}")
        staged, marker = self._path(f"{self.root}/_staged-{uuid.uuid4().hex}"), self._path(f"{self.root}/_committed/{new}")
        self._fs.mkdirs(marker.getParent())
        self._fs.create(staged).close()
        if self._fs.exists(marker) or not self._fs.rename(staged, marker):
            raise RuntimeError(f"another writer committed version {new}")
        return new

    def prune(self, keep: int = 2) -> None:
        for v in self.versions()[:-keep]:
            first = self.versions()[-keep:][0]
            needed = {n for n in TABLES if not any(self._fs.exists(self._path(f"{self.root}/v={w}/{n}")) for w in self.versions() if v < w <= first)}
            for n in set(TABLES) - needed:
                for f in (n, f"{n}.more"):
                    self._fs.delete(self._path(f"{self.root}/v={v}/{f}"), True)


def missing_tables(store: Store) -> list[str]:
    return [n for n in TABLES if store.read(n).isEmpty() and not any(store._fs.exists(store._path(f"{store.root}/v={v}/{n}")) for v in store.versions())]


def migrate(store: Store, steps: dict[int, dict]) -> int:
    """Run the table migrations that are newer than the stored schema version, each in a commit with its number."""
    meta = store.read("schema_meta")
    row = meta.filter(F.col("key") == "schema_version").select("value").take(1)
    at = int(row[0][0]) if row else 0
    for number in sorted(n for n in steps if n > at):
        tables = {name: change(store.read(name)) for name, change in steps[number].items()}
        tables["schema_meta"] = store.spark.createDataFrame([("schema_version", str(number))], TABLES["schema_meta"].schema)
        store.commit(tables, store.current())
    return max([at, *steps])
