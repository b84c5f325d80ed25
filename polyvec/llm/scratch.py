"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder, and only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="polyvec-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


class Scratch:
    """Writes tables under one new folder; drop() removes those that are no longer read. A table that a
    result still reads lazily can't be dropped here: the folder goes when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{uuid.uuid4().hex}"
        self.count = 0
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/t{self.count}"

    def write(self, df: DataFrame) -> DataFrame:
        """df, written as Parquet and read back: no lineage, and it outlives lost executors."""
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


class Log:
    """Numbered manifests below a path: each appears whole, by a rename, and the last one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/{name}".rstrip("/"))

    def _last(self) -> int:
        at = self._at("")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return max((int(n[1:-5]) for n in names if n.startswith("v")), default=0)

    def read(self) -> dict | None:
        last = self._last()
        return json.loads(self.spark.read.text(f"{self.path}/_log/v{last:08d}.json", wholetext=True).first()[0]) if last else None

    def segment(self, kind: str, table: DataFrame) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        table.write.parquet(f"{self.path}/{name}")
        return name

    def publish(self, state: dict) -> None:
        draft, final = self._at(f"draft-{uuid.uuid4().hex}"), self._at(f"v{self._last() + 1:08d}.json")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            raise RuntimeError(f"another writer published {final}")


def file_system(path: str):
    """(pyarrow file system, path in it) of a URI, as tasks see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///") if path.startswith("file:") else path)


def column(name: str) -> str:
    """name for F.col(), whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no taken column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
