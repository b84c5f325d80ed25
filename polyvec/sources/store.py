"""Indexes on disk: immutable Parquet segments, and numbered manifests that say which make a version.

An append writes the segments of the new documents and a manifest, a delete those of the deleted ids;
nothing else is touched, so their cost is that of the batch. A rewrite (a rebuild, a compaction) writes
whole tables. Readers keep the version they opened; segments that none of the last manifests name are
removed.

A manifest holds: tables (segments by table), meta (totals and marks), buffer (the segments whose
documents wait for the codebook to grow) and text (the segments of the keyword index).
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvec.operators.codec import Codec
from polyvec.operators.ids import blocks, placed
from polyvec.operators.index import VectorIndex, inverted

TABLES = ("docs", "codes", "ivf", "metadata", "dead")


class Store:
    """The versions of one index below a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = self._p("")
        self._fs = self._fs_path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _names(self, folder: str) -> list[str]:
        at = self._p(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._p(name))

    def versions(self) -> list[str]:
        return [n.removesuffix(".json") for n in self._names("versions") if n.endswith(".json")]

    def current(self) -> str | None:
        return (self.versions() or [None])[-1]

    def _manifest(self, version: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0])

    def _write(self, name: str, table: DataFrame) -> str:
        segment = f"data/{name}-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.path}/{segment}")
        return segment

    def _codec(self, codec: Codec) -> str:
        head = (codec.nbits, codec.cutoffs.tolist(), codec.weights.tolist(), codec.average.tolist(), codec.threshold)
        rows = [(i, v.tolist(), *(head if i == 0 else (None,) * 5)) for i, v in enumerate(codec.centroids)]
        schema = "centroid_id int, vec array<double>, nbits int, cutoffs array<double>, weights array<double>, average array<double>, threshold double"
        return self._write("codec", self.spark.createDataFrame(rows, schema).coalesce(1))

    def manifest(self) -> dict | None:
        """What makes the current version; fields that older versions lack are empty."""
        version = self.current()
        if version is None:
            return None
        found = {"buffer": None, "text": []} | self._manifest(version)
        found["tables"] = {t: [] for t in TABLES} | found["tables"]
        return found

    def publish(self, manifest: dict, keep: int = 2) -> str:
        """The manifest appears under its number by a rename, whole or not at all."""
        last = self.current()
        version = f"v{int(last[1:]) + 1 if last else 1:08d}"
        draft, final = self._p(f"versions/_{uuid.uuid4().hex}"), self._p(f"versions/{version}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another writer published {version}")
        kept = self.versions()[-keep:]
        used = {s for v in kept for s in _segments(self._manifest(v))}
        for folder in ("data", "text"):
            for name in self._names(folder):
                if f"{folder}/{name}" not in used:
                    self._fs.delete(self._p(f"{folder}/{name}"), True)
        for old in self.versions()[:-keep]:
            self._fs.delete(self._p(f"versions/{old}.json"), False)
        return version

    @staticmethod
    def _lists(codes: DataFrame) -> DataFrame:
        return inverted(codes).repartition("centroid_id").sortWithinPartitions("centroid_id", "doc_id")

    def read(self, segments: list[str], evolving: bool = False) -> DataFrame:
        return self.spark.read.option("mergeSchema", evolving).parquet(*[f"{self.path}/{s}" for s in segments])

    def encoded(self, codes: DataFrame) -> dict[str, str]:
        """Writes codes and their inverted lists: the segments by table."""
        segment = self._write("codes", codes)
        return {"codes": segment, "ivf": self._write("ivf", self._lists(self.read([segment])))}

    def save(self, index: VectorIndex, metadata: DataFrame | None = None, text: list | None = None, keep: int = 2) -> str:
        """Writes all tables anew, with positions as stored ids."""
        index = index.whole()
        own = self.encoded(index.codes)
        tables = {k: [v] for k, v in own.items()} | {"docs": [self._write("docs", index.docs)], "codec": [self._codec(index.codec)], "dead": []}
        tables["metadata"] = [self._write("metadata", metadata)] if metadata is not None else []
        meta = index.meta | {"next_id": index.meta["documents"], "threshold": index.codec.threshold}
        return self.publish({"tables": tables, "meta": meta, "buffer": None, "text": text or []}, keep)

    def codec(self, codec: Codec) -> str:
        return self._codec(codec)

    def segment(self, kind: str, table: DataFrame) -> str:
        return self._write(kind, table)

    def _table(self, manifest: dict, name: str) -> DataFrame:
        return self.read(manifest["tables"][name], name == "metadata")

    def dead(self, manifest: dict) -> DataFrame | None:
        """The blocks of deleted ids of a version."""
        if not manifest["tables"].get("dead"):
            return None
        return blocks(self._table(manifest, "dead"), manifest["meta"]["next_id"])

    def load(self, version: str | None = None) -> VectorIndex:
        version = version or self.current()
        if version is None:
            raise FileNotFoundError(f"no index in {self.path}")
        manifest = self._manifest(version)
        rows = self._table(manifest, "codec").orderBy("centroid_id").toArrow()
        book = rows.column("vec").combine_chunks()
        head = {c: rows.column(c)[0].as_py() for c in ("nbits", "cutoffs", "weights", "average", "threshold")}
        threshold = manifest["meta"].get("threshold", head["threshold"])  # it moves with every batch, the codebook does not
        codec = Codec(head["nbits"], book.flatten().to_numpy().reshape(len(book), -1), np.array(head["cutoffs"]), np.array(head["weights"]), np.array(head["average"]), threshold)
        return VectorIndex(codec, *(self._table(manifest, t) for t in ("docs", "codes", "ivf")), manifest["meta"], self.dead(manifest))

    def metadata(self, stored: bool = False) -> DataFrame | None:
        """The metadata of the live documents, by position; stored: of all, by stored id."""
        manifest = self.manifest()
        if manifest is None or not manifest["tables"]["metadata"]:
            return None
        rows = self._table(manifest, "metadata")
        return rows if stored else placed(rows, self.dead(manifest))

    def clone(self, path: str) -> Store:
        """A copy of the current version at another path, which must not be an index yet."""
        other = Store(self.spark, path)
        if other.current():
            raise FileExistsError(path)
        manifest, conf = self.manifest(), self.spark._jsc.hadoopConfiguration()
        for segment in sorted(_segments(manifest)):
            self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._p(segment), other._fs, other._p(segment), False, conf)
        other.publish(manifest)
        return other

    def drop(self) -> bool:
        return self._fs.delete(self._fs_path, True)


def _segments(manifest: dict) -> set[str]:
    """Every segment that a manifest names."""
    own = {s for part in manifest["tables"].values() for s in part}
    return own | {s for part in manifest.get("text") or [] for s in (part["postings"], part["stats"], *part["stale"])}


def list_indices(spark: SparkSession, root: str) -> list[str]:
    """The names of the indexes below root."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
    return [n for n in names if Store(spark, f"{root.rstrip('/')}/{n}").current()]


def segment_sizes(store: Store) -> DataFrame:
    """table, segments: how many segments each table of the current version has."""
    manifest = store.manifest()
    return store.spark.createDataFrame([(k, len(v)) for k, v in manifest["tables"].items()], "table string, segments int").orderBy(F.col("table"))
