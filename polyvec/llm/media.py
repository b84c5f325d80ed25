"""Media columns: payloads in tar shards by content, rows with digest, shard, offset and length.

Every distinct payload (by SHA-256) is written once, into the tar shard of the task that gets its
digest; a row refers to it by shard, offset and length. Metadata columns (kind, size, sampling
rate, duration) come from reading the first HEAD bytes of a payload in place, never the rest.

Shards are named after the partition and the attempt, and the index of what was written is itself a
written table: a task that runs again leaves an unreferenced file, never a wrong row. A shard is given
by its whole address, so rows can be read wherever they go.
"""

from __future__ import annotations

import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvec.llm.scratch import Scratch, file_system, shared_root

HEAD = 64
SHARD_BYTES = 1 << 29
BUNDLE_BYTES = 1 << 20


def png(data: bytes, width: int = 64) -> bytes:
    """The bytes as a grey picture of the given width, the last line filled up with zeros."""
    height = max(1, -(-len(data) // width))
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:].reshape(-1, width)[:] = np.frombuffer(data.ljust(height * width, b"\0"), np.uint8).reshape(height, width)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def wav(samples: np.ndarray, rate: int = 8000) -> bytes:
    """Samples in [-1, 1] as one channel of 16-bit sound."""
    body = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def header(head: bytes, length: int) -> dict:
    """What the first bytes of a payload of the given length say; all None but kind for the unknown."""
    out = dict.fromkeys(("width", "height", "bits", "channels", "rate", "duration_ms"))
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 26:
        width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
        return out | {"kind": "image/png", "width": width, "height": height, "bits": bits, "channels": {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)}
    if head[:3] == b"GIF" and len(head) >= 10:
        width, height = struct.unpack("<HH", head[6:10])
        return out | {"kind": "image/gif", "width": width, "height": height}
    if head[:2] == b"BM" and len(head) >= 30:
        width, height, _, bits = struct.unpack("<iiHH", head[18:30])
        return out | {"kind": "image/bmp", "width": width, "height": abs(height), "bits": bits}
    if head[:4] == b"RIFF" and head[8:16] == b"WAVEfmt " and len(head) >= 36:
        _, channels, rate, per_second, _, bits = struct.unpack("<HHIIHH", head[20:36])
        size = struct.unpack("<I", head[40:44])[0] if head[36:40] == b"data" else max(0, length - 44)
        return out | {"kind": "audio/wav", "bits": bits, "channels": channels, "rate": rate, "duration_ms": round(1000 * size / per_second) if per_second else None}
    return out | {"kind": "application/octet-stream"}


def page_images(pages: DataFrame) -> DataFrame:
    """media_id ('page:' and page_id), payload: the bytes of each page as a picture; null html gives no payload."""

    def run(batches):
        for batch in batches:
            out = [png(x) if x is not None else None for x in batch.column("payload").to_pylist()]
            yield pa.record_batch([batch.column("media_id"), pa.array(out, pa.binary())], names=["media_id", "payload"])

    source = pages.select(F.concat(F.lit("page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("media_id"), F.encode(F.col("html"), "UTF-8").alias("payload"))
    return source.mapInArrow(run, "media_id string, payload binary")


def vector_sounds(embeddings: DataFrame) -> DataFrame:
    """media_id ('vector:' and vec_id), payload: each vector as a short sound; a null vector gives no payload."""

    def run(batches):
        for batch in batches:
            out = [wav(np.array([v or 0.0 for v in x], np.float64)) if x is not None else None for x in batch.column("embedding").to_pylist()]
            yield pa.record_batch([batch.column("media_id"), pa.array(out, pa.binary())], names=["media_id", "payload"])

    source = embeddings.select(F.concat(F.lit("vector:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).alias("media_id"), "embedding")
    return source.mapInArrow(run, "media_id string, payload binary")


def write_shards(distinct: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """digest, shard, offset, length of distinct (digest, payload) rows, written as tar files below folder.

    A payload is a member named after its digest. Payloads smaller than a member's own header share
    members (bundles) of up to bundle_bytes; rows point into those all the same.
    """
    from pyspark import TaskContext

    def run(batches):
        context = TaskContext.get()
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        name, out, at, count = "", None, 0, 0
        bundle: list[tuple[bytes, bytes]] = []
        rows: list[tuple] = []

        def member(title: str, data: bytes) -> int:
            """Writes a member; tells where its data begins."""
            nonlocal name, out, at, count
            if out is None or at >= shard_bytes:
                close()
                name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{count}.tar"
                out, at, count = system.open_output_stream(f"{base}/{name}"), 0, count + 1
            info = tarfile.TarInfo(title)
            info.size = len(data)
            out.write(info.tobuf(tarfile.USTAR_FORMAT))
            out.write(data)
            out.write(bytes(-len(data) % 512))
            begin = at + 512
            at = begin + len(data) + (-len(data) % 512)
            return begin

        def close() -> None:
            if out is not None:
                out.write(bytes(1024))
                out.close()

        def flush() -> None:
            if bundle:
                begin = member(f"bundle/{bundle[0][0].hex()}", b"".join(p for _, p in bundle))
                for digest, payload in bundle:
                    rows.append((digest, f"{folder}/{name}", begin, len(payload)))
                    begin += len(payload)
                bundle.clear()

        def done():
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["digest", "shard", "offset", "length"])
            rows.clear()
            return batch

        held = 0
        for batch in batches:
            for digest, payload in zip(batch.column("digest").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if len(payload) >= 512:
                    begin = member(f"{digest.hex()[:2]}/{digest.hex()}", payload)
                    rows.append((digest, f"{folder}/{name}", begin, len(payload)))
                    continue
                bundle.append((digest, payload))
                held += len(payload)
                if held >= bundle_bytes:
                    flush()
                    held = 0
            if rows:
                yield done()
        flush()
        if rows:
            yield done()
        close()

    return distinct.select("digest", "payload").mapInArrow(run, "digest binary, shard string, offset long, length long")


META = "kind string, width int, height int, bits int, channels int, rate int, duration_ms long"


class _Files:
    """The open file of the last shard read."""

    def __init__(self):
        self.name, self.file, self.systems = None, None, {}

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.close()
            folder, _, name = shard.rpartition("/")
            if folder not in self.systems:
                self.systems[folder] = file_system(folder)
            system, base = self.systems[folder]
            self.name, self.file = shard, system.open_input_file(f"{base}/{name}")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.name = self.file = None


def read_headers(index: DataFrame, head: int = HEAD) -> DataFrame:
    """index (digest, shard, offset, length) with the metadata columns, from the first head bytes of each payload."""
    columns = [x.split()[0] for x in META.split(", ")]
    types = [pa.string(), *[pa.int32()] * 5, pa.int64()]

    def run(batches):
        files = _Files()
        for batch in batches:
            rows = [header(files.read(shard, offset, min(head, length)), length) for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True)]
            meta = [pa.array([r[c] for r in rows], t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("digest", "shard", "offset", "length")), *meta], names=["digest", "shard", "offset", "length", *columns])
        files.close()

    return index.select("digest", "shard", "offset", "length").mapInArrow(run, f"digest binary, shard string, offset long, length long, {META}")


def read_payloads(rows: DataFrame) -> DataFrame:
    """rows (media_id, shard, offset, length) as media_id, payload: one range read each."""

    def run(batches):
        files = _Files()
        for batch in batches:
            out = [files.read(shard, offset, length) if shard is not None else None for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True)]
            yield pa.record_batch([batch.column("media_id"), pa.array(out, pa.binary())], names=["media_id", "payload"])
        files.close()

    return rows.select("media_id", "shard", "offset", "length").mapInArrow(run, "media_id string, payload binary")


def media_table(media: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """media_id, digest, shard, offset, length and the metadata columns of media (media_id, payload).

    Payloads are stored once however many rows have them. Digests come first, from a pass that moves
    no payload; a payload that only one row has is then written by the task that reads it, and only
    those that several rows share are brought together by digest. The list of shared digests is
    joined, by broadcast only while Spark finds it small.

    An empty payload has length 0 and kind application/octet-stream. A null payload gives nulls, a
    null media_id stays null. Repeated rows each stay; the copies of a payload are equal, so it does
    not matter which is written. Payloads of any length are kept whole. Columns other than media_id
    and payload are ignored, whatever their names; an empty table gives no rows. media is read twice:
    for the digests and for the payloads.
    """
    rows = media.select("media_id", "payload").withColumn("digest", F.unhex(F.sha2("payload", 256)))
    named = scratch.write(rows.select("media_id", "digest"))
    shared = scratch.write(named.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest", F.lit(True).alias("shared")))
    marked = rows.where("payload is not null").join(shared, "digest", "left")
    once = marked.where("shared is null").select("digest", "payload")
    often = marked.where("shared").groupBy("digest").agg(F.first("payload").alias("payload"))
    index = scratch.write(write_shards(once.unionByName(often), folder))
    known = scratch.write(read_headers(index))
    scratch.drop(index, shared)
    return named.join(known, "digest", "left").select("media_id", F.lower(F.hex("digest")).alias("digest"), *known.columns[1:])


def media_columns(spark: SparkSession, pages: DataFrame, embeddings: DataFrame, folder: str | None = None) -> DataFrame:
    """The media table of all pages (as pictures) and all vectors (as sounds).

    folder: where the shards go; by default a new one in the folder that the cluster shares, which
    stays. Every row names its shard in full. The pictures and sounds stand for media that would be
    read from a table; they are drawn again where that would be read again, which costs less disk
    than keeping them.
    """
    folder = folder or f"{shared_root(spark)}/media-{uuid.uuid4().hex}"
    return media_table(page_images(pages).unionByName(vector_sounds(embeddings)), folder, Scratch(spark))


def tar_members(data: bytes) -> dict[str, bytes]:
    """Name and content of the members of a tar file (for tests and exports)."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar.getmembers()}
