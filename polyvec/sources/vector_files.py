"""Vectors from .npy files and from base64, and back."""

from __future__ import annotations

import base64
import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def npy_header(data: bytes) -> dict:
    """descr, fortran_order, shape and the offset of the values of an .npy file's first bytes."""
    f = io.BytesIO(data)
    major, _ = np.lib.format.read_magic(f)
    shape, fortran, dtype = np.lib.format.read_array_header_1_0(f) if major == 1 else np.lib.format.read_array_header_2_0(f)
    return {"descr": dtype.str, "fortran_order": fortran, "shape": shape, "offset": f.tell()}


def read_npy(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """file, row, values of one- and two-dimensional .npy files of any number type, as doubles."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(len(a), -1).astype(np.float64)
                yield pd.DataFrame({"file": name, "row": np.arange(len(a)), "values": list(a)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "file string, row long, values array<double>")


def documents(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """docs(doc_id, embs) of rows(row, values) and lengths(doc_id, n): documents follow each other in rows."""
    from polyvec.operators.index import running_start

    spans = running_start(lengths.where("n > 0"), "doc_id", "n", "_start").select("doc_id", F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("n") - 1)).alias("row"))
    joined = rows.join(spans, "row")
    return joined.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "values"))), lambda s: s["values"]).alias("embs"))


def write_npy(matrix: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.save(f, matrix, allow_pickle=False)
    return f.getvalue()


def write_npy_files(rows: DataFrame, column: str, folder: str, dtype: str = "<f4", per_file: int = 1 << 20) -> DataFrame:
    """Writes the vectors of a column as .npy matrices of a number type (converted as needed), files of at most
    per_file rows by task; gives file, rows. Files are named by task and attempt, in row order."""
    from pyarrow import fs
    from pyspark import TaskContext

    target = folder.replace("file:///", "file:/").replace("file:/", "file:///") if folder.startswith("file:") else folder

    def run(batches):
        context = TaskContext.get()
        system, base = fs.FileSystem.from_uri(target)
        held, n, count = [], 0, 0

        def flush():
            nonlocal held, n, count
            name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{count:06d}.npy"
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(write_npy(np.concatenate(held)))
            done = pd.DataFrame({"file": [name], "rows": [n]})
            held, n, count = [], 0, count + 1
            return done

        for batch in batches:
            if not len(batch):
                continue
            held.append(np.stack(batch["v"].to_list()).astype(dtype))
            n += len(batch)
            if n >= per_file:
                yield flush()
        if n:
            yield flush()

    out = rows.select(F.col(column).alias("v")).mapInPandas(run, "file string, rows long")
    return out.sparkSession.createDataFrame(out.collect(), "file string, rows long")  # a row a file


def to_base64(docs: DataFrame) -> DataFrame:
    """doc_id, data, n, dim of docs(doc_id, embs): single precision, little-endian, as base64."""

    def run(batches):
        for batch in batches:
            lists = batch.column("embs")
            whole = [encode_base64(np.array(x, "<f4").reshape(len(x), -1) if x else np.zeros((0, 0))) for x in lists.to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array([d for d, _ in whole], pa.string()), pa.array([s[0] for _, s in whole], pa.int32()), pa.array([s[1] for _, s in whole], pa.int32())], names=["doc_id", "data", "n", "dim"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "embs").mapInArrow(run, "doc_id long, data string, n int, dim int")


def encode_base64(matrix: np.ndarray) -> tuple[str, list[int]]:
    return base64.b64encode(np.ascontiguousarray(matrix, "<f4").tobytes()).decode(), list(matrix.shape)


def decode_base64(rows: DataFrame, column: str = "data", rows_column: str = "n", dim_column: str = "dim") -> DataFrame:
    """rows with embs array<array<float>> from base64 little-endian floats of n rows and dim columns.

    A wrong length, or a number that is not finite, is an error.
    """

    def run(batches):
        for batch in batches:
            out = []
            for text, n, dim in zip(*(batch.column(c).to_pylist() for c in (column, rows_column, dim_column)), strict=True):
                a = np.frombuffer(base64.b64decode(text), "<f4")
                if len(a) != n * dim:
                    raise ValueError(f"{len(a)} numbers for shape {n} x {dim}")
                if not np.isfinite(a).all():
                    raise ValueError("numbers that are not finite")
                out.append(a.reshape(n, dim).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.list_(pa.float32())))], names=[*batch.schema.names, "embs"])

    from pyspark.sql.types import ArrayType, FloatType, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("embs", ArrayType(ArrayType(FloatType()))))


def from_json(rows: DataFrame, column: str) -> DataFrame:
    """rows with embs from nested JSON lists; rows of unequal length are an error."""
    embs = F.from_json(column, "array<array<double>>")
    ragged = F.size(F.array_distinct(F.transform(embs, lambda v: F.size(v)))) > 1
    return rows.withColumn("embs", F.when(ragged, F.raise_error(F.lit("vectors of unequal length")).cast("array<array<double>>")).otherwise(embs))
