"""A content-addressed WARC archive: payload bytes once, record headers apart, records by a join.

A record is its exact header block (version line to blank line) and its payload. The archive has two
tables: payloads (digest, n_bytes, fold, payload), one row for distinct bytes, and headers
(digest, n_bytes, fold, header, more), where the struct more keeps the record's other columns, so
that no name of theirs can clash. The address is the SHA-256 of the bytes together with
their length and a second, independent hash, so that bytes of different content never share a row;
on the way back every payload is hashed again, and a mismatch is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvec.llm.scratch import Log, column, fresh

ADDRESS = ["digest", "n_bytes", "fold"]
DATE = "2024-01-01T00:00:00Z"
_NL = "\r\n"


def _hex_id(value: Column) -> Column:
    h = F.md5(value)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record_id, header, payload: every page as a WARC response record.

    A null html is an empty payload; a null url leaves the target line out. Record ids follow from
    page_id and url, so repeated rows have the same one; a null page_id counts as ''. Further columns
    are ignored.
    """
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", _hex_id(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url")).alias("record_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    lines = [
        F.lit("WARC/1.1" + _NL + "WARC-Type: response" + _NL + "WARC-Record-ID: "), F.col("record_id"), F.lit(_NL),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), "url", F.lit(_NL)), F.lit("")),
        F.lit(f"WARC-Date: {date}{_NL}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit(f"{_NL}Content-Type: text/html; charset=utf-8{_NL}Content-Length: "), F.length("payload").cast("string"), F.lit(_NL + _NL),
    ]
    return rows.select("page_id", "record_id", F.encode(F.concat(*lines), "UTF-8").alias("header"), "payload")


def archive(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads, headers) of records with header and payload. Nothing is written here: see save().

    The digest is always computed here; a column of that name is kept like any other, unread. A null
    payload counts as empty. Repeated rows are repeated headers of one payload; the copies of a
    payload are equal bytes, so it does not matter which one is kept. Very long payloads are kept
    whole. An empty table gives two empty ones.
    """
    more = [c for c in rows.columns if c.lower() not in ("header", "payload")]
    kept = [F.struct(*[F.col(column(c)) for c in more]).alias("more")] if more else []
    payload = F.coalesce(F.col("payload"), F.lit(b"")).alias("payload")
    addressed = rows.select(payload, "header", *kept).select("*", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("n_bytes"), F.xxhash64("payload").alias("fold"))
    payloads = addressed.groupBy(*ADDRESS).agg(F.first("payload").alias("payload"))
    return payloads, addressed.drop("payload")


def restore(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """The records' other columns, header, digest and record: header, payload and the closing blank
    lines, byte for byte. Of the last two names, those that records have get underscores before them.

    A payload that no longer has its digest raises an error; a null header gives a null record.
    """
    rows = headers.join(payloads, ADDRESS)
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), "digest")).cast("binary"))
    own = headers.schema["more"].dataType.names if "more" in headers.columns else []
    taken = [*own, "header"]
    return rows.select(*[F.col(f"more.{column(c)}") for c in own], "header", F.col("digest").alias(fresh("digest", taken)), F.concat("header", sound, F.lit(b"\r\n\r\n")).alias(fresh("record", taken)))


def save(rows: DataFrame, path: str, batch: str | None = None) -> bool:
    """Adds records to the archive at path: payloads that it lacks, and all headers.

    Both are written as segments, and a manifest that appears by a rename names them: what a failed
    run wrote is named by none, and so is never read. batch: a name for these rows; if the archive
    has that batch already nothing is done (False), so a job may be run again. One writer at a time.
    """
    spark = rows.sparkSession
    log = Log(spark, path)
    state = log.read() or {"payloads": [], "headers": [], "batches": []}
    if batch is not None and batch in state["batches"]:
        return False
    payloads, headers = archive(rows)
    if state["payloads"]:
        have = spark.read.parquet(*[f"{path}/{s}" for s in state["payloads"]]).select(*ADDRESS)
        payloads = payloads.join(have, ADDRESS, "left_anti")
    state["headers"].append(log.segment("headers", headers))
    state["payloads"].append(log.segment("payloads", payloads))
    if batch is not None:
        state["batches"].append(batch)
    log.publish(state)
    return True


def tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, headers) of the archive at path."""
    state = Log(spark, path).read()
    if state is None:
        raise FileNotFoundError(f"no archive in {path}")
    return tuple(spark.read.option("mergeSchema", k == "headers").parquet(*[f"{path}/{s}" for s in state[k]]) for k in ("payloads", "headers"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archive at path."""
    return restore(*tables(spark, path))


def parse(data: bytes) -> list[tuple[bytes, bytes]]:
    """(header, payload) of every record of an uncompressed WARC file, or of one gzipped by record."""
    import zlib

    if data[:2] == b"\x1f\x8b":
        out = []
        while data:
            member = zlib.decompressobj(31)
            out.append(member.decompress(data) + member.flush())
            data = member.unused_data
        data = b"".join(out)
    found, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        header = data[at:end]
        length = next(int(line.split(b":", 1)[1]) for line in header.split(b"\r\n") if line.lower().startswith(b"content-length:"))
        found.append((header, data[end : end + length]))
        at = end + length + 4
    return found


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, record_no, header, payload of the records in WARC files (.warc, .warc.gz) below path."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = parse(bytes(content))
                yield pd.DataFrame({"path": name, "record_no": range(len(rows)), "header": [h for h, _ in rows], "payload": [p for _, p in rows]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{warc,warc.gz}").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, record_no long, header binary, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, record_id, digest, header, record: pages as records, archived and restored.

    header and record as text. Every row of pages gives one record, repeated rows too, whose bytes
    are stored once; pages of any length are whole. Nulls are as in records(); columns other than
    page_id, url and html are ignored, whatever their names. An empty table gives no rows.
    """
    payloads, headers = archive(records(pages))
    rows = restore(payloads, headers)
    return rows.select("page_id", "record_id", "digest", F.decode("header", "UTF-8").alias("header"), F.decode("record", "UTF-8").alias("record"))


def round_trip_sql() -> str:
    return f"""
with p as (select page_id, coalesce(html, '') as html, url, md5(concat_ws('|', coalesce(page_id::varchar, ''), url)) as h, sha256(coalesce(html, '')) as digest from pages),
r as (select *, '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' as record_id,
  chr(13) || chr(10) as nl from p),
x as (select *, 'WARC/1.1' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: ' || record_id || nl || coalesce('WARC-Target-URI: ' || url || nl, '')
  || 'WARC-Date: {DATE}' || nl || 'WARC-Payload-Digest: sha256:' || digest || nl || 'Content-Type: text/html; charset=utf-8' || nl
  || 'Content-Length: ' || strlen(html) || nl || nl as header from r)
select page_id, record_id, digest, header, header || html || nl || nl as record from x"""
