"""Token ids packed into rows of one length, best fit decreasing.

Every task tokenizes its part of the table and packs it, in groups of some 33 million tokens, so that
a task holds one group at most; nothing is shuffled. Texts longer than a row are cut into full rows
and a rest, so no token is lost or repeated. Pieces go, longest first, into the open row with the
least sufficient room; a segment tree over capacities finds it in logarithmic time.

A packed row holds: ids (little-endian, 2 bytes where the vocabulary allows, else 4; padded),
cu_seqlens (0 and the end of every segment), position_ids (restarting at every segment), and for
every segment its doc_id and the place of its first token in the document. write() turns packed rows
into files of id matrices, position matrices and cumulative lengths; read() gives the rows back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvec.llm.scratch import file_system
from polyvec.llm.textvec import resident, slices, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH = 2048
WORDS_KEPT = 600_000
GROUP = 1 << 25  # tokens packed together


class Tokenizer:
    """Byte-level BPE. Texts are cut at blanks that follow another sign: no pattern match goes across
    one, so each distinct run of a batch is encoded once and the ids are those of the whole text."""

    def __init__(self, path: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = max(ranks.values()) + 1  # the free id, after every document and as padding
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words: dict[bytes, bytes] = {}

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of them by text), without end marks."""
        data, offsets = utf8(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(column), np.int64)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        # The last two bytes of the wider blanks: not cutting after a look-alike is harmless.
        wide = np.zeros(len(data), bool)
        wide[1:] = np.isin(data[1:], [*range(0x80, 0x8B), 0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F]) & np.isin(data[:-1], [0xC2, 0x9A, 0x80, 0x81])
        opens = np.zeros(len(data), bool)
        opens[1:] = (data[1:] == 32) & ~(space | wide)[:-1]
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[starts] = True
        at = np.flatnonzero(opens)
        runs = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = runs.dictionary_encode()
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        known, found, make = self.words, [], self.encoding.encode_ordinary
        for run in coded.dictionary.to_pylist():
            ids = known.get(run)
            if ids is None:
                ids = known[run] = np.array(make(run), np.int32).tobytes()
            found.append(ids)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        code = coded.indices.to_numpy()
        lengths = size[code]
        ends = np.cumsum(lengths)
        ids = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[code] - (ends - lengths), lengths)]
        total = np.concatenate(([0], ends))
        edge = np.searchsorted(at, offsets)
        return ids, total[edge[1:]] - total[edge[:-1]]


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in lengths, which is in falling order; every length at most capacity."""
    width = 1
    while width < capacity + 1:
        width *= 2
    tree = [0] * (2 * width)  # number of open bins below each node; the leaves are their free room
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []

    def count(free: int, by: int) -> None:
        i = free + width
        while i:
            tree[i] += by
            i >>= 1

    for place, size in enumerate(lengths):
        i = size + width  # the leftmost leaf from here on with an open bin
        while i and not tree[i]:
            while i and i & 1:
                i >>= 1
            i += 1 if i else 0
        if i:
            while i < width:
                i = 2 * i if tree[2 * i] else 2 * i + 1
            free = i - width
            own = room[free].pop()
            count(free, -1)
            bins[own].append(place)
        else:
            own, free = len(bins), capacity
            bins.append([place])
        left = free - size
        if left:
            room[left].append(own)
            count(left, 1)
    return bins


def _binaries(a: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    n = len(a)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * a.shape[1] * a.itemsize).astype(np.int32)), pa.py_buffer(a.tobytes())])


def _schema(doc_id: str) -> str:
    return f"n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{doc_id}>, starts array<int>"


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, group: int = GROUP) -> DataFrame:
    """shard, row, n_tokens, ids, cu_seqlens, position_ids, doc_ids, starts: one row a packed sequence.

    shard is the input partition, row counts in it; the ids of a shard in row order are its id
    matrix of `length` columns. Which documents share a row follows from the partitions of docs,
    and is the same whenever those are; that every token is there once holds for any. Every
    document ends with the end mark, which also pads; padding has position 0. Null and empty texts
    give no segment; null doc_ids and repeated rows pass through; doc_id may be of any type. Texts
    longer than a row, however long, are cut without loss. Ties of length go by input order. Columns
    other than doc_id and text are ignored, whatever their names. An empty table gives no rows.
    """
    from pyspark import TaskContext

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind_of = docs.schema["doc_id"].dataType.simpleString()

    def packed(ids: np.ndarray, size: np.ndarray, doc: pa.Array, end: int, shard: int, first_row: int):
        kind = ids.dtype
        start = np.cumsum(size) - size
        pieces = -(-size // length)
        owner = np.repeat(np.arange(len(size)), pieces)
        shift = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
        piece = np.minimum(size[owner] - shift, length)
        order = np.argsort(-piece, kind="stable")
        bins = best_fit_decreasing(piece[order].tolist(), length)
        ramp = np.arange(length, dtype=kind if length <= 1 << 16 else np.dtype("<u4"))
        for first in range(0, len(bins), 256):
            some = bins[first : first + 256]
            matrix = np.full((len(some), length), end, kind)
            places = np.zeros((len(some), length), ramp.dtype)
            cuts, members, offs, used = [], [], [], []
            for r, own_bin in enumerate(some):
                at, ends = 0, [0]
                for p in order[own_bin]:
                    n, begin = int(piece[p]), int(start[owner[p]] + shift[p])
                    matrix[r, at : at + n] = ids[begin : begin + n]
                    places[r, at : at + n] = ramp[:n]
                    at += n
                    ends.append(at)
                    members.append(int(owner[p]))
                    offs.append(int(shift[p]))
                cuts.append(ends)
                used.append(at)
            n = len(some)
            segments = np.concatenate(([0], np.cumsum([len(c) - 1 for c in cuts]))).astype(np.int32)
            yield pa.record_batch(
                [
                    pa.array(np.full(n, shard, np.int32)),
                    pa.array(np.arange(first_row + first, first_row + first + n, dtype=np.int32)),
                    pa.array(used, pa.int32()),
                    _binaries(matrix),
                    pa.array(cuts, pa.list_(pa.int32())),
                    _binaries(places),
                    pa.ListArray.from_arrays(pa.array(segments), doc.take(pa.array(members))),
                    pa.ListArray.from_arrays(pa.array(segments), pa.array(offs, pa.int32())),
                ],
                names=["shard", "row", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts"],
            )

    def run(batches):
        own = resident(f"packing:{vocabulary}", lambda: Tokenizer(vocabulary))
        kind = np.dtype("<u2") if own.end < 1 << 16 else np.dtype("<u4")
        shard, row, held = TaskContext.get().partitionId(), 0, 0
        parts, sizes, ids_of = [], [], []

        def flush():
            nonlocal row, held
            if not held:
                return
            ids, size, doc = np.concatenate(parts), np.concatenate(sizes), pa.concat_arrays(ids_of)
            for x in (parts, sizes, ids_of):
                x.clear()
            held = 0
            for batch in packed(ids, size, doc, own.end, shard, row):
                row += batch.num_rows
                yield batch

        for whole in batches:
            for batch in slices(whole, "text", 6_000_000):
                ids, count = own.encode(batch.column("text"))
                has = count > 0
                count = count[has]
                out = np.full(len(ids) + len(count), own.end, kind)
                stay = np.ones(len(out), bool)
                stay[np.cumsum(count + 1) - 1] = False
                out[stay] = ids
                parts.append(out)
                sizes.append(count + 1)
                ids_of.append(batch.column("doc_id").filter(pa.array(has)))
                held += len(out)
                if held >= group:
                    yield from flush()
        yield from flush()

    return source.mapInArrow(run, f"shard int, row int, {_schema(kind_of)}")


# Files: per task one of ids and one of position_ids (rows of one length, little-endian), and one of
# cu_seqlens (int32, rows one after another); a Parquet table says where each row is.


def write(packed: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of pack() below folder, which must be new; gives the table of rows.

    Files are named after task and attempt, and only those of attempts whose table rows were
    committed are named there: a task that runs again leaves a file that nobody reads.
    """
    from pyspark import TaskContext

    doc_id = packed.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        context = TaskContext.get()
        system, base = file_system(folder)
        name, outs, row, cu_at = f"{context.partitionId():06d}-{context.taskAttemptId()}", {}, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if not outs:
                system.create_dir(f"{base}/data", recursive=True)
                outs = {kind: system.open_output_stream(f"{base}/data/{name}.{kind}") for kind in ("ids", "positions", "cu")}
            n = batch.num_rows
            for kind, c in (("ids", "ids"), ("positions", "position_ids")):
                for value in batch.column(c):
                    outs[kind].write(value.as_buffer())
            cuts = batch.column("cu_seqlens")
            outs["cu"].write(np.asarray(cuts.flatten()).astype("<i4").tobytes())
            many = np.asarray(cuts.value_lengths()).astype(np.int64)
            bytes_of = [np.asarray(pc.binary_length(batch.column(c))).astype(np.int32) for c in ("ids", "position_ids")]
            yield pa.record_batch(
                [pa.array([name] * n), pa.array(np.arange(row, row + n)), batch.column("n_tokens"), *map(pa.array, bytes_of), pa.array(cu_at + np.cumsum(many) - many), pa.array(many.astype(np.int32)), batch.column("doc_ids"), batch.column("starts")],
                names=["file", "row", "n_tokens", "id_bytes", "position_bytes", "cu_at", "cu_count", "doc_ids", "starts"],
            )
            row, cu_at = row + n, cu_at + int(many.sum())
        for out in outs.values():
            out.close()

    where = f"file string, row long, n_tokens int, id_bytes int, position_bytes int, cu_at long, cu_count int, doc_ids array<{doc_id}>, starts array<int>"
    packed.select("n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts").mapInArrow(run, where).write.parquet(f"{folder}/rows")
    return packed.sparkSession.read.parquet(f"{folder}/rows")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """file, row and the other columns of the packed rows that write() put below folder, by range reads."""
    table = spark.read.parquet(f"{folder}/rows")
    doc_id = table.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        system, base = file_system(folder)
        name, files = None, {}
        for batch in batches:
            got = {"ids": [], "positions": [], "cu": []}
            for file, row, wide, long, at, many in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "id_bytes", "position_bytes", "cu_at", "cu_count")), strict=True):
                if file != name:
                    for f in files.values():
                        f.close()
                    name, files = file, {kind: system.open_input_file(f"{base}/data/{file}.{kind}") for kind in got}
                got["ids"].append(files["ids"].read_at(wide, row * wide))
                got["positions"].append(files["positions"].read_at(long, row * long))
                got["cu"].append(np.frombuffer(files["cu"].read_at(4 * many, 4 * at), "<i4"))
            yield pa.record_batch(
                [batch.column("file"), batch.column("row"), batch.column("n_tokens"), pa.array(got["ids"], pa.binary()), pa.array(got["cu"], pa.list_(pa.int32())), pa.array(got["positions"], pa.binary()), batch.column("doc_ids"), batch.column("starts")],
                names=["file", "row", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts"],
            )
        for f in files.values():
            f.close()

    return table.mapInArrow(run, f"file string, row long, {_schema(doc_id)}")


def matrix(path: str, length: int = LENGTH, dtype: str = "<u2") -> np.ndarray:
    """A file of ids or positions on a local disk as a matrix, mapped and not read."""
    return np.memmap(path, dtype, "r").reshape(-1, length)
