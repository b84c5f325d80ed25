"""SentencePiece (merge type) encoding and decoding with a table of prefixes' last tokens.

Every prefix of a string has one merge-type encoding, and so one last token. A sequence of tokens
is an encoding exactly if every adjacent pair is one: merges inside tokens go on independently
until one crosses a boundary, and whether it does shows in the pair alone. So the last token of a
prefix is the one automaton match ending there that is compatible with the last token of the prefix
before it. One pass over the matches (Aho-Corasick over all pieces) fills the table; walking it
backwards gives the ids.

No piece has a blank after another sign, so encodings never cross a word's start: a text falls
into words, each distinct word of a batch is encoded once, and all that is done per text is
array work. The vocabulary file is read by its path on each worker and never copied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvec.llm.scratch import fresh
from polyvec.llm.textvec import resident, slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
WORDS_KEPT = 80_000  # words in each of the two generations that a worker remembers: speed only
PAIRS_KEPT = 1_000_000  # pairs of tokens that a worker remembers: speed only


class Codec:
    """The tables of one model file: pieces, scores, automaton; and what was computed so far."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  ﬁ Å \tx "
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("only models that keep texts as they are")
        size = sp.vocab_size()
        self.unknown = sp.unk_id()
        self.bytes = {}
        self.pieces: list[str] = []
        raw: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            self.pieces.append(piece)
            self.score.append(sp.get_score(i))
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"" if not sp.is_unknown(i) else " ⁇ ".encode())
            else:
                self.ids[piece] = i
                raw.append(piece.replace(BLANK, " ").encode())
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece goes across the start of a word")
        self.lines = not any("\n" in p for p in self.ids)
        self.raw = pa.array(raw, pa.binary())
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merges(self, text: str) -> list[str]:
        """The definition: join the adjacent pair of the best score (the leftmost of equals) until none is a piece."""
        parts = list(text)
        ids, score = self.ids, self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or score[k] > best):
                    best, at = score[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, token: int) -> str:
        return self.pieces[token] if token >= 0 else chr(-1 - token)

    def _pair(self, a: int, b: int) -> bool:
        left, right = self._text(a), self._text(b)
        ok = self.merges(left + right) == [left, right]
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        self.pairs[(a << 24) + b] = ok
        return ok

    def encode_word(self, word: str, before: tuple[str, list] = ("", [None])) -> tuple[list[int], list]:
        """(ids, table) of a word (blanks as BLANK). Signs that are no piece become bytes, or the unknown id.

        before: another word and its table, of which the prefixes common to both are taken over."""
        known, table = before
        done = 0  # prefixes up to here have their last token; matches come by their ends, longest first
        for a, b in zip(known, word):
            if a != b:
                break
            done += 1
        last: list = table[: done + 1] + [None] * (len(word) - done)
        get, alone, pair = self.pairs.get, self.alone, self._pair
        for end, (token, size) in self.automaton.iter(word):
            if end < done:
                continue
            while done < end:  # a sign that ends no piece stands for itself
                last[done + 1] = -1 - ord(word[done])
                done += 1
            left = last[end + 1 - size]
            if left is None:
                ok = alone.get(token)
                if ok is None:
                    ok = alone[token] = self.merges(word[: end + 1]) == [word[: end + 1]]
            else:
                ok = get((left << 24) + token)
                if ok is None:
                    ok = pair(left, token)
            if ok:
                done = end + 1
                last[done] = token
        end = len(word)
        while done < end:
            last[done + 1] = -1 - ord(word[done])
            done += 1
        out: list[int] = []
        pieces = self.pieces
        while end:
            token = last[end]
            if token >= 0:
                out.append(token)
                end -= len(pieces[token])
            else:
                sign = word[end - 1].encode()
                out.extend([self.bytes[b] for b in reversed(sign)] if self.bytes else [self.unknown])
                end -= 1
        out.reverse()
        return out, last

    def split(self, column) -> tuple[pa.Array, np.ndarray]:
        """(words of all texts one after another, number of them by text)."""
        text = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), BLANK, " ")
        some = np.asarray(pc.binary_length(text)) > 0
        text = pc.if_else(pa.array(some), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())), text)
        data, offsets = utf8(text)
        if not len(data):
            return pa.array([], pa.large_string()), np.zeros(len(column), np.int64)
        blank = data == 32
        opens = np.zeros(len(data), bool)
        opens[1:] = blank[1:] & ~blank[:-1]
        if self.lines:
            line = data == 10
            opens |= line
            opens[1:] |= line[:-1]
        opens[offsets[:-1][some]] = True
        at = np.flatnonzero(opens)
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        cuts = np.searchsorted(at, offsets)
        return words, np.diff(cuts)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of them by text)."""
        words, count = self.split(column)
        if not len(words):
            return np.zeros(0, np.int32), count
        coded = words.dictionary_encode()
        if len(self.words) > WORDS_KEPT:
            self.words, self.older = {}, self.words
        known, every, new = self.words, coded.dictionary.to_pylist(), []
        for word in every:
            if word not in known:
                ids = self.older.get(word)
                if ids is None:
                    new.append(word)
                else:
                    known[word] = ids
        before = ("", [None])
        for word in sorted(new):  # neighbours share the start of their tables
            plain = word.replace(" ", BLANK)
            ids, table = self.encode_word(plain, before)
            before = (plain, table)
            known[word] = np.array(ids, np.int32).tobytes()
        found = [known[w] for w in every]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.int32)
        code = coded.indices.to_numpy()
        lengths = size[code]
        ends = np.cumsum(lengths)
        start = (np.cumsum(size) - size)[code]
        ids = flat[np.arange(ends[-1]) + np.repeat(start - (ends - lengths), lengths)]
        total = np.concatenate(([0], ends))
        edge = np.concatenate(([0], np.cumsum(count)))
        return ids, total[edge[1:]] - total[edge[:-1]]

    def decode(self, ids: np.ndarray, count: np.ndarray) -> pa.Array:
        """The texts: bytes of the pieces, without the blank put before each text."""
        joined = self.raw.take(pa.array(ids))
        ends = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(joined)).astype(np.int64)))) if len(ids) else np.zeros(1, np.int64)
        data = np.frombuffer(b"".join(joined.to_pylist()) if joined.offset or not len(ids) else joined.buffers()[2], np.uint8)[: ends[-1]]
        bounds = ends[np.concatenate(([0], np.cumsum(count)))]
        some = bounds[:-1] < bounds[1:]
        leads = bounds[:-1][some]
        cut = np.zeros(len(count), bool)
        cut[some] = data[leads] == 32
        stay = np.ones(len(data), bool)
        stay[bounds[:-1][cut]] = False
        bounds = bounds - np.concatenate(([0], np.cumsum(cut)))
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[stay])])
        try:
            return cut.cast(pa.large_string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8: only in ids that no encoding gives
            return pa.array([x.decode(errors="replace") for x in cut.to_pylist()], pa.large_string())


def codec(path: str = MODEL) -> Codec:
    return resident(f"sp_codec:{path}", lambda: Codec(path))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids, round_trip for every row: the ids of its text, and whether decoding them
    gives the text back.

    The ids are those of the model's own library. A null text has null ids and round_trip; an
    empty one no ids. A sign BLANK in a text becomes a blank, as in the library, so round_trip is
    false there. Of pairs with equal scores the leftmost merges first. doc_id may be null and of
    any type. Very long texts are encoded whole, repeated rows each; columns other than doc_id and
    text are ignored, whatever their names; an empty table stays empty.
    """
    source = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                own, column = codec(model), batch.column("text")
                ids, count = own.encode(column)
                back = pc.equal(own.decode(ids, count), pc.fill_null(column.cast(pa.large_string()), ""))
                missing = pc.is_null(column)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(ids))
                none = pa.scalar(None, pa.list_(pa.int32()))
                if missing.true_count:
                    lists = pc.if_else(missing, none, lists)
                    back = pc.if_else(missing, pa.scalar(None, pa.bool_()), back)
                yield pa.record_batch([batch.column("doc_id"), pa.array(count.astype(np.int32)), lists, back], names=["doc_id", "n_ids", "ids", "round_trip"])

    return source.mapInArrow(run, f"doc_id {kind}, n_ids int, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows (with ids array<int>) with one more column, decoded; null for null ids.

    Where rows have a column of that name, the new one gets underscores before it. Empty ids give
    an empty text; repeated rows are decoded each; other columns, nulls in them too, stay as they are.
    """
    kind = rows.schema
    at = rows.columns.index("ids")
    name = fresh("decoded", rows.columns)
    from pyspark.sql.types import StringType

    def run(batches):
        for batch in batches:
            lists = batch.column(at)
            count = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            text = codec(model).decode(np.asarray(lists.flatten()).astype(np.int32), count).cast(pa.string())
            text = pc.if_else(pc.is_null(lists), pa.scalar(None, pa.string()), text)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, type(kind)([*kind.fields]).add(name, StringType()))
