"""Texts to token vectors: the contract of an encoder, and one without a model for tests and dry runs."""

from __future__ import annotations

import hashlib
import re
import string
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EncoderConfig:
    query_length: int = 48
    document_length: int = 300
    dimension: int = 128
    query_prefix: str = "[Q]"
    document_prefix: str = "[D]"
    mask: str = "[MASK]"
    skipped: frozenset = frozenset(string.punctuation)


class Encoder(Protocol):
    """What encode_documents() and encode_queries() need; sent to the executors as it is."""

    config: EncoderConfig

    def tokenize(self, text: str) -> list[str]: ...

    def vectors(self, tokens: list[str]) -> np.ndarray: ...


class HashEncoder:
    """A fixed random direction for every token, with a little of its neighbours mixed in."""

    def __init__(self, config: EncoderConfig = EncoderConfig(), context: float = 0.15):
        self.config, self.context = config, context
        self._known: dict[str, np.ndarray] = {}

    def tokenize(self, text: str) -> list[str]:
        return re.findall(r"\w+|[^\w\s]", text.lower())

    def _direction(self, token: str) -> np.ndarray:
        v = self._known.get(token)
        if v is None:
            seed = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
            v = np.random.default_rng(seed).standard_normal(self.config.dimension)
            v = self._known[token] = v / np.linalg.norm(v)
            if len(self._known) > 100_000:
                self._known.clear()
        return v

    def vectors(self, tokens: list[str]) -> np.ndarray:
        own = np.array([self._direction(t) for t in tokens]).reshape(-1, self.config.dimension)
        near = own.copy()
        near[1:] += self.context * own[:-1]
        near[:-1] += self.context * own[1:]
        return near / np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-12)


def document_tokens(encoder: Encoder, text: str) -> tuple[list[str], np.ndarray]:
    """(tokens up to the length limit with the prefix, which of them count: no skipped signs)."""
    tokens = [encoder.config.document_prefix, *encoder.tokenize(text)][: encoder.config.document_length]
    return tokens, np.array([t not in encoder.config.skipped for t in tokens], bool)


def query_tokens(encoder: Encoder, text: str) -> list[str]:
    """Tokens with the prefix, cut or filled up with masks to the query length."""
    tokens = [encoder.config.query_prefix, *encoder.tokenize(text)][: encoder.config.query_length]
    return tokens + [encoder.config.mask] * (encoder.config.query_length - len(tokens))


def encode_documents(rows: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """docs(doc_id, embs) of rows with a text; each distinct text of a batch is encoded once."""

    def run(batches):
        for batch in batches:
            coded = batch.column("text").dictionary_encode()
            out = []
            for t in coded.dictionary.to_pylist():
                tokens, counts = document_tokens(encoder, t)
                out.append(encoder.vectors(tokens)[counts].tolist())
            vectors = pa.array(out, pa.list_(pa.list_(pa.float64())))
            yield pa.record_batch([batch.column("doc_id"), vectors.take(coded.indices)], names=["doc_id", "embs"])

    return rows.where(F.col(text).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, embs array<array<double>>")


def encode_distinct(rows: DataFrame, encoder: Encoder) -> DataFrame:
    """docs(doc_id, embs) of rows(doc_id, text), each distinct text of the whole table encoded once and its
    vectors given to every row that has it. Texts meet by digest; a text that very many rows share is one
    key of that join, which Spark splits."""
    keyed = rows.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_key", F.sha2("text", 256))
    once = keyed.groupBy("_key").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                tokens, counts = document_tokens(encoder, t)
                out.append(encoder.vectors(tokens)[counts].tolist())
            yield pa.record_batch([batch.column("_key"), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["_key", "embs"])

    return keyed.select("doc_id", "_key").join(once.mapInArrow(run, "_key string, embs array<array<double>>"), "_key").select("doc_id", "embs")


def encode_queries(rows: DataFrame, encoder: Encoder) -> DataFrame:
    """queries(query_id, qpos, qvec) of rows(query_id, text)."""

    def run(batches):
        for batch in batches:
            for query, text in zip(batch.column("query_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                v = encoder.vectors(query_tokens(encoder, text or ""))
                yield pa.record_batch([pa.array([query] * len(v), pa.int64()), pa.array(range(len(v)), pa.int32()), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["query_id", "qpos", "qvec"])

    return rows.select(F.col("query_id").cast("long").alias("query_id"), "text").mapInArrow(run, "query_id long, qpos int, qvec array<double>")


def padded(embs: Column, length: int, dimension: int) -> Column:
    """Exactly `length` vectors: cut, or filled up with zeros."""
    zero = F.array_repeat(F.lit(0.0), dimension)
    return F.slice(F.concat(embs, F.array_repeat(zero, length)), 1, length)


def mask(embs: Column, length: int) -> Column:
    """1 for each of the first `length` places that has a vector, 0 for the others."""
    n = F.size(embs)
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (i <= n).cast("int"))
