"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence has a probability sigmoid(bias + sum of the weights of its words); a document is toxic
with the noisy-or of its sentences, 1 - prod(1 - p). The weights are fitted by gradient descent on
the likelihood of document labels alone; afterwards the same sentence scores point out the
offending sentences. Words are hashed into a fixed number of buckets, so the model has a fixed
size whatever the corpus.

Training reads a bounded sample of labelled documents (parameter ``sample``, half of it for
either class at most); scoring covers all documents and whole texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvec.llm.textvec import U64, slices, utf8, word_hashes

BUCKETS = 1 << 18
SAMPLE = 4000
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True
_SENTENCE = re.compile(r"[.!?\n]")


def sentence_words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document position, sentence index), once for every feature of a sentence: its
    words and their beginnings of 5 to 7 bytes, so that inflected forms share what is learnt.
    The index of a sentence is the number of ends (. ! ? or line break) before it in the text."""
    h, doc, first, *parts = word_hashes(column, (5, 6, 7))
    none = np.zeros(0, np.int64)
    if not len(h):
        return none, none, none
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    before = np.concatenate(([0], np.cumsum(_ENDS[data])))
    sentence = before[first]  # counted over the whole column: unique with the document
    bag = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])))
    opens = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
    keys = [(bag << 18) | (h & U64(BUCKETS - 1)).astype(np.int64)]
    keys += [((bag << 18) | (p & U64(BUCKETS - 1)).astype(np.int64))[p != 0] for p in parts]
    key = np.concatenate(keys)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])]
    bag = key >> 18
    doc = doc[opens]
    return key & (BUCKETS - 1), doc[bag], (sentence[opens] - before[offsets[:-1]][doc])[bag]


class Model:
    """Weights by bucket and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def sentences(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document position, sentence index, probability) of every sentence with words."""
        bucket, doc, sentence = sentence_words(column)
        if not len(bucket):
            return doc, doc, np.zeros(0)
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])))
        z = self.bias + np.add.reduceat(self.weights[bucket].astype(np.float64), new)
        return doc[new], sentence[new], 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def documents(self, column) -> tuple[np.ndarray, tuple]:
        doc, sentence, p = self.sentences(column)
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(column)) if len(doc) else np.zeros(len(column))
        return -np.expm1(clean), (doc, sentence, p)


def loss(model: Model, bucket: np.ndarray, bag: np.ndarray, doc: np.ndarray, label: np.ndarray, penalty: float) -> float:
    """What fit() makes small: minus the mean log-likelihood of each class, and the penalty on weights."""
    z = model.bias + np.bincount(bag, model.weights[bucket].astype(np.float64), minlength=len(doc))
    s = np.bincount(doc, np.logaddexp(0, z), minlength=len(label))  # minus log of 1 - score
    own = np.where(label == 1, -np.log(-np.expm1(-np.maximum(s, 1e-12))), s)
    return 0.5 * own[label == 1].mean() + 0.5 * own[label == 0].mean() + penalty * model.weights.sum()


def gradient(w: np.ndarray, b: float, w_at: np.ndarray, bag: np.ndarray, doc: np.ndarray, label: np.ndarray, penalty: float) -> np.ndarray:
    """The derivatives of loss() by the weights w (w_at: the place in w of each word) and, last, the bias."""
    mass = np.where(label == 1, 0.5 / label.sum(), 0.5 / (label == 0).sum())
    z = b + np.bincount(bag, w[w_at], minlength=len(doc))
    s = np.bincount(doc, np.logaddexp(0, z), minlength=len(label))
    ds = np.where(label == 1, -1 / np.expm1(np.clip(s, 1e-6, 50)), 1.0) * mass
    dz = ds[doc] / (1 + np.exp(-np.clip(z, -60, 60)))
    return np.append(np.bincount(w_at, dz[bag], minlength=len(w)) + penalty, dz.sum())


def fit(bucket: np.ndarray, bag: np.ndarray, doc: np.ndarray, label: np.ndarray, steps: int = 100, rate: float = 0.25, penalty: float = 1e-4, least_docs: int = 4) -> Model:
    """bucket, bag: words and the sentence each is in; doc: of each sentence; label: of each document.

    Words found in fewer than least_docs documents get no weight. The two classes weigh alike.
    Weights stay at 0 or above (harmless words can't excuse an insult) under an L1 penalty.
    """
    weights = np.zeros(BUCKETS)
    if len(label) == 0 or label.min() == label.max():
        return Model(weights, -60.0)
    pair = np.unique(bucket.astype(np.int64) * len(label) + doc[bag])
    seen = np.bincount(pair // len(label), minlength=BUCKETS)
    use = seen[bucket] >= least_docs
    used, w_at = np.unique(bucket[use], return_inverse=True)
    bag = bag[use]
    w, b = np.zeros(len(used)), -6.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        g = gradient(w, b, w_at, bag, doc, label, penalty)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        w, b = np.maximum(0, w - move[:-1]), b - move[-1]
    weights[used] = w
    return Model(weights.astype(np.float32), float(b))


def _features(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            bucket, doc, sentence = sentence_words(batch.column("text"))
            new = np.append(True, (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])) if len(doc) else np.zeros(0, bool)
            packed = bucket.astype(np.int32) * 2 + new.astype(np.int32)  # the low bit opens a sentence
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=batch.num_rows)))).astype(np.int32)
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(packed))], names=["doc_id", "toxic", "words"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **parameters) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic 0/1).

    A document labelled both ways counts as toxic; unlabelled rows and null labels are ignored. Rows
    that repeat a doc_id count once, with the least text. Ties of the sample's hash order go by
    doc_id; its texts are learnt from whole. Without documents of both classes, as in an empty
    table, the model finds nothing toxic.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    part = [known.where(F.col("toxic") == k).orderBy(*order).limit(sample // 2) for k in (0, 1)]
    chosen = part[0].unionByName(part[1])  # at most `sample` rows of two numbers: safe to broadcast
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", "text")
    # In order of doc_id, so that the weights do not hang on the order in which tasks end.
    got = texts.mapInArrow(_features, "doc_id string, toxic int, words array<int>").toArrow().sort_by("doc_id")
    label = got.column("toxic").to_numpy().astype(np.int64)
    lists = got.column("words").combine_chunks()
    packed = lists.flatten().to_numpy()
    owner = np.repeat(np.arange(len(label)), lists.value_lengths().to_numpy())
    opens = (packed & 1).astype(bool)
    return fit(packed >> 1, np.cumsum(opens) - 1, owner[opens], label, **parameters)


def _scored(batches, model: Model, threshold: float, sentence_threshold: float):
    for whole in batches:
        for batch in slices(whole, "text"):
            column = batch.column("text")
            score, (doc, sentence, p) = model.documents(column)
            rows: list[int] = []
            columns: list[list] = [[], [], [], []]
            for i in np.flatnonzero(score >= threshold):
                own = np.flatnonzero(doc == i)
                worst = own[p[own] >= min(sentence_threshold, p[own].max())]
                text = _SENTENCE.split(column[int(i)].as_py())
                for k in worst:
                    rows.append(int(i))
                    for c, x in zip(columns, (float(score[i]), int(sentence[k]), float(p[k]), text[sentence[k]].strip()), strict=True):
                        c.append(x)
            if rows:
                more = [pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int32(), pa.float64(), pa.string()), strict=True)]
                yield pa.record_batch([batch.column("doc_id").take(pa.array(rows)), *more], names=["doc_id", "doc_score", "sentence_no", "sentence_score", "sentence"])


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.6, sentence_threshold: float = 0.3) -> DataFrame:
    """The offending sentences of toxic documents: doc_id, doc_score, sentence_no, sentence_score, sentence.

    A document is toxic from a noisy-or score of threshold on; its sentences from
    sentence_threshold on are listed, or the worst if none reaches that (all of them, where several
    tie). Null and empty texts have score 0. doc_id may be null and of any type. Texts are scored
    whole, repeated rows each; columns other than doc_id and text are ignored, whatever their names.
    An empty table gives no rows.
    """
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lambda it: _scored(it, model, threshold, sentence_threshold), f"doc_id {kind}, doc_score double, sentence_no int, sentence_score double, sentence string")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.6) -> DataFrame:
    """docs without toxic documents; all columns, whatever their names, and all other rows stay, null
    texts and repeated rows too. An empty table stays empty."""
    at = docs.columns.index("text")

    def keep(batches):
        for whole in batches:
            for batch in slices(whole, whole.schema.names[at]):
                score, _ = model.documents(batch.column(at))
                yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(keep, docs.schema)
