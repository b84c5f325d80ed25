"""The library's front: an index with vectors, metadata and texts, and searches over it."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvec.functions.predicate import where
from polyvec.functions.text import all_words_query, any_identifier_query
from polyvec.operators import fulltext, fusion, ids as places, metadata as meta
from polyvec.operators.codec import encode_docs, merged_threshold, residual_quantile
from polyvec.operators.index import IndexConfig, SearchParameters, VectorIndex, added, create, dense, exact_search, expand, renumber, repair, search, statistics
from polyvec.sources.store import Store, list_indices

MOST_DEAD = 0.3  # share of deleted documents from which a delete compacts


class Engine:
    """One index at a path. Every change publishes a new version and then moves to it.

    Documents go by positions from 0 without gaps; a delete moves those of later documents. What a
    change costs is its own size: an append writes its segments, a delete the deleted ids, until
    MOST_DEAD of all documents are deleted and the index is compacted. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, config: IndexConfig = IndexConfig(), tokenizer: str = "unicode61", most_documents: int | None = None, text_columns: Sequence[str] | None = None, progress: Callable[[str, dict], None] | None = None):
        self.spark, self.config, self.tokenizer, self.most, self.text_columns = spark, config, tokenizer, most_documents, text_columns
        self.store, self.progress = Store(spark, path), progress
        self.index: VectorIndex | None = None
        self.rows: DataFrame | None = None
        self.reload()

    def reload(self) -> None:
        """Moves to the version that was published last."""
        self.manifest = self.store.manifest()
        if self.manifest is not None:
            self.index, self.rows = self.store.load(), self.store.metadata()

    def _publish(self, manifest: dict, action: str, **more) -> None:
        marks = manifest["meta"]
        marks["updates"], marks["last_update"], marks["last_action"] = marks.get("updates", 0) + 1, time.time(), action
        self.store.publish(manifest)
        self.reload()
        if self.progress is not None:
            self.progress(action, {"documents": self.count()} | more)

    def _commit(self, index: VectorIndex, rows: DataFrame | None, action: str = "rewrite") -> None:
        """Writes everything anew, the keyword index too if there was one."""
        had_text = bool(self.manifest and self.manifest["text"])
        marks = {k: v for k, v in (self.manifest["meta"] if self.manifest else {}).items() if k.startswith(("last_", "updates"))}
        index.meta = marks | index.meta | {"last_update": time.time(), "last_action": action, "updates": marks.get("updates", 0) + 1}
        self.store.save(index, rows)
        self.reload()
        if had_text:
            self.publish_text()
        if self.progress is not None:
            self.progress(action, {"documents": self.count()})

    def count(self) -> int:
        return self.index.meta["documents"] if self.index else 0

    def info(self) -> dict:
        """Totals and health of the index; last_update is in seconds, updated_at as RFC 3339."""
        if not self.index:
            return {"documents": 0}
        own = dict(self.index.meta)
        buffered = (self.manifest["buffer"] or {}).get("documents", 0)
        dead = own["next_id"] - own["documents"]
        if "last_update" in own:
            own["updated_at"] = rfc3339(own["last_update"])
        return own | {"tokenizer": self.tokenizer, "has_metadata": self.rows is not None, "has_text": bool(self.manifest["text"]), "buffered": buffered, "deleted": dead, "segments": sum(map(len, self.manifest["tables"].values()))}

    def add(self, docs: DataFrame, rows: DataFrame | None = None, marks: dict | None = None) -> str:
        """Adds docs(doc_id, embs) and metadata(doc_id, ...). Their ids only tell which row belongs to which
        document and in what order they come; they get positions after the index's. A row without a
        document is an error. Tells the regime. marks are kept with the index's totals (see info())."""
        base = self.index.meta["next_id"] if self.index else 0
        number = dense(docs).withColumn("_new", F.col("_new") + base).persist()
        n_new = number.count()
        if rows is not None and not rows.join(number, "doc_id", "left_anti").isEmpty():
            raise ValueError("metadata for documents that are not there")

        def renamed(table: DataFrame) -> DataFrame:
            return table.join(number, "doc_id").withColumn("doc_id", F.col("_new")).select(*table.columns)

        docs, new = renamed(docs), renamed(rows) if rows is not None else None
        try:
            if self.index is None or self.count() + n_new <= self.config.start_from_scratch:
                regime = "create" if self.index is None else "rebuild"
                live = docs.withColumn("doc_id", F.col("doc_id") - base + self.count()) if self.index else docs
                whole = live if self.index is None else self.index.whole().docs.unionByName(live)
                index = create(whole, self.config)
                index.meta |= marks or {}
                if new is not None and self.index is not None:
                    new = new.withColumn("doc_id", F.col("doc_id") - base + self.count())
                self._commit(index, meta.add(self.rows, new) if new is not None and self.rows is not None else new if new is not None else self.rows, regime)
            else:
                regime = self._append(docs, new, n_new, marks)
        finally:
            number.unpersist()
        if self.most is not None and self.count() > self.most:
            self.evict(self.most)
        return regime

    def _append(self, docs: DataFrame, rows: DataFrame | None, n_new: int, marks: dict | None) -> str:
        """New segments for the new documents alone; when the buffer is full, also for the codes of those in it."""
        store, manifest = self.store, self.store.manifest()
        tables, buffer = manifest["tables"], manifest["buffer"] or {"docs": [], "codes": [], "ivf": [], "documents": 0}
        own = store.segment("docs", docs)
        fresh = store.read([own])
        tables["docs"].append(own)
        full = buffer["documents"] + n_new >= self.config.buffer_size
        index, todo = self.index, fresh
        if full:
            if buffer["docs"]:
                todo = index.alive(store.read(buffer["docs"])).unionByName(fresh)
            codec = expand(index, todo)
            if len(codec.centroids) > len(index.codec.centroids):
                tables["codec"] = [store.codec(codec)]
            index = replace(index, codec=codec)
            for t in ("codes", "ivf"):
                tables[t] = [s for s in tables[t] if s not in buffer[t]]
        segments = store.encoded(encode_docs(todo, index.codec))
        for t, s in segments.items():
            tables[t].append(s)
        if rows is not None:
            tables["metadata"].append(store.segment("metadata", rows))
        new = statistics(fresh.select("doc_id", F.col("embs").alias("codes")))
        old = manifest["meta"]
        threshold = merged_threshold(old["threshold"], old["tokens"], residual_quantile(fresh, index.codec), new["tokens"])
        manifest["meta"] = old | added(old, new) | {"next_id": old["next_id"] + n_new, "threshold": threshold, "centroids": len(index.codec.centroids)} | (marks or {})
        manifest["buffer"] = None if full else {"docs": [*buffer["docs"], own], **{t: [*buffer[t], s] for t, s in segments.items()}, "documents": buffer["documents"] + n_new}
        if manifest["text"] and rows is not None:
            self._add_text(manifest, rows)
        regime = "expand" if full else "buffer"
        self._publish(manifest, regime, added=n_new)
        return regime

    def _remove(self, manifest: dict, gone: DataFrame) -> int:
        """Marks the live documents of gone(doc_id), stored ids, as deleted in a manifest; tells how many."""
        segment = self.store.segment("dead", gone.select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
        ids = self.store.read([segment])
        span = ids.agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
        if span["n"]:
            # Only files of these ids are read: ids grow with the segments.
            own = self.store.read(manifest["tables"]["codes"]).where(F.col("doc_id").between(span["a"], span["b"])).join(ids, "doc_id", "left_semi")
            manifest["meta"] |= added(manifest["meta"], statistics(own), -1)
            if manifest["text"]:
                self._drop_text(manifest, ids)
            manifest["tables"]["dead"].append(segment)
        return span["n"]

    def _removed(self, manifest: dict, n: int, action: str) -> int:
        if n:
            self._publish(manifest, action, deleted=n)
            if self.info()["deleted"] > MOST_DEAD * self.index.meta["next_id"]:
                self.compact()
        return n

    def delete(self, condition: str, values: Sequence = ()) -> int:
        """Deletes the documents that satisfy the condition; tells how many."""
        return self.delete_many([(condition, values)])

    def delete_many(self, conditions: Sequence[tuple[str, Sequence]], marks: dict | None = None) -> int:
        """A batch of deletes in one version. Each condition sees what the ones before it left, at new
        positions, so conditions on doc_id mean the positions of that moment."""
        manifest, n = self.store.manifest(), 0
        for condition, values in conditions:
            dead = self.store.dead(manifest)
            rows = self.store.read(manifest["tables"]["metadata"], True)
            live = places.placed(rows.withColumn("_stored", F.col("doc_id")), dead)
            n += self._remove(manifest, where(live, condition, values).select(F.col("_stored").alias("doc_id")))
        manifest["meta"] |= marks or {}
        if not n and marks:
            self._publish(manifest, "delete", deleted=0)
        return self._removed(manifest, n, "delete")

    def delete_ids(self, gone: DataFrame) -> int:
        """Deletes the documents at the positions of gone(doc_id); positions that nothing has are ignored."""
        manifest = self.store.manifest()
        own = gone.where((F.col("doc_id") >= 0) & (F.col("doc_id") < self.count()))
        return self._removed(manifest, self._remove(manifest, self.index.stored(own)), "delete")

    def evict(self, most: int) -> int:
        """Deletes the oldest documents but the newest `most`; tells how many."""
        cut = self.count() - most
        return self.delete_ids(self.spark.range(cut).withColumnRenamed("id", "doc_id")) if cut > 0 else 0

    def compact(self) -> None:
        """One segment a table again, with positions as stored ids."""
        self._commit(self.index.whole(), self.rows, "compact")

    def update_metadata(self, condition: str, values: Sequence, changes: dict) -> int:
        """Changes the rows that satisfy the condition; the metadata is written anew, of the keyword index only
        the changed rows."""
        manifest = self.store.manifest()
        stored = self.store.metadata(stored=True)
        live = places.placed(stored.select("doc_id", F.col("doc_id").alias("_stored"), *[c for c in stored.columns if c != "doc_id"]), self.store.dead(manifest))
        out = meta.update_where(live, condition, values, changes).withColumn("doc_id", F.col("_stored")).drop("_stored")
        segment = self.store.segment("metadata", out)
        written = self.store.read([segment])
        n = written.where("changed").count()
        if n:
            manifest["tables"]["metadata"] = [self.store.segment("metadata", written.drop("changed"))]
            if manifest["text"]:
                changed = written.where("changed").drop("changed")
                self._drop_text(manifest, changed.select("doc_id"))
                stale = self.store.segment("dead", changed.select("doc_id"))
                for part in manifest["text"]:
                    part["stale"].append(stale)
                self._add_text(manifest, changed)
            self._publish(manifest, "update", changed=n)
        return n

    def repair(self) -> None:
        """Cuts the longer of vectors and metadata to the length of the shorter."""
        if self.rows is not None:
            self._commit(*repair(self.index, self.rows), action="repair")

    def reconcile(self) -> dict:
        """Counts the documents and tokens that are there and corrects the totals by them; tells what differed."""
        manifest = self.store.manifest()
        true = statistics(self.index.alive(self.index.codes))
        wrong = {k: (manifest["meta"].get(k), v) for k, v in true.items() if manifest["meta"].get(k) != v}
        if wrong:
            manifest["meta"] |= true
            self._publish(manifest, "reconcile")
        return wrong

    def subset(self, condition: str | None, values: Sequence = (), ids: Sequence[int] | None = None) -> DataFrame | None:
        """doc_id of what a search is restricted to; a condition goes before a list of ids."""
        if condition:
            return where(self.rows, condition, values).select("doc_id")
        return self.spark.createDataFrame([(int(i),) for i in ids], "doc_id long") if ids is not None else None

    # The keyword index: segments of postings by stored ids, kept up by every change once it is published.

    def _texts(self, rows: DataFrame) -> DataFrame:
        from polyvec.functions.text import row_text

        columns = self.text_columns or [c for c in rows.columns if c != "doc_id"]
        return rows.select("doc_id", row_text(*[c for c in columns if c in rows.columns]).alias("text"))

    def _text_segment(self, rows: DataFrame) -> dict:
        built = fulltext.build(self._texts(rows), self.tokenizer)
        return {"tokenizer": self.tokenizer, "stale": []} | fulltext.write_segment(self.store, built)

    def _text_totals(self, manifest: dict, sign: int, n: int, total: int) -> None:
        own = manifest["meta"]
        own["text_n"], own["text_total"] = own.get("text_n", 0) + sign * n, own.get("text_total", 0) + sign * total

    def _add_text(self, manifest: dict, rows: DataFrame) -> None:
        part = self._text_segment(rows)
        manifest["text"].append(part)
        self._text_totals(manifest, 1, part["n"], part["total"])

    def _drop_text(self, manifest: dict, ids: DataFrame) -> None:
        """Takes the live documents of ids(doc_id) out of the totals."""
        span = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
        stats = fulltext.segments(self.store, manifest["text"], self.store.dead(manifest), 0, 0).doc_stats.where(F.col("doc_id").between(*span))
        row = stats.join(ids, "doc_id", "left_semi").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).first()
        self._text_totals(manifest, -1, row["n"], row["total"] or 0)

    def publish_text(self) -> None:
        """Writes the keyword index; from now on every change adds to it what it changes."""
        manifest = self.store.manifest()
        manifest["text"] = []
        manifest["meta"] |= {"text_n": 0, "text_total": 0}
        self._add_text(manifest, places.alive(self.store.metadata(stored=True), self.store.dead(manifest)))
        self._publish(manifest, "text")

    def text_index(self) -> fulltext.TextIndex:
        """The written keyword index, or one that is built while searching; both by stored ids."""
        dead = self.store.dead(self.manifest)
        if self.manifest["text"]:
            own = self.manifest["meta"]
            return fulltext.segments(self.store, self.manifest["text"], dead, own["text_n"], own["text_total"])
        built = fulltext.build(self._texts(places.alive(self.store.metadata(stored=True), dead)), self.tokenizer)
        return built

    def search(self, queries: DataFrame | None = None, text: str | None = None, parameters: SearchParameters = SearchParameters(), condition: str | None = None, values: Sequence = (), ids: Sequence[int] | None = None, alpha: float = 0.75, fusion_mode: str = "relative_score", with_metadata: bool = True, exact: bool = False) -> DataFrame:
        """query_id, rank, doc_id, score and metadata: by vectors, by words, or by both fused. exact: the
        vectors of all documents of the subset are scored as they are.

        A hybrid search takes one query and fetches three times k on either side. A text that is no
        valid query finds nothing there instead of failing the search.
        """
        if queries is None and text is None:
            raise ValueError("a search needs vectors, a text or both")
        if fusion_mode not in fusion.MODES or not 0 <= alpha <= 1:
            raise ValueError("unknown fusion mode, or alpha outside 0..1")
        subset = self.subset(condition, values, ids)
        hybrid = queries is not None and text is not None
        if hybrid and queries.select("query_id").distinct().count() != 1:
            raise ValueError("a hybrid search takes exactly one query")
        wide = replace(parameters, k=parameters.k * 3) if hybrid else parameters
        semantic = None
        if queries is not None:
            semantic = exact_search(self.index, queries, wide.k, subset, wide.digits) if exact else search(self.index, queries, wide, subset)
        keyword = None
        if text is not None:
            query_id = queries.select("query_id").first()[0] if hybrid else 0
            keyword = self.keywords({query_id: text}, wide.k, subset)
        found = fusion.MODES[fusion_mode](semantic, keyword, alpha, parameters.k) if hybrid else semantic if semantic is not None else keyword
        if with_metadata and self.rows is not None:
            found = found.join(self.rows, "doc_id", "left").orderBy("query_id", "rank")
        return found

    def keywords(self, texts: dict[int, str], k: int | None = 10, subset: DataFrame | None = None, words: str = "query") -> DataFrame:
        """query_id, rank, doc_id, score of several texts at once; one that is no valid query finds nothing.

        words: "query" takes texts as they are, "all" and "any" ask for all or any of a text's words, whatever
        signs are between them."""
        texts = {i: all_words_query(t) if words == "all" else any_identifier_query(t) if words == "any" else t for i, t in texts.items()}
        own = self.index.stored(subset.select("doc_id").distinct()) if subset is not None else None
        index = self.text_index()
        valid = {}
        for query_id, text in texts.items():
            try:
                fulltext.parse(text, index.tokenizer)
                valid[query_id] = text
            except fulltext.QueryError:
                continue
        return self.index.placed(fulltext.search_many(index, valid, k, own))

    def exact(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return exact_search(self.index, queries, k)

    def metadata(self, condition: str | None = None, values: Sequence = (), limit: int | None = None) -> DataFrame:
        return meta.get(self.rows, condition, values, limit)

    def clone(self, path: str) -> Engine:
        """A copy at another path, from which it goes on by itself."""
        self.store.clone(path)
        return Engine(self.spark, path, self.config, self.tokenizer, self.most, self.text_columns)

    def drop(self) -> bool:
        return self.store.drop()


def rfc3339(seconds: float) -> str:
    """A moment as RFC 3339, in UTC and whole seconds."""
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(seconds))


__all__ = ["Engine", "IndexConfig", "SearchParameters", "create", "list_indices", "renumber", "rfc3339", "statistics"]
