"""Indexes over HTTP: JSON requests to the calls of Engine. Routing is apart from the server, so it runs without one."""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from polyvec.engine import Engine, IndexConfig, SearchParameters, list_indices
from polyvec.functions.predicate import ConditionError
from polyvec.operators import maxsim
from polyvec.operators import metadata as meta
from polyvec.operators.encoder import Encoder, document_tokens, query_tokens
from polyvec.sources import metadata_rows

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.\-]*\Z")
_DOCS, _QUERIES = "doc_id long, embs array<array<double>>", "query_id long, qpos int, qvec array<double>"


class Failure(Exception):
    """A request that can't be answered: status and message."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def _floats(vectors) -> list[list[float]]:
    a = np.asarray(vectors, np.float64)
    if a.ndim != 2 or not np.isfinite(a).all():
        raise Failure(400, "vectors must be a matrix of finite numbers")
    return a.tolist()


class Service:
    """The indexes below one folder."""

    def __init__(self, spark: SparkSession, root: str, encoder: Encoder | None = None):
        self.spark, self.root, self.encoder = spark, root.rstrip("/"), encoder
        self.engines: dict[str, Engine] = {}
        self.settings: dict[str, dict] = {}
        self.lock = threading.RLock()
        one = r"/indices/(?P<name>[^/]+)"
        self.routes: list[tuple[str, re.Pattern, Callable]] = [
            (method, re.compile(path + r"\Z"), call)
            for method, path, call in (
                ("GET", "/health", self.health), ("GET", "/", self.health), ("GET", "/indices", self.names), ("POST", "/indices", self.create),
                ("GET", one, self.info), ("DELETE", one, self.drop), ("PUT", f"{one}/config", self.configure), ("POST", f"{one}/documents", self.add), ("DELETE", f"{one}/documents", self.delete),
                ("POST", f"{one}/update", self.add), ("POST", f"{one}/update_with_encoding", self.add), ("POST", f"{one}/search(?:/filtered)?(?:_with_encoding)?", self.search),
                ("GET", f"{one}/metadata", self.rows), ("GET", f"{one}/metadata/count", self.row_count), ("POST", f"{one}/metadata/check", self.check), ("POST", f"{one}/metadata/query", self.query),
                ("POST", f"{one}/metadata/get", self.get), ("POST", f"{one}/metadata/update", self.change), ("POST", "/encode", self.encode), ("POST", "/rerank(?:_with_encoding)?", self.rerank),
            )
        ]

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, dict]:
        """(status, answer): 400 for what is malformed, 404 for what isn't there, 409 for what is there already."""
        path = path.split("?")[0].rstrip("/") or "/"
        known = False
        for verb, pattern, call in self.routes:
            m = pattern.match(path)
            known = known or m is not None
            if m and verb == method:
                try:
                    return 200, call(body or {}, **m.groupdict())
                except Failure as e:
                    return e.status, {"error": str(e)}
                except (ConditionError, KeyError, TypeError, ValueError) as e:
                    return 400, {"error": f"{type(e).__name__}: {e}"}
        return (405, {"error": "method not allowed"}) if known else (404, {"error": "no such route"})

    def _engine(self, name: str) -> Engine:
        with self.lock:
            if name not in self.engines:
                if not NAME.match(name) or name not in list_indices(self.spark, self.root):
                    raise Failure(404, f"no index {name}")
                self.engines[name] = self._open(name)
            return self.engines[name]

    def _open(self, name: str) -> Engine:
        own = self.settings.get(name, {})
        config = IndexConfig(**{k: own[k] for k in ("nbits", "start_from_scratch", "buffer_size") if k in own})
        return Engine(self.spark, f"{self.root}/{name}", config, own.get("fts_tokenizer", "unicode61"), own.get("max_documents"))

    # Indexes

    def health(self, body: dict) -> dict:
        names = list_indices(self.spark, self.root)
        return {"status": "healthy", "indices": [{"name": n} | {k: v for k, v in self._engine(n).info().items() if k in ("documents", "tokens", "updated_at", "buffered")} for n in names]}

    def names(self, body: dict) -> dict:
        return {"indices": list_indices(self.spark, self.root)}

    def create(self, body: dict) -> dict:
        name = body["name"]
        if not NAME.match(name):
            raise Failure(400, f"{name!r} is no name")
        with self.lock:
            if name in self.settings or name in list_indices(self.spark, self.root):
                raise Failure(409, f"index {name} exists")
            if body.get("config", {}).get("fts_tokenizer", "unicode61") not in ("unicode61", "trigram"):
                raise Failure(400, "unknown tokenizer")
            self.settings[name] = dict(body.get("config", {}))
            self.engines[name] = self._open(name)
        return {"name": name}

    def info(self, body: dict, name: str) -> dict:
        return {"name": name} | self._engine(name).info()

    def drop(self, body: dict, name: str) -> dict:
        engine = self._engine(name)
        with self.lock:
            self.engines.pop(name)
            self.settings.pop(name, None)
            return {"name": name, "deleted": engine.drop()}

    def configure(self, body: dict, name: str) -> dict:
        engine = self._engine(name)
        engine.most = body.get("max_documents", engine.most)
        return {"name": name, "max_documents": engine.most}

    # Documents

    def add(self, body: dict, name: str) -> dict:
        """documents: matrices, or texts with an encoder; metadata: as many objects."""
        engine = self._engine(name)
        given = body["documents"]
        vectors = [_floats(self._vectors(d, False) if isinstance(d, str) else d["embeddings"] if isinstance(d, dict) else d) for d in given]
        objects = body.get("metadata")
        if objects is not None and len(objects) != len(vectors):
            raise Failure(400, f"{len(objects)} metadata objects for {len(vectors)} documents")
        rows = metadata_rows.from_rows(self.spark, objects) if objects else None
        with self.lock:
            regime = engine.add(self.spark.createDataFrame(list(enumerate(vectors)), _DOCS), rows)
            if rows is not None and not engine.manifest["text"]:
                engine.publish_text()
        return {"name": name, "regime": regime, "documents": engine.count()}

    def delete(self, body: dict, name: str) -> dict:
        with self.lock:
            return {"name": name, "deleted": self._engine(name).delete(body["condition"], body.get("parameters", []))}

    # Searches

    def _vectors(self, text: str, query: bool) -> np.ndarray:
        if self.encoder is None:
            raise Failure(400, "there is no encoder for texts")
        if query:
            return self.encoder.vectors(query_tokens(self.encoder, text))
        tokens, counts = document_tokens(self.encoder, text)
        return self.encoder.vectors(tokens)[counts]

    def search(self, body: dict, name: str) -> dict:
        """queries (matrices, or texts with an encoder), text_query, or both; subset or filter_condition."""
        engine = self._engine(name)
        asked = [_floats(self._vectors(q, True) if isinstance(q, str) else q["embeddings"] if isinstance(q, dict) else q) for q in body.get("queries", [])]
        texts = body.get("text_query")
        texts = [texts] if isinstance(texts, str) else texts or []
        own = body.get("params", {})
        parameters = SearchParameters(k=own.get("top_k", 10), probes=own.get("n_ivf_probe", 8), full_scores=own.get("n_full_scores", 4096), centroid_threshold=own.get("centroid_score_threshold", 0.4))
        options = {"condition": body.get("filter_condition"), "values": body.get("filter_parameters", []), "ids": body.get("subset")}
        if asked and texts:
            if len(asked) != 1 or len(texts) != 1:
                raise Failure(400, "a hybrid search takes exactly one query")
            options |= {"alpha": body.get("alpha", 0.75), "fusion_mode": body.get("fusion", "relative_score")}
        queries = self.spark.createDataFrame([(i, j, v) for i, q in enumerate(asked) for j, v in enumerate(q)], _QUERIES) if asked else None
        n = max(len(asked), len(texts))
        if queries is None and len(texts) > 1:
            subset = engine.subset(options["condition"], options["values"], options["ids"])
            found = engine.keywords(dict(enumerate(texts)), parameters.k, subset)
            found = found if engine.rows is None else found.join(engine.rows, "doc_id", "left")
        else:
            found = engine.search(queries, texts[0] if texts else None, parameters, **options)
        results = [{"query_id": i, "document_ids": [], "scores": [], "metadata": []} for i in range(n)]
        for r in found.orderBy("query_id", "rank").collect():  # at most k rows a query
            row = r.asDict()
            at = results[row.pop("query_id")]
            row.pop("rank")
            at["document_ids"].append(row.pop("doc_id"))
            at["scores"].append(row.pop("score"))
            at["metadata"].append(row or None)
        return {"num_queries": n, "results": results}

    # Metadata

    def _rows(self, found, limit: int | None = None) -> list[dict]:
        return [r.asDict() for r in (found if limit is None else found.limit(limit)).collect()]  # what was asked for

    def rows(self, body: dict, name: str) -> dict:
        return {"metadata": self._rows(self._engine(name).metadata())}

    def row_count(self, body: dict, name: str) -> dict:
        engine = self._engine(name)
        return {"count": engine.rows.count() if engine.rows is not None else 0, "has_metadata": engine.rows is not None}

    def check(self, body: dict, name: str) -> dict:
        ids = self.spark.createDataFrame([(int(i),) for i in body["document_ids"]], "doc_id long")
        got = {r["doc_id"]: r["present"] for r in meta.existing(self._engine(name).rows, ids).collect()}
        return {"existing": sorted(i for i, p in got.items() if p), "missing": sorted(i for i, p in got.items() if not p)}

    def query(self, body: dict, name: str) -> dict:
        found = meta.ids_where(self._engine(name).rows, body["condition"], body.get("parameters", []))
        return {"document_ids": [r[0] for r in found.orderBy("doc_id").collect()]}

    def get(self, body: dict, name: str) -> dict:
        engine = self._engine(name)
        if body.get("document_ids") is not None:
            ids = self.spark.createDataFrame([(int(i), n) for n, i in enumerate(body["document_ids"])], "doc_id long, pos int")
            return {"metadata": self._rows(meta.get_by_ids(engine.rows, ids).drop("pos"), body.get("limit"))}
        return {"metadata": self._rows(engine.metadata(body.get("condition"), body.get("parameters", []), body.get("limit")))}

    def change(self, body: dict, name: str) -> dict:
        with self.lock:
            return {"updated": self._engine(name).update_metadata(body["condition"], body.get("parameters", []), body["updates"])}

    # Without an index

    def encode(self, body: dict) -> dict:
        query = body.get("input_type", "document") == "query"
        return {"embeddings": [self._vectors(t, query).tolist() for t in body["texts"]]}

    def rerank(self, body: dict) -> dict:
        """index and score of given documents, best first: matrices, or texts with an encoder."""
        one = lambda x, query: _floats(self._vectors(x, query) if isinstance(x, str) else x["embeddings"] if isinstance(x, dict) else x)
        asked, given = one(body["query"], True), [one(d, False) for d in body["documents"]]
        if not asked or not given:
            raise Failure(400, "a query and documents are needed")
        docs = self.spark.createDataFrame(list(enumerate(given)), _DOCS)
        found = maxsim.rerank(docs, self.spark.createDataFrame([(0, j, v) for j, v in enumerate(asked)], _QUERIES))
        return {"results": [{"index": r["doc_id"], "score": r["score"]} for r in found.orderBy("rank").select("doc_id", F.col("score")).collect()]}


def serve(service: Service, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for the service; serve_forever() runs it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size)) if size else {}
                status, out = service.handle(self.command, self.path, body)
            except json.JSONDecodeError as e:
                status, out = 400, {"error": str(e)}
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


__all__ = ["Failure", "Service", "serve"]
