"""The routes, and one request through a real server."""

import json
import threading
import urllib.request

from polyvec.operators.encoder import EncoderConfig, HashEncoder
from polyvec.service import Service, serve

TEXTS = ["Rust programming", "Python scripting", "Go concurrency", "Rust again"]


def test_routes(spark, tmp_path):
    encoder = HashEncoder(EncoderConfig(query_length=6, document_length=10, dimension=16))
    service = Service(spark, f"file://{tmp_path}/all", encoder)
    call = lambda method, path, body=None: service.handle(method, path, body)
    assert call("GET", "/indices") == (200, {"indices": []}) and call("GET", "/indices/none")[0] == 404 and call("GET", "/nowhere")[0] == 404 and call("PUT", "/indices")[0] == 405
    assert call("POST", "/indices", {"name": "a/b"})[0] == 400 and call("POST", "/indices", {"name": "one"})[0] == 200 and call("POST", "/indices", {"name": "one"})[0] == 409
    rows = [{"title": t, "year": 2020 + i} for i, t in enumerate(TEXTS)]
    assert call("POST", "/indices/one/update_with_encoding", {"documents": TEXTS, "metadata": rows}) == (200, {"name": "one", "regime": "create", "documents": 4})
    assert call("POST", "/indices/one/update", {"documents": [[[1.0, float("nan")]]]})[0] == 400 and call("POST", "/indices/one/documents", {"documents": TEXTS, "metadata": rows[:1]})[0] == 400
    found = call("POST", "/indices/one/search_with_encoding", {"queries": ["python scripting"], "params": {"top_k": 2, "centroid_score_threshold": None}})[1]["results"][0]
    assert found["document_ids"][0] == 1 and found["metadata"][0]["title"] == "Python scripting" and found["scores"] == sorted(found["scores"], reverse=True)
    assert call("POST", "/indices/one/search", {"text_query": ["rust", "what is this?"]})[1]["results"][0]["document_ids"] == [0, 3]
    assert call("POST", "/indices/one/search/filtered", {"text_query": "rust", "filter_condition": "year > ?", "filter_parameters": [2021]})[1]["results"][0]["document_ids"] == [3]
    assert call("POST", "/indices/one/search", {"text_query": "rust", "filter_condition": "year > 2021"})[0] == 400
    assert call("POST", "/indices/one/metadata/check", {"document_ids": [0, 9]})[1] == {"existing": [0], "missing": [9]}
    assert call("POST", "/indices/one/metadata/query", {"condition": "title LIKE ?", "parameters": ["rust%"]})[1] == {"document_ids": [0, 3]}
    assert [r["doc_id"] for r in call("POST", "/indices/one/metadata/get", {"document_ids": [2, 0, 2]})[1]["metadata"]] == [2, 0]
    assert call("POST", "/indices/one/metadata/update", {"condition": "year = ?", "parameters": [2021], "updates": {"title": "Zig"}})[1] == {"updated": 1}
    assert call("DELETE", "/indices/one/documents", {"condition": "title = ?", "parameters": ["Rust programming"]})[1]["deleted"] == 1
    assert call("GET", "/indices/one/metadata/count")[1]["count"] == 3 and call("POST", "/indices/one/search", {"text_query": "zig"})[1]["results"][0]["document_ids"] == [0]
    ranked = call("POST", "/rerank", {"query": [[1, 0], [0, 1]], "documents": [[[0, 0.5]], [[1, 1]], [[0.9, 0]]]})[1]["results"]
    assert [(r["index"], round(r["score"], 6)) for r in ranked] == [(1, 2.0), (2, 0.9), (0, 0.5)]
    assert len(call("POST", "/encode", {"texts": ["a b"], "input_type": "query"})[1]["embeddings"][0]) == 6
    server = serve(service, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/indices/one") as answer:
        assert json.load(answer)["documents"] == 3
    server.shutdown()
    assert call("DELETE", "/indices/one") == (200, {"name": "one", "deleted": True}) and call("GET", "/indices") == (200, {"indices": []})
