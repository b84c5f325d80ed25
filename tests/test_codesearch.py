"""Search over a small tree, and the encoder's contract."""

import numpy as np
from pyspark.sql import functions as F

from polyvec.codesearch import CodeSearch, clone_index, search_all
from polyvec.operators import encoder as enc

FILES = {
    "src/parser.py": "def parse_request(text):\n    return text.split()\n\nclass HandlerStack:\n    def push(self, item):\n        self.items.append(item)\n",
    "src/store.py": "def save_rows(rows):\n    for r in rows:\n        write(r)\n",
    "tests/test_parser.py": "def test_parse_request():\n    assert parse_request('a')\n",
    "README.md": "# Title\nHow to parse a request.\n",
}


def write(root, files):
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)


def test_code_search(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, FILES)
    code = CodeSearch(spark, f"file://{tmp_path}/index", enc.HashEncoder(enc.EncoderConfig(query_length=8, document_length=80, dimension=32)))
    assert code.refresh(f"file://{root}") == {"added": 4}
    assert code.search("parse_request").first().file == "src/parser.py"
    assert {r.file for r in code.search("parse request", pattern="split\\(").collect()} == {"src/parser.py"}
    assert {r.file for r in code.search("rows", include=["*.md"]).collect()} <= {"README.md"}
    assert "README.md" not in {r.file for r in code.search("parse request", code_only=True).collect()}
    assert code.status(f"file://{root}") == {"unchanged": 4}
    (root / "README.md").unlink()
    write(root, {"src/store.py": "def drop_everything():\n    pass\n\n# more\n"})
    assert code.refresh(f"file://{root}") == {"unchanged": 2, "deleted": 1, "changed": 1}
    assert code.search("drop_everything").first().file == "src/store.py"
    assert {r.file for r in code.files(code.engine.rows).collect()} == {"src/parser.py", "src/store.py", "tests/test_parser.py"}
    assert code.reconcile() == {} and {r.language for r in code.stats().collect()} == {"python"}
    hits = code.grouped(code.search("parse request"), "parse request").collect()
    assert hits[0].file == "src/parser.py" and all(h.shown for h in hits[0].hits)
    assert {r.file for r in code.search("rows", files=["src/parser.py"]).collect()} == {"src/parser.py"}
    # Given files alone; ignore files of folders; several trees; a copy that goes on by itself.
    write(root, {"src/extra.go": "package x\n\nfunc ParseRequest(a string) string {\n\treturn a\n}\n", "gen/.gitignore": "*.py\n", "gen/made.py": "def made():\n    pass\n", "src/bad.py": "def (\n"})
    assert code.refresh(f"file://{root}", files=["src/extra.go"]) == {"added": 1}
    assert code.status(f"file://{root}") == {"unchanged": 4, "added": 1} and [(r.file, r.reason) for r in code.skipped(f"file://{root}").collect()] == [("src/bad.py", "no units")]
    other = clone_index(code, f"file://{tmp_path}/copy")
    (root / "src/store.py").unlink()
    assert other.refresh(f"file://{root}")["deleted"] == 1 and code.engine.count() > other.engine.count()
    found = search_all({"a": code, "b": other}, "ParseRequest", 6).collect()
    assert {r.path for r in found} == {"a", "b"} and found[0].file == "src/extra.go"


def test_build_in_batches(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, FILES)
    seen = []
    code = CodeSearch(spark, f"file://{tmp_path}/index", enc.HashEncoder(enc.EncoderConfig(query_length=8, document_length=80, dimension=16)), progress=lambda action, more: seen.append((action, more["documents"])))
    code._index(code.plan(f"file://{root}")[0].where("file = 'src/store.py'"))  # what an interrupted build left
    assert code.refresh(f"file://{root}", batch_files=2) == {"added": 3, "unchanged": 1}
    assert len([a for a, _ in seen if a in ("create", "rebuild")]) >= 2 and seen[-1][0] == "text"
    assert code.status(f"file://{root}") == {"unchanged": 4}


def test_encoder(spark):
    e = enc.HashEncoder(enc.EncoderConfig(query_length=6, document_length=5, dimension=16))
    assert enc.query_tokens(e, "a b") == ["[Q]", "a", "b", "[MASK]", "[MASK]", "[MASK]"]
    tokens, counts = enc.document_tokens(e, "a, b! c d e")
    assert len(tokens) == 5 and tokens[2] == "," and not counts[2]
    rows = spark.createDataFrame([(1, "a, b"), (2, "a, b"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: np.array(r.embs) for r in enc.encode_documents(rows, e).collect()}
    assert set(got) == {1, 2} and (got[1] == got[2]).all() and np.allclose(np.linalg.norm(got[1], axis=1), 1)
    docs = enc.encode_documents(rows, e).select(enc.padded(F.col("embs"), 4, 16).alias("p"), enc.mask(F.col("embs"), 4).alias("m")).first()
    assert len(docs.p) == 4 and docs.m == [1, 1, 1, 0] and docs.p[3] == [0.0] * 16
