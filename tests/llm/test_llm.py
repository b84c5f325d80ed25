"""The training-data operators: brute force, exact round trips, held-out accuracy, and odd tables."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from polyvec.llm import html_extract, licenses, media, mixing, near_dup, packing, quality, queries, sp_codec, toxicity, warc
from polyvec.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, node long, _quality int, _split int, _place int, part string, total int"
LONG = " ".join(f"word{i % 997}x{i % 31}" for i in range(30_000)) + "."


def odd_rows():
    more = ("a", 1, 2, 3, 4, "p", 5)
    texts = [(1, "A plain sentence, with commas."), (1, "A plain sentence, with commas."), (2, None), (None, "A text without an id."), (3, ""), (4, "   \n\t"), (5, LONG), (6, LONG + " More."), (7, "x"), (8, "naïve café ▁ 😀 日本語の文。"), (None, None)]
    return [(i, t, "en" if k % 3 else None, None if k % 4 == 0 else f"s{k % 2}", len(t) if t else None, *more) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_query(spark, duck, small, name):
    got = queries.queries()[name](spark, small).toPandas()
    assert len(got)
    if name in queries.oracle_sql():
        want = duck.sql(queries.oracle_sql()[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns) and rows_of(got, columns) == rows_of(want, columns)


# 1. Near-duplicates


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        out.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    return out


def similar_pairs(texts, threshold):
    sets, where = shingle_sets(texts), defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    both = defaultdict(int)
    for ids in where.values():
        for a, b in itertools.combinations(ids, 2):
            both[a, b] += 1
    return {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in both.items() if n / (len(sets[a]) + len(sets[b]) - n) >= threshold}


def groups(found, ids):
    root = {r.doc_id: r.duplicate_of for r in found.collect()}
    return {i: root.get(i, i) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for base in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(30, 400))]
        texts.append(text)
        for _ in range(rng.choice([0, 1, 3])):
            copy = list(text)
            for _ in range(max(1, len(copy) // rng.choice([12, 20, 40]))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    texts = [" ".join(t) for t in texts]
    hub = [rng.choice(words) for _ in range(200)]
    for k in range(300):  # a group far larger than a leaf
        copy = list(hub)
        copy[k % 200] = words[k]
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = groups(near_dup.near_duplicates(docs, leaf=16), range(len(texts)))
    true = similar_pairs(texts, 0.5)
    assert sum(got[a] == got[b] for a, b in true) >= 0.97 * len(true)
    near = {i for p in similar_pairs(texts, 0.4) for i in p}
    assert all(got[i] == i for i in range(len(texts)) if i not in near)
    assert len({got[i] for i in range(len(texts) - 300, len(texts))}) == 1


def test_near_duplicates_depth_limit(spark):
    """Nodes that are still large at the last level are compared in blocks, all against all."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        half = [rng.choice(base) + str(rng.random()) for _ in range(400)]
        texts += [" ".join(base + half), " ".join(base + half[:-8] + ["z"] * 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = groups(near_dup.near_duplicates(docs, leaf=4, depth=1, threshold=0.6), range(len(texts)))
    assert sum(got[a] == got[b] for a, b in similar_pairs(texts, 0.65)) == len(similar_pairs(texts, 0.65))


def test_near_duplicates_of_single_members(spark):
    """Near copies of one member of a large group, unlike all its others, are found."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    texts = [base[:300] + [f"p{i}x{j}" for j in range(60)] for i in range(1100)]
    members = rng.sample(range(200, 1100), 150)
    for i in members:
        # The member's own words stay, so that no other member is similar to the copy.
        texts.append([f"c{i}x{j}" for j in range(95)] + texts[i][95:])
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = groups(near_dup.near_duplicates(docs), range(len(texts)))
    assert len({got[i] for i in range(1100)}) == 1
    assert sum(got[1100 + n] == got[i] for n, i in enumerate(members)) >= 0.97 * len(members)


def test_near_duplicates_of_documents(spark, small, documents):
    """op1 over the whole table: the groups of all pairs of documents, compared set by set."""
    rows = documents.orderBy("doc_id").collect()
    root = {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sure = similar_pairs([r.text for r in rows], 0.56)  # beyond two standard errors of the estimate
    for a, b in sure:
        x, y = sorted((find(rows[a].doc_id), find(rows[b].doc_id)))
        root[y] = x
    got = groups(queries.queries()["op1_near_duplicates"](spark, small), root)
    assert sure and all(got[x] == got[find(x)] for x in root)
    near = {rows[i].doc_id for p in similar_pairs([r.text for r in rows], 0.42) for i in p}
    assert all(got[x] == x for x in root if x not in near)


def test_near_duplicates_recall_at_the_threshold(spark):
    """Pairs just above the threshold, in families whose shared words make large nodes, are found with
    the probability that was asked for; survival() is what a simulation of the branching gives."""
    rng = random.Random(12)
    texts, pairs = [], []
    for family in range(10):
        shared = [f"f{family}s{i}" for i in range(60)]
        for k in range(60):
            own = [f"f{family}o{k}x{i}" for i in range(140)]
            a, b = shared + own + [f"a{family}x{k}x{i}" for i in range(88)], shared + own + [f"b{family}x{k}x{i}" for i in range(88)]
            pairs.append((len(texts), len(texts) + 1))
            texts += [" ".join(a), " ".join(b)]
    assert 0.51 < min(similar_pairs([texts[i] for i in pairs[0]], 0.5).values()) < 0.54
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = groups(near_dup.near_duplicates(docs, leaf=16), range(len(texts)))
    low = (near_dup.mix64(near_dup.signatures(*near_dup.shingles(pa.array(texts))).astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
    # What is asked for is that pairs meet; whether they then count is the estimate's matter.
    met = [(a, b) for a, b in pairs if near_dup._similar(low[a], low[b]) >= 0.5]
    assert len(met) > 300 and sum(got[a] == got[b] for a, b in met) >= 0.95 * len(met)
    alive = np.ones(20_000)
    draw = np.random.default_rng(1)
    for depth in range(1, 7):
        alive = draw.binomial(alive.astype(np.int64) * 128, 1 / 128)
        assert (alive > 0).mean() == pytest.approx(near_dup.survival(depth), abs=0.02)
    assert 1 - (1 - near_dup.survival(6)) ** near_dup.trees_for(0.95, 6) >= 0.95 > 1 - (1 - near_dup.survival(6)) ** (near_dup.trees_for(0.95, 6) - 1)


def test_near_duplicates_whatever_the_size(spark):
    """Texts of common blocks, so that nodes are large: a small part of the table has no link that the whole
    lacks, and the sizes at which nodes are compared or dealt out in another way change nothing."""
    rng = random.Random(3)
    blocks = [" ".join(f"b{i}x{j}" for j in range(12)) for i in range(60)]
    texts = []
    for _ in range(500):
        both, rest = (lambda x: (x[:20], x[20:40]))(rng.sample(blocks, 40))
        texts += [" ".join(both + rest[:10]), " ".join(both + rest[10:])]
    low = (near_dup.mix64(near_dup.signatures(*near_dup.shingles(pa.array(texts))).astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
    every = [(a, b) for a in range(1000) for b in a + 1 + np.flatnonzero(near_dup._similar(low[a], low[a + 1 :]) >= 0.5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def found(docs, **sizes):
        return {tuple(r) for r in near_dup.near_duplicates(docs, **sizes).collect()}

    whole = found(docs, trees=2, leaf=2000)
    root = dict(whole)
    part = found(docs.where("doc_id < 100"), trees=2)
    assert len(part) > 10 and all(root.get(a, a) == root.get(b, b) for a, b in part)
    assert found(docs, trees=2) == found(docs, trees=2, leaf=4) == found(docs, trees=2, held=256) == whole
    assert found(docs, leaf=4) == set(zip(*near_dup._star(*np.array(every).T), strict=True))


@pytest.mark.parametrize(("shared", "much"), [(0.0, 0), (0.1, 0), (0.45, 0), (0.1, 1 << 60)])
def test_near_duplicate_links_against_all_pairs(shared, much):
    """By bands, by bands that separate little, and by all pairs, a large node has the same components."""
    rng = np.random.default_rng(6)
    base, centre = rng.integers(0, 256, 256).astype(np.uint8), rng.integers(0, 256, (700, 256)).astype(np.uint8)
    centre = np.where(rng.random(centre.shape) < shared, base, centre)
    sig = centre[rng.integers(0, 700, 1500)]
    sig = np.where(rng.random(sig.shape) < rng.uniform(0, 0.6, (1500, 1)), rng.integers(0, 256, sig.shape), sig).astype(np.uint8)
    a, b = np.nonzero(np.concatenate([near_dup._similar(sig[i : i + 50, None], sig[None]) for i in range(0, 1500, 50)]) >= 0.5)
    table = pa.table({"node": np.full(1500, 7), "doc_id": np.arange(1500), "sig": pa.array([x.tobytes() for x in sig], pa.binary())})
    got = [near_dup._star(np.asarray(r["a"]), np.asarray(r["b"])) for r in near_dup._links(table.to_batches(400), 0.5, 16, much)]
    assert len(got) == 1 and 300 < len(got[0][0]) < 1400
    assert set(zip(*got[0], strict=True)) == set(zip(*near_dup._star(a, b), strict=True))


@pytest.mark.parametrize("depth", [2, 6])
def test_near_duplicates_in_dealt_nodes(spark, depth):
    """Nodes of more rows than a task may hold are dealt out, at the last level too; the groups stay the same."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    texts = [base[:300] + [f"p{i}x{j}" for j in range(60)] for i in range(900)]
    members = rng.sample(range(900), 60)
    texts += [[f"c{i}x{j}" for j in range(95)] + texts[i][95:] for i in members]
    half = [[f"h{i}" for i in range(200)] + [f"q{k}x{i}" for i in range(230)] for k in range(400)]  # alike, but less than the threshold
    texts = [" ".join(t) for t in texts + half]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = groups(near_dup.near_duplicates(docs, held=64, depth=depth), range(len(texts)))
    assert len({got[i] for i in range(900)}) == 1 and sum(got[900 + n] == got[i] for n, i in enumerate(members)) >= 0.97 * len(members)
    assert all(got[i] == i for i in range(960, 1360))


def test_near_duplicates_of_repeated_rows(spark):
    """Rows that repeat change nothing: nodes of different texts between the same two stay apart."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(200):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(6):
            copy = list(base)
            for at in rng.sample(range(120), 12):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    once, twice = ({tuple(r) for r in near_dup.near_duplicates(d, threshold=0.3, depth=1, trees=2).collect()} for d in (docs, docs.union(docs)))
    assert once == twice and len(once) > 300


def test_near_duplicates_ids_of_any_kind(spark):
    """Strings as ids, and ids that come with several texts, each of which counts."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [("x", a), ("y", a + " more"), ("x", b), ("z", b + " end"), ("w", c), ("w", c), (None, a), ("v", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {tuple(r) for r in near_dup.near_duplicates(docs).collect()} == {("y", "x"), ("z", "x")}
    numbers = {"x": 7, "y": 8, "z": 3, "w": 4, "v": 5, None: None}
    small = spark.createDataFrame([(numbers[i], t) for i, t in rows], "doc_id int, text string")
    assert {tuple(r) for r in near_dup.near_duplicates(small).collect()} == {(7, 3), (8, 3)}
    assert near_dup.drop_near_duplicates(docs.withColumn("a.b", F.lit(1))).columns == ["doc_id", "text", "a.b"]


def test_near_duplicates_odd(odd, empty):
    got = near_dup.near_duplicates(odd)
    assert [tuple(r) for r in got.collect()] == [(6, 5)]
    kept = near_dup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "None", "None"])
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.drop_near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(b, a) for a, b in (sorted(rng.sample(range(500), 2)) for _ in range(400))] + [(i + 1, i) for i in range(1000, 1200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.doc_id: r.root for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


# 2. Licences


def test_license_expressions():
    ok = lambda text: licenses.evaluate(licenses.read_expression(text)[0])[::2]
    assert ok("mit") == (licenses.PERMISSIVE, "MIT")
    assert ok("mit or gpl-3.0-only and bsd-3-clause") == (licenses.PERMISSIVE, "MIT OR GPL-3.0 AND BSD-3-Clause")
    assert ok("(mit or gpl-3.0-only) and cc-by-nc-4.0") == (licenses.NONCOMMERCIAL, "(MIT OR GPL-3.0) AND CC-BY-NC-4.0")
    assert ok("gpl-2.0+ with classpath-exception-2.0") == (licenses.WEAK, "GPL-2.0-or-later WITH Classpath-exception-2.0")
    assert ok("gpl-2.0 with foo-exception")[0] == licenses.CLOSED
    assert ok("gpl-3.0-linking-exception") == (licenses.CLOSED, "gpl-3.0-linking-exception") and ok("gpl-2.0-with-classpath-exception") == (licenses.WEAK, "GPL-2.0-with-classpath-exception")
    assert ok("proprietary or mit") == (licenses.PERMISSIVE, "proprietary OR MIT") and ok("mit and licenseref-acme") == (licenses.CLOSED, "MIT AND licenseref-acme")
    for prose in ("mit or the rest", "mit and this module", "mit with some changes", "mit and well-known", "mit with (isc)", "mit\nand isc"):
        assert licenses.read_expression(prose)[0] == ["mit"], prose
    assert licenses.read_expression("(mit or isc")[0] == [] and licenses.read_expression("mit and")[0] == ["mit"] and licenses.read_expression("and mit")[0] == []


def naive_expression(tokens):
    """The class by recursive descent."""
    at = 0

    def atom():
        nonlocal at
        if tokens[at] == "(":
            at += 1
            out = either()
            at += 1
        else:
            out = licenses.identifier(tokens[at])[1]
            at += 1
        if at < len(tokens) and tokens[at] == "with":
            known = tokens[at + 1] in licenses.EXCEPTIONS
            out = licenses.CLOSED if not known else licenses.WEAK if out == licenses.COPYLEFT else out
            at += 2
        return out

    def both():
        nonlocal at
        out = atom()
        while at < len(tokens) and tokens[at] == "and":
            at += 1
            out = max(out, atom())
        return out

    def either():
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] == "or":
            at += 1
            out = min(out, both())
        return out

    return either()


def test_license_expressions_at_random():
    rng = random.Random(6)
    names = [x.lower() for x in licenses.LICENSES] + ["unheard-of-1.0"]

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return [rng.choice(names)] + (["with", rng.choice([*licenses.EXCEPTIONS, "odd-exception"])] if rng.random() < 0.2 else [])
        inner = [*make(depth - 1), rng.choice(["and", "or"]), *make(depth - 1)]
        return ["(", *inner, ")"] if rng.random() < 0.5 else inner

    for _ in range(500):
        tokens = make(3)
        assert licenses.read_expression(" ".join(tokens) + " ! rest")[0] == tokens
        assert licenses.evaluate(tokens)[0] == naive_expression(tokens)


def naive_scan(text):
    """(expression, category, allowed, licences) of a text by trying every phrase at every place."""
    low = re.sub(r"\s+", lambda m: "\n" if len(m[0].splitlines()) > 1 or m[0].splitlines() != [m[0]] else " ", text.lower().strip())
    flat = low.replace("\n", " ")
    phrases = [(p, n) for n, (_, ps) in licenses.LICENSES.items() for p in ps]
    at, found = 0, []
    starts = sorted({m.start() for p, _ in phrases for m in re.finditer(re.escape(p), flat)} | {m.start() for m in re.finditer(licenses.TAG, flat)})
    for start in starts:
        if start < at or (start and flat[start - 1].isalnum()):
            continue
        here = [(len(p), n) for p, n in phrases if flat.startswith(p, start) and not flat[start + len(p) : start + len(p) + 1].isalnum()]
        if flat.startswith(licenses.TAG, start):
            rest = low[start + len(licenses.TAG) :].split("\n")[0]
            for end in range(len(rest), 0, -1):  # the longest beginning of the line that parses
                m = re.fullmatch(r"[a-z0-9 ().:+\-]+", rest[:end])
                tokens = re.findall(r"[()]|[^\s()]+", rest[:end]) if m and not rest[:end].endswith((" ", ".", ":")) and not rest[end : end + 1].isalnum() and rest[end : end + 1] not in ("-", "+") else []
                if tokens and naive_valid(tokens):
                    found.append((licenses.evaluate(tokens)[2], naive_expression(tokens), {licenses.identifier(t)[0] for i, t in enumerate(tokens) if t not in ("and", "or", "with", "(", ")") and (not i or tokens[i - 1] != "with")}))
                    at = start + len(licenses.TAG) + end
                    break
            else:
                at = start + len(licenses.TAG)
        elif here:
            size, name = max(here)
            found.append((name, licenses.LICENSES[name][0], {name}))
            at = start + size
    if not found:
        return None
    shown = list(dict.fromkeys(f[0] for f in found))
    worst = max(f[1] for f in found)
    joined = shown[0] if len(shown) == 1 else " AND ".join(f"({x})" if " OR " in x else x for x in shown)
    return joined, licenses.CLASSES[worst], worst <= licenses.WEAK, sorted(set().union(*(f[2] for f in found)))


def naive_valid(tokens):
    """Is it an expression whose operands look like identifiers? By a grammar on one sign a token."""
    signs, first = "", True
    for i, t in enumerate(tokens):
        if t in ("(", ")"):
            signs += t
        elif t in ("and", "or"):
            signs += "o"
        elif t == "with":
            signs += "w"
        elif i and tokens[i - 1] == "with":
            signs += "e" if t in licenses.EXCEPTIONS or "-exception" in t or "-note" in t else "?"
        else:
            signs += "a" if first or licenses.named(t) else "?"
            first = False
    signs = signs.replace("awe", "a")
    while True:
        less = signs.replace("(a)", "a").replace("aoa", "a")
        if less == signs:
            return signs == "a"
        signs = less


TAGGED = [
    "x SPDX-License-Identifier: MIT\nand this module does x", "// spdx-license-identifier: MIT or the rest", "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND BSD-3-Clause */", "SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0.",
    "SPDX-License-Identifier: Proprietary\nSPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier:", "SPDX-License-Identifier: (MIT", "SPDX-License-Identifier: AND", "SPDX-License-Identifier: LicenseRef-Acme-7 AND MIT, under the MIT License",
    "GNU Lesser General Public License, version 2.1 and GNU Affero\n  General Public License, version 3", "permit license; a MIT  \n License, all rights reserved.", "SPDX-License-Identifier: WTFPL or Beerware with fun",
]


def test_license_scan_against_naive(spark, documents):
    """Every document, and texts with tags: expression, category, allowed and licences."""
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TAGGED)], "doc_id long, text string")
    rows = documents.select("doc_id", "text").unionByName(more)
    found = {r.doc_id: (r.expression, r.category, r.allowed, r.licenses) for r in licenses.scan(rows).collect()}
    want = {r.doc_id: naive_scan(r.text) for r in rows.collect()}
    assert found == {k: v for k, v in want.items() if v is not None}
    assert found[10**6][:2] == ("MIT", "permissive") and found[10**6 + 1][0] == "MIT" and 10**6 + 5 not in found


def test_license_scan_is_linear_in_blanks():
    import time

    began = time.perf_counter()
    automaton = licenses._automaton()
    for text in (" " * 2_000_000 + "MIT License", "mit" + "\t \n" * 500_000 + "license", "SPDX-License-Identifier: " * 40_000 + "MIT", "(" * 500_000):
        licenses.scan_text(text, automaton)
    assert licenses.scan_text("mit" + " \n" * 1000 + "license", automaton)[0][1] == "MIT" and time.perf_counter() - began < 20


@pytest.mark.parametrize("form", ["{}", "({})"])
def test_license_expression_is_read_whole(form):
    """Expressions of more than 4,000 characters, with the strictest licence at the end."""
    automaton = licenses._automaton()
    for n in (500, 503, 5000):
        text = "code SPDX-License-Identifier: " + form.format(" AND ".join(["MIT"] * n + ["GPL-3.0"]))
        ((place, _, kind, names),) = licenses.scan_text(text + "\nmore", automaton)
        assert (place, kind, names) == (5, licenses.COPYLEFT, ["GPL-3.0", "MIT"])


def test_license_odd(spark, odd, empty):
    rows = odd.unionByName(spark.createDataFrame([(20, "x SPDX-License-Identifier: MIT OR\n Apache-2.0 x", *odd_rows()[0][2:]), (21, "permit license; MIT licensees", *odd_rows()[0][2:]), (None, "Released under the\nMIT   License", *odd_rows()[0][2:])], SCHEMA))
    got = {r.doc_id: (r.expression, r.category, r.allowed) for r in licenses.scan(rows).collect()}
    assert got == {20: ("MIT", "permissive", True), None: ("MIT", "permissive", True)}
    named = rows.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text", F.lit(1).alias("expression"), F.lit(2).alias("n_hits"))
    assert {r.doc_id for r in licenses.scan(named).collect()} == {"d20", None}
    assert licenses.scan(empty).count() == 0


# 3. Packing


def test_best_fit_decreasing_against_naive():
    rng = random.Random(3)
    for _ in range(20):
        sizes = sorted((rng.randint(1, 50) for _ in range(200)), reverse=True)
        bins = packing.best_fit_decreasing(sizes, 50)
        assert sorted(i for b in bins for i in b) == list(range(200)) and all(sum(sizes[i] for i in b) <= 50 for b in bins)
        naive = []
        for s in sizes:
            fits = [k for k, room in enumerate(naive) if room >= s]
            if fits:
                naive[min(fits, key=lambda k: naive[k])] -= s
            else:
                naive.append(50 - s)
        assert len(bins) == len(naive)


def unpacked(rows, length, end):
    docs = defaultdict(dict)
    for r in rows:
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert (ids[r.n_tokens :] == end).all() and (places[r.n_tokens :] == 0).all()
        for a, b, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts):
            assert (places[a:b] == np.arange(b - a)).all()
            docs[doc][start] = ids[a:b].tolist()
    return {d: [t for s in sorted(p) for t in p[s]] for d, p in docs.items()}


def test_packing_loses_nothing(documents):
    tokenizer = packing.Tokenizer(packing.VOCABULARY)
    got = unpacked(packing.pack(documents, length=256).collect(), 256, tokenizer.end)
    for r in documents.collect():
        assert got[r.doc_id] == [*tokenizer.encoding.encode_ordinary(r.text), tokenizer.end]


def test_packing_in_groups_and_by_any_id(documents):
    """Groups bound what a task holds; every document is there once, whatever its id's type."""
    tokenizer = packing.Tokenizer(packing.VOCABULARY)
    named = documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text", F.lit(1).alias("shard"))
    rows = packing.pack(named, length=128, group=5_000).collect()
    got = unpacked(rows, 128, tokenizer.end)
    assert got == {f"d{r.doc_id}": [*tokenizer.encoding.encode_ordinary(r.text), tokenizer.end] for r in documents.collect() if r.text}
    assert len({(r.shard, r.row) for r in rows}) == len(rows)


def test_packed_files_round_trip(spark, documents, tmp_path):
    rows = packing.pack(documents.repartition(3), length=256)
    index = packing.write(rows, f"file://{tmp_path}/p")
    key = lambda r: (r.n_tokens, bytes(r.ids), bytes(r.position_ids), tuple(r.cu_seqlens), tuple(r.doc_ids), tuple(r.starts))
    back = packing.read(spark, f"file://{tmp_path}/p")
    assert sorted(map(key, back.collect())) == sorted(map(key, rows.collect())) and index.count() == back.count()
    whole = {f: packing.matrix(f"{tmp_path}/p/data/{f}.ids", 256) for f in {r.file for r in index.collect()}}
    assert all((whole[r.file][r.row] == np.frombuffer(r.ids, "<u2")).all() for r in back.collect())
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        packing.write(rows, f"file://{tmp_path}/p")
    assert packing.read(spark, f"file://{tmp_path}/p").count() == index.count()
    packing.write(packing.pack(documents.limit(0)), f"file://{tmp_path}/none")
    assert packing.read(spark, f"file://{tmp_path}/none").count() == 0


def test_run_tokenizer_is_the_library():
    rng = random.Random(9)
    tokenizer = packing.Tokenizer(packing.VOCABULARY)
    texts = ["".join(rng.choice("ab é 　  \n\n .1'st\t ") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", " ", LONG]
    ids, count = tokenizer.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [tokenizer.encoding.encode_ordinary(t) for t in texts]


def test_packing_odd(odd, empty):
    rows = packing.pack(odd).collect()
    assert {d for r in rows for d in r.doc_ids} == {1, None, 4, 5, 6, 7, 8}
    assert packing.pack(empty).count() == 0


# 4. WARC


def test_warc_round_trip(spark, small, tmp_path):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    more = spark.createDataFrame([(900, None, None, 1), (None, "http://x/", "", 1), (901, "http://y/", "same", 1), (902, "http://z/", "same", 1), (902, "http://z/", "same", 1)], "page_id long, url string, html string, digest int")
    rows = pages.unionByName(more, allowMissingColumns=True)
    got = warc.round_trip(rows).collect()
    assert len(got) == rows.count()
    want = sorted(r.html or "" for r in rows.collect())
    parsed = [warc.parse(r.record.encode()) for r in got]
    assert sorted(p[0][1].decode() for p in parsed) == want and all(len(p) == 1 for p in parsed)
    assert {p[0][0].decode() for p in parsed} == {r.header for r in got}
    payloads, _ = warc.archive(warc.records(rows))
    assert payloads.count() == len(set(want))
    assert warc.round_trip(rows.limit(0)).count() == 0
    at = f"file://{tmp_path}/a"
    assert warc.save(warc.records(more), at, "first") and warc.save(warc.records(more.limit(3)), at, "second")
    assert not warc.save(warc.records(more), at, "first")  # run again: nothing is repeated
    spark.range(1).selectExpr("cast('x' as binary) as payload").write.parquet(f"{at}/payloads/left-by-a-failed-run")
    assert warc.tables(spark, at)[0].count() == 2 and warc.load(spark, at).count() == 8
    (tmp_path / "w").mkdir()
    (tmp_path / "w/x.warc").write_bytes(b"".join(r.record.encode() for r in got))
    assert warc.read_files(spark, f"file://{tmp_path}/w").count() == len(got)


def test_warc_odd_columns(spark):
    """Columns with the archive's own names are kept and not trusted; nulls and long payloads come back."""
    rows = spark.createDataFrame([(b"h1", b"same", "wrong", 7, "r", "d"), (b"h2", b"same", None, None, None, None), (b"h3", None, "wrong", 1, "r", "d"), (None, b"x", "y", 2, "r", "d"), (b"h4", b"long " * 400_000, "z", 3, "r", "d")], "header binary, payload binary, digest string, n_bytes int, record string, `a.b` string")
    payloads, headers = warc.archive(rows)
    assert payloads.count() == 4
    got = warc.restore(payloads, headers)
    assert got.columns == ["digest", "n_bytes", "record", "a.b", "header", "_digest", "_record"]
    by = {r.header and bytes(r.header): r for r in got.collect()}
    assert bytes(by[b"h1"]._record) == b"h1same\r\n\r\n" and by[b"h1"].digest == "wrong" and bytes(by[b"h3"]._record) == b"h3\r\n\r\n" and by[None]._record is None and len(by[b"h4"]._record) == 2_000_006
    bare = warc.restore(*warc.archive(rows.select("header", "payload")))
    assert bare.columns == ["header", "digest", "record"] and bare.count() == 5
    assert warc.restore(*warc.archive(rows.limit(0))).count() == 0


def test_warc_finds_damage(spark):
    payloads, headers = warc.archive(warc.records(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.restore(payloads.withColumn("payload", F.lit(b"abd")), headers).collect()


# 5. Toxicity


def toy(n, seed):
    rng = random.Random(seed)
    words, bad = [f"plain{i}" for i in range(300)], ["idiotic", "scumbag", "morons"]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randint(3, 9))]
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] = f"{sentences[k]} {rng.choice(bad)}"
        rows.append((i, ". ".join(sentences) + ".", int(toxic), k if toxic else -1))
    return rows


def test_toxicity_held_out(spark):
    train, test = toy(400, 1), toy(200, 2)
    frame = lambda rows: spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, toxic int")
    model = toxicity.train(frame(train).select("doc_id", "text"), frame(train).select("doc_id", "toxic"))
    found = toxicity.offending_sentences(frame(test), model).collect()
    flagged = {r.doc_id for r in found}
    truth = {r[0] for r in test if r[2]}
    assert len(flagged & truth) >= 0.95 * len(truth) and len(flagged - truth) <= 2
    worst = {}
    for r in found:
        worst[r.doc_id] = max(worst.get(r.doc_id, (0, -1)), (r.sentence_score, r.sentence_no))
    assert sum(worst[d][1] == test[d][3] for d in flagged & truth) >= 0.95 * len(truth)
    assert all(any(b in r.sentence for b in ("idiotic", "scumbag", "morons")) for r in found if (r.sentence_score, r.sentence_no) == worst[r.doc_id] and r.doc_id in truth)


def test_noisy_or_by_hand():
    weights = np.zeros(toxicity.BUCKETS, np.float32)
    bucket, _, _ = toxicity.sentence_words(pa.array(["bad"]))
    weights[bucket] = 3.0
    model = toxicity.Model(weights, -2.0)
    score, (doc, sentence, p) = model.documents(pa.array(["good. bad bad! good", "", None, "good"]))
    q = 1 / (1 + np.exp(2.0))
    assert sentence.tolist() == [0, 1, 2, 0] and p[1] == pytest.approx(1 / (1 + np.exp(-1.0)))
    assert score == pytest.approx([1 - (1 - p[1]) * (1 - q) ** 2, 0, 0, q])


def test_gradient_against_differences():
    """The gradient by small changes of each weight; steps along it make the loss smaller."""
    rng = np.random.default_rng(3)
    doc = np.repeat(np.arange(12), 4)  # four sentences a document
    label = (np.arange(12) % 3 == 0).astype(np.int64)
    bag = np.repeat(np.arange(48), 5)
    w_at = rng.integers(0, 9, 240)
    w, b = rng.uniform(0.1, 1, 9), -1.5
    weights = np.zeros(toxicity.BUCKETS)

    def loss(w, b):
        weights[:9] = w
        return toxicity.loss(toxicity.Model(weights, b), w_at, bag, doc, label, 0.01)

    got = toxicity.gradient(w, b, w_at, bag, doc, label, 0.01)
    for i in range(10):
        step = np.where(np.arange(9) == i, 1e-5, 0)
        more = 1e-5 if i == 9 else 0
        assert got[i] == pytest.approx((loss(w + step, b + more) - loss(w - step, b - more)) / 2e-5, abs=1e-6)
    fitted = [toxicity.fit(w_at, bag, doc, label, steps=n, penalty=0.01, least_docs=1) for n in (1, 10, 100)]
    losses = [toxicity.loss(m, w_at, bag, doc, label, 0.01) for m in fitted]
    assert losses[0] > losses[1] > losses[2]


def test_toxic_sentences_against_naive(spark, documents, small):
    """op5 over the whole table: every document, cut into sentences and words one by one."""
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.train(documents, labels)
    assert (toxicity.train(documents.repartition(5), labels).weights == model.weights).all()
    bucket = {}

    def weight(word):
        if word not in bucket:
            bucket[word] = toxicity.sentence_words(pa.array([word]))[0]
        return bucket[word]

    want = {}
    for r in documents.collect():
        scores = {}
        for k, sentence in enumerate(re.split(r"[.!?\n]", r.text or "")):
            words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", sentence.lower())
            if words:
                own = set(np.concatenate([weight(w) for w in words]).tolist())
                scores[k] = (1 / (1 + np.exp(-(model.bias + sum(float(model.weights[b]) for b in own)))), sentence.strip())
        score = 1 - np.prod([1 - p for p, _ in scores.values()])
        if score >= 0.6:
            least = min(0.3, max(p for p, _ in scores.values()))
            want |= {(r.doc_id, k): (score, p, t) for k, (p, t) in scores.items() if p >= least - 1e-12}
    got = {(r.doc_id, r.sentence_no): (r.doc_score, r.sentence_score, r.sentence) for r in queries.queries()["op5_toxicity"](spark, small).collect()}
    assert got.keys() == want.keys() and len(got) > 10
    assert all(got[k][2] == want[k][2] and got[k][:2] == pytest.approx(want[k][:2], abs=1e-6) for k in got)


def test_toxicity_odd(spark, odd, empty, documents, small):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.drop_toxic(odd, model).schema == odd.schema
    nothing = toxicity.train(odd, labels.where("doc_id = 5"))
    assert toxicity.offending_sentences(odd, nothing).count() == 0 and toxicity.drop_toxic(odd, nothing).count() == odd.count()
    assert toxicity.offending_sentences(empty, nothing).count() == 0 and toxicity.train(empty, labels).bias == -60.0
    named = documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text", F.lit("own").alias("sentence"), F.lit(1).alias("toxic"))
    other = spark.read.parquet(f"{small}/labels.parquet").withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    plain = toxicity.offending_sentences(documents, toxicity.train(documents, spark.read.parquet(f"{small}/labels.parquet")))
    assert toxicity.train(named.unionByName(named), other).weights.any() and {r.doc_id for r in toxicity.offending_sentences(named, toxicity.train(named, other)).collect()} >= {f"d{r.doc_id}" for r in plain.limit(3).collect()}


# 6. Mixing


def naive_mixture(rows, weights, budget):
    import hashlib

    out, by = [], defaultdict(list)
    for doc_id, text, source in rows:
        digest = hashlib.md5(f"{mixing.SEED}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
        by[source].append((int(digest[:15], 16), -1 if doc_id is None else doc_id, len((text or "").split())))
    total = {s: sum(x[2] for x in v) for s, v in by.items()}
    weight = {s: int(total[s] ** 0.5) if weights is None else round(weights.get(s, 0) * 10**6) for s in by}
    amount = sum(total.values()) if budget is None else budget
    for s, v in by.items():
        left = amount * weight[s] // sum(weight.values()) if sum(weight.values()) else 0
        epoch = 0
        while left > 0 and total[s] > 0:
            start = 0
            for key, doc, n in sorted(v):
                if start < min(left, total[s]) or left >= total[s]:
                    out.append((s, epoch, doc, n, min(n, left - start) if left < total[s] else n))
                start += n
            left -= total[s]
            epoch += 1
        if total[s] > 0 and left == 0:
            pass
    return sorted(out, key=repr)


@pytest.mark.parametrize("weights,budget", [(None, None), ({"s0": 3, "s1": 1}, 700), ({"s1": 1}, 5000)])
def test_mixture_against_naive(spark, weights, budget, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 7)
    rng = random.Random(8)
    rows = [(i if i % 17 else None if i == 17 else i, " ".join("w" * rng.randint(0, 20)), rng.choice(["s0", "s0", "s0", "s1", None])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs, weights, budget).collect()
    want = naive_mixture(rows, weights, budget)
    assert sorted(((r.source, r.epoch, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.taken_tokens) for r in got), key=repr) == want
    texts = mixing.mixture(docs, weights, budget, whole=True)
    assert texts.columns == docs.columns
    assert sum(len(r.text.split()) for r in texts.collect()) == sum(w[4] for w in want)


def test_mixture_cuts_keep_white_space(spark):
    docs = spark.createDataFrame([(1, "  a b\n\nc d", "x", 10)], "doc_id long, text string, source string, n_chars long")
    got = mixing.mixture(docs, {"x": 1}, 7, whole=True).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("  a b\n\nc", 8), ("  a b\n\nc d", 10)]


def test_mixture_odd(odd, empty):
    got = mixing.mixture(odd).collect()
    assert {r.source for r in got} == {None, "s0", "s1"}
    whole = mixing.mixture(odd, whole=True)
    assert whole.columns == odd.columns and whole.count() == len(got)
    assert mixing.mixture(empty).count() == 0 and mixing.mixture(empty, whole=True).count() == 0
    dotted = odd.withColumnRenamed("part", "a.b").withColumnRenamed("total", "tick`s").withColumn("_doc_0", F.lit(1))
    again = mixing.mixture(dotted, whole=True)
    assert again.columns == dotted.columns and again.count() == len(got) and quality.cleaned(dotted).columns == dotted.columns


# 7. HTML


def naive_best(source):
    """Scores by walking up from every paragraph of html.parser's own tree."""
    from html.parser import HTMLParser

    class Node:
        def __init__(self, tag, parent, weight):
            self.tag, self.parent, self.weight, self.text, self.link, self.kids, self.points, self.scored = tag, parent, weight, "", 0, [], 0.0, False

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.at = self.root = Node("#", None, 0)
            self.nodes = []

        def handle_starttag(self, tag, attrs):
            names = [v or "" for k, v in attrs if k in ("class", "id")]
            weight = html_extract.START.get(tag, 0) + sum(25.0 * bool(html_extract.GOOD.search(n)) - 25.0 * bool(html_extract.BAD.search(n)) for n in names)
            node = Node(tag, self.at, weight)
            self.at.kids.append(node)
            self.nodes.append(node)
            self.at = node

        def handle_endtag(self, tag):
            self.at = self.at.parent

        def handle_data(self, data):
            self.at.kids.append(data)

    reader = Reader()
    reader.feed(source)

    def size(n):
        return sum(len(" ".join(k.split())) if isinstance(k, str) else size(k) for k in n.kids)

    def links(n):
        return size(n) if n.tag == "a" else sum(links(k) for k in n.kids if not isinstance(k, str))

    def own(n):
        return "".join(k if isinstance(k, str) else own(k) if k.tag not in html_extract.BLOCKS else "" for k in n.kids)

    for n in reader.nodes:
        text = " ".join(own(n).split())
        if n.tag == "p" and len(text) >= html_extract.LEAST:
            points = 1 + text.count(",") + min(len(text) / 100, 3)
            up = n.parent
            for share in (1, 2, 6, 8):
                if up is None or up.parent is None:
                    break
                if not up.scored:
                    up.scored, up.points = True, up.weight
                up.points += points / share
                up = up.parent
    for n in reader.nodes:
        n.points *= 1 - links(n) / size(n) if size(n) else 1
    scored = [(n.points, -k, n) for k, n in enumerate(reader.nodes) if n.scored and size(n)]
    if not scored:
        return 0.0, "", None
    most, _, best = max(scored)

    def text(n):
        """With a line break before and after every block."""
        if n is not best and n.weight <= -15:
            return ""
        inner = "".join(k if isinstance(k, str) else text(k) for k in n.kids)
        return f"\n{inner}\n" if n.tag in html_extract.BLOCKS else inner

    kept = []
    for n in best.parent.kids:
        if isinstance(n, str):
            continue
        take = n is best or (n.scored and n.points >= max(10.0, most * 0.2))
        if n.tag == "p" and not take:
            plain, dense = " ".join(own(n).split()), links(n) / size(n) if size(n) else 1.0
            take = dense < 0.25 if len(plain) > 80 else bool(plain) and dense == 0 and any(plain.endswith(x) or x + " " in plain for x in ".!?。")
        if take:
            kept += [" ".join(x.split()) for x in text(n).split("\n") if x.strip()]
    return most, best.tag, "\n".join(kept)


def test_html_scores_against_naive():
    rng = random.Random(5)

    def paragraph():
        words = [rng.choice(["alpha", "beta,", "gamma", "delta", "<a href='x'>link words</a>"]) for _ in range(rng.randint(1, 40))]
        return f"<p>{' '.join(words)}</p>"

    def block(depth):
        tag = rng.choice(["div", "section", "article"])
        name = rng.choice(["", " class='sidebar'", " id='story'", " class=\"x\""])
        inner = "".join(block(depth - 1) if depth and rng.random() < 0.5 else paragraph() for _ in range(rng.randint(1, 4)))
        return f"<{tag}{name}>{inner}<p>end of block{rng.choice(['', '.', ', or not', ' <i>in</i> <b>parts</b>! More'])}</p></{tag}>"

    dropped = siblings = 0
    for _ in range(300):
        source = f"<html><body>{block(3)}{block(2)}{paragraph()}{block(1)}</body></html>"
        points, tag, text = naive_best(source)
        _, got_text, got, container = html_extract.extract(source)
        assert got == pytest.approx(points) and container == tag and (text is None or got_text == text)
        dropped += "sidebar" in source
        siblings += text is not None and len(html_extract._lines(html_extract.tree(source)[0], frozenset())) > text.count("\n") + 1
    assert dropped and siblings


def test_html_by_hand():
    page = "<html><head><title>A &amp; B</title><script>var x='<p>no</p>'</script></head><body><nav><a href=/>Home, sweet</a></nav><div id=main><h1>T</h1><p>First paragraph, with commas, and enough words to count.<p>Second<br>line, also of some length, &eacute;<!-- gone --></div><footer>Foot, note, text that is long enough to count</footer>"
    title, text, points, tag = html_extract.extract(page)
    assert title == "A & B" and tag == "div" and "Home" not in text and "Foot" not in text
    assert text.split("\n") == ["T", "First paragraph, with commas, and enough words to count.", "Second", "line, also of some length, é"]
    for broken in ("", "<", "<p", "</p>", "<p>x", "<table><tr><td>a<td>b", "<!--", "<![CDATA[x", "plain", "<script>", "<p" * 500, "<div>" * 3000 + "deep"):
        html_extract.extract(broken)


BROKEN = {"<a ": "<a ", "unclosed quotes": '<a b="x ', "no end in sight": "<a '>' ", "open inline tags and blocks": "<i><h1>", "open items": "<ul><li>", "open cells": "<table><tr><td>", "end tags of nothing": "<i></b>", "ids": '<p id="', "signs": "<"}


@pytest.mark.parametrize("name", BROKEN)
def test_html_is_linear_on_broken_pages(name):
    import time

    took = []
    for size in (100_000, 800_000):
        source = BROKEN[name] * (size // len(BROKEN[name]))
        began = time.perf_counter()
        html_extract.extract(source)
        took.append(time.perf_counter() - began)
    assert took[1] < 15 and took[1] < 24 * max(took[0], 0.02)  # eight times the page


def test_html_tags_by_hand():
    text = lambda x: html_extract.extract(x)[1]
    assert text('<p a=">" b=\'"\'>one</p> 1 < 2 <b>two') == "one\n1 < 2 two"
    assert text("<p <b>bold</b> rest") == "bold rest" and text('<p title="no end>one <p>two') == "one\ntwo"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == "a\nb\nc\nd\ne"
    assert text("x <a") == "x" and text("<div><p>a</div>b</p>c") == "a\nbc"


def test_html_odd(spark):
    rows = spark.createDataFrame([(1, None, "x"), (None, "<p>" + "long text, " * 20000, "x"), (2, "", "x"), (2, "", "x")], "page_id long, html string, title string")
    got = html_extract.extracted(rows).collect()
    assert len(got) == 4 and [r.text for r in got if r.page_id == 1] == [None] and len([r for r in got if r.page_id is None][0].text) > 200000
    assert html_extract.extracted(rows.limit(0)).count() == 0
    clash = rows.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("page_id"), "html", *[F.lit(1).alias(c) for c in ("text", "points", "container", "title")])
    assert {r.page_id for r in html_extract.extracted(clash).collect()} == {"p1", "p2", None}


def test_html_finds_articles(spark, small):
    for r in html_extract.extracted(spark.read.parquet(f"{small}/pages.parquet")).collect():
        assert "var t=" not in (r.text or "") and "©" not in (r.text or "")


# 8. Quality


def test_quality_rules():
    cases = {"home | about | contact | help": "navigation", "A$$$ B### C%%% D&&&": "symbols", "BUY NOW!! CHEAP!!": "shouting", "Next": "no_sentence", "We use cookies to help you.": "boilerplate", "foo " * 20 + "foo.": "same_words"}
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    cases |= {"Alle Rechte vorbehalten.": "boilerplate", "Cliquez ici pour lire la suite.": "boilerplate", "Política de privacidad, en esta página.": "boilerplate"}
    rows = spark.createDataFrame([(k,) for k in [*cases, "An ordinary sentence, of words."]], "x string")
    got = {r.x: {k for k, v in r.asDict().items() if v is True} for r in rows.select("x", *[c.alias(n) for n, c in quality.line_fails(F.trim("x")).items()]).collect()}
    for line, rule in cases.items():
        assert rule in got[line], line
    assert got["An ordinary sentence, of words."] == set()


def test_quality_odd(odd, empty):
    kept = quality.cleaned(odd)
    assert kept.schema.names == odd.schema.names
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "5", "6", "8", "None"]
    assert quality.cleaned(empty).count() == 0 and quality.report(empty).count() == 0


# 9. SentencePiece


def test_codec_is_the_library(documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp_codec.MODEL)
    own = sp_codec.Codec(sp_codec.MODEL)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdeth \n.é中😀▁\t") for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", " ", "\n", "aaaaaaaaaaaa", LONG[:3000]]
    texts += [r.text for r in documents.limit(60).collect()]
    ids, count = own.encode(pa.array(texts))
    want = [lib.encode(t) for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == want
    assert own.decode(ids, count).to_pylist() == [lib.decode(w) for w in want]
    for word in {w for t in texts for w in t.split()}:
        plain = sp_codec.BLANK + word.replace(sp_codec.BLANK, "")
        got, _ = own.encode_word(plain)
        assert [own.pieces[i] for i in got if i in own.ids.values()] == [p for p in own.merges(plain) if p in own.ids]


def test_codec_odd(odd, empty):
    got = {(r.doc_id, r.n_ids): r for r in sp_codec.encode(odd).collect()}
    assert got[2, 0].ids is None and got[3, 0].ids == [] and got[8, max(n for d, n in got if d == 8)].round_trip is False
    assert all(r.round_trip for k, r in got.items() if k[0] not in (2, 8) and r.ids is not None)
    back = {r.doc_id: r.decoded for r in sp_codec.decode(sp_codec.encode(odd)).collect() if r.doc_id}
    assert back[5] == LONG and back[2] is None and back[3] == ""
    clash = sp_codec.decode(sp_codec.encode(odd).withColumn("decoded", F.lit("own")))
    assert clash.columns == ["doc_id", "n_ids", "ids", "round_trip", "decoded", "_decoded"] and {r._decoded for r in clash.collect() if r.doc_id == 5} == {LONG} and {r.decoded for r in clash.collect()} == {"own"}
    assert sp_codec.encode(empty).count() == 0


# 10. Media


def test_media_round_trip(spark, tmp_path):
    rows = [("a", media.png(b"hello" * 50)), ("b", media.png(b"hello" * 50)), ("c", media.wav(np.linspace(-1, 1, 800))), ("d", b""), ("e", None), (None, b"GIF89a\x05\x00\x04\x00"), ("f", b"BM" + bytes(16) + (7).to_bytes(4, "little") + (9).to_bytes(4, "little") + b"\1\0\x18\0"), ("g", b"\xff" * 100_000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "media_id string, payload binary, digest string")
    folder = f"file://{tmp_path}/shards"
    got = media.media_table(table, folder, Scratch(spark))
    by = {r.media_id: r for r in got.collect()}
    assert (by["a"].shard, by["a"].offset) == (by["b"].shard, by["b"].offset) and by["a"].kind == "image/png" and (by["a"].width, by["a"].height) == (64, 4)
    assert by["c"].duration_ms == 100 and by["c"].rate == 8000 and by["d"].length == 0 and by["e"].shard is None
    assert (by[None].width, by[None].height) == (5, 4) and (by["f"].height, by["f"].bits) == (9, 24) and by["g"].kind == "application/octet-stream"
    assert {r.media_id: None if r.payload is None else bytes(r.payload) for r in media.read_payloads(got).collect()} == dict(rows)
    members = [m for f in (tmp_path / "shards").iterdir() for m in media.tar_members(f.read_bytes()).items()]
    import hashlib

    whole = {data for name, data in members if not name.startswith("bundle/")}
    small = b"".join(data for name, data in members if name.startswith("bundle/"))
    distinct = {p for _, p in rows if p is not None}
    assert whole == {p for p in distinct if len(p) >= 512} and len(small) == sum(len(p) for p in distinct if len(p) < 512)
    assert all(name.split("/")[1] == hashlib.sha256(data).hexdigest() for name, data in members if not name.startswith("bundle/"))
    assert media.media_table(table.limit(0), f"{folder}2", Scratch(spark)).count() == 0


def test_media_against_naive(spark, small):
    """op10 over the whole tables: digest, place and metadata of every picture and sound, drawn here anew."""
    import hashlib

    pages, vectors = spark.read.parquet(f"{small}/pages.parquet").collect(), spark.read.parquet(f"{small}/embeddings.parquet").collect()
    want = {f"page:{r.page_id}": media.png(r.html.encode()) for r in pages} | {f"vector:{r.vec_id}": media.wav(np.array(r.embedding, np.float64)) for r in vectors}
    got = queries.queries()["op10_media"](spark, small)
    payloads = {r.media_id: bytes(r.payload) for r in media.read_payloads(got).collect()}
    assert payloads == want
    places = {}
    for r in got.collect():
        p = want[r.media_id]
        assert r.digest == hashlib.sha256(p).hexdigest() and r.length == len(p) and places.setdefault(r.digest, (r.shard, r.offset)) == (r.shard, r.offset)
        if r.media_id.startswith("page"):
            assert (r.kind, r.width, r.height, r.bits, r.channels) == ("image/png", int.from_bytes(p[16:20], "big"), int.from_bytes(p[20:24], "big"), 8, 1)
        else:
            assert (r.kind, r.rate, r.channels, r.bits, r.duration_ms) == ("audio/wav", 8000, 1, 16, round(1000 * (len(p) - 44) / 16000))
    assert len(set(places.values())) == len(places) == len(set(want.values()))


def test_media_odd(spark, tmp_path):
    """Repeated rows, long payloads, names that helpers have, given folders."""
    long = bytes(range(256)) * 20_000
    rows = [("x", long)] * 3 + [("y", long), ("x", b""), (None, None), ("z", b"s"), ("z", b"s")]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "media_id string, payload binary, shard int, offset int, shared int")
    got = media.media_table(table, f"file://{tmp_path}/m", Scratch(spark))
    back = [(r.media_id, None if r.payload is None else bytes(r.payload)) for r in media.read_payloads(got).collect()]
    assert sorted(back, key=repr) == sorted(rows, key=repr) and {r.shard.rpartition("/")[0] for r in got.collect() if r.shard} == {f"file://{tmp_path}/m"}
    assert sum(f.stat().st_size for f in (tmp_path / "m").iterdir()) < 2 * len(long)
    none = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string"), spark.createDataFrame([(1, None), (None, [0.5, None])], "vec_id long, embedding array<float>")
    assert {(r.media_id, r.kind) for r in media.media_columns(spark, *none, f"file://{tmp_path}/n").collect()} == {("page:1", None), ("vector:1", None), ("vector:null", "audio/wav")}


# Pipeline


def test_pipeline_against_brute_force(spark, duck, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [s[0] for s in corpus_pipeline.STAGES][-1].startswith("SentencePiece") and len(corpus_pipeline.STAGES) == 5
    got = corpus_pipeline.run(spark, small).collect()
    docs = duck.sql(f"select doc_id, array_to_string(_kept, chr(10)) as text, source from ({quality.sql()}) order by doc_id").fetchall()
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    model = toxicity.train(frame, spark.read.parquet(f"{small}/labels.parquet"))
    score, _ = model.documents(pa.array([d[1] for d in docs]))
    docs = [d for d, s in zip(docs, score) if s < 0.6]
    root = list(range(len(docs)))
    for a, b in sorted(similar_pairs([d[1] for d in docs], 0.5)):
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    docs = [d for i, d in enumerate(docs) if root[i] == i]
    want = defaultdict(int)
    for _, _, doc_id, _, taken in naive_mixture(docs, None, None):
        want[doc_id] += taken
    text = {d[0]: d[1] for d in docs}
    assert {r.doc_id for r in got} == {d for d in want}
    own = sp_codec.Codec(sp_codec.MODEL)
    decoded = defaultdict(int)
    for r in got:
        back = own.decode(np.array(r.ids, np.int32), np.array([len(r.ids)]))[0].as_py()
        assert r.round_trip and text[r.doc_id].startswith(back)
        decoded[r.doc_id] += len(back.split())
    assert decoded == want


def test_pipeline_stages_on_odd_tables(spark, odd, empty, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (odd, empty):
        docs = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = Scratch(spark).write(stage(spark, docs, str(tmp_path)))
            if k < 4:
                assert docs.columns == table.columns
        assert docs.count() >= 0
