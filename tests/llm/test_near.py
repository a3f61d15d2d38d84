"""Operators 4, 5, 7 and 9 against brute force."""

import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import decontaminate, jaccard, line_dedup, vectors
from reviewlens.llm.common import components

SCHEMA = "doc_id long, text string"


def _docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("clash")).withColumn("w", F.lit(0.5))


def _roots(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {x for e in edges for x in e}
    assert {r.node: r.component for r in found} == _roots(nodes, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _near_texts(seed=4):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    out, common = [], " ".join(rng.choice(words, 60))
    for group in range(25):
        base = list(rng.choice(words, rng.integers(6, 120)))
        for _ in range(rng.integers(1, 5)):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(len(copy))] = str(rng.choice(words))
            text = " ".join(copy)
            out.append(text if group % 3 else text + " " + common)
    return out


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_similar_documents(spark):
    texts = [*_near_texts(), None, "", " \n", "one two", "ONE two", "one two three", "É x", "é x", "a" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])]
    sets = {i: _shingles(t) for i, t in enumerate(texts)}
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    roots = _roots(sets, links)
    found = jaccard.similar_documents(_docs(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, found)) == sorted((i, len(sets[i]), roots[i]) for i, _ in rows)
    assert len(links) > 20


@pytest.mark.parametrize("bits", [15, 27])
def test_full_bitmaps_lose_nothing(spark, bits):
    docs = _docs(spark, list(enumerate(_near_texts(6))))
    found = {tuple(r) for r in jaccard.similar_documents(docs, bits=bits).collect()}
    sets = {i: _shingles(t) for i, t in enumerate(_near_texts(6))}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = _roots(sets, links)
    assert found == {(i, len(sets[i]), roots[i]) for i in sets}


@pytest.mark.parametrize("cell_bytes", [jaccard.CELL_BYTES, 2000])
def test_growing_texts_link_across_bands(spark, monkeypatch, cell_bytes):
    monkeypatch.setattr(jaccard, "CELL_BYTES", cell_bytes)
    rng = np.random.default_rng(12)
    texts = []
    for family in range(40):
        words, n = [f"f{family}w{i}" for i in range(400)], int(rng.integers(20, 60))
        for _ in range(rng.integers(3, 7)):
            texts.append(" ".join(words[:n]))
            n = int((n - 4) * rng.uniform(1.12, 1.25)) + 4
    rows = list(enumerate(texts))
    sets = {i: _shingles(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = _roots(sets, links)
    found = {r.doc_id: r.component_id for r in jaccard.similar_documents(_docs(spark, rows)).collect()}
    assert found == roots


def test_prefixes_of_linked_sets_share_a_signature():
    rng = np.random.default_rng(9)
    for _ in range(2000):
        universe = jaccard.mix(np.arange(1, 200, dtype="uint64") + np.uint64(rng.integers(1 << 40)))
        often = set(rng.choice(universe, rng.integers(0, 199), replace=False).tolist())
        n = int(rng.integers(4, 60))
        x = rng.choice(universe, n, replace=False)
        drop = int(rng.integers(0, n // 5 + 1))
        y = np.concatenate([x[drop:], rng.choice(np.setdiff1d(universe, x), int(rng.integers(0, n // 5 + 1)), replace=False)])
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            s, t = (jaccard.prefix_signatures(z, np.array([v in often for v in z.tolist()])) for z in (x, y))
            assert len(np.intersect1d(s, t))


def test_copies_add_no_signatures(spark, monkeypatch):
    rng = np.random.default_rng(21)
    texts = [" ".join(f"t{i}x{w}" for w in rng.integers(0, 10**6, 40)) for i in range(30)]
    rows = [(100 * copy + i, text.upper() if copy == 2 else text) for copy in range(4) for i, text in enumerate(texts)]
    stored, write = {}, jaccard.materialize

    def noted(df, name):
        out = write(df, name)
        stored.setdefault(name, out)
        return out

    monkeypatch.setattr(jaccard, "materialize", noted)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4, "doc_id")
    found = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs).collect()}
    assert found == {i: i % 100 for i, _ in rows}
    assert stored["signatures"].count() == 0


def test_bitmaps_fit_their_keys(spark, monkeypatch):
    sizes, whole = [], jaccard.Bitmap.__init__

    def seen(self, pieces, bits):
        whole(self, pieces, bits)
        sizes.append(self.shared.value.nbytes)

    monkeypatch.setattr(jaccard.Bitmap, "__init__", seen)
    texts = [" ".join(f"w{i % 7}x{j}" for j in range(40)) for i in range(14)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs).collect()}
    assert found == {i: i % 7 for i in range(14)}
    assert len(sizes) == 4 and max(sizes) <= 1 << 14  # 14 * 36 shingles, 64 to 128 bits for each; they were of 16 MB


def test_open_signatures_and_their_graph(spark):
    rng = np.random.default_rng(22)
    band, component = rng.integers(0, 7, 60).tolist(), rng.integers(0, 4, 60).tolist()
    shared = sorted({(int(rng.integers(0, 25)), int(rng.integers(0, 60))) for _ in range(110)})
    named = spark.createDataFrame([(s, x, band[x], component[x]) for s, x in shared], "sig long, node long, band int, component long")
    pairs = [
        (s, x, y) for (s, x), (t, y) in combinations(shared, 2)
        if s == t and abs(band[x] - band[y]) <= 1 and component[x] != component[y]
    ]
    left, graph = jaccard._open(named)
    met = {(s, z) for s, x, y in pairs for z in (x, y)}
    assert len(pairs) > 40
    assert met <= {(r.sig, r.node) for r in left.collect()} <= set(shared)
    top = {r.node: r.component for r in graph.collect()}
    assert all(top[x] == top[y] for _, x, y in pairs)


def test_similar_documents_of_an_empty_table(spark):
    assert jaccard.similar_documents(_docs(spark, [])).collect() == []


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _cut(rows):
    seen, out = [], []
    for _, text in rows:
        kept = []
        for line in text.split("\n"):
            w = line.lower().split()
            near = [v for v in seen if v == w or min(len(v), len(w)) >= 10 and abs(len(v) - len(w)) < 2 and _edit(v, w) < 2]
            if len(w) < 5 or not near:
                kept.append(line)
            if len(w) >= 5:
                seen.append(w)
        out.append("\n".join(kept))
    return out


def test_line_dedup(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    bases = [list(rng.choice(words, rng.integers(2, 16))) for _ in range(25)]
    rows = []
    for doc in range(120):
        lines = []
        for _ in range(rng.integers(0, 6)):
            line = list(bases[rng.integers(len(bases))])
            kind = rng.integers(5)
            at = rng.integers(len(line))
            if kind == 1:
                line[at] = str(rng.choice(words))
            elif kind == 2:
                del line[at]
            elif kind == 3:
                line.insert(at, str(rng.choice(words)))
            lines.append(" ".join(line).upper() if kind == 4 else " ".join(line))
        rows.append((doc, "\n".join(lines)))
    found = line_dedup.dedup_lines(_docs(spark, rows).repartition(4)).orderBy("doc_id").collect()
    assert [r.text for r in found] == _cut(rows)
    assert sum(r.n_removed for r in found) > 50


def test_line_dedup_makes_words_and_variants_once(spark, monkeypatch):
    plans, write = {}, line_dedup.materialize

    def noted(df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(line_dedup, "materialize", noted)
    words = "one two three four five six seven eight nine ten eleven twelve"
    found = line_dedup.dedup_lines(_docs(spark, [(1, words), (2, words.replace("six", "6")), (3, words + " more")])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == [(1, 0), (2, 1), (3, 1)]
    assert plans["line-keys"].count("split(lower(") == 1
    assert [sum("Window [" in line for line in plan.splitlines()) for name, plan in plans.items() if "variants" in name] == [1, 0, 0]
    assert "unboundedfollowing" not in "".join(plans.values()).lower()


def test_line_dedup_of_nulls_repeats_and_long_lines(spark):
    long = " ".join(f"x{i}" for i in range(6000))
    rows = [(1, None), (2, ""), (None, "a b c d e"), (3, "a b c d e\nf"), (3, "a b c d e\nf"), (4, long), (5, long + " y")]
    found = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(_docs(spark, rows)).collect()}
    assert found == {
        (1, None, 0, 0), (2, "", 1, 0), (None, "a b c d e", 1, 0), (3, "f", 2, 1), (4, long, 1, 0), (5, "", 1, 1),
    }
    assert line_dedup.dedup_lines(_docs(spark, [])).collect() == []


def test_line_dedup_of_short_lines_and_scripts_without_spaces(spark):
    chinese, thai = "这是一个没有空格的很长的句子它在许多文件中重复出现而且应该被删除", "นี่คือประโยคยาวที่ไม่มีช่องว่างและปรากฏซ้ำในหลายเอกสาร"
    rows = [
        (1, f"{chinese}\n{thai}\nCopyright 2020 Acme\nyes\nno no"),
        (2, f"{chinese}\nCopyright  2020 ACME\nyes\nno no"),
        (3, f"{chinese[:9]}新{chinese[10:]}\n{thai}\nown line"),  # one character of a long line differs
    ]
    found = line_dedup.dedup_lines(_docs(spark, rows)).orderBy("doc_id").collect()
    assert [r.text for r in found] == [rows[0][1], "yes\nno no", "own line"]


def test_near_vectors(spark):
    rng = np.random.default_rng(8)
    rows, at = [], 0
    for _ in range(60):
        center = rng.standard_normal(32)
        for _ in range(rng.integers(1, 12)):
            rows.append((at, (center + 0.08 * rng.standard_normal(32)).astype("float32").tolist()))
            at += 1
    rows += [(at, rows[0][1]), (at + 1, rows[0][1])]
    odd = [None, [], [0.0] * 32, [1.0, None] * 16, [float("nan")] * 32, [float("inf")] * 32, [1.0, 2.0]]
    rows += [(at + 2 + i, v) for i, v in enumerate(odd)]
    good = {i: np.array(v, dtype="float64") for i, v in rows[: at + 2]}
    links = [
        (a, b) for a, b in combinations(good, 2)
        if good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9
    ]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("clash"))
    found = vectors.near_vectors(vecs.repartition(3)).collect()
    n_links = {i: 0 for i, _ in rows}
    for a, b in links:
        n_links[a] += 1
        n_links[b] += 1
    assert sum(r.n_links for r in found) >= 0.97 * 2 * len(links)
    assert all(r.n_links <= n_links[r.vec_id] for r in found)
    roots = _roots([i for i, _ in rows], links)
    assert sum(r.component_id == roots[r.vec_id] for r in found) >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert vectors.near_vectors(vecs.limit(0)).collect() == []


def test_near_vectors_of_a_dense_cluster_all_link(spark):
    rng = np.random.default_rng(10)
    center = rng.standard_normal(32)
    cluster = center + 0.1 * rng.standard_normal((6000, 32))
    beside = center + 0.35 * rng.standard_normal((300, 32))
    x = np.concatenate([cluster, beside, rng.standard_normal((2000, 32))]).astype("float32")
    units = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    true = np.concatenate([(units[i : i + 1000] @ units.T >= 0.9).sum(axis=1) - 1 for i in range(0, len(x), 1000)])
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {r.vec_id: r for r in vectors.near_vectors(vecs.repartition(3)).collect()}
    links = np.array([found[i].n_links for i in range(len(x))])
    assert true[:6000].min() > 2 * vectors.WINDOW * vectors.PASSES
    print("recall", links.sum() / true.sum(), links[6000:6300].sum() / true[6000:6300].sum(), links[6300:].sum(), true[6300:].sum())
    assert (links <= true).all() and links[:6000].sum() >= 0.999 * true[:6000].sum()
    assert links[6000:6300].sum() >= 0.97 * true[6000:6300].sum()
    assert {found[i].component_id for i in range(6000)} == {0}


def test_passes_follow_from_the_number_of_vectors():
    p = 1 - np.arccos(0.9) / np.pi
    for n in (0, 1, 64, 10**4, 10**6, 10**7, 10**8, 10**10):
        bits, passes = vectors._plan(n, 0.9, vectors.PASSES, vectors.WINDOW)
        assert passes >= vectors.PASSES and n <= vectors.WINDOW << bits
        assert 1 - (1 - p**bits) ** passes >= vectors.RECALL


def _words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_contamination(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(25)] + ["É", "ß9", "zü"]
    items = [(i, " ".join(rng.choice(words, n))) for i, n in enumerate([1, 2, 3, 5, 8, 12, 13, 14, 30, 40, 0])]
    items += [(8, "w1 w2 w3 other text"), (None, " ".join(["null"] * 15)), (77, None)]
    docs = []
    for d in range(60):
        parts = list(rng.choice(words, rng.integers(0, 60)))
        w = _words(items[rng.integers(4, 10)][1])
        k = rng.integers(0, max(1, len(w) - 12))
        at = rng.integers(len(parts) + 1)
        docs.append((d, " ".join([*parts[:at], *w[k : k + int(rng.integers(10, 20))], *parts[at:]]).upper() + "!"))
    docs += [(60, None), (61, ""), (62, "null " * 20), (5, docs[5][1]), (63, docs[5][1])]
    wanted = []
    for d, text in docs:
        w, hit, ids = _words(text), set(), set()
        for i, item in items:
            x = _words(item)
            n = min(13, len(x))
            windows = {tuple(x[s : s + n]) for s in range(len(x) - n + 1)} if n else set()
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    ids |= {str(i)} - {"None"}
        wanted.append((d, len(w), len(hit), ",".join(sorted(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("fp", F.lit("clash"))
    found = decontaminate.contamination(_docs(spark, docs).repartition(3), bench).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in found) == sorted(wanted)
    monkeypatch.setattr(decontaminate, "small", lambda stored: stored)  # as with more windows than are broadcast
    shuffled = decontaminate.contamination(_docs(spark, docs).repartition(3), bench).collect()
    assert sorted(shuffled, key=str) == sorted(found, key=str)
    none = decontaminate.contamination(_docs(spark, docs), bench.limit(0)).collect()
    assert not any(r.contaminated or r.n_hit for r in none)
    assert decontaminate.contamination(_docs(spark, []), bench).collect() == []
