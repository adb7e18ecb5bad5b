"""Toxicity, whitening and conversation trie against brute force, with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from kindred.llm import toxicity, trie, whitening

# ---------------------------------------------------------------- conversation trie

TURNS = "conv_id long, turn long, role string, text string, conv_id_ string"


def rebuilt(rows):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            by[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return out


def brute_trie(rows):
    convs = rebuilt(rows)
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, inside in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(inside) - 1) * len(path[-1][1].encode()) if path else 0
    out = []
    for path, inside in members.items():
        ends = ",".join(str(c) for c in sorted(inside) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((
            min(inside), len(path), parent, len(inside), len(children.get(path, ())), leaves[path], saved[path],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 120), *range(-12, 0), 10**12, 10**12 + 3]:
        if c % 7 == 5:
            continue  # absent, also as a base
        for turn in range(rng.randint(1, 12)):
            text = rng.choice(["a", "b", "é" * 3, "", None]) if turn < 6 else f"own {c} {turn}"
            rows.append((c, turn, rng.choice(["user", "assistant", None]), text, "x"))
    rows += [(200, None, "user", "null first", "x"), (200, 1, "user", "late", "x"), (200, 1, "user", "late", "x"), (None, 0, "user", "nobody", "x")]
    for c in range(300, 420):  # a large group of copies
        rows += [(c, t, "user", "same", None) for t in range(12)]
    rows += [(500, t, "user", "long " * (t % 3), None) for t in range(700)]  # long, and its own from the first turns on
    return rows


@pytest.mark.parametrize("few", [40, 10**6])
def test_trie(spark, monkeypatch, few):
    """Many shards and one shard give the nodes of a plain dictionary of prefixes."""
    monkeypatch.setattr(trie, "FEW_TURNS", few)
    monkeypatch.setattr(trie, "TURNS", few)
    rows = conversations()
    got = trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    none = [(None, 1, "user", "x", None)]
    assert trie.prefix_trie(spark.createDataFrame(none, TURNS)).count() == 0


def test_trie_sql():
    con = duckdb.connect()
    rows = [r[:4] for r in conversations() if r[0] != 200]
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(trie.OP13_SQL).fetchall(), key=str) == brute_trie(rows)


def test_medians_visit_all_and_balance():
    for n in (0, 1, 2, 7, 100):
        assert sorted(trie.medians(n)) == list(range(n))
    tree = trie.TernaryTree()
    for i in trie.medians(1023):
        tree.insert([i])
    height = [0] * len(tree.code)
    for v in range(1, len(tree.code)):
        for u in (tree.low[v], tree.high[v]):
            if u > 0:
                height[u] = height[v] + 1
    assert max(height) == 9


# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<float>, n long"


def check_whitened(rows, vectors):
    """Rows of one length of vectors against numpy; signs are free, equal rows have equal results."""
    x = np.floor(1024 * np.array([v for _, v in vectors], np.float32).astype(float)).astype(object) + 100000
    n, total = len(x), x.sum(axis=0)
    z = n * x - total
    v = (z.T @ z / n**3).astype(float)
    e = np.linalg.eigvalsh(v)[::-1]
    by = defaultdict(list)
    for r in rows:
        by[r.component].append(r)
    for k, part in sorted(by.items()):
        assert len(part) == n
        assert sorted((str(r.vec_id), r.deviation) for r in part) == sorted((str(i), int((row**2).sum())) for (i, _), row in zip(vectors, z))
        assert all(r.n == n and abs(r.explained - e[k - 1] / e.sum()) < 1e-6 * r.explained and r.identity_error < 1e-9 for r in part)
    w = {}
    for r in rows:
        w.setdefault((str(r.vec_id), r.deviation), {})[r.component] = r.whitened
    table = np.array([[w[str(i), int((row**2).sum())][k] for k in sorted(by)] for (i, _), row in zip(vectors, z)])
    assert np.abs(table.T @ table / n - np.eye(len(by))).max() < 1e-9
    basis = (z / n).astype(float).T @ table / n / np.sqrt(e[: len(by)])  # V v / e = v
    assert np.abs(v @ basis - basis * e[: len(by)]).max() < 1e-7 * e[0]


def test_whitening(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 0.3, (60, 5)) * [1, 0.9, 0.5, 0.4, 0.2]
    good = [(i, v.tolist()) for i, v in enumerate(base)] + [(3, base[3].tolist()), (None, base[4].tolist()), (9, base[0].tolist())]
    short = [(100 + i, v.tolist()) for i, v in enumerate(rng.normal(0, 2, (9, 2)))]
    bad = [(70, None), (71, []), (72, [1.0, None, 0.0, 0.0, 0.0]), (73, [float("nan")] * 5), (74, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    lone = [(80, [1.0, 2.0, 3.0])]  # nothing to whiten
    rows = [(i, v, 7) for i, v in good + short + bad + lone]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    assert len(got) == 5 * len(good) + 2 * len(short)
    check_whitened([r for r in got if r.n == len(good)], good)
    check_whitened([r for r in got if r.n == len(short)], short)
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_whitening_repeated_eigenvalues_and_rank(spark):
    """Corners of a cube: all eigenvalues equal; a flat set: fewer components than dimensions."""
    cube = [(i, [float(i >> k & 1) for k in range(4)]) for i in range(16)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in cube], VECTORS)).collect()
    assert len(got) == 16 * 4
    check_whitened(got, cube)
    flat = [(i, [float(i), float(-i), 0.5 * i * i, 1.0]) for i in range(12)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in flat], VECTORS)).collect()
    assert sorted({r.component for r in got}) == [1, 2]
    check_whitened(got, flat)


def test_characteristic_polynomial_and_roots(spark):
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 9):
        a = rng.integers(-9, 10, (d, d)).astype(object)
        m = (a @ a.T * 10**9).tolist()
        poly = whitening.characteristic(spark, m)
        assert poly[-1] == 1 and poly[-2] == -sum(m[i][i] for i in range(d))
        for t in (0, 3, -(10**10)):  # det(t - m) by fraction-free elimination
            assert sum(c * t**i for i, c in enumerate(poly)) == bareiss([[(t if i == j else 0) - m[i][j] for j in range(d)] for i in range(d)])
        roots = [num / 2**shift if shift >= 0 else num * 2**-shift for num, shift, times in whitening.largest_roots(poly, d) for _ in range(times)]
        want = np.linalg.eigvalsh(np.array(m, float))[::-1]
        assert np.allclose(roots, want[: len(roots)], rtol=1e-9, atol=want[0] * 1e-12)
    assert whitening.largest_roots([0, 0, 1], 3) == []


def bareiss(m):
    m, sign, before = [row[:] for row in m], 1, 1
    n = len(m)
    for k in range(n - 1):
        if m[k][k] == 0:
            swap = next((i for i in range(k + 1, n) if m[i][k]), None)
            if swap is None:
                return 0
            m[k], m[swap], sign = m[swap], m[k], -sign
        for i in range(k + 1, n):
            for j in range(k + 1, n):
                m[i][j] = (m[i][j] * m[k][k] - m[i][k] * m[k][j]) // before
        before = m[k][k]
    return sign * m[-1][-1]


def test_scatter_is_exact_for_large_entries(spark):
    rows = [(i, [float(x) * 2**40 + i for x in (i, 3 - i, 7)], 0) for i in range(5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long")
    n, s, m = whitening.scatter(vectors)[3]
    y = [[int(1024 * c) for c in v] for _, v, _ in rows]
    assert (n, s) == (5, [sum(c) for c in zip(*y)])
    assert m == [[5 * sum(r[i] * r[j] for r in y) - s[i] * s[j] for j in range(3)] for i in range(3)]


# ---------------------------------------------------------------- toxicity


def toxic_corpus():
    """Texts of common words; a toxic one holds insults, or words with a beginning of its own."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioutnsr") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        kind = rng.random()
        if kind < 0.08:
            text[rng.randrange(len(text))] = rng.choice(["idiot", "scum", "worthless", "clown"])
        elif kind < 0.16:
            text[rng.randrange(len(text))] = "zorg" + rng.choice(words)
        docs.append((i, " ".join(text), "a", 5))
        if i % 3:
            labels.append((i, 1, int(kind < 0.16)))
    docs += [(None, "you idiot", "b", 5), (2000, None, "a", 5), (2001, "", "a", 5), (2002, "x" * 200_000, "a", 5), (7, docs[7][1], "a", 5)]
    return docs, labels


DOCS, LABELS = "doc_id long, text string, score string, predicted long", "doc_id long, quality int, toxic int"


def test_toxicity(spark):
    docs, labels = toxic_corpus()
    frame, told = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)
    model = toxicity.learn(frame, told)
    assert any(s.startswith("zorg") for s in model.lexicon)
    got = toxicity.score(frame, model).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p and t for p, t in held) >= 0.95 * sum(t for _, t in held)
    assert sum(p and not t for p, t in held) <= 0.01 * len(held)
    assert all(not r.predicted for r in got if not (r.text or "").strip())
    again = toxicity.learn(frame.repartition(7), told)
    assert again.lexicon == model.lexicon and np.allclose(again.weights, model.weights)


def test_toxicity_learns_nothing_of_held_out_labels(spark):
    docs, labels = toxic_corpus()
    frame = spark.createDataFrame(docs, DOCS)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, two = (toxicity.learn(frame, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert one.lexicon == two.lexicon and np.allclose(one.weights, two.weights)


def test_toxicity_without_rows_or_labels(spark):
    docs, labels = toxic_corpus()
    none = spark.createDataFrame([], LABELS)
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.score(empty, toxicity.learn(empty, none)).count() == 0
    frame = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id: r.score for r in toxicity.score(frame, toxicity.learn(frame, none)).collect()}
    texts = dict((d[0], d[1]) for d in docs)
    insulted = [i for i, t in texts.items() if t and {"idiot", "scum", "worthless"} & set(t.split())]
    calm = [i for i, t in texts.items() if i not in insulted]
    assert min(got[i] for i in insulted) > max(np.mean([got[i] for i in calm]), 0.05)


def test_label_model_finds_accuracies_and_correlations():
    """Votes drawn from a known model, two of them copies of each other: rates, prior, the tree's edge."""
    rng = np.random.default_rng(2)
    k, n = len(toxicity.NAMES), 40_000
    y = rng.random(n) < 0.15
    rate = np.where(y[:, None], 0.6, 0.03)
    votes = (rng.random((n, k)) < rate).astype(int)
    votes[:, 6:] = 0
    votes[:, 5] = np.where(rng.random(n) < 0.95, votes[:, 4], votes[:, 5])
    codes, at, counts = np.unique(votes @ (1 << np.arange(k)), return_inverse=True, return_counts=True)
    known = np.zeros((len(codes), 2))
    np.add.at(known, (at[:300], y[:300].astype(int)), 1)
    model = toxicity.fit_label_model(toxicity._bits(codes), counts, known)
    assert abs(model.prior - 0.15) < 0.02
    assert model.parents[5] == 4 or model.parents[4] == 5
    assert abs(model.rates[1, 0, 0] - 0.6) < 0.05 and abs(model.rates[0, 0, 0] - 0.03) < 0.02
    q = model.posterior(toxicity._bits(codes))[at]
    assert ((q > 0.5) == y).mean() > 0.96
