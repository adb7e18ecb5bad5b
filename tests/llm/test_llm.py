"""Each operator against a brute-force version on small tables with odd rows."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from kindred.llm import bpe, lines, mixing, neardup, quality, search, secrets, sharding, suffixes, vectors

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 8))) for _ in range(60)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE = [prose(60) for _ in range(6)]
LONG = prose(4000) + "\n" + "=" * 3000
TEXTS = [
    *BASE, BASE[0], BASE[0], BASE[1] + " tail", " ".join(BASE[2].split()[1:]), None, "", " \n\t ", "one two", "one two", "x" * 900,
    "ab" * 500, LONG, "\n".join(BASE[:3]), "\n".join([BASE[0], BASE[1][:-1] + "!", "short", "short", ""]), "日本語 テキスト " * 60, prose(300) + BASE[4] * 2,
]
ROWS = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)] + [(None, BASE[3], None, "s1", 1), (3, BASE[3], "en", "s0", 2), (3, BASE[3], "en", "s0", 2)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def roots(n, links):
    label = list(range(n))
    for _ in range(n):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_near_duplicates(docs, empty):
    def runs(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [runs(r[1]) for r in ROWS]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    label = roots(len(sets), links)
    degree = Counter(x for pair in links for x in pair)
    least = defaultdict(list)
    for i, r in enumerate(ROWS):
        least[label[i]].append(r[0])
    want = sorted(((r[0] is None, r[0] or 0, min((x for x in least[label[i]] if x is not None), default=None), degree[i]) for i, r in enumerate(ROWS)), key=str)
    got = [(r.doc_id is None, r.doc_id or 0, r.class_id, r.n_links) for r in neardup.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == want
    assert neardup.near_duplicates(empty).count() == 0


def test_sketch_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x = rng.integers(0, 2**63, 900).astype(np.uint64)
        a, b = neardup.sketch(x[:800]), neardup.sketch(x[100:])
        shared = len(neardup.survivors(a[None], b[None])[0])
        assert shared == 0 or (a == b).mean() > 0.4
        c = neardup.sketch(np.concatenate([x[:720], x[880:]]))
        assert len(neardup.survivors(a[None], c[None])[0]) == 1


def test_mix(docs, empty):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(ROWS)
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in ROWS]
    assert sorted(got["size"]) == sorted(sizes)
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got.repeats * got["size"]).all()
    by = got.groupby(got.source.fillna("null")).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert abs(by.target.sum() - sum(sizes)) < 1e-6 and (by.target <= 3 * by["size"]).all()
    assert ((by.taken - by.target).abs() <= by.most).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    order = ["doc_id", "source", "size", "taken"]
    assert again[order].sort_values(order).values.tolist() == got[order].sort_values(order).values.tolist() or str(again[order].sort_values(order).values.tolist()) == str(got[order].sort_values(order).values.tolist())
    assert mixing.mix(empty).count() == 0


def test_mix_source_without_words(spark):
    """A source of empty and null texts only takes nothing; the others take what they take without it."""
    rows = [(i, prose(5 + 7 * i), "en", f"t{i % 2}", 1) for i in range(8)]
    bare = [(20, None, "en", "v", 0), (21, "", "en", "v", 0), (22, " \n\t", "en", None, 0)]
    take = lambda data: {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(spark.createDataFrame(data, SCHEMA)).collect()}
    got = take(rows + bare)
    assert got == take(rows) | {r[0]: (0, 0, 0.0, 0) for r in bare}
    assert sum(x[3] for x in got.values()) > 0
    assert take(bare) == {r[0]: (0, 0, 0.0, 0) for r in bare}


def test_sorting_regions_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(8)
    regions = [rng.integers(97, 123, 900).astype(np.uint8).tobytes() for _ in range(300)]
    tracemalloc.start()
    suffixes.repeated_windows(regions)
    peak = tracemalloc.get_traced_memory()[1] / sum(map(len, regions))
    tracemalloc.stop()
    assert peak < 85, peak  # bytes a byte of text


def test_suffix_array_and_windows():
    for _ in range(60):
        k = RNG.choice([1, 2, 3, 200])
        t = np.array([RNG.randint(1, k) for _ in range(RNG.randint(1, 60))] + [0], np.uint16)
        assert suffixes.suffix_array(t, k + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        regions = [bytes(RNG.choice(b"ab\xff") for _ in range(RNG.randint(3, 40))) for _ in range(6)]
        counts = Counter(r[i : i + 5] for r in regions for i in range(len(r) - 4))
        want = [[i for i in range(len(r) - 4) if counts[r[i : i + 5]] > 1] for r in regions]
        assert [x.tolist() for x in suffixes.repeated_windows(regions, 5)] == want


@pytest.mark.parametrize("hot", [4096, 1])
def test_remove_repeats(docs, empty, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    data = [(r[0], (r[1] or "").encode()) for r in ROWS]
    counts = Counter(b[i : i + 400] for _, b in data for i in range(len(b) - 399))
    want = []
    for doc_id, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if counts[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        want.append((doc_id, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffixes.remove_repeats(empty).count() == 0


def test_suffix_tasks_give_their_rows_in_pieces(monkeypatch):
    """What a task makes of a batch is handed on by bytes of text, not batch by batch."""
    monkeypatch.setattr(suffixes, "SHARD", 4_000)
    rng = np.random.default_rng(5)
    texts = [rng.bytes(int(n)) for n in [900] * 12 + [9_000, 10, 400]]
    batch = pd.DataFrame({"key": [bytes([i]) * 16 for i in range(15)], "data": texts})
    parts = list(suffixes._regions(iter([batch, batch.iloc[:0]])))
    assert len(parts) > 3 and max(len(set(p["key"])) for p in parts) <= 5
    rows = [(k, f, n) for p in parts for k, f, n in zip(p["key"], p["first"], p["windows"])]
    whole = [(batch["key"][o], f, n) for o, f, n, *_ in suffixes.regions_of(texts)]
    assert sorted(rows) == sorted(whole)
    ids = pd.DataFrame({"doc_id": range(15), "data": texts, "spans": None, "copied": [i == 12 for i in range(15)]})
    done = list(suffixes._removed(iter([ids])))
    assert len(done) > 3 and pd.concat(done)["n_removed"].tolist() == [9_000 if i == 12 else 0 for i in range(15)]


def test_bpe(docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.FILE), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for frequent in (bpe.FREQUENT, 8):
        for r in bpe.tokenize(docs, P.path(bpe.FILE), frequent).collect():
            ids = own.encode_ordinary(r.text or "")
            assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
            assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.tokenize(empty, P.path(bpe.FILE)).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(size=16) * 0.12 * (i // 12)).tolist()) for i in range(60)]
    rows += [(100, None), (101, []), (102, [0.0] * 16), (103, [float("nan")] * 16), (104, rows[0][1]), (None, rows[1][1]), (105, [None] * 16), (106, [1.0, 2.0])]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for b in range(len(good)) for a in range(b) if len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= 0.95]
    label, degree = roots(len(good), links), Counter(x for pair in links for x in pair)
    for k, (i, _) in enumerate(good):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (degree[k], good[label[k]][0], good[label[k]][0] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (100, 101, 102, 103, 105, 106)) and not got[None].kept
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sharding(docs, empty):
    got = sharding.assign(docs).toPandas()
    assert len(got) == len(ROWS) and sorted(got["size"]) == sorted(len((r[1] or "").encode()) + 8 for r in ROWS)
    assert Counter(got.text_crc32) == Counter(zlib.crc32((r[1] or "").encode()) for r in ROWS)
    for _, shard in got.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    assert sharding.assign(empty).count() == 0


def test_packing_is_even():
    rng = np.random.default_rng(1)
    items = rng.lognormal(size=(5000, 3))
    room = np.tile(items.sum(axis=0) / 24, (24, 1))
    at = sharding.pack(items, room.copy())
    loads = np.array([items[at == s].sum(axis=0) for s in range(24)])
    assert (abs(loads[:, 0] / room[:, 0] - 1) < 0.01).all()


def test_quality_model(spark, empty):
    good = [prose(80) for _ in range(300)]
    bad = [prose(80).upper().replace(" ", "!! ") for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*good, *bad, None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(360)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = quality.score(docs, model).toPandas()
    held = got[got.held_out & (got.doc_id < 360)]
    assert ((held.predicted == 1) == (held.doc_id < 300)).mean() > 0.9 and got.score.between(0, 1).all()
    assert all(bool(h) == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    none = quality.learn(docs, labels.limit(0))
    assert none is None and {r.predicted for r in quality.score(docs, none).collect()} == {1}
    assert quality.learn(empty, labels) is None and quality.score(empty, None).count() == 0


def test_quality_draw(spark):
    rows = spark.range(5000).selectExpr("id doc_id", "if(id % 3 = 0, null, concat('t', id)) text")
    least = lambda n: [r.draw for r in quality._draw(rows.repartition(n), 200).orderBy("draw").limit(200).collect()]
    first = least(3)
    assert len(first) == 200 and first == least(7)
    assert first == [r.draw for r in quality._draw(rows, 10**6).orderBy("draw").limit(200).collect()]


def test_secrets(spark):
    texts = ["password = 'hunter22' Token:abc secret: token = abcdefgh", "AKIA" + "A1" * 9 + " AKIAshort", "é" * 5 + "0123456789abcdef" * 2, None, "", 'API_KEY="a.b-c/d+e="']
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, texts[0]), (None, texts[1])]
    versions = spark.createDataFrame(rows, "path long, text string")
    added, found = secrets.scan(versions)
    assert added.count() == 5  # null is the empty text
    assign = re.compile(secrets.ASSIGN)
    for r in found.select("path", "blob", secrets.written(found["spans"]).alias("s")).collect():
        t = next(x for x in texts if hashlib.sha256((x or "").encode()).digest() == bytes(r.blob)) or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert r.s == ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    more, again = secrets.scan(versions.union(spark.createDataFrame([(20, "secret=newnewnew")], "path long, text string")), added)
    assert more.count() == 1 and again.count() == len(rows) + 1
    assert again.where("size(spans) > 0").count() == found.where("size(spans) > 0").count() + 1


@pytest.mark.parametrize("shard", [search.SHARD, 3])
def test_search(docs, empty, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD", shard)  # with 3, best scores go on over many shards
    words = [Counter(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ROWS]
    n, average = len(ROWS), sum(sum(w.values()) for w in words) / len(ROWS)
    df = Counter(x for w in words for x in w)
    queries = docs.where("doc_id in (0, 8, 13, 18)").selectExpr("doc_id query_id", "text")
    got = defaultdict(list)
    for r in search.search(docs, queries, 5).orderBy("query_id", "place").collect():
        got[r.query_id].append((r.doc_id, r.score))
    for q in (0, 8, 13, 18):
        scores = []
        for r, w in zip(ROWS, words):
            s = sum(c * np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * w[t] * 2.2 / (w[t] + 1.2 * (0.25 + 0.75 * sum(w.values()) / average)) for t, c in words[q].items() if w[t])
            if s:
                scores.append((-round(s, 6), r[0] is None, r[0] or 0))
        want = [(None if null else i, -s) for s, null, i in sorted(scores)[:5]]
        assert [x[0] for x in got[q]] == [x[0] for x in want] and np.allclose([x[1] for x in got[q]], [x[1] for x in want], atol=2e-6)
    assert search.search(empty, queries).count() == 0


def test_search_ties_by_id(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD", 4)
    rows = [(i, "same words here") for i in range(40, 0, -1)] + [(None, "same words here"), (50, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    queries = docs.where("doc_id in (7, 50)").selectExpr("doc_id query_id", "text")
    got = [(r.query_id, r.place, r.doc_id) for r in search.search(docs, queries, 5).orderBy("query_id", "place").collect()]
    assert got == [(7, p, p) for p in range(1, 6)] + [(50, 1, 50)]


@pytest.mark.parametrize("often", [2, 512])
def test_search_scores_many_queries_of_a_shard_at_once(monkeypatch, often):
    """Scores are the sums over all words, bounds are above them, whichever words are columns."""
    monkeypatch.setattr(search, "OFTEN", often)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.5, 30) if x < 200) for _ in range(100)] + [None]
    frame = pd.DataFrame({"shard": 0, "doc_id": np.arange(101), "text": texts})
    row = next(next(search._indexed(iter([frame]))).itertuples())
    terms, blocks, of = search._scorer(row, 20.0)
    counts = [search._counts(t, {}) for t in texts]
    weight = rng.random(len(terms))
    many = 7
    at = [np.searchsorted(terms, counts[q][0]) for q in range(many)]
    bound, scored = of(np.repeat(np.arange(many), [len(a) for a in at]), np.concatenate(at), np.concatenate([weight[a] for a in at]), many)
    total = scored(np.ones((many, blocks), bool))
    for q in range(many):
        for d, (own, tf, length) in enumerate(counts):
            both = np.isin(own, counts[q][0])
            f = tf[both].astype(float)
            want = (weight[np.searchsorted(terms, own[both])] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / 20.0))).sum()
            assert abs(total[q, d] - want) < 1e-9 and bound[q, d // search.BLOCK] >= want - 1e-9
    some = rng.random((many, blocks)) < 0.5
    kept = np.repeat(some, search.BLOCK, axis=1)[:, :101]
    assert np.allclose(scored(some), np.where(kept, total, 0.0))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_and_segments():
    words = ["".join(RNG.choice("abc") for _ in range(RNG.randint(0, 14))) for _ in range(70)]
    arrays = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    i, j = np.triu_indices(len(words), 1)
    for c in (1, 2, 3):
        want = [distance(words[a], words[b]) <= c for a, b in zip(i, j)]
        assert lines.within(arrays, i, j, c).tolist() == want
        keys = [{(t, k, w[a : a + z]) for t, k, a, z in lines.probes(len(w), c)} for w in words]
        assert all(keys[a] & keys[b] for a, b, near in zip(i, j, want) if near and min(len(words[a]), len(words[b])) > c)


def test_dedup_lines(docs, empty):
    places = sorted({(r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest(), k, l) for r in ROWS for k, l in enumerate((r[1] or "").split("\n")) if l})
    distinct = sorted({p[4] for p in places})
    links = [(a, b) for b in range(len(distinct)) for a in range(b) if min(len(distinct[a]), len(distinct[b])) >= 20 and abs(len(distinct[a]) - len(distinct[b])) <= 2 and len(distinct[a]) < 2000 and distance(distinct[a], distinct[b]) <= 2]
    label = dict(zip(distinct, roots(len(distinct), links)))
    seen, gone = set(), set()
    for p in places:
        if label[p[4]] in seen:
            gone.add(p[:4])
        seen.add(label[p[4]])
    for r in lines.dedup_lines(docs.withColumn("gone", docs["doc_id"])).collect():
        key = (r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).digest())
        parts = [] if r.text is None else r.text.split("\n")
        assert r.n_lines == len(parts)
        assert r.kept_text == (None if r.text is None else "\n".join(l for k, l in enumerate(parts) if (*key, k) not in gone))
    assert lines.dedup_lines(empty).count() == 0


def test_pipeline_stages_keep_clean_documents(spark, docs):
    kept = corpus_pipeline.near_copies(spark, docs, "")
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and 6 not in ids and 7 not in ids and {10, 11, 12} <= set(ids)
    assert kept.columns == docs.columns
    assert corpus_pipeline.lines(spark, docs, "").columns == docs.columns
    mixed = corpus_pipeline.mixture(spark, docs, "")
    assert mixed.columns == docs.columns and mixed.count() == mixing.mix(docs).selectExpr("sum(repeats)").first()[0]
    done = corpus_pipeline.tokens(spark, docs, "").where("doc_id = 0").first()
    assert done.decoded_sha256 == hashlib.sha256(BASE[0].encode()).hexdigest()
