"""Null and repeated doc_ids: mixes near their targets, even shards."""

import random

import duckdb
import numpy as np

import corpus_pipeline
from kindred.llm import mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def many(ids):
    """3,000 texts of 50 words in three sources."""
    rng = random.Random(2)
    return [(ids(i), " ".join(f"w{rng.randrange(500)}" for _ in range(50)), "en", "abc"[i % 3], 0) for i in range(3000)]


def test_mix_takes_near_its_targets_whatever_the_ids(spark):
    for ids in (lambda i: None, lambda i: i // 1500, lambda i: i):
        got = mixing.mix(spark.createDataFrame(many(ids), SCHEMA)).toPandas()
        by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
        assert (abs(by.taken - by.target) <= 50).all(), by
        assert (got.taken <= 3 * got["size"]).all()


def test_mix_of_wholly_equal_rows(spark):
    """A third of all rows are one row over and over; the SQL takes as many of them."""
    rows = many(lambda i: i)[:600] + [(7, "same words here", "en", "a", 0)] * 300
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    key = ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(map(tuple, mixing.mix(docs).select(*key).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    want = sorted(con.execute(f"SELECT {', '.join(key)} FROM ({mixing.OP2_SQL})").fetchall())
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    mixed = corpus_pipeline.mixture(spark, docs, "")
    assert mixed.count() == sum(r[4] // r[1] for r in got if r[1])
    assert mixed.where("doc_id = 7 and text = 'same words here'").count() == sum(r[4] // 3 for r in got if r[0] == 7 and r[1] == 3)


def test_shards_are_even_whatever_the_ids(spark):
    rng = random.Random(4)
    words = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(20, 60)))
    equal = words()
    texts = [words() for _ in range(4000)]
    for ids in (lambda i: None, lambda i: 5):
        rows = [(ids(i), equal, "en", "a", 0) for i in range(2000)] + [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
        got = sharding.assign(spark.createDataFrame(rows, SCHEMA).repartition(7)).toPandas()
        by = got.groupby("shard")["size"].sum()
        assert len(by) == 24 and abs(by / by.mean() - 1).max() < 0.02, by.describe()
        for _, shard in got.groupby("shard"):
            assert sorted(shard.slot) == list(range(len(shard)))
    rows = [(i, None, "en", "a", 0) for i in range(3000)] + [(10_000 + i, t, "en", "a", 0) for i, t in enumerate(texts + texts[:2000])]
    got = sharding.assign(spark.createDataFrame(rows, SCHEMA)).toPandas()
    counts, sizes = got.groupby("shard").size(), got.groupby("shard")["size"].sum()
    assert abs(sizes / sizes.mean() - 1).max() < 0.03 and counts.max() < 1.5 * counts.mean() and np.isclose(counts.sum(), 9000)
