"""Hot groups give the same results as plain windows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kindred.operators import pairs, scoring
from kindred.operators.contract import ContractError
from kindred.operators.pairs import gram
from kindred.operators.positions import chunked, first_free, group_positions, hot_groups
from kindred.operators.sequences import prefix_examples, transitions
from kindred.operators.split import Split, prepare, split_events


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows, one user has a third of them, times repeat."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 97 + 2).alias("user_id"),
        (F.col("id") * 7919 % 211).alias("item_id"),
        F.timestamp_micros((F.col("id") * 31 % 50).cast("bigint")).alias("timestamp"),
        F.lit(1.0).alias("value"), F.col("id").alias("o"),
    ).cache()


def test_hot_positions_equal_plain(skewed):
    order = [F.col("timestamp"), F.col("o")]
    plain = group_positions(skewed, ["user_id"], order, hot=None)
    hot = hot_groups(skewed, ["user_id"], 100)
    assert [r.user_id for r in hot.collect()] == [1]
    split = group_positions(skewed, ["user_id"], order, hot=hot, hot_rows=100)
    assert plain.exceptAll(split).isEmpty() and split.count() == 3000


def test_one_time_for_all_rows_still_spreads(skewed):
    same = skewed.withColumn("timestamp", F.lit(None).cast("timestamp"))
    order = [F.col("timestamp"), F.col("o")]
    plain = group_positions(same, ["user_id"], order, hot=None)
    assert plain.exceptAll(group_positions(same, ["user_id"], order, hot_rows=100)).isEmpty()


def test_global_positions(skewed):
    order = [-F.col("item_id"), F.col("o")]
    small = group_positions(skewed, [], order)
    large = group_positions(skewed, [], order, hot_rows=200)
    assert small.exceptAll(large).isEmpty()


@pytest.mark.parametrize("strategy", ["temporal", "user_holdout"])
def test_hot_split_equals_plain(skewed, strategy):
    s = Split(strategy, 0.1, 0.2)
    plain = split_events(skewed, ["o"], s)
    assert plain.exceptAll(split_events(skewed, ["o"], s, hot_rows=100)).isEmpty()


def test_chunks_see_what_the_whole_group_sees(skewed, monkeypatch):
    placed = group_positions(skewed, ["user_id"], [F.col("o")]).cache()
    whole_t, whole_p = transitions(placed), prefix_examples(placed, 5)
    import kindred.operators.sequences as seq

    monkeypatch.setattr(seq, "chunked", lambda df, g, context: chunked(df, g, context, chunk=13))
    assert whole_t.exceptAll(transitions(placed)).isEmpty()
    assert whole_p.exceptAll(prefix_examples(placed, 5)).isEmpty()
    assert whole_p.count() == placed.where(F.col("pos") > 1).count()


def test_first_free_against_brute_force(spark):
    excluded = spark.createDataFrame(
        [(1, p) for p in (1, 2, 3, 5, 9)] + [(2, p) for p in (4, 7)] + [(4, p) for p in range(1, 11)],
        "request_id long, pos long")
    need = spark.createDataFrame([(1, 4), (2, 3), (3, 2), (4, 5), (5, 0)],
                                 "request_id long, need int")
    got = {}
    for r in first_free(excluded, need, "request_id", 10).collect():
        got.setdefault(r.request_id, []).append(r.pos)
    assert {k: sorted(v) for k, v in got.items()} == {1: [4, 6, 7, 8], 2: [1, 2, 3], 3: [1, 2]}


@pytest.mark.parametrize("cell", [3, 1000])
def test_gram_in_cells(spark, skewed, cell):
    ratings = skewed.groupBy("user_id", "item_id").agg(F.sum("value").alias("w"))
    a, b = ratings.alias("a"), ratings.alias("b")
    want = a.join(b, F.col("a.user_id") == F.col("b.user_id")).where(
        F.col("a.item_id") < F.col("b.item_id")
    ).groupBy(F.col("a.item_id").alias("item"), F.col("b.item_id").alias("other")).agg(
        F.sum(F.col("a.w") * F.col("b.w")).alias("weight"))
    got = gram(ratings, "user_id", "item_id", "w", cell)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def _rows(df):
    return {(r["item"], r["other"]): round(r["weight"], 9) for r in df.collect()}


@pytest.mark.parametrize("hot, cell", [(10**6, 3), (10**6, 1000), (3, 4)])
def test_sums_in_both_directions_travel_once(spark, skewed, monkeypatch, hot, cell):
    monkeypatch.setattr(pairs, "HOT_ITEM", hot)
    monkeypatch.setattr(pairs, "DENSE", 10**6)
    ratings = skewed.groupBy("user_id", "item_id").agg(F.sum("value").alias("w"))
    got = pairs.gram_both(ratings, "user_id", "item_id", "w", cell)
    want = pairs.mirror(gram(ratings, "user_id", "item_id", "w", cell))
    assert _rows(got) == _rows(want) and got.count() == want.count()
    if hot == 10**6:  # ranks and sums need the rows of a pair together, and so do the rows of an item
        plan = pairs.top_neighbours(got, 3)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(item") == 1 and "hashpartitioning(item#" in plan


def test_dense_groups_are_summed_before_they_travel(spark):
    ratings = spark.range(400).selectExpr("id div 4 AS user_id", "id % 4 AS item_id", "1.0D AS w")
    plan = pairs.gram_both(ratings, "user_id", "item_id", "w")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item#" in plan and ", other#" in plan.split("hashpartitioning(item#")[1].split(")")[0]
    missing = ratings.withColumn("item_id", F.when(F.col("item_id") > 0, F.col("item_id")))
    assert _rows(pairs.gram_both(missing, "user_id", "item_id", "w")) == _rows(
        pairs.mirror(gram(missing, "user_id", "item_id", "w")))


def test_history_products_travel_by_request(spark):
    vector = spark.createDataFrame(
        [(1, 1, 2.0), (1, 2, 1.0), (2, 2, 3.0), (2, 3, 0.0), (3, 9, 1.0)], "request_id long, item_id long, value double")
    edges = spark.createDataFrame(
        [(1, 2, 0.5), (1, 3, 0.25), (2, 3, 0.5), (3, 1, 1.0)], "item long, other long, weight double")
    got = scoring.weighted_history(vector, edges)
    want = {(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.5)}
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in scoring.weighted_history(vector, edges, vector).collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "other#" not in "".join(p.split(")")[0] for p in plan.split("hashpartitioning(")[1:])


def test_only_near_positions_are_kept(spark):
    order = spark.range(1, 1001).select(F.col("id").alias("item_id"), F.col("id").alias("pos"))
    taken = spark.range(400).selectExpr("id % 40 AS request_id", "1 + (id * 37) % 1000 AS item_id")
    near = scoring.near_positions([taken, taken], order, 5)
    assert near.count() == taken.where("item_id <= 25").distinct().count()  # 10 rows twice, and 5 free ones
    need = spark.range(40).select(F.col("id").alias("request_id"), F.lit(5).alias("need"))
    whole = first_free(taken.distinct().withColumnRenamed("item_id", "pos"), need, "request_id", 1000)
    part = first_free(near, need, "request_id", 1000)
    assert whole.exceptAll(part).isEmpty() and part.exceptAll(whole).isEmpty()


def test_prepare_reads_its_input_once(spark):
    rows = [(u, i, 1.0, datetime(2024, 1, 1) + timedelta(hours=i), 10 * u + i) for u in range(3) for i in range(5)]
    raw = spark.createDataFrame(rows, "user_id long, item_id long, value double, timestamp timestamp, row long")
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    prepared = prepare(raw.mapInPandas(count, raw.schema), ["row"], Split("temporal", 0.2, 0.2))
    assert prepared.events.count() == 15 and seen.value == 15
    with pytest.raises(ContractError, match=r"row must tell all rows apart \(1 ties\)"):
        prepare(raw.withColumn("row", F.when(F.col("row") > 1, F.col("row"))), ["row"], Split("temporal", 0.2, 0.2))
