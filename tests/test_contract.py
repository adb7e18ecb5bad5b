import pytest
from pyspark.sql import functions as F

from conftest import mixed
from kindred.functions.ids import MIXED_ID, decode_identifier, encode_identifier
from kindred.functions.numbers import holdout_counts
from kindred.functions.text import hash_column, hash_sign, tokens
from kindred.operators.contract import Columns, ContractError, item_catalog, normalize
from kindred.operators.split import Split, dense_index, prepare, split_events, split_integrity


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_type_preserving_ids(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", MIXED_ID)])
    df = spark.createDataFrame([(mixed(x),) for x in ["2", 2, 1, "1"]], schema)
    rows = dense_index(df, "id").orderBy("pos").collect()
    assert [r.id.i if r.id.kind == 0 else r.id.s for r in rows] == [1, 2, "1", "2"]
    back = df.withColumn("back", decode_identifier(encode_identifier(df, "id")))
    assert back.where(F.col("id") != F.col("back")).count() == 0


def test_decode_rejects_bad_forms(spark):
    df = frame(spark, [('{"type":"integer","value":"x"}',), ('{"type":"string","value":""}',),
                       ('{"type":"float","value":1}',)], "e string")
    assert df.where(decode_identifier(F.col("e")).isNotNull()).count() == 0


def test_renamed_columns_and_defaults(spark):
    df = frame(spark, [(1, "a"), (2, "b")], "account long, product string")
    out = normalize(df, Columns("account", "product"))
    assert out.columns == ["user_id", "item_id", "value"]
    assert [r.value for r in out.collect()] == [1.0, 1.0]


@pytest.mark.parametrize("rows,schema,columns,message", [
    ([(1,)], "user_id long", Columns(), "missing"),
    ([(1, 2, 3)], "user_id long, product long, item_id long", Columns(item_id="product"),
     "duplicate"),
    ([(1, 2)], "user_id long, item_id long", Columns(item_id="user_id"), "same source"),
    ([], "user_id long, item_id long", Columns(), "at least one row"),
    ([(1, 2, float("nan"))], "user_id long, item_id long, value double", Columns(value="value"),
     "finite"),
    ([(1, 2, float("inf"))], "user_id long, item_id long, value double", Columns(value="value"),
     "finite"),
    ([(1, 2, None)], "user_id long, item_id long, value double", Columns(value="value"), "finite"),
    ([(1, 2, "not-a-timestamp")], "user_id long, item_id long, timestamp string",
     Columns(timestamp="timestamp"), "timestamps"),
    ([(True, 2)], "user_id boolean, item_id long", Columns(), "string or an integer"),
    ([(1.5, 2)], "user_id double, item_id long", Columns(), "string or an integer"),
    ([("", 2)], "user_id string, item_id long", Columns(), "non-empty"),
    ([(None, 2)], "user_id string, item_id long", Columns(), "non-empty"),
])
def test_contract_errors(spark, rows, schema, columns, message):
    with pytest.raises(ContractError, match=message):
        normalize(frame(spark, rows, schema), columns)


def test_null_timestamp_is_allowed_but_not_for_temporal_splits(spark):
    df = frame(spark, [(1, 2, None, 0)], "user_id long, item_id long, timestamp string, o long")
    out = normalize(df, Columns(timestamp="timestamp"))
    assert out.first().timestamp is None
    with pytest.raises(ContractError, match="every interaction"):
        split_events(out, ["o"], Split("temporal"))


def test_extra_columns_stay_and_last_metadata_wins(spark):
    df = frame(spark, [(1, 7, "old", 0), (2, 7, "new", 1), (1, 8, None, 2)],
               "user_id long, item_id long, tag string, o long")
    events = normalize(df)
    assert "tag" in events.columns
    rows = {r.item_id: r.tag for r in item_catalog(events, ["o"]).collect()}
    assert rows == {7: "new", 8: None}


def loop_rule(n, v_ratio, t_ratio):
    if n < 3:
        return 0, 0
    v = max(1, round(n * v_ratio)) if v_ratio > 0 else 0
    t = max(1, round(n * t_ratio)) if t_ratio > 0 else 0
    while v + t >= n:
        if v >= t and v > 0:
            v -= 1
        else:
            t -= 1
    return v, t


@pytest.mark.parametrize("v,t", [(0.1, 0.2), (0.0, 0.2), (0.3, 0.0), (0.49, 0.5), (0.01, 0.98),
                                 (0.98, 0.01), (0.25, 0.25), (0.0, 0.0), (0.005, 0.99)])
def test_holdout_closed_form(spark, v, t):
    ns = spark.range(1, 201).withColumnRenamed("id", "n")
    a, b = holdout_counts(F.col("n"), v, t)
    for r in ns.select("n", a.alias("v"), b.alias("t")).collect():
        assert (r.v, r.t) == loop_rule(r.n, v, t), r


@pytest.mark.parametrize("split", [Split("temporal", 0.5, 0.5), Split("temporal", -0.1, 0.2),
                                   Split("other", 0.1, 0.2), Split("temporal", 0.1, 1.0)])
def test_bad_split_settings(ring, split):
    with pytest.raises(ContractError):
        split_events(ring, ["row"], split)


def test_ring_temporal_test_rows(ring_prepared):
    rows = ring_prepared.part("test").select("row").orderBy("row").collect()
    assert [r.row for r in rows] == [5, 11, 17, 23, 29]


def test_splits_partition_and_repeat(ring):
    events = normalize(ring, Columns(value="value", timestamp="timestamp"))
    one = split_events(events, ["row"], Split("user_holdout", 0.2, 0.2, 7))
    again = split_events(events.repartition(3), ["row"], Split("user_holdout", 0.2, 0.2, 7))
    assert one.exceptAll(again).isEmpty()
    assert tuple(split_integrity(one, events, ["row"]).first()) == (0, 0, 0)
    other = split_events(events, ["row"], Split("user_holdout", 0.2, 0.2, 8))
    assert not one.exceptAll(other).isEmpty()


def test_few_events_stay_in_training(spark):
    df = frame(spark, [(1, 1, 0), (1, 2, 1)], "user_id long, item_id long, o long")
    p = prepare(normalize(df), ["o"])
    assert [r.split for r in p.events.collect()] == ["train", "train"]


def test_tokens_and_hashes(spark):
    import hashlib
    import re

    texts = ["Red apple, red-ish!", "été À l'école ½ x_1", "", "ПРИВЕТ мир 123"]
    df = frame(spark, [(t,) for t in texts], "t string")
    for r in df.select("t", tokens(F.col("t")).alias("k")).collect():
        assert r.k == re.findall(r"[\w-]+", r.t.lower())
    words = frame(spark, [(w,) for w in ["red", "été", "a" * 50]], "w string")
    for r in words.select("w", hash_column(F.col("w"), 128).alias("c"),
                          hash_sign(F.col("w")).alias("s")).collect():
        d = hashlib.sha256(r.w.encode()).digest()
        assert r.c == int.from_bytes(d[:4], "big") % 128
        assert r.s == (1.0 if d[4] & 1 else -1.0)
